"""Operators for training-data work; nothing outside this package imports it."""
