"""Weights, ranks and the status decision."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V


def lookup(c: Column, table: dict) -> Column:
    """Constant map as an expression; NULL for unknown keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), c)


def source_weight(source: Column) -> Column:
    return lookup(source, V.SOURCE_WEIGHTS)


def status_value(status: Column) -> Column:
    return F.coalesce(lookup(status, V.STATUS_VALUES), F.lit(-1.0))


def micros(days: float = 0, hours: float = 0) -> int:
    return int((days * 24 + hours) * 3600 * 1_000_000)


def decay(age_seconds: Column, half_life_days: float = V.HALF_LIFE_DAYS) -> Column:
    return F.pow(F.lit(0.5), age_seconds / F.lit(86400.0 * half_life_days))


def rank_cli(status: Column) -> Column:
    """Order of the command-line search: waiting list ties with not accepting."""
    return F.coalesce(lookup(status, V.RANK_CLI), F.lit(3))


def rank_web(status: Column) -> Column:
    """Order of the site's lists: waiting list right after accepting."""
    return F.coalesce(lookup(status, V.RANK_WEB), F.lit(4))


def classify(confidence: Column, score: Column, clinic: Column) -> Column:
    """Status from unrounded numbers; the practice's own fresh word wins."""
    return (
        F.when(clinic.isNotNull(), clinic)
        .when(confidence < V.MIN_CONFIDENCE, F.lit("unknown"))
        .when(score >= V.CLEAR_SCORE, F.lit("accepting"))
        .when(score <= -V.CLEAR_SCORE, F.lit("not_accepting"))
        .otherwise(F.lit("mixed"))
    )


STATUS_GROUPS = {"accepting": ["accepting", "waitlist"], "unknown": ["unknown", "mixed"]}


def in_group(status: Column, english: Column, group: str) -> Column:
    """The list filters a visitor can pick."""
    if group == "english":
        return english
    return status.isin(STATUS_GROUPS.get(group, [group]))


def flag_counts(source: Column, observed_at: Column, as_of: Column, years: int = V.FLAG_YEARS) -> Column:
    """A visitor's fact is believed for a year, a practice's or website's until replaced."""
    return (source != "user") | (observed_at > as_of - F.make_interval(F.lit(years)))
