"""Care-capacity analytics as Spark DataFrame jobs."""
