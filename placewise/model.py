"""Domain schemas and the row rules they must satisfy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import values as V

PROVIDER_SCHEMA = T.StructType(
    [T.StructField("provider_id", T.LongType()), T.StructField("place_id", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in ("facility_id", "ico", "name", "facility_type", "street", "house_no", "city", "city_slug", "postcode", "district", "region")]
    + [T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("phone", "email", "web", "care_form", "raw_specialties")]
    + [
        T.StructField("active", T.BooleanType()),
        T.StructField("first_seen_at", T.TimestampType()),
        T.StructField("last_seen_at", T.TimestampType()),
        T.StructField("web_checked_at", T.TimestampType()),
        T.StructField("web_check_error", T.StringType()),
        T.StructField("web_found", T.StringType()),
        T.StructField("web_found_source", T.StringType()),
        T.StructField("web_suggested", T.StringType()),
        T.StructField("web_search_at", T.TimestampType()),
    ]
)
SIGNAL_SCHEMA = T.StructType(
    [
        T.StructField("signal_id", T.LongType()),
        T.StructField("provider_id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("observed_at", T.TimestampType()),
        T.StructField("note", T.StringType()),
        T.StructField("reporter_hash", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# What each stored table promises; the names appear in the quarantine output.
RULES: dict[str, dict[str, callable]] = {
    "providers": {"coords_together": lambda: F.col("lat").isNull() == F.col("lng").isNull()},
    "signals": {
        "status_known": lambda: F.col("status").isin(V.STATUSES),
        "source_known": lambda: F.col("source").isin(list(V.SOURCE_WEIGHTS)),
        "scope_known": lambda: F.col("scope").isin(V.SCOPES),
        "note_length": lambda: F.length("note") <= 500,
    },
    "flags": {
        "flag_known": lambda: F.col("flag").isin(V.FLAGS),
        "source_known": lambda: F.col("source").isin(list(V.SOURCE_WEIGHTS)),
        "note_length": lambda: F.length("note") <= 500,
    },
    "subscriptions": {"radius_range": lambda: F.col("radius_km").between(1, 100)},
    "mail_log": {"kind_known": lambda: F.col("kind").isin("confirm", "alert")},
    "sponsored": {
        "tagline_length": lambda: F.length("tagline") <= 140,
        "interval_order": lambda: F.col("ends_on") >= F.col("starts_on"),
    },
}


def violations(table: str) -> Column:
    """Names of the broken rules. A rule that evaluates to NULL holds, as in a table CHECK."""
    return F.array_compact(
        F.array(*[F.when(~rule(), F.lit(name)) for name, rule in RULES[table].items()])
    )


def check(df: DataFrame, table: str) -> DataFrame:
    return df.withColumn("violations", violations(table))


def split_valid(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(rows that keep every rule, quarantined rows with the names of the broken ones)"""
    checked = check(df, table)
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)
