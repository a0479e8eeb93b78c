"""Small derived columns the lists and reports show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V
from .status import lookup
from .text import slugify_web


def place_label(city: Column, slug: Column, district: Column) -> Column:
    """Name the district when the town shares its name with a bigger one."""
    return F.when(
        district.isNotNull() & (slug != slugify_web(city)), F.concat(city, F.lit(" (okres "), district, F.lit(")"))
    ).otherwise(city)


def short_label(city: Column) -> Column:
    return F.regexp_replace(city, r" \(okres .*\)$", "")


def address(street: Column, house_no: Column, city: Column, postcode: Column) -> Column:
    """One line; unbreakable spaces keep postcode, town and district number together."""
    nothing = lambda c: F.nullif(c, F.lit(""))
    line = F.concat_ws(" ", nothing(street), nothing(house_no))
    code = F.regexp_replace(nothing(postcode), r"^(\d{3})(\d{2})$", "$1 $2")
    town = F.regexp_replace(nothing(city), r" (\d+)$", " $1")
    return F.concat_ws(", ", nothing(line), nothing(F.concat_ws(" ", code, town)))


def ago(at: Column, as_of: Column) -> Column:
    """struct<n,unit>: 0/'today', whole days up to 44, then months (n counts backwards in time)."""
    days = F.floor((F.unix_micros(at) - F.unix_micros(as_of)) / F.lit(86_400_000_000.0) + F.lit(0.5))
    return (
        F.when(at.isNull(), F.lit(None))
        .when(days > -1, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit("today").alias("unit")))
        .when(days > -45, F.struct(days.cast("bigint").alias("n"), F.lit("day").alias("unit")))
        .otherwise(F.struct(F.floor(days / 30 + F.lit(0.5)).cast("bigint").alias("n"), F.lit("month").alias("unit")))
    )


def insurers_short(codes: Column, everybody: str = "všechny pojišťovny") -> Column:
    """Names joined by dots, one phrase when all are there, NULL when none."""
    names = F.transform(codes, lambda c: F.coalesce(lookup(c, V.INSURER_NAMES), c))
    return F.when(F.size(codes) == len(V.INSURER_NAMES), F.lit(everybody)).when(
        F.size(codes) > 0, F.array_join(names, " · ")
    )


def share_pct(part: Column, of: Column) -> Column:
    return F.when(of != 0, F.lit(100.0) * part / of).otherwise(F.lit(0.0))


def colour_bucket(share: Column) -> Column:
    """Map shade 4 (most) to 0 (nobody known)."""
    return F.when(share >= 10, 4).when(share >= 5, 3).when(share >= 2, 2).when(share >= 0.0001, 1).otherwise(0)


def is_prague(slug: Column) -> Column:
    return slug.rlike(V.PRAGUE_SLUG)


def natural_order(place: Column) -> list[Column]:
    """Czech alphabet, numbers at the end compared as numbers."""
    return [
        F.collate(F.regexp_replace(F.lower(place), r"\s*\d+$", ""), "cs_CI"),
        F.regexp_extract(place, r"(\d+)$", 1).try_cast("int").asc_nulls_first(),
        place,
    ]
