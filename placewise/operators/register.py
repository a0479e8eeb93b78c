"""The register: dirty rows -> one row per place -> the next snapshot."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as T
from ..functions.geo import parse_coords
from ..functions.status import lookup
from ..session import cut_lineage
from .order import numbered
from .status import at

ATTRIBUTES = [
    "name", "facility_id", "ico", "facility_type", "street", "house_no", "city", "city_slug", "postcode", "district",
    "region", "lat", "lng", "phone", "email", "web", "care_form",
]
# What is worked out once a place has its row, and the texts it is worked out from.
DERIVED = ["city_slug", "postcode", "lat", "lng"]
GIVEN = [c for c in ATTRIBUTES if c not in DERIVED] + ["postcode_text", "lat_text", "lng_text", "gps"]
CARRIED = [
    "first_seen_at", "web_checked_at", "web_check_error", "web_found", "web_found_source", "web_suggested", "web_search_at",
]


def label_rules(spark) -> DataFrame:
    """Register label -> specialty, derived from the one list of specialties."""
    return spark.createDataFrame(
        [(label, slug) for slug, _, labels in V.SPECIALTIES for label in labels], "label string, specialty_slug string"
    )


def specialty_dim(spark) -> DataFrame:
    return spark.createDataFrame(V.SPECIALTIES, "slug string, name_cs string, labels array<string>")


def _mentions(c: Column, needles: list[str]) -> Column:
    return c.rlike("|".join(re.escape(n) for n in needles))


def _slugs(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def closed_name(name: Column) -> Column:
    """A care home's, shelter's or company's own doctor."""
    return name.rlike(f"(?iu){V.CLOSED_NAMES}")


def specialties_col(raw: Column, care_form: Column, facility_type: Column) -> Column:
    """Tracked specialties of one register row as a sorted array."""
    rules = {label: slug for slug, _, labels in V.SPECIALTIES for label in labels}
    labels = F.split(F.coalesce(raw, F.lit("")), "[,;|]")
    tracked = F.array_sort(F.array_distinct(F.array_compact(F.transform(labels, lambda x: lookup(F.lower(T.strip(x)), rules)))))
    inpatient = (F.coalesce(care_form, F.lit("")) != "") & ~F.lower(care_form).contains(V.OUTPATIENT_WORD)
    seen = lambda found: F.when(inpatient, F.array_except(found, _slugs(V.SPECIALISTS))).otherwise(found)

    def open_to_public(x: Column) -> Column:
        kind, found = x["kind"], x["found"]
        out = F.when(_mentions(kind, V.CLOSED_FACILITIES), F.array().cast("array<string>"))
        for own_practice, keep in V.SINGLE_KIND:
            out = out.when(kind.contains(own_practice), F.array_intersect(found, _slugs(keep)))
        return out.when(_mentions(kind, V.PSYCHIATRY_ONLY), F.array_intersect(found, _slugs(["psychiatr"]))).otherwise(found)

    kind = F.lower(F.coalesce(facility_type, F.lit("")))
    given = T.let(tracked, lambda found: F.struct(kind.alias("kind"), seen(found).alias("found")))
    return T.let(given, lambda x: F.when(F.size(x["found"]) > 0, open_to_public(x)).otherwise(x["found"]))


def place_key(place_id: Column, facility_id: Column, ico: Column, name: Column, city: Column, street: Column, house_no: Column) -> Column:
    """The register's own id, or facility and address where an export has none."""
    who = F.coalesce(facility_id, ico, name)
    return F.coalesce(place_id, F.concat_ws("|", who, city, street, house_no))


def parse_rows(rows: DataFrame, order: Column) -> DataFrame:
    """Typed rows of a bound register: (place_id, ord, raw, specialties, attributes)."""
    have = set(rows.columns)
    field = lambda n: T.clean(F.col(n)) if n in have else F.lit(None).cast("string")
    cleaned = rows.select(order.alias("ord"), *[field(n).alias(n) for n in V.FIELD_ALIASES]).filter(F.col("name").isNotNull())
    raw = F.when(closed_name(F.col("name")), F.lit("")).otherwise(F.coalesce("specialties", F.lit("")))
    return cleaned.withColumns(
        {
            "place_id": place_key(*[F.col(c) for c in ("place_id", "facility_id", "ico", "name", "city", "street", "house_no")]),
            "raw": raw,
            "specialties": specialties_col(raw, F.col("care_form"), F.col("facility_type")),
            "at": parse_coords(F.col("lat"), F.col("lng"), F.col("gps")),
            "postcode": T.postcode(F.col("postcode")),
            "city_slug": T.slugify(F.col("city")),
            **{f"{c}_text": F.col(c) for c in ("postcode", "lat", "lng")},
        }
    ).withColumns({"lat": F.col("at.lat"), "lng": F.col("at.lng")})


def with_derived(places: DataFrame) -> DataFrame:
    """Slug, postcode and coordinates from the texts of the row that a place keeps."""
    at_ = parse_coords(F.col("lat_text"), F.col("lng_text"), F.col("gps"))
    worked_out = places.withColumns({"at": at_, "postcode": T.postcode(F.col("postcode_text")), "city_slug": T.slugify(F.col("city"))})
    worked_out = worked_out.withColumns({"lat": F.col("at.lat"), "lng": F.col("at.lng")})
    return worked_out.select("place_id", *ATTRIBUTES, "specialties", "raw_specialties")


def merge_places(parsed: DataFrame, only_tracked: bool = True) -> DataFrame:
    """One row per place: the first row's attributes, all rows' specialties, labels in order.

    Rows are first reduced per (place, label text) on the map side, so even a place with a large
    share of the file reaches the second grouping as a few rows, one per distinct label text.
    Texts are only folded and parsed for the row that a place keeps.
    """
    first = F.struct("ord", *GIVEN)
    labels = parsed.groupBy("place_id", "raw").agg(
        F.min_by(first, "ord").alias("first"),
        F.array_distinct(F.flatten(F.collect_set("specialties"))).alias("specialties"),
    )
    seen = F.struct(F.col("first.ord").alias("ord"), F.col("raw"))
    merged = labels.groupBy("place_id").agg(
        F.min_by("first", F.col("first.ord")).alias("first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("specialties")))).alias("specialties"),
        F.sort_array(F.collect_list(F.when(F.col("raw") != "", seen))).alias("labels"),
    )
    merged = merged.select(
        "place_id", *[F.col(f"first.{c}").alias(c) for c in GIVEN], "specialties",
        F.array_join(F.transform("labels", lambda s: s["raw"]), ", ").alias("raw_specialties"),
    )
    return with_derived(merged.filter(F.size("specialties") > 0) if only_tracked else merged)


def slug_district_counts(places: DataFrame) -> DataFrame:
    return (
        places.filter(F.col("city_slug").isNotNull() & F.col("district").isNotNull())
        .groupBy("city_slug", "district")
        .agg(F.count("*").alias("n"))
    )


def disambiguate_slugs(places: DataFrame) -> DataFrame:
    """Towns of one name: the district with most places keeps the plain slug."""
    shared = (
        slug_district_counts(places)
        .groupBy("city_slug")
        .agg(F.max_by("district", F.struct("n", "district")).alias("main"), F.count("*").alias("districts"))
        .filter(F.col("districts") > 1)
        .select("city_slug", "main")
    )
    other = F.col("district") != F.col("main")
    suffixed = F.concat_ws("-", "city_slug", T.slugify(F.col("district")))
    return (
        places.join(shared, "city_slug", "left")
        .withColumn("city_slug", F.when(other, suffixed).otherwise(F.col("city_slug")))
        .drop("main")
    )


def places_from_rows(rows: DataFrame, order: Column, only_tracked: bool = True) -> DataFrame:
    """Register rows to places. The merged places, one short row each, are kept: the slugs and the
    next snapshot read them several times, and the raw rows should be parsed once."""
    return disambiguate_slugs(cut_lineage(merge_places(parse_rows(rows, order), only_tracked)))


def bridge_of(places: DataFrame) -> DataFrame:
    return places.select("place_id", F.explode("specialties").alias("specialty_slug"))


# ------------------------------------------------------------------------------- summaries
def label_profile(rows: DataFrame, top: int = 40) -> DataFrame:
    """Most frequent labels of a file, marked when tracked."""
    rules = label_rules(rows.sparkSession)
    labels = rows.select(F.explode(F.split(F.coalesce("specialties", F.lit("")), ",")).alias("label"))
    counts = (
        labels.select(F.lower(T.strip(F.col("label"))).alias("label")).filter(F.col("label") != "").groupBy("label").agg(F.count("*").alias("n"))
    )
    return counts.orderBy(F.col("n").desc(), "label").limit(top).join(F.broadcast(rules), "label", "left")


def import_summary(places: DataFrame) -> DataFrame:
    return (
        places.select(F.explode("specialties").alias("specialty"), "lat")
        .groupBy("specialty")
        .agg(F.count("*").alias("places"), F.count_if(F.col("lat").isNull()).alias("without_gps"))
    )


# ------------------------------------------------------------------------------- snapshot
def _import_counts(prev: DataFrame, new: DataFrame) -> tuple[Column, Column]:
    """(active places before, places in the new file) as scalar subqueries."""
    return (
        prev.filter("active").agg(F.count("*")).scalar(),
        new.agg(F.count("*")).scalar(),
    )


def truncated(prev: DataFrame, new: DataFrame, min_ratio: float = V.MIN_IMPORT_RATIO) -> Column:
    """True when the new file is so short that missing places must not be closed."""
    before, n_new = _import_counts(prev, new)
    return (before > 0) & (n_new < F.lit(min_ratio) * before)


def upsert(prev: DataFrame, new: DataFrame, as_of, min_ratio: float = V.MIN_IMPORT_RATIO) -> DataFrame:
    """The next snapshot: listed places are (re)opened and refreshed, missing ones close.

    One full outer join on the natural key; ids, first-seen times and web findings stay. New places
    get the ids after the highest one, in the order of their keys.
    """
    highest = prev.agg(F.coalesce(F.max("provider_id"), F.lit(0)).alias("m")).scalar()
    unseen = numbered(new.select("place_id").join(prev.select("place_id"), "place_id", "left_anti"), F.col("place_id"), name="new_id")
    fresh = new.select("place_id", *ATTRIBUTES, "raw_specialties", F.lit(True).alias("listed")).join(unseen, "place_id", "left")
    skip = truncated(prev, new, min_ratio)
    listed = F.coalesce(F.col("n.listed"), F.lit(False))
    pick = lambda c: F.when(listed, F.col(f"n.{c}")).otherwise(F.col(f"p.{c}")).alias(c)
    key = F.coalesce(F.col("p.place_id"), F.col("n.place_id"))
    return (
        prev.alias("p")
        .join(fresh.alias("n"), F.col("p.place_id") == F.col("n.place_id"), "full")
        .select(
            F.coalesce(F.col("p.provider_id"), highest + F.col("n.new_id")).alias("provider_id"),
            key.alias("place_id"),
            *[pick(c) for c in ATTRIBUTES + ["raw_specialties"]],
            F.when(listed, True).otherwise(F.col("p.active") & skip).alias("active"),
            F.when(listed, at(as_of)).otherwise(F.col("p.last_seen_at")).alias("last_seen_at"),
            F.coalesce(F.col("p.first_seen_at"), at(as_of)).alias("first_seen_at"),
            *[F.col(f"p.{c}").alias(c) for c in CARRIED if c != "first_seen_at"],
        )
    )


def replace_bridge(prev_bridge: DataFrame, new: DataFrame) -> DataFrame:
    """Specialties of listed places are replaced, those of missing places kept."""
    kept = prev_bridge.join(new.select("place_id"), "place_id", "left_anti")
    return kept.select("place_id", "specialty_slug").unionByName(bridge_of(new)).distinct()


def missing_places(prev: DataFrame, new: DataFrame) -> DataFrame:
    """Active places that the new file does not list."""
    return prev.filter("active").join(new.select("place_id"), "place_id", "left_anti")


def import_stats(prev: DataFrame, new: DataFrame, min_ratio: float = V.MIN_IMPORT_RATIO) -> DataFrame:
    """One row: upserted, new, deactivated, skipped. One pass over the joined keys."""
    keys = (
        prev.select("place_id", F.col("active").alias("was_active"))
        .join(new.select("place_id", F.lit(True).alias("listed")), "place_id", "full")
    )
    listed, old = F.col("listed").isNotNull(), F.col("was_active").isNotNull()
    n = keys.agg(
        F.count_if(listed).alias("upserted"), F.count_if(listed & ~old).alias("new"),
        F.count_if(F.col("was_active") & ~listed).alias("gone"), F.count_if(F.col("was_active")).alias("before"),
    )
    skip = (F.col("before") > 0) & (F.col("upserted") < F.lit(min_ratio) * F.col("before"))
    return n.select(
        "upserted", "new", F.when(skip, F.lit(0).cast("bigint")).otherwise(F.col("gone")).alias("deactivated"),
        skip.alias("skipped_deactivation"),
    )


def apply_register(prev: DataFrame, prev_bridge: DataFrame, new: DataFrame, as_of, min_ratio: float = V.MIN_IMPORT_RATIO):
    """(snapshot, bridge, stats) after importing ``new``."""
    return upsert(prev, new, as_of, min_ratio), replace_bridge(prev_bridge, new), import_stats(prev, new, min_ratio)
