"""Provider cards: a provider with its status, facts and specialties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.contact import effective_web
from ..functions.status import flag_counts
from .status import at, provider_status


def newest_flags(flags: DataFrame) -> DataFrame:
    """One row per (provider, flag, source): the newest observation wins."""
    return flags.groupBy("provider_id", "flag", "source").agg(F.max("observed_at").alias("observed_at"))


def flag_summary(flags: DataFrame, as_of) -> DataFrame:
    """All facts of a provider in one aggregation instead of one lookup per fact."""
    counts = flag_counts(F.col("source"), F.col("observed_at"), at(as_of))
    code = F.when(F.col("flag").startswith("ins") & counts, F.substring("flag", 4, 10))
    codes = F.sort_array(F.collect_set(code))
    has = lambda name, extra=F.lit(True): F.bool_or((F.col("flag") == name) & extra)
    return flags.groupBy("provider_id").agg(
        has("self_pay", counts).alias("self_pay"),
        has("english", counts).alias("english"),
        has("english_site").alias("english_site"),
        F.when(F.size(codes) > 0, codes).alias("insurers"),
    )


def specialty_lists(bridge: DataFrame) -> DataFrame:
    """Sorted slugs per provider; there are only as many as tracked specialties."""
    return bridge.groupBy("provider_id").agg(F.sort_array(F.collect_set("specialty_slug")).alias("specialties"))


def provider_cards(providers: DataFrame, bridge: DataFrame, status: DataFrame, flags: DataFrame, as_of) -> DataFrame:
    """Active providers with everything a list shows.

    Every side is grouped or keyed by ``provider_id``, so one hash partitioning serves all joins.
    """
    facts = flag_summary(flags, as_of)
    no = F.lit(False)
    return (
        providers.filter("active")
        .join(specialty_lists(bridge), "provider_id", "left")
        .join(status.select("provider_id", "status", "last_signal_at", "last_source"), "provider_id", "left")
        .join(facts, "provider_id", "left")
        .withColumns(
            {
                "status": F.coalesce("status", F.lit("unknown")),
                "web": effective_web(F.col("web"), F.col("web_found")),
                "self_pay": F.coalesce("self_pay", no),
                "english": F.coalesce("english", no),
                "english_site": F.coalesce("english_site", no),
            }
        )
    )


def of_these(rows: DataFrame, providers: DataFrame) -> DataFrame:
    """Only what belongs to the given providers, before anything is aggregated."""
    return rows.join(providers.select("provider_id"), "provider_id", "left_semi")


def cards_of(providers: DataFrame, bridge: DataFrame, signals: DataFrame, flags: DataFrame, as_of) -> DataFrame:
    """Cards of a few providers: the log and the facts of everybody else are left out first."""
    status = provider_status(of_these(signals, providers), as_of)
    return provider_cards(providers, of_these(bridge, providers), status, of_these(flags, providers), as_of)


def by_specialty(cards: DataFrame) -> DataFrame:
    """One row per (provider, specialty)."""
    return cards.withColumn("specialty", F.explode("specialties"))


def listing(providers: DataFrame, bridge: DataFrame, status: DataFrame) -> DataFrame:
    """The narrow form for counting: (provider, specialty, status) of active providers."""
    return (
        bridge.withColumnRenamed("specialty_slug", "specialty")
        .join(providers.filter("active"), "provider_id")
        .join(status.select("provider_id", "status", "last_signal_at"), "provider_id", "left")
        .withColumn("status", F.coalesce("status", F.lit("unknown")))
    )
