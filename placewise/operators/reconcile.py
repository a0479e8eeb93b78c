"""From what sites say to the signal log and the fact table; which sites to read at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import values as V
from ..functions.contact import effective_web, error_kind, normalize_site
from .evidence import attributable, crawl_summary, fits_specialty
from .status import at, days


# ------------------------------------------------------------------------------- targets
def sites_listed(providers: DataFrame, bridge: DataFrame, town_regex: str, specialties: list[str] | None = None) -> DataFrame:
    """Active practices with a website in the chosen towns and fields."""
    wanted = bridge.filter(F.col("specialty_slug").isin(specialties)) if specialties else bridge
    fields = bridge.groupBy("provider_id").agg(F.count("*").alias("n_spec"))
    return (
        providers.withColumn("web", effective_web(F.col("web"), F.col("web_found")))
        .filter(F.col("active") & F.col("web").isNotNull() & F.col("city_slug").rlike(town_regex))
        .join(wanted.select("provider_id"), "provider_id", "left_semi")
        .join(fields, "provider_id")
        .select("provider_id", "web", "name", "facility_type", "n_spec")
    )


def big_facility(n_spec: Column, facility_type: Column, name: Column) -> Column:
    """One register entry for many departments: what its site says fits none of them."""
    label = F.concat(F.coalesce(facility_type, F.lit("")), F.lit(" "), F.coalesce(name, F.lit("")))
    return (n_spec >= V.MAX_SPECIALTIES_PER_PLACE) | label.rlike(f"(?iu){V.BIG_FACILITY}")


def site_groups(listed: DataFrame, most: int = V.MAX_PRACTICES_PER_SITE) -> DataFrame:
    """Comparable site -> its practices; sites of more than ``most`` practices are left out.

    Only ``most + 1`` practices of a site ever reach the grouping: that is enough to tell that
    there are too many, so a chain's homepage cannot fill a task.
    """
    sites = listed.select("provider_id", normalize_site(F.col("web")).alias("site")).filter(F.col("site").isNotNull())
    first = W.partitionBy("site").orderBy("provider_id")
    few = sites.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= most + 1)
    groups = few.groupBy("site").agg(F.sort_array(F.collect_list("provider_id")).alias("provider_ids"))
    return groups.filter(F.size("provider_ids") <= most)


def crawl_targets(providers: DataFrame, bridge: DataFrame, town_regex: str, specialties: list[str] | None = None) -> DataFrame:
    listed = sites_listed(providers, bridge, town_regex, specialties)
    small = listed.filter(~big_facility(F.col("n_spec"), F.col("facility_type"), F.col("name")))
    return site_groups(small)


def dropped_providers(listed: DataFrame, targets: DataFrame) -> DataFrame:
    """Practices that list a site which is not read any more."""
    checked = targets.select(F.explode("provider_ids").alias("provider_id"))
    return listed.select("provider_id").join(checked, "provider_id", "left_anti")


def forget_dropped(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Signals or facts without what was read on sites no longer checked."""
    old = rows.join(dropped, "provider_id", "left_semi").filter(F.col("source") == "web_crawl")
    key = [c for c in ("signal_id",) if c in rows.columns] or ["provider_id", "flag", "source"]
    return rows.join(old.select(*key), key, "left_anti")


# ------------------------------------------------------------------------------- signals
def crawl_note(snippet: Column, page_url: Column) -> Column:
    return F.substring(F.concat(F.lit("„"), F.substring(snippet, 1, 300), F.lit("“ — "), page_url), 1, 500)


def decide(results: DataFrame, signals: DataFrame, specialties: DataFrame, as_of) -> DataFrame:
    """One action per practice: keep, delete, refresh or insert.

    ``results``: (provider_id, status, scope, snippet, page_url, error). A site that failed to
    load changes nothing; one that says nothing, or speaks of someone else, removes what was read
    there before; a repeated verdict refreshes its note, a new one is added.
    """
    recent = (
        signals.filter((F.col("source") == "web_crawl") & (F.col("observed_at") > at(as_of) - days(V.RECHECK_DAYS)))
        .select("provider_id", "status").distinct().withColumn("seen", F.lit(True))
    )
    fields = F.coalesce("specialties", F.array().cast("array<string>"))
    judged = (
        results.join(specialties, "provider_id", "left")
        .withColumn("mine", attributable(F.col("snippet"), fields))
        .join(recent, ["provider_id", "status"], "left")
    )
    action = (
        F.when(F.col("error").isNotNull(), "keep").when(F.col("status").isNull(), "delete").when(~F.col("mine"), "delete")
        .when(F.col("seen"), "refresh").otherwise("insert")
    )
    return judged.select(
        "provider_id", "status", "scope", crawl_note(F.col("snippet"), F.col("page_url")).alias("note"), action.alias("action")
    )


def apply_decisions(signals: DataFrame, decisions: DataFrame, as_of) -> DataFrame:
    """The signal log after a crawl; running it again changes nothing."""
    d = decisions.filter(F.col("action") != "keep").select(
        "provider_id", F.col("status").alias("new_status"), F.col("scope").alias("new_scope"), F.col("note").alias("new_note"), "action"
    )
    crawled = F.col("source") == "web_crawl"
    fresh = crawled & (F.col("action") == "refresh") & (F.col("status") == F.col("new_status")) & (
        F.col("observed_at") > at(as_of) - days(V.RECHECK_DAYS)
    )
    kept = (
        signals.join(d, "provider_id", "left")
        .filter(~(crawled & F.coalesce(F.col("action") == "delete", F.lit(False))))
        .withColumns(
            {
                "note": F.when(fresh, F.col("new_note")).otherwise(F.col("note")),
                "scope": F.when(fresh, F.col("new_scope")).otherwise(F.col("scope")),
            }
        )
        .select(*signals.columns)
    )
    now = at(as_of)
    added = decisions.filter(F.col("action") == "insert").select(
        F.xxhash64("provider_id", "status", now).alias("signal_id"), "provider_id", F.lit("web_crawl").alias("source"), "status",
        F.coalesce("scope", F.lit("all")).alias("scope"), now.alias("observed_at"), "note", now.alias("created_at"),
    )
    return kept.unionByName(added, allowMissingColumns=True)


def new_verdicts(results: DataFrame, signals: DataFrame, as_of) -> DataFrame:
    """Verdicts that do not repeat one of the last days (the rest only refresh their note)."""
    recent = signals.filter((F.col("source") == "web_crawl") & (F.col("observed_at") > at(as_of) - days(V.RECHECK_DAYS)))
    said = results.filter(F.col("error").isNull() & F.col("status").isNotNull())
    return said.join(recent.select("provider_id", "status"), ["provider_id", "status"], "left_anti")


def mark_checked(providers: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """When each practice's site was last looked at, and what went wrong then; others keep what they had."""
    seen = results.groupBy("provider_id").agg(F.lit(True).alias("checked"), F.max("error").alias("new_error"))
    before = lambda name, kind: F.col(name) if name in providers.columns else F.lit(None).cast(kind)
    return (
        providers.join(seen, "provider_id", "left")
        .withColumns(
            {
                "web_checked_at": F.when(F.col("checked"), at(as_of)).otherwise(before("web_checked_at", "timestamp")),
                "web_check_error": F.when(F.col("checked"), F.col("new_error")).otherwise(before("web_check_error", "string")),
            }
        )
        .drop("checked", "new_error")
    )


def run_summary(results: DataFrame, found: DataFrame) -> DataFrame:
    """(part, name, n): outcomes of a run, practices by fact found, and kinds of errors."""
    part = lambda name: F.lit(name).alias("part")
    outcomes = crawl_summary(results).select(part("outcome"), F.col("outcome").alias("name"), "n")
    facts = found.groupBy(F.col("flag").alias("name")).agg(F.count("*").alias("n")).select(part("fact"), "name", "n")
    failed = results.filter(F.col("error").isNotNull()).groupBy(error_kind(F.col("error")).alias("name")).agg(F.count("*").alias("n"))
    return outcomes.unionByName(facts).unionByName(failed.select(part("error"), "name", "n"))


# ------------------------------------------------------------------------------- facts
def found_flags(site_flags: DataFrame, results: DataFrame, specialties: DataFrame) -> DataFrame:
    """(provider_id, flag, note): facts of loaded sites that fit the practice."""
    loaded = results.filter(F.col("error").isNull()).select("provider_id", "site", "page_url")
    fields = F.coalesce("specialties", F.array().cast("array<string>"))
    return (
        loaded.join(site_flags, "site")
        .join(specialties, "provider_id", "left")
        .filter(fits_specialty(F.col("snippet"), fields))
        .select("provider_id", "flag", crawl_note(F.col("snippet"), F.coalesce("page_url", "site")).alias("note"))
    )


def reconcile_flags(flags: DataFrame, found: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """The fact table after a crawl: found facts are renewed, facts no longer stated go."""
    loaded = results.filter(F.col("error").isNull()).select("provider_id").distinct()
    read_before = flags.filter(F.col("source") == "web_crawl").join(loaded, "provider_id", "left_semi")
    kept = flags.join(read_before.select("provider_id", "flag", "source"), ["provider_id", "flag", "source"], "left_anti")
    cols = [c for c in ("provider_id", "flag", "source", "note", "observed_at") if c in flags.columns or c == "note"]
    kept = kept if "note" in kept.columns else kept.withColumn("note", F.lit(None).cast("string"))
    new = found.select(
        "provider_id", "flag", F.lit("web_crawl").alias("source"), "note", at(as_of).alias("observed_at")
    )
    return kept.select(*cols).unionByName(new.select(*cols))


def stale_flags(flags: DataFrame, found: DataFrame, results: DataFrame) -> DataFrame:
    """Facts read earlier that the site does not state any more."""
    loaded = results.filter(F.col("error").isNull()).select("provider_id")
    known = flags.filter(F.col("source") == "web_crawl").join(loaded, "provider_id", "left_semi")
    return known.select("provider_id", "flag").join(found.select("provider_id", "flag"), ["provider_id", "flag"], "left_anti")
