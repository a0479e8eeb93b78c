"""Time-decayed availability status per provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions import status as S


def at(as_of) -> Column:
    """The moment a job looks at, as a Column."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def days(n: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(int(n * 24)))


def hours(n: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(int(n)))


def in_window(observed_at: Column, as_of, horizon_days: float = V.HORIZON_DAYS) -> Column:
    """Not older than the horizon, at most an hour ahead of the clock."""
    now = at(as_of)
    return (observed_at > now - days(horizon_days)) & (observed_at <= now + hours(V.FUTURE_HOURS))


def weigh(signals: DataFrame, as_of, half_life_days: float = V.HALF_LIFE_DAYS) -> DataFrame:
    """Weight ``w`` and value ``v`` of every signal; age counts in fractions of a day."""
    age = (F.unix_micros(at(as_of)) - F.unix_micros("observed_at")) / F.lit(1e6)
    return signals.withColumns(
        {"w": S.source_weight(F.col("source")) * S.decay(age, half_life_days), "v": S.status_value(F.col("status"))}
    )


def provider_status(
    signals: DataFrame,
    as_of,
    half_life_days: float = V.HALF_LIFE_DAYS,
    horizon_days: float = V.HORIZON_DAYS,
    clinic_days: float = V.CLINIC_DAYS,
) -> DataFrame:
    """One row per provider with a signal inside the window.

    A single hash aggregation: every part (sums, newest row, the practice's own newest word)
    combines on the map side, so a provider holding a large share of the log stays one small
    partial row per task.
    """
    own_word = (F.col("source") == "clinic") & (F.col("observed_at") > at(as_of) - days(clinic_days))
    recent = signals.select("signal_id", "provider_id", "source", "status", "observed_at").filter(
        in_window(F.col("observed_at"), as_of, horizon_days)
    )
    key = _age_key()
    sums = (
        weigh(recent, as_of, half_life_days)
        .groupBy("provider_id")
        .agg(
            F.sum("w").alias("confidence"),
            (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("score"),
            F.max("observed_at").alias("last_signal_at"),
            F.max(key).alias("newest"),
            F.max(F.when(own_word, key)).alias("own"),
        )
    )
    return _classified(sums)


def _classified(sums: DataFrame) -> DataFrame:
    """Status rows from (provider_id, confidence, score, last_signal_at, newest, own)."""
    # the last two digits of a key say which source and status it stands for
    clinic = F.when(F.col("own").isNotNull(), _said("own")[1])
    return sums.select(
        "provider_id",
        F.round("confidence", 3).alias("confidence"),
        F.round("score", 3).alias("score"),
        "last_signal_at",
        S.classify(F.col("confidence"), F.col("score"), clinic).alias("status"),
        _said("newest")[0].alias("last_source"),
    )


# ------------------------------------------------------------------------------- sums by day
def day_sums(signals: DataFrame, half_life_days: float = V.HALF_LIFE_DAYS) -> DataFrame:
    """(provider_id, day, w, wv, last_signal_at, newest, own): what a day's signals add to the status at any later time.

    Weights are grown to the start of the day instead of decayed to a moment, so the rows of several batches add up and are
    brought to the moment of reading by one factor per day.
    """
    key = _age_key()
    day = F.date_trunc("day", F.col("observed_at"))
    since = (F.unix_micros("observed_at") - F.unix_micros(day)) / F.lit(1e6)
    grown = S.source_weight(F.col("source")) * F.pow(F.lit(2.0), since / F.lit(86400.0 * half_life_days))
    return signals.withColumns({"day": day, "g": grown, "v": S.status_value(F.col("status")), "key": key}).groupBy("provider_id", "day").agg(
        F.sum("g").alias("w"), F.sum(F.col("g") * F.col("v")).alias("wv"), F.max("observed_at").alias("last_signal_at"),
        F.max("key").alias("newest"), F.max(F.when(F.col("source") == "clinic", F.col("key"))).alias("own"),
    )


def status_of_days(
    days_: DataFrame, edges: DataFrame, as_of, half_life_days: float = V.HALF_LIFE_DAYS, horizon_days: float = V.HORIZON_DAYS, clinic_days: float = V.CLINIC_DAYS,
) -> DataFrame:
    """The status at ``as_of`` from the sums of whole days and the signals of the days that the window cuts (``edges``)."""
    now = at(as_of)
    first, last = F.date_trunc("day", now - days(horizon_days)), F.date_trunc("day", now + hours(V.FUTURE_HOURS))
    whole = days_.filter((F.col("day") > first) & (F.col("day") < last))
    cut = edges.filter(in_window(F.col("observed_at"), as_of, horizon_days) & F.date_trunc("day", F.col("observed_at")).isin(first, last))
    rows = whole.select("provider_id", "day", "w", "wv", "last_signal_at", "newest", "own").unionByName(day_sums(cut, half_life_days))
    factor = S.decay((F.unix_micros(now) - F.unix_micros("day")) / F.lit(1e6), half_life_days)
    # a key begins with its time: 22 digits of row and code follow
    said_at = F.floor(F.col("own") / F.lit("1" + "0" * 22).cast("decimal(23,0)"))
    sums = rows.withColumn("f", factor).groupBy("provider_id").agg(
        F.sum(F.col("w") * F.col("f")).alias("confidence"), (F.sum(F.col("wv") * F.col("f")) / F.sum(F.col("w") * F.col("f"))).alias("score"),
        F.max("last_signal_at").alias("last_signal_at"), F.max("newest").alias("newest"), F.max("own").alias("own"),
    )
    recent = said_at.cast("long") > F.unix_micros(now - days(clinic_days))
    return _classified(sums.withColumn("own", F.when(recent, F.col("own"))))


def _age_key() -> Column:
    """One number that sorts rows by (observed_at, signal_id) and carries source and status.

    A maximum of numbers is kept in place by Spark's hash aggregation; a maximum of structs or
    strings would make it sort the whole log first. Digits: time in microseconds, then 20 for the
    id moved above zero, one for the source, one for the status.
    """
    # a name that is not known counts as 9: the row stays, its name reads as null
    index = lambda c, names: F.coalesce(S.lookup(F.col(c), {n: i for i, n in enumerate(names)}), F.lit(9))
    code = index("source", V.SOURCE_WEIGHTS) * 10 + index("status", V.STATUSES)
    big = lambda c, digits: c.cast(f"decimal({digits},0)")
    row = big(F.col("signal_id"), 20) + big(F.lit("9223372036854775808"), 20)
    return big(
        big(F.unix_micros("observed_at"), 16) * big(F.lit("1" + "0" * 22), 23) + big(row, 21) * big(F.lit("100"), 3) + big(code, 2), 38
    )


def _said(key: str) -> tuple[Column, Column]:
    """(source, status) that the last two digits of a key stand for."""
    code = (F.col(key) % 100).cast("int")
    name = lambda names, at_: F.get(F.array(*[F.lit(x) for x in names]), at_.cast("int"))
    return name(V.SOURCE_WEIGHTS, F.floor(code / 10)), name(V.STATUSES, code % 10)


def clinic_latest(signals: DataFrame, as_of, clinic_days: float = V.CLINIC_DAYS) -> DataFrame:
    """The practice's own newest word of the last month."""
    rows = signals.filter((F.col("source") == "clinic") & in_window(F.col("observed_at"), as_of, clinic_days))
    return rows.groupBy("provider_id").agg(F.max(_age_key()).alias("newest")).select("provider_id", _said("newest")[1].alias("status"))


def last_source(signals: DataFrame, as_of) -> DataFrame:
    rows = signals.filter(in_window(F.col("observed_at"), as_of))
    return rows.groupBy("provider_id").agg(F.max(_age_key()).alias("newest")).select("provider_id", _said("newest")[0].alias("last_source"))


def latest_crawl_note(signals: DataFrame) -> DataFrame:
    """Newest quote read from a website, per provider: the newest key first, then the row that has it."""
    crawled = signals.filter((F.col("source") == "web_crawl") & F.col("note").isNotNull()).withColumn("key", _age_key())
    newest = crawled.groupBy("provider_id").agg(F.max("key").alias("key"))
    return crawled.join(newest, ["provider_id", "key"]).select("provider_id", "note", "observed_at")


def news(signals: DataFrame) -> DataFrame:
    """When the latest "accepting" report about a provider arrived, whatever its source."""
    return (
        signals.filter(F.col("status") == "accepting")
        .groupBy("provider_id")
        .agg(F.max("created_at").alias("news_at"))
    )
