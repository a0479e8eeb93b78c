"""Who should hear about which practice: matching, budget, ledger, retention, digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import values as V
from .spatial import circle_pairs, nearest_lists
from .status import at, days, hours, news

# Circles of 1 to 100 km: cells of about 9 km are fine enough for the small ones, next to the pairs of the large ones.
ALERT_FINEST = 3
NEWS_DAYS = [2.0**i for i in range(-6, 8)]  # from half an hour or so to 128 days


def active_subscriptions(subs: DataFrame) -> DataFrame:
    return subs.filter(F.col("verified_at").isNotNull() & F.col("unsubscribed_at").isNull())


def _asking(subs: DataFrame) -> DataFrame:
    return active_subscriptions(subs).select(
        "subscription_id", F.col("specialty_slug").alias("specialty"), F.col("lat").alias("q_lat"),
        F.col("lng").alias("q_lng"), F.col("radius_km").cast("double").alias("radius_km"), "verified_at", "created_at",
    )


def _offered(listing: DataFrame) -> DataFrame:
    """Accepting practices by specialty."""
    return listing.filter(F.col("status") == "accepting").select(
        "specialty", F.col("provider_id").alias("c_id"), F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng")
    )


def alert_match(subs: DataFrame, listing: DataFrame) -> DataFrame:
    """All (subscription, accepting practice) pairs within the subscriber's own radius."""
    return _matched(_asking(subs), _offered(listing))


def _matched(asking: DataFrame, offered: DataFrame) -> DataFrame:
    """The pairs, with what either side brings along. What decides on a pair is joined to its sides before: pairs go through no shuffle."""
    return circle_pairs(asking, offered, ["specialty"], finest=ALERT_FINEST).withColumnRenamed("c_id", "provider_id")


def only_news(subs: DataFrame, listing: DataFrame, signals: DataFrame) -> DataFrame:
    """Pairs with an "accepting" report that arrived after the sign-up was confirmed.

    "Some report is newer" is the same as "the newest one is", so one row per provider decides.
    """
    offered = _offered(listing).join(news(signals).withColumnRenamed("provider_id", "c_id"), "c_id")
    return _matched(_asking(subs), offered).filter(F.col("news_at") > F.col("verified_at"))


def recently_told(ledger: DataFrame, as_of, renotify_days: int = V.RENOTIFY_DAYS) -> DataFrame:
    recent = ledger.filter(F.col("sent_at") > at(as_of) - days(renotify_days))
    return recent.select("subscription_id", "provider_id").distinct()


def _told(ledger: DataFrame, as_of) -> DataFrame:
    """(subscription_id, told): the practices of each subscriber's messages of the last weeks."""
    return recently_told(ledger, as_of).groupBy("subscription_id").agg(F.collect_list("provider_id").alias("told"))


def not_told(subs: DataFrame, listing: DataFrame, ledger: DataFrame, as_of) -> DataFrame:
    """Pairs that no message of the last weeks told of."""
    asking = _asking(subs).join(_told(ledger, as_of), "subscription_id", "left")
    told = F.coalesce(F.array_contains("told", F.col("provider_id")), F.lit(False))
    return _matched(asking, _offered(listing)).filter(~told).drop("told")


def _age(n_days: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n_days * 86400))


def _news_grade(news_at: Column, as_of) -> Column:
    """Place in ``NEWS_DAYS`` of the shortest time within which the news came, or their number."""
    out = F.lit(len(NEWS_DAYS))
    for g in range(len(NEWS_DAYS) - 1, -1, -1):
        out = F.when(news_at > at(as_of) - _age(NEWS_DAYS[g]), F.lit(g)).otherwise(out)
    return out


def _sure_grade(verified_at: Column, as_of) -> Column:
    """Every practice up to this grade has news for a subscriber confirmed at that time, none above the next has."""
    out = F.lit(-1)
    for g, n in enumerate(NEWS_DAYS):
        out = F.when(at(as_of) - _age(n) >= verified_at, F.lit(g)).otherwise(out)
    return out


def pending_alerts(
    subs: DataFrame, listing: DataFrame, signals: DataFrame, ledger: DataFrame, as_of, k: int = V.MAX_PER_ALERT
) -> DataFrame:
    """Per subscription the ``k`` nearest practices it should hear about now.

    The circle of a subscriber in a crowded place is first shrunk to where the grid proves at
    least ``k`` practices with certain news, plus one for each it was told about lately, so the
    result is the same as cutting the full list but the full list is never made.
    """
    asking = (
        _asking(subs)
        .join(_told(ledger, as_of), "subscription_id", "left")
        .withColumn("told", F.coalesce("told", F.array().cast("array<bigint>")))
        .withColumns({"need": F.lit(k) + F.size("told"), "max_grade": _sure_grade(F.col("verified_at"), as_of)})
    )
    offered = (
        _offered(listing)
        .join(news(signals).withColumnRenamed("provider_id", "c_id"), "c_id")
        .withColumn("grade", _news_grade(F.col("news_at"), as_of))
    )
    fresh = lambda c: (c["news_at"] > F.col("verified_at")) & ~F.array_contains("told", c["c_id"])
    found = nearest_lists(asking, offered, k, ["specialty"], fresh)
    rows = found.select("subscription_id", "specialty", "created_at", F.posexplode_outer("near").alias("at", "p")).filter(F.col("p").isNotNull())
    return rows.select("subscription_id", F.col("p.c_id").alias("provider_id"), "specialty", "p.km", (F.col("at") + 1).alias("rn"), "created_at")


# ------------------------------------------------------------------------------- sending
def mails_left(mail_log: DataFrame, as_of, limit: int = V.DAILY_MAILS) -> DataFrame:
    """One row: how many messages may still go out."""
    used = F.count_if(F.col("sent_at") > at(as_of) - hours(24))
    return mail_log.agg(F.greatest(F.lit(limit) - used, F.lit(0)).alias("budget"))


def alert_queue(pending: DataFrame) -> DataFrame:
    """One message per subscription, oldest sign-up first."""
    return pending.groupBy("subscription_id").agg(
        F.min("created_at").alias("created_at"), F.count("*").alias("practices")
    )


def within_budget(queue: DataFrame, failed: DataFrame, mail_log: DataFrame, as_of, limit: int = V.DAILY_MAILS) -> DataFrame:
    """The messages that may go out now, in order, with their position ``pos``.

    Refused addresses are out of the way first, they use no budget. The queue is cut to the
    day's limit by a distributed top-k; only those few rows are numbered.
    """
    head = (
        queue.join(failed.select("subscription_id"), "subscription_id", "left_anti")
        .orderBy("created_at", "subscription_id")
        .limit(limit)
    )
    pos = F.row_number().over(W.orderBy("created_at", "subscription_id"))
    budget = mails_left(mail_log, as_of, limit).scalar()
    return head.withColumn("pos", pos).filter(F.col("pos") <= budget)


def alert_outbox(pending: DataFrame, sending: DataFrame, cards: DataFrame, subs: DataFrame) -> DataFrame:
    """One row per message with its practices, ready for whatever sends it."""
    lines = pending.join(sending.select("subscription_id", "pos"), "subscription_id").join(
        cards.select("provider_id", "name", "street", "house_no", "city", "phone", "email", "web"), "provider_id"
    )
    practice = F.struct("rn", "provider_id", "name", "street", "house_no", "city", "phone", "email", "web", "km")
    mails = lines.groupBy("subscription_id", "pos").agg(F.sort_array(F.collect_list(practice)).alias("practices"))
    who = subs.select(
        "subscription_id", F.col("email").alias("to"), "token", "specialty_slug", "radius_km",
        F.coalesce("place_label", F.lit("vybrané místo")).alias("place"), F.coalesce("lang", F.lit("cs")).alias("lang"),
    )
    return mails.join(who, "subscription_id")


def mark_sent(ledger: DataFrame, delivered: DataFrame, as_of) -> DataFrame:
    """The ledger after a run: told pairs carry the newest time."""
    new = delivered.select("subscription_id", "provider_id", at(as_of).alias("sent_at"))
    both = ledger.select("subscription_id", "provider_id", "sent_at").unionByName(new)
    return both.groupBy("subscription_id", "provider_id").agg(F.max("sent_at").alias("sent_at"))


def log_sent(mail_log: DataFrame, sent: DataFrame, as_of) -> DataFrame:
    """The mail log after a run: one row per message sent."""
    new = sent.select(F.lit("alert").alias("kind"), at(as_of).alias("sent_at"))
    return mail_log.select("kind", "sent_at").unionByName(new)


def mark_notified(subs: DataFrame, sent: DataFrame, as_of) -> DataFrame:
    """Subscriptions with the time of their newest message."""
    told = sent.select("subscription_id", F.lit(True).alias("told"))
    newest = F.when(F.col("told"), at(as_of)).otherwise(F.col("last_notified_at"))
    return subs.join(told, "subscription_id", "left").withColumn("last_notified_at", newest).drop("told")


def run_stats(queue: DataFrame, sent: DataFrame, failed: DataFrame, removed: DataFrame) -> DataFrame:
    """One row: due, sent, failed, deferred, removed sign-ups.

    Only refusals that came up before the budget ran out count as failed.
    """
    last = sent.agg(F.max(F.struct("created_at", "subscription_id")).alias("last")).scalar()
    mine = queue.join(failed.select("subscription_id", F.lit(True).alias("bad")), "subscription_id", "left")
    key = F.struct("created_at", "subscription_id")
    n_sent = sent.agg(F.count("*")).scalar()
    n_removed = removed.agg(F.count("*")).scalar()
    left_over = F.count_if(F.col("bad").isNull())
    counts = mine.agg(
        F.count("*").alias("due"), left_over.alias("good"), F.count_if(F.col("bad") & (key <= last)).alias("failed_before"),
        F.count_if(F.col("bad")).alias("bad"),
    ).withColumns({"sent": n_sent, "removed_unconfirmed": n_removed})
    failed_n = F.when(F.col("sent") == F.col("good"), F.col("bad")).otherwise(F.col("failed_before"))
    return counts.select(
        "due", "sent", failed_n.alias("failed"), (F.col("due") - F.col("sent") - failed_n).alias("deferred"), "removed_unconfirmed"
    )


# ------------------------------------------------------------------------------- retention
def expired_signups(subs: DataFrame, as_of) -> DataFrame:
    return subs.filter(F.col("verified_at").isNull() & (F.col("created_at") < at(as_of) - days(V.PENDING_DAYS)))


def keep_subscriptions(subs: DataFrame, as_of) -> DataFrame:
    """Unconfirmed sign-ups of more than a week are gone, old requester hashes blanked."""
    old = F.col("created_at") < at(as_of) - days(V.HASH_DAYS)
    kept = subs.filter(F.col("verified_at").isNotNull() | (F.col("created_at") >= at(as_of) - days(V.PENDING_DAYS)))
    return kept.withColumn("requester_hash", F.when(~old, F.col("requester_hash")))


def keep_mail_log(mail_log: DataFrame, as_of) -> DataFrame:
    return mail_log.filter(F.col("sent_at") >= at(as_of) - days(V.MAIL_LOG_DAYS))


def keep_signals(signals: DataFrame, as_of) -> DataFrame:
    old = F.col("created_at") < at(as_of) - days(V.HASH_DAYS)
    return signals.withColumn("reporter_hash", F.when(~old, F.col("reporter_hash")))


def apply_retention(subs: DataFrame, mail_log: DataFrame, signals: DataFrame, as_of):
    return keep_subscriptions(subs, as_of), keep_mail_log(mail_log, as_of), keep_signals(signals, as_of)


# ------------------------------------------------------------------------------- digest
def digest_reports(signals: DataFrame, providers: DataFrame, as_of, n_hours: int = 24) -> DataFrame:
    recent = signals.filter((F.col("source") == "user") & (F.col("created_at") > at(as_of) - hours(n_hours)))
    return recent.select("signal_id", "provider_id", "created_at", "status", "scope", "note").join(
        providers.select("provider_id", "name", "city"), "provider_id"
    )


def digest_flags(signals: DataFrame, flags: DataFrame, providers: DataFrame, as_of, n_hours: int = 24) -> DataFrame:
    """Visitors' facts about the practices reported today."""
    today = signals.filter((F.col("source") == "user") & (F.col("created_at") > at(as_of) - hours(n_hours)))
    mine = flags.filter(F.col("source") == "user").join(today.select("provider_id"), "provider_id", "left_semi")
    return mine.select("provider_id", "flag").join(providers.select("provider_id", "name", "city"), "provider_id")


def digest_sites(providers: DataFrame) -> DataFrame:
    """Suggested websites nobody has checked yet, however old."""
    return providers.filter(F.col("web_suggested").isNotNull()).select("provider_id", "name", "city", "web_suggested")


def digest_subs(subs: DataFrame, as_of, n_hours: int = 24) -> DataFrame:
    since = at(as_of) - hours(n_hours)
    return subs.agg(
        F.count_if(F.col("created_at") > since).alias("new"),
        F.count_if(F.col("verified_at") > since).alias("confirmed"),
        F.count_if(F.col("verified_at").isNotNull() & F.col("unsubscribed_at").isNull()).alias("active"),
    )


def digest(signals: DataFrame, flags: DataFrame, providers: DataFrame, subs: DataFrame, as_of, n_hours: int = 24) -> DataFrame:
    """All parts of the evening summary as (part, key, text) rows; only counts of subscribers.

    Nothing comes out when there is neither a report nor a suggested site.
    """
    line = lambda df, part, key, text: df.select(F.lit(part).alias("part"), key.cast("string").alias("key"), text.alias("text"))
    reports = digest_reports(signals, providers, as_of, n_hours)
    sites = digest_sites(providers)
    parts = line(reports, "report", F.col("signal_id"), F.concat_ws(" ", "status", "scope", "name"))
    parts = parts.unionByName(line(digest_flags(signals, flags, providers, as_of, n_hours), "flag", F.col("provider_id"), F.col("flag")))
    parts = parts.unionByName(line(sites, "site", F.col("provider_id"), F.col("web_suggested")))
    counts = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("new", "confirmed", "active")])
    parts = parts.unionByName(line(digest_subs(subs, as_of, n_hours), "subscriptions", F.lit(""), counts))
    worth = reports.select(F.lit(1).alias("x")).unionByName(sites.select(F.lit(1).alias("x"))).agg(F.count("*")).scalar()
    return parts.filter(worth > 0)


# ------------------------------------------------------------------------------- change log
def apply_changes(subs: DataFrame, changes: DataFrame) -> DataFrame:
    """Confirmations, unsubscriptions and failed sends applied by token.

    ``changes``: (token, op, ts). The first confirmation counts; unsubscribing removes the row;
    a failed send counts only while the sign-up is unconfirmed, returns one send and back-dates
    the sign-up so that trying again works at once.
    """
    firsts = changes.groupBy("token").agg(
        F.min(F.when(F.col("op") == "confirm", F.col("ts"))).alias("confirmed"),
        F.count_if(F.col("op") == "unsubscribe").alias("gone"),
    )
    open_ = subs.join(firsts, "token", "left").filter(F.coalesce("gone", F.lit(0)) == 0)
    verified = F.coalesce("verified_at", F.when(F.col("unsubscribed_at").isNull(), F.col("confirmed")))
    open_ = open_.withColumn("verified_at", verified).drop("confirmed", "gone")
    until = open_.select("token", "verified_at")
    fails = (
        changes.filter(F.col("op") == "failed")
        .join(until, "token")
        .filter(F.col("verified_at").isNull() | (F.col("ts") < F.col("verified_at")))
        .groupBy("token")
        .agg(F.count("*").alias("fails"), F.max("ts").alias("failed_at"))
    )
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(V.SEND_FAILED_MINUTES))
    return (
        open_.join(fails, "token", "left")
        .withColumns(
            {
                "confirm_sends": F.greatest(F.col("confirm_sends") - F.coalesce("fails", F.lit(0)), F.lit(0)).cast("int"),
                "created_at": F.coalesce(F.col("failed_at") - minutes, F.col("created_at")),
            }
        )
        .drop("fails", "failed_at")
    )
