"""Registered queries: alerts, digest, retention, subscriptions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import status as ST
from ..operators.order import numbered
from ..session import cut_lineage, shared_folder
from ..sources import domain as D
from ..sources import sinks
from .registry import STEPS, km_sql, query
from .serving import us

US, DAY, HOUR = D.AS_OF_US, D.DAY_US, D.HOUR_US

STEPS.update({
    "asking": "SELECT * FROM subscriptions WHERE verified_us IS NOT NULL AND unsubscribed_us IS NULL",
    "matched": f"""
        SELECT s.subscription_id, s.specialty_slug, s.verified_us, s.created_us, p.provider_id, {km_sql('s.lat', 's.lng', 'p.lat', 'p.lng')} AS km
          FROM asking s JOIN spec_cards p ON p.specialty = s.specialty_slug AND p.status = 'accepting'
         WHERE {km_sql('s.lat', 's.lng', 'p.lat', 'p.lng')} <= s.radius_km""",
    "news_at": "SELECT provider_id, max(created_us) AS news_us FROM signals WHERE status = 'accepting' GROUP BY 1",
    "told": f"SELECT DISTINCT subscription_id, provider_id FROM ledger WHERE sent_us > {US} - 60 * {DAY}",
    "pending": """
        SELECT * FROM (
            SELECT m.*, row_number() OVER (PARTITION BY m.subscription_id ORDER BY km, m.provider_id) AS rn FROM matched m
             WHERE EXISTS (SELECT 1 FROM news_at n WHERE n.provider_id = m.provider_id AND n.news_us > m.verified_us)
               AND NOT EXISTS (SELECT 1 FROM told t WHERE t.subscription_id = m.subscription_id AND t.provider_id = m.provider_id)) WHERE rn <= 10""",
    "queue": "SELECT subscription_id, min(created_us) AS created_us, count(*) AS practices FROM pending GROUP BY 1",
    "refused": "SELECT subscription_id, subscription_id % 17 = 3 AS bad FROM subscriptions",
    "budget": f"SELECT greatest(450 - count(*) FILTER (WHERE sent_us > {US} - 24 * {HOUR}), 0) AS budget FROM mail_log",
    "outgoing": """
        SELECT * FROM (SELECT q.*, row_number() OVER (ORDER BY created_us, q.subscription_id) AS pos FROM queue q
          JOIN refused r ON r.subscription_id = q.subscription_id AND NOT r.bad) WHERE pos <= (SELECT budget FROM budget)""",
    "changes": """
        SELECT 'tok_' || CAST((event_id * 7) % (SELECT count(*) FROM orders) AS STRING) AS token,
               CASE k % 4 WHEN 0 THEN 'confirm' WHEN 1 THEN 'unsubscribe' ELSE 'failed' END AS op, ts_us FROM ev""",
})


def pending(d):
    return A.pending_alerts(d.subscriptions, d.listing, d.signals, d.ledger, d.as_of)


def refused(d):
    """Addresses the mail server turned down."""
    return d.subscriptions.filter(F.col("subscription_id") % 17 == 3).select("subscription_id")


@query("C5_alert_match", "SELECT subscription_id, provider_id, round(km, 6) AS km FROM matched")
def alert_match(d):
    return A.alert_match(d.subscriptions, d.listing).select("subscription_id", "provider_id", F.round("km", 6).alias("km"))


@query("C6_only_news", """
    SELECT subscription_id, provider_id FROM matched m
     WHERE EXISTS (SELECT 1 FROM signals a WHERE a.provider_id = m.provider_id AND a.status = 'accepting' AND a.created_us > m.verified_us)""")
def only_news(d):
    return A.only_news(d.subscriptions, d.listing, d.signals).select("subscription_id", "provider_id")


@query("C7_not_told", """
    SELECT subscription_id, provider_id FROM matched m
     WHERE NOT EXISTS (SELECT 1 FROM told t WHERE t.subscription_id = m.subscription_id AND t.provider_id = m.provider_id)""")
def not_told(d):
    return A.not_told(d.subscriptions, d.listing, d.ledger, d.as_of).select("subscription_id", "provider_id")


@query("J4_renotify", "SELECT subscription_id, count(*) AS told FROM told GROUP BY 1")
def renotify(d):
    return A.recently_told(d.ledger, d.as_of).groupBy("subscription_id").agg(F.count("*").alias("told"))


@query("M6_pending_alerts", "SELECT subscription_id, provider_id, round(km, 6) AS km, CAST(rn AS INT) AS rn FROM pending")
def pending_alerts(d):
    return pending(d).select("subscription_id", "provider_id", F.round("km", 6).alias("km"), "rn")


@query("E4_top10_per_alert", """
    SELECT subscription_id, count(*) AS practices, round(max(km), 6) AS farthest FROM pending GROUP BY 1""")
def top10_per_alert(d):
    return pending(d).groupBy("subscription_id").agg(F.count("*").alias("practices"), F.round(F.max("km"), 6).alias("farthest"))


@query("F9_alert_queue_order", """
    SELECT CAST(row_number() OVER (ORDER BY created_us, subscription_id) AS INT) AS pos, subscription_id, created_us
      FROM queue""")
def alert_queue_order(d):
    queue = numbered(A.alert_queue(pending(d)), F.col("created_at"), F.col("subscription_id"))
    return queue.select(F.col("pos").cast("int").alias("pos"), "subscription_id", us("created_at"))


@query("D22_mail_budget", "SELECT CAST(budget AS BIGINT) AS budget FROM budget")
def mail_budget(d):
    return A.mails_left(d.mail_log, d.as_of)


@query("J5_daily_budget", "SELECT subscription_id, CAST(pos AS INT) AS pos FROM outgoing")
def daily_budget(d):
    out = A.within_budget(A.alert_queue(pending(d)), refused(d), d.mail_log, d.as_of)
    return out.select("subscription_id", "pos")


@query("M7_alert_run", f"""
    SELECT due, sent, CASE WHEN sent = good THEN bad ELSE before END AS failed, due - sent - CASE WHEN sent = good THEN bad ELSE before END AS deferred, removed_unconfirmed FROM (
        SELECT count(*) AS due, (SELECT count(*) FROM outgoing) AS sent, count(*) FILTER (WHERE NOT r.bad) AS good, count(*) FILTER (WHERE r.bad) AS bad,
               count(*) FILTER (WHERE r.bad AND row(q.created_us, q.subscription_id) <= (SELECT max(row(created_us, subscription_id)) FROM outgoing)) AS before,
               (SELECT count(*) FROM subscriptions WHERE verified_us IS NULL AND created_us < {US} - 7 * {DAY}) AS removed_unconfirmed
          FROM queue q JOIN refused r ON r.subscription_id = q.subscription_id)""")
def alert_run(d):
    """Retention, then matching, then the budgeted queue: the numbers of one run."""
    subs = A.keep_subscriptions(d.subscriptions, d.as_of)
    due = cut_lineage(A.alert_queue(A.pending_alerts(subs, d.listing, d.signals, d.ledger, d.as_of)))
    sent = A.within_budget(due, refused(d), A.keep_mail_log(d.mail_log, d.as_of), d.as_of)
    return A.run_stats(due, sent, refused(d), A.expired_signups(d.subscriptions, d.as_of))


@query("A12_alert_rows", """
    SELECT o.subscription_id, CAST(o.pos AS INT) AS pos, s.email AS recipient, coalesce(s.place_label, 'vybrané místo') AS place,
           (SELECT string_agg(CAST(p.provider_id AS STRING), ',' ORDER BY p.rn) FROM pending p WHERE p.subscription_id = o.subscription_id) AS providers
      FROM outgoing o JOIN subscriptions s ON s.subscription_id = o.subscription_id""")
def alert_rows(d):
    """The outbox, written as JSON lines and read back."""
    due = cut_lineage(pending(d))
    sending = A.within_budget(A.alert_queue(due), refused(d), d.mail_log, d.as_of)
    box = A.alert_outbox(due, sending, d.cards, d.subscriptions)
    folder = sinks.write_outbox(box, f"{shared_folder(d.spark)}/outbox", uuid.uuid4().hex)
    back = d.spark.read.schema(box.schema).json(folder)
    ids = F.array_join(F.transform("practices", lambda p: p["provider_id"].cast("string")), ",")
    return back.select("subscription_id", "pos", F.col("to").alias("recipient"), "place", ids.alias("providers"))


@query("L9_mark_sent", f"""
    SELECT subscription_id, provider_id, max(sent_us) AS sent_us FROM (
        SELECT subscription_id, provider_id, sent_us FROM ledger UNION ALL
        SELECT p.subscription_id, p.provider_id, {US} FROM pending p JOIN outgoing o ON o.subscription_id = p.subscription_id) GROUP BY 1, 2""")
def mark_sent(d):
    due = cut_lineage(pending(d))
    sending = A.within_budget(A.alert_queue(due), refused(d), d.mail_log, d.as_of)
    delivered = due.join(sending.select("subscription_id"), "subscription_id", "left_semi")
    return A.mark_sent(d.ledger, delivered, d.as_of).select("subscription_id", "provider_id", us("sent_at"))


@query("L9_mail_log", f"""
    SELECT kind, sent_us, count(*) AS n FROM (
        SELECT kind, sent_us FROM mail_log UNION ALL SELECT 'alert', {US} FROM outgoing) GROUP BY 1, 2""")
def sent_mail_log(d):
    """Each message sent is one row of the mail log, so the next run's budget counts it."""
    sending = A.within_budget(A.alert_queue(pending(d)), refused(d), d.mail_log, d.as_of)
    log = A.log_sent(d.mail_log, sending, d.as_of)
    return log.groupBy("kind", us("sent_at")).agg(F.count("*").alias("n"))


@query("L9_last_notified", f"""
    SELECT s.subscription_id, CASE WHEN o.subscription_id IS NOT NULL THEN {US} END AS last_notified_us
      FROM subscriptions s LEFT JOIN outgoing o ON o.subscription_id = s.subscription_id""")
def last_notified(d):
    sending = A.within_budget(A.alert_queue(pending(d)), refused(d), d.mail_log, d.as_of)
    subs = d.subscriptions.withColumn("last_notified_at", F.lit(None).cast("timestamp"))
    return A.mark_notified(subs, sending, d.as_of).select("subscription_id", us("last_notified_at"))


@query("J7_retention", f"""
    SELECT subscription_id, CASE WHEN created_us >= {US} - 90 * {DAY} THEN requester_hash END AS requester_hash FROM subscriptions
     WHERE verified_us IS NOT NULL OR created_us >= {US} - 7 * {DAY}""")
def retention(d):
    return A.keep_subscriptions(d.subscriptions, d.as_of).select("subscription_id", "requester_hash")


@query("J7_retention_mail_log", f"SELECT mail_id, kind FROM mail_log WHERE sent_us >= {US} - 30 * {DAY}")
def retention_mail_log(d):
    return A.keep_mail_log(d.mail_log, d.as_of).select("mail_id", "kind")


@query("J7_retention_signals", f"SELECT signal_id, CASE WHEN created_us >= {US} - 90 * {DAY} THEN reporter_hash END AS reporter_hash FROM signals")
def retention_signals(d):
    return A.keep_signals(d.signals, d.as_of).select("signal_id", "reporter_hash")


@query("D8_digest_subs", f"""
    SELECT count(*) FILTER (WHERE created_us > {US} - 24 * {HOUR}) AS new, count(*) FILTER (WHERE verified_us > {US} - 24 * {HOUR}) AS confirmed,
           count(*) FILTER (WHERE verified_us IS NOT NULL AND unsubscribed_us IS NULL) AS active FROM subscriptions""")
def digest_subs(d):
    return A.digest_subs(d.subscriptions, d.as_of)


@query("C12_flags_today", f"""
    SELECT f.provider_id, f.flag, p.name FROM flags f JOIN providers p ON p.provider_id = f.provider_id
     WHERE f.source = 'user' AND f.provider_id IN (SELECT provider_id FROM signals WHERE source = 'user' AND created_us > {US} - 48 * {HOUR})""")
def flags_today(d):
    return A.digest_flags(d.signals, d.flags, d.providers, d.as_of, 48).select("provider_id", "flag", "name")


@query("M8_digest", f"""
    SELECT 'report' AS part, CAST(signal_id AS STRING) AS key, s.status || ' ' || scope || ' ' || name AS text
      FROM signals s JOIN providers p ON p.provider_id = s.provider_id WHERE source = 'user' AND created_us > {US} - 24 * {HOUR}
    UNION ALL SELECT 'flag', CAST(provider_id AS STRING), flag FROM flags
     WHERE source = 'user' AND provider_id IN (SELECT provider_id FROM signals WHERE source = 'user' AND created_us > {US} - 24 * {HOUR})
    UNION ALL SELECT 'site', CAST(provider_id AS STRING), web_suggested FROM providers WHERE web_suggested IS NOT NULL
    UNION ALL SELECT 'subscriptions', '', count(*) FILTER (WHERE created_us > {US} - 24 * {HOUR}) || ' ' || count(*) FILTER (WHERE verified_us > {US} - 24 * {HOUR})
           || ' ' || count(*) FILTER (WHERE verified_us IS NOT NULL AND unsubscribed_us IS NULL) FROM subscriptions""")
def digest(d):
    return A.digest(d.signals, d.flags, d.providers, d.subscriptions, d.as_of)


def changes(d):
    n = d.given("orders").agg(F.count("*")).scalar()
    op = F.when(F.col("k") % 4 == 0, "confirm").when(F.col("k") % 4 == 1, "unsubscribe").otherwise("failed")
    token = F.concat(F.lit("tok_"), ((F.col("event_id") * 7) % n).cast("string"))
    return d._event.select(token.alias("token"), op.alias("op"), F.timestamp_micros("ts_us").alias("ts"))


@query("L10_subscription_changes", f"""
    WITH firsts AS (SELECT token, min(CASE WHEN op = 'confirm' THEN ts_us END) AS conf, count(*) FILTER (WHERE op = 'unsubscribe') AS gone FROM changes GROUP BY 1),
    left_over AS (
        SELECT s.*, coalesce(s.verified_us, CASE WHEN s.unsubscribed_us IS NULL THEN f.conf END) AS ver
          FROM subscriptions s LEFT JOIN firsts f ON f.token = s.token WHERE coalesce(f.gone, 0) = 0),
    fails AS (SELECT c.token, count(*) AS n, max(ts_us) AS last_us FROM changes c JOIN left_over o ON o.token = c.token
               WHERE op = 'failed' AND (o.ver IS NULL OR c.ts_us < o.ver) GROUP BY 1)
    SELECT subscription_id, ver AS verified_us, CAST(greatest(confirm_sends - coalesce(n, 0), 0) AS INT) AS confirm_sends,
           coalesce(last_us - 11 * 60 * 1000000, created_us) AS created_us FROM left_over o LEFT JOIN fails f ON f.token = o.token""")
def subscription_changes(d):
    out = A.apply_changes(d.subscriptions, changes(d))
    return out.select("subscription_id", us("verified_at"), "confirm_sends", us("created_at"))
