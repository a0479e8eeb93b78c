"""Registered queries: a Spark job and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from ..sources import domain as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Named steps the SQL twins share, in order; a step may use the ones above it.
STEPS: dict[str, str] = {
    "providers": f"SELECT {D.select_list(D.PROVIDERS)} FROM {D.PROVIDERS_FROM}",
    "bridge": f"""
        SELECT c_custkey AS provider_id, {D.SEGMENT_SLUG} AS specialty_slug FROM customer
        UNION ALL SELECT c_custkey, 'hygienistka' FROM customer WHERE c_custkey % 4 = 0
        UNION ALL SELECT c_custkey, 'chirurg' FROM customer WHERE c_custkey % 8 = 0""",
    "ev": f"""
        SELECT event_id, user_id, event_type, value, {D.EVENT_K} AS k, epoch_us(ts) AS ts_us,
               (SELECT count(*) FROM customer) AS n_providers FROM events""",
    "signals": f"SELECT {D.select_list(D.SIGNALS)} FROM ev",
    "flag_events": f"SELECT {D.select_list(D.FLAG_EVENTS)} FROM ev",
    "flags": "SELECT provider_id, flag, source, max(observed_us) AS observed_us FROM flag_events GROUP BY 1, 2, 3",
    "reports": f"SELECT {D.select_list(D.REPORTS)} FROM ev",
    "report_forms": f"SELECT {D.select_list(D.REPORT_FORMS)} FROM ev",
    "signup_requests": f"SELECT {D.select_list(D.SIGNUP_REQUESTS)} FROM ev",
    "signup_forms": f"SELECT {D.select_list(D.SIGNUP_FORMS)} FROM ev",
    "searches": f"SELECT {D.select_list(D.SEARCHES)} FROM ev",
    "subscriptions": f"SELECT {D.select_list(D.SUBSCRIPTIONS)} FROM orders",
    "ledger": f"SELECT {D.select_list(D.LEDGER)} FROM orders",
    "mail_log": f"SELECT {D.select_list(D.MAIL_LOG)} FROM orders",
    "sponsored": f"SELECT {D.select_list(D.SPONSORED)} FROM orders",
    "register_rows": f"SELECT {D.select_list(D.REGISTER_ROWS)} FROM {D.REGISTER_FROM}",
    "crawl_pages": f"SELECT {D.select_list(D.PAGES)} FROM pages",
    "weighted": f"""
        SELECT *, CASE source WHEN 'clinic' THEN 1.0e0 WHEN 'region' THEN 0.8e0 WHEN 'user' THEN 0.6e0 ELSE 0.4e0 END
                  * pow(0.5e0, ({D.AS_OF_US} - observed_us) / 1e6 / 86400.0e0 / 30.0e0) AS w,
               CASE status WHEN 'accepting' THEN 1.0e0 WHEN 'waitlist' THEN 0.3e0 ELSE -1.0e0 END AS v
          FROM signals
         WHERE observed_us > {D.AS_OF_US} - 90 * {D.DAY_US} AND observed_us <= {D.AS_OF_US} + {D.HOUR_US}""",
    "clinic": f"""
        SELECT provider_id, status FROM (
            SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY observed_us DESC, signal_id DESC) AS rn FROM signals
             WHERE source = 'clinic' AND observed_us > {D.AS_OF_US} - 30 * {D.DAY_US} AND observed_us <= {D.AS_OF_US} + {D.HOUR_US})
         WHERE rn = 1""",
    "newest": """
        SELECT provider_id, source FROM (
            SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY observed_us DESC, signal_id DESC) AS rn FROM weighted)
         WHERE rn = 1""",
    "status_full": """
        SELECT a.provider_id, a.confidence, a.score, a.last_signal_us,
               CASE WHEN c.status IS NOT NULL THEN c.status WHEN a.confidence < 0.3e0 THEN 'unknown'
                    WHEN a.score >= 0.5e0 THEN 'accepting' WHEN a.score <= -0.5e0 THEN 'not_accepting' ELSE 'mixed' END AS status,
               n.source AS last_source
          FROM (SELECT provider_id, sum(w) AS confidence, sum(w * v) / sum(w) AS score, max(observed_us) AS last_signal_us
                  FROM weighted GROUP BY 1) a
          LEFT JOIN clinic c ON c.provider_id = a.provider_id JOIN newest n ON n.provider_id = a.provider_id""",
    "facts": f"""
        SELECT provider_id,
               bool_or(flag = 'self_pay' AND ok) AS self_pay, bool_or(flag = 'english' AND ok) AS english,
               bool_or(flag = 'english_site') AS english_site,
               string_agg(DISTINCT CASE WHEN flag LIKE 'ins%' AND ok THEN substr(flag, 4) END, ',' ORDER BY CASE WHEN flag LIKE 'ins%' AND ok THEN substr(flag, 4) END) AS insurers
          FROM (SELECT *, source <> 'user' OR observed_us > epoch_us(TIMESTAMP '{D.AS_OF}' - INTERVAL 1 YEAR) AS ok FROM flags)
         GROUP BY 1""",
    "cards": """
        SELECT p.provider_id, p.name, p.street, p.house_no, p.city, p.city_slug, p.postcode, p.district, p.region, p.lat, p.lng,
               p.phone, p.email, coalesce(nullif(p.web, ''), p.web_found) AS web, p.facility_type,
               coalesce(s.status, 'unknown') AS status, s.last_signal_us, s.last_source,
               coalesce(f.self_pay, false) AS self_pay, coalesce(f.english, false) AS english,
               coalesce(f.english_site, false) AS english_site, f.insurers,
               (SELECT string_agg(specialty_slug, ',' ORDER BY specialty_slug) FROM bridge b WHERE b.provider_id = p.provider_id) AS specialties
          FROM providers p LEFT JOIN status_full s ON s.provider_id = p.provider_id
          LEFT JOIN facts f ON f.provider_id = p.provider_id WHERE p.active""",
    "spec_cards": """
        SELECT c.*, b.specialty_slug AS specialty, CASE status WHEN 'accepting' THEN 0 WHEN 'waitlist' THEN 1 WHEN 'mixed' THEN 2 WHEN 'unknown' THEN 3 ELSE 4 END AS rank
          FROM cards c JOIN bridge b ON b.provider_id = c.provider_id""",
    "town_rows": """
        SELECT specialty, city_slug, min(city) AS city, min(region) AS region, min(district) AS district, count(*) AS n,
               avg(lat) AS lat, avg(lng) AS lng, count(*) FILTER (WHERE status = 'accepting') AS accepting
          FROM spec_cards WHERE city_slug IS NOT NULL GROUP BY 1, 2""",
    "town_page_counts": """
        SELECT specialty, city_slug, count(*) AS n,
               count(*) FILTER (WHERE status = 'accepting') AS accepting, count(*) FILTER (WHERE status = 'waitlist') AS waitlist,
               count(*) FILTER (WHERE status = 'mixed') AS mixed, count(*) FILTER (WHERE status = 'unknown') AS unknown,
               count(*) FILTER (WHERE status = 'not_accepting') AS not_accepting,
               count(*) FILTER (WHERE status <> 'unknown') AS known, count(*) FILTER (WHERE status IN ('accepting', 'waitlist')) AS open,
               count(*) FILTER (WHERE english) AS english, avg(lat) AS lat, avg(lng) AS lng
          FROM spec_cards WHERE city_slug IS NOT NULL GROUP BY 1, 2""",
}


def km_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    """The distance in SQL."""
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2)"
    return f"(2 * 6378.168e0 * asin(least(1.0e0, sqrt({a}))))"


def with_steps(sql: str, steps: str = "") -> str:
    """Put the named steps (and the ones they use) in front of ``sql``."""
    import re

    wanted: set[str] = set()

    def add(text: str) -> None:
        for name in STEPS:
            if name not in wanted and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                wanted.add(name)
                add(STEPS[name])

    add(sql + " " + steps)
    head = ", ".join(f"{name} AS ({STEPS[name]})" for name in STEPS if name in wanted)
    if not head:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(domain)`` under ``name``."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(D.Domain(configure(spark), folder))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_steps(sql)
        return fn

    return register
