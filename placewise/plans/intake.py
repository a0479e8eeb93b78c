"""Registered queries: validation, rate limits, sponsors, areas."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import model
from ..functions import contact as C
from ..operators import areas, intake
from ..operators import discover as DI
from ..session import shared_folder
from ..sources import domain as D
from ..sources.polygons import read_polygons
from .registry import STEPS, query
from .serving import us

US, DAY = D.AS_OF_US, D.DAY_US
FORMS_AT = "2024-01-20 00:00:00"
FORMS_US = US - 11 * DAY


# ------------------------------------------------------------------------------- validation
@query("B16_constraint_check", """
    SELECT tbl, broken, count(*) AS n FROM (
        SELECT 'signals' AS tbl, CASE WHEN length(note) > 500 THEN 'note_length' END AS broken FROM signals
        UNION ALL SELECT 'providers', CASE WHEN (lat IS NULL) <> (lng IS NULL) THEN 'coords_together' END
          FROM (SELECT lat, CASE WHEN provider_id % 7 <> 1 THEN lng END AS lng FROM providers)
        UNION ALL SELECT 'subscriptions', CASE WHEN radius_km * 2 NOT BETWEEN 1 AND 100 THEN 'radius_range' END FROM subscriptions
        UNION ALL SELECT 'sponsored', CASE WHEN ends_on < starts_on THEN 'interval_order' END
          FROM (SELECT starts_on, CASE WHEN listing_id % 9 = 0 THEN starts_on - 1 ELSE ends_on END AS ends_on FROM sponsored)) GROUP BY 1, 2""")
def constraint_check(d):
    """Rows by the rule they break, over copies of the tables with planted faults."""
    planted = {
        "signals": d.signals,
        "providers": d.providers.withColumn("lng", F.when(F.col("provider_id") % 7 != 1, F.col("lng"))),
        "subscriptions": d.subscriptions.withColumn("radius_km", F.col("radius_km") * 2),
        "sponsored": d.sponsored.withColumn("ends_on", F.when(F.col("listing_id") % 9 == 0, F.date_sub("starts_on", 1)).otherwise(F.col("ends_on"))),
    }
    out = None
    for table, df in planted.items():
        part = model.check(df, table).select(F.lit(table).alias("tbl"), F.explode_outer("violations").alias("broken"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("tbl", "broken").agg(F.count("*").alias("n"))


STEPS["report_checked"] = f"""
    SELECT *, CASE WHEN pid IS NULL OR pid <= 0 THEN 'provider' WHEN status NOT IN ('accepting', 'not_accepting', 'waitlist') THEN 'status'
                   WHEN sc NOT IN ('adults', 'children', 'all') THEN 'scope' WHEN noon IS NULL THEN 'date'
                   WHEN ({FORMS_US} - noon) / 86400000000.0e0 < -1 OR ({FORMS_US} - noon) / 86400000000.0e0 > 60 THEN 'age' END AS reason
      FROM (SELECT *, TRY_CAST(trim(provider) AS BIGINT) AS pid, coalesce(nullif(trim(scope), ''), 'all') AS sc,
                   CASE WHEN regexp_matches(visit_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN epoch_us(TRY_CAST(visit_date || ' 12:00:00' AS TIMESTAMP)) END AS noon FROM report_forms)"""


@query("B17_report_validate", f"""
    SELECT form_id, reason, sc AS scope, least(noon, {FORMS_US}) AS observed_us,
           nullif(substr(regexp_replace(trim(note), '\\s+', ' ', 'g'), 1, 300), '') AS note,
           array_to_string(list_filter(list_distinct_ordered, lambda c: c IN ('111', '201', '205', '207', '209', '211', '213')), ',') AS insurers
      FROM (SELECT *, CASE insurers WHEN '' THEN [] WHEN '111,999,111' THEN ['111', '999'] ELSE ['213', '201'] END AS list_distinct_ordered FROM report_checked)""")
def report_validate(d):
    forms = d.report_forms.withColumnRenamed("provider", "provider")
    out = intake.check_reports(forms, FORMS_AT)
    return out.select("form_id", "reason", "scope", us("observed_at"), "note", F.array_join("insurers", ",").alias("insurers"))


@query("H18_site_address", """
    SELECT form_id, CASE site WHEN 'www.Zubar-Novak.cz' THEN 'http://www.zubar-novak.cz/' WHEN 'https://A.cz/x?y=1' THEN 'https://a.cz/x' END AS site FROM report_forms""")
def site_address(d):
    return d.report_forms.select("form_id", C.site_address(F.col("site")).alias("site"))


@query("B18_signup_validate", """
    SELECT form_id, lower(trim(email)) AS email, coalesce(specialty IN ('zubar', 'praktik', 'ocni') AND regexp_matches(lower(trim(email)), '^[^@ ]+@[^@ ]+\\.[a-z]{2,}$')
           AND TRY_CAST(lat AS DOUBLE) > 48.4 AND TRY_CAST(lat AS DOUBLE) < 51.2 AND CAST(lng AS DOUBLE) > 12 AND CAST(lng AS DOUBLE) < 19
           AND trim(place) <> '' AND radius_km IN ('5', '20'), false) AS ok, CASE WHEN lang = 'en' THEN 'en' ELSE 'cs' END AS lang FROM signup_forms""")
def signup_validate(d):
    return intake.check_signups(d.signup_forms).select("form_id", "email", "ok", "lang")


@query("B19_bot_filter", """
    SELECT form_id FROM report_forms WHERE trap = '' AND (sent_us - rendered_us) / 1e6 BETWEEN 3 AND 21600""")
def bot_filter(d):
    bot = intake.is_bot(F.col("trap"), F.col("rendered_at"), F.col("sent_at"))
    return d.report_forms.filter(~bot).select("form_id")


# ------------------------------------------------------------------------------- rate limits
REPORT_FOLD = f"""
    WITH RECURSIVE known AS (
        SELECT r.report_id, r.reporter, r.provider_id, r.created_us AS ts, row_number() OVER (PARTITION BY reporter ORDER BY created_us, report_id) AS i
          FROM reports r JOIN providers p ON p.provider_id = r.provider_id AND p.active),
    fold AS (
        SELECT reporter, 0 AS i, CAST(NULL AS BIGINT) AS report_id, CAST(NULL AS STRING) AS result, CAST([] AS STRUCT(p BIGINT, t BIGINT)[]) AS acc FROM (SELECT DISTINCT reporter FROM known)
        UNION ALL
        SELECT reporter, i, report_id, result, CASE WHEN result = 'ok' THEN list_append(kept, {{'p': provider_id, 't': ts}}) ELSE kept END FROM (
            SELECT k.reporter, CAST(k.i AS INT) AS i, k.report_id, k.provider_id, k.ts, list_filter(f.acc, lambda a: a.t > k.ts - {DAY}) AS kept,
                   CASE WHEN len(list_filter(f.acc, lambda a: a.t > k.ts - {DAY} AND a.p = k.provider_id)) > 0 THEN 'duplicate'
                        WHEN len(list_filter(f.acc, lambda a: a.t > k.ts - {DAY})) >= 10 THEN 'too_many' ELSE 'ok' END AS result
              FROM fold f JOIN known k ON k.reporter = f.reporter AND k.i = f.i + 1))
    SELECT report_id, result FROM fold WHERE report_id IS NOT NULL
    UNION ALL SELECT report_id, 'no_provider' FROM reports r WHERE NOT EXISTS (SELECT 1 FROM providers p WHERE p.provider_id = r.provider_id AND p.active)"""


@query("J1_report_limit", REPORT_FOLD)
def report_limit(d):
    return intake.limit_reports(d.reports, d.providers)



WHERE_SQL = "{spec} || '/' || CAST(radius_km AS STRING) || '/' || CAST(round(lat, 3) AS STRING) || '/' || CAST(round(lng, 3) AS STRING)"
STEPS.update({
    "asked_signups": f"""
        SELECT request_id, lower(email) AS email, requester, {WHERE_SQL.format(spec='specialty')} AS place, created_us AS t, row_number() OVER (ORDER BY created_us, request_id) AS i FROM signup_requests""",
    "old_signups": f"""
        SELECT 's' || CAST(subscription_id AS STRING) AS sub, subscription_id AS id, lower(email) AS email, requester_hash AS owner, {WHERE_SQL.format(spec='specialty_slug')} AS place,
               created_us AS t, CAST(confirm_sends AS BIGINT) AS sends, verified_us AS v, unsubscribed_us AS u FROM subscriptions""",
    # what stood in the tables when each request came: the address's and the visitor's rows, mails of the day
    "own_rows": """
        SELECT a.i, list({'sub': o.sub, 'place': o.place, 't': o.t, 'sends': o.sends, 'v': o.v, 'u': o.u, 'owner': o.owner} ORDER BY o.t, o.id) AS own
          FROM asked_signups a JOIN old_signups o ON o.email = a.email AND o.t <= a.t GROUP BY 1""",
    "visitor_rows": f"SELECT a.i, list(o.sub) AS subs FROM asked_signups a JOIN old_signups o ON o.owner = a.requester AND o.t <= a.t AND o.t > a.t - {DAY} GROUP BY 1",
    "mail_rows": f"SELECT a.i, count(*) AS mails FROM asked_signups a JOIN mail_log m ON m.sent_us <= a.t AND m.sent_us > a.t - {DAY} GROUP BY 1",
    "signup_line": """
        SELECT a.*, coalesce(o.own, []) AS own, coalesce(v.subs, []) AS subs, coalesce(m.mails, 0) AS mails
          FROM asked_signups a LEFT JOIN own_rows o ON o.i = a.i LEFT JOIN visitor_rows v ON v.i = a.i LEFT JOIN mail_rows m ON m.i = a.i""",
})
SENT = "STRUCT(sub VARCHAR, email VARCHAR, owner VARCHAR, place VARCHAR, t BIGINT, made BIGINT)[]"
LAST_T = "list_max(list_transform(list_filter(acc, lambda a: a.sub = {s}.sub), lambda a: a.t))"
# One request after the other; ``acc`` are the confirmations sent so far, ``made`` is when their subscription began.
SIGNUP_FOLD = f"""
    WITH RECURSIVE line AS MATERIALIZED (SELECT * FROM signup_line), fold AS (
        SELECT 0 AS i, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS result, CAST([] AS {SENT}) AS acc
        UNION ALL
        SELECT i, request_id, result, CASE WHEN result = 'send' THEN list_append(acc, {{'sub': coalesce(same.sub, 'r' || request_id), 'email': email, 'owner': coalesce(same.owner, requester),
               'place': place, 't': t, 'made': coalesce(same.made, t)}}) ELSE acc END FROM (
            SELECT *, CASE WHEN same.v <= t THEN 'already' WHEN by_requester >= 5 OR by_email >= 3 OR active >= 10 OR mails + len(list_filter(acc, lambda a: a.t > t - {DAY})) >= 450 THEN 'too_many'
                   WHEN same.sub IS NULL THEN 'send' WHEN greatest(same.t, coalesce(same.last_t, same.t)) > t - 600000000 OR same.sends + same.more >= 3 THEN 'already' ELSE 'send' END AS result FROM (
                SELECT CAST(k.i AS INT) AS i, k.request_id, k.email, k.requester, k.place, k.t, k.mails, f.acc,
                       len(list_distinct(list_concat(k.subs, list_transform(list_filter(f.acc, lambda a: a.owner = k.requester AND a.t > k.t - {DAY}), lambda a: a.sub)))) AS by_requester,
                       len(list_distinct(list_concat(list_transform(list_filter(k.own, lambda o: o.t > k.t - {DAY}), lambda o: o.sub),
                                                     list_transform(list_filter(f.acc, lambda a: a.email = k.email AND a.t > k.t - {DAY}), lambda a: a.sub)))) AS by_email,
                       len(list_filter(k.own, lambda o: o.u IS NULL OR o.u > k.t)) + len(list_distinct(list_transform(list_filter(f.acc, lambda a: a.email = k.email AND a.sub LIKE 'r%'), lambda a: a.sub))) AS active,
                       list_sort(list_concat(
                           list_transform(list_filter(k.own, lambda o: o.place = k.place AND (o.u IS NULL OR o.u > k.t)), lambda o: {{'made': o.t, 'sub': o.sub, 't': o.t, 'sends': o.sends, 'v': o.v, 'owner': o.owner,
                               'last_t': list_max(list_transform(list_filter(f.acc, lambda a: a.sub = o.sub), lambda a: a.t)), 'more': len(list_filter(f.acc, lambda a: a.sub = o.sub))}}),
                           list_transform(list_filter(f.acc, lambda a: a.email = k.email AND a.place = k.place AND a.sub LIKE 'r%'), lambda r: {{'made': r.made, 'sub': r.sub, 't': r.t, 'sends': 0::BIGINT, 'v': NULL::BIGINT, 'owner': r.owner,
                               'last_t': list_max(list_transform(list_filter(f.acc, lambda a: a.sub = r.sub), lambda a: a.t)), 'more': len(list_filter(f.acc, lambda a: a.sub = r.sub))}})))[1] AS same
                  FROM fold f JOIN line k ON k.i = f.i + 1)))
    SELECT request_id, result FROM fold WHERE request_id IS NOT NULL"""


@query("J2_signup_limit", SIGNUP_FOLD)
def signup_limit(d):
    return intake.limit_signups(d.signup_requests, d.subscriptions, d.mail_log)


# ------------------------------------------------------------------------------- keyed updates
@query("L11_flag_upsert_user", """
    SELECT provider_id, flag, source, max(observed_us) AS observed_us FROM (
        SELECT provider_id, flag, source, observed_us FROM flags UNION ALL SELECT provider_id, 'english', 'user', created_us FROM reports) GROUP BY 1, 2, 3""")
def flag_upsert_user(d):
    new = d.reports.select("provider_id", F.lit("english").alias("flag"), F.col("created_at").alias("observed_at"))
    return intake.merge_user_flags(d.flags, new).select("provider_id", "flag", "source", us("observed_at"))


@query("L12_suggest_site", """
    SELECT p.provider_id, CASE WHEN coalesce(web, '') = '' AND web_found IS NULL THEN coalesce(site, web_suggested) ELSE web_suggested END AS web_suggested
      FROM providers p LEFT JOIN (SELECT provider_id, arg_max('http://s' || CAST(report_id AS STRING) || '.cz/', row(created_us, report_id)) AS site FROM reports GROUP BY 1) r ON r.provider_id = p.provider_id""")
def suggest_site(d):
    site = F.concat(F.lit("http://s"), F.col("report_id").cast("string"), F.lit(".cz/"))
    new = d.reports.select("provider_id", site.alias("site"), F.struct("created_at", "report_id").alias("ts"))
    return DI.suggest_sites(d.providers, new).select("provider_id", "web_suggested")


PAGE_SQL = f"SELECT s.listing_id, s.provider_id, b.specialty_slug, p.city_slug, s.tagline, s.starts_on, s.ends_on FROM sponsored s JOIN providers p ON p.provider_id = s.provider_id JOIN bridge b ON b.provider_id = s.provider_id"


def listings(d):
    place = d.providers.select("provider_id", "city_slug")
    return d.sponsored.join(place, "provider_id").join(d.bridge, "provider_id")


@query("L8_sponsor_list", f"SELECT listing_id, specialty_slug, CAST(ends_on AS STRING) AS ends_on FROM ({PAGE_SQL}) WHERE ends_on >= DATE '{D.AS_OF_DATE}'")
def sponsor_list(d):
    return intake.running_listings(listings(d), d.as_of).select("listing_id", "specialty_slug", F.col("ends_on").cast("string").alias("ends_on"))


@query("L8_sponsor_end", f"""
    SELECT listing_id, CAST(CASE WHEN e THEN least(starts_on, DATE '{D.AS_OF_DATE}' - 1) ELSE starts_on END AS STRING) AS starts_on,
           CAST(CASE WHEN e THEN DATE '{D.AS_OF_DATE}' - 1 ELSE ends_on END AS STRING) AS ends_on
      FROM (SELECT s.*, o_orderstatus = 'F' AS e FROM sponsored s JOIN orders ON o_orderkey = listing_id)""")
def sponsor_end(d):
    """Listings of finished orders are ended."""
    done = d.given("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("listing_id"))
    out = intake.end_listings(d.sponsored, done, d.as_of)
    return out.select("listing_id", F.col("starts_on").cast("string").alias("starts_on"), F.col("ends_on").cast("string").alias("ends_on"))


@query("L8_sponsor_add", f"""
    SELECT specialty_slug, city_slug, count(*) AS n, CAST(min(starts_on) AS STRING) AS first FROM (
        SELECT specialty_slug, city_slug, starts_on FROM ({PAGE_SQL})
        UNION ALL SELECT 'zubar', coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'praha' END, p.city_slug), DATE '{D.AS_OF_DATE}' FROM orders JOIN providers p ON p.provider_id = o_custkey) GROUP BY 1, 2""")
def sponsor_add(d):
    new = d.given("orders").select(
        (F.col("o_orderkey") + 10**9).alias("listing_id"), F.col("o_custkey").alias("provider_id"), F.lit("zubar").alias("specialty_slug"),
        F.when(F.col("o_orderkey") % 2 == 0, "praha").alias("city_slug"), F.lit("Nově").alias("tagline"),
        F.lit(None).cast("date").alias("starts_on"), F.lit("2024-03-01").cast("date").alias("ends_on"),
    )
    out = intake.add_listings(listings(d), new, d.providers, d.as_of)
    return out.groupBy("specialty_slug", "city_slug").agg(F.count("*").alias("n"), F.min("starts_on").cast("string").alias("first"))


# ------------------------------------------------------------------------------- areas
# One diamond per nation with a diamond hole; centres spread over the country.
CX, CY = "12.5e0 + (n_nationkey % 5) * 1.3e0", "48.8e0 + ((n_nationkey - n_nationkey % 5) / 5) * 0.5e0"
AREA_SQL = f"SELECT n_name AS area, {CX} AS cx, {CY} AS cy FROM nation"
STEPS["areas"] = AREA_SQL
IN_SQL = """
    SELECT provider_id, area FROM providers JOIN areas ON abs(lng - cx) / 0.7e0 + abs(lat - cy) / 0.3e0 < 1 AND NOT abs(lng - cx) / 0.2e0 + abs(lat - cy) / 0.1e0 < 1"""


# The diamonds' own rule decides for points on an outline.
IN_DIAMOND = "abs(lng - cx) / 0.7e0 + abs(lat - cy) / 0.3e0 < 1 AND NOT abs(lng - cx) / 0.2e0 + abs(lat - cy) / 0.1e0 < 1"


def centres(d):
    return d.given("nation").select(F.col("n_name").alias("area"), F.expr(CX).alias("cx"), F.expr(CY).alias("cy"))


def located(d, outlines):
    points = d.providers.select("provider_id", "lat", "lng")
    return areas.inside(points, outlines.join(centres(d), "area"), outline=F.expr(IN_DIAMOND)).select("provider_id", "area")


def diamonds(d):
    nation = centres(d)
    at = lambda dx, dy: F.struct((F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y"))
    ring = lambda a, b: F.array(at(-a, 0.0), at(0.0, b), at(a, 0.0), at(0.0, -b), at(-a, 0.0))
    return nation.select("area", F.array(ring(0.7, 0.3), ring(0.2, 0.1)).alias("rings"))


@query("C13_point_in_polygon", IN_SQL)
def point_in_polygon(d):
    return located(d, diamonds(d))


@query("A13_polygons_source", f"SELECT area, count(*) AS practices FROM ({IN_SQL}) GROUP BY 1")
def polygons_source(d):
    """Outlines written as GeoJSON, read back, and used."""
    pairs = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.col("area").alias("name")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), pairs.alias("coordinates")).alias("geometry"),
    )
    folder = f"{shared_folder(d.spark)}/areas/{uuid.uuid4().hex}"
    # one document per nation: a small fixed dimension
    diamonds(d).select(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")).write.json(folder)
    outlines = read_polygons(d.spark, folder, "name", multi_line=False)
    return located(d, outlines).groupBy("area").agg(F.count("*").alias("practices"))
