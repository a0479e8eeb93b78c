"""Registered queries: status, cards, near-me, towns and areas, place search."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import values as V
from ..functions import contact as C
from ..functions import display as X
from ..functions import geo as G
from ..functions import status as S
from ..operators import cards as K
from ..operators import serve
from ..operators import status as ST
from ..sources import domain as D
from .registry import km_sql, query

POINT = (49.8, 15.4)
US = D.AS_OF_US


def us(column: str, name: str | None = None):
    return F.unix_micros(column).alias(name or column.replace("_at", "_us"))


# ------------------------------------------------------------------------------- status
@query("D1_provider_status", """
    SELECT provider_id, round(confidence, 3) AS confidence, round(score, 3) AS score, last_signal_us, status, last_source
      FROM status_full""")
def provider_status(d):
    return d.status.select("provider_id", "confidence", "score", us("last_signal_at"), "status", "last_source")


@query("E1_clinic_latest", "SELECT provider_id, status FROM clinic")
def clinic_latest(d):
    return ST.clinic_latest(d.signals, d.as_of)


@query("E2_last_source", "SELECT provider_id, source AS last_source FROM newest")
def last_source(d):
    return ST.last_source(d.signals, d.as_of)


@query("E5_latest_crawl_note", """
    SELECT provider_id, note, observed_us FROM (
        SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY observed_us DESC, signal_id DESC) AS rn
          FROM signals WHERE source = 'web_crawl' AND note IS NOT NULL) WHERE rn = 1""")
def latest_crawl_note(d):
    return ST.latest_crawl_note(d.signals).select("provider_id", "note", us("observed_at"))


@query("H11_decay", "SELECT signal_id, round(w, 6) AS w, v FROM weighted")
def decay(d):
    recent = d.signals.filter(ST.in_window(F.col("observed_at"), d.as_of))
    return ST.weigh(recent, d.as_of).select("signal_id", F.round("w", 6).alias("w"), "v")


@query("H31_source_weight", """
    SELECT source, status, count(*) AS n,
           min(CASE source WHEN 'clinic' THEN 1.0e0 WHEN 'region' THEN 0.8e0 WHEN 'user' THEN 0.6e0 WHEN 'web_crawl' THEN 0.4e0 END) AS weight,
           min(CASE status WHEN 'accepting' THEN 1.0e0 WHEN 'waitlist' THEN 0.3e0 ELSE -1.0e0 END) AS value
      FROM signals GROUP BY 1, 2""")
def source_weight(d):
    return d.signals.groupBy("source", "status").agg(
        F.count("*").alias("n"),
        F.min(S.source_weight(F.col("source"))).alias("weight"),
        F.min(S.status_value(F.col("status"))).alias("value"),
    )


@query("J6_late_future", f"""
    SELECT CASE WHEN observed_us <= {US} - 90 * {D.DAY_US} THEN 'late' WHEN observed_us > {US} + {D.HOUR_US} THEN 'future' ELSE 'counted' END AS fate,
           count(*) AS n FROM signals GROUP BY 1""")
def late_future(d):
    age = F.col("observed_at")
    fate = (
        F.when(ST.in_window(age, d.as_of), "counted").when(age > d.now, "future").otherwise("late")
    )
    return d.signals.groupBy(fate.alias("fate")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------------- cards and filters
CARD_SQL = "provider_id, status, last_signal_us, last_source, web, self_pay, english, english_site, insurers, specialties"


def card_cols():
    return [
        "provider_id", "status", us("last_signal_at"), "last_source", "web", "self_pay", "english", "english_site",
        F.array_join("insurers", ",").alias("insurers"), F.array_join("specialties", ",").alias("specialties"),
    ]


@query("C3_provider_cards", f"SELECT {CARD_SQL} FROM cards")
def provider_cards(d):
    return d.cards.select(*card_cols())


@query("C1_specialty_join", """
    SELECT b.specialty_slug AS specialty, count(*) AS n FROM providers p JOIN bridge b ON b.provider_id = p.provider_id
     WHERE p.active GROUP BY 1""")
def specialty_join(d):
    return d.listing.groupBy("specialty").agg(F.count("*").alias("n"))


@query("C2_status_left_join", """
    SELECT p.provider_id, coalesce(s.status, 'unknown') AS status FROM providers p
      LEFT JOIN status_full s ON s.provider_id = p.provider_id WHERE p.active""")
def status_left_join(d):
    return d.providers.filter("active").join(d.status, "provider_id", "left").select(
        "provider_id", F.coalesce("status", F.lit("unknown")).alias("status")
    )


@query("D12_insurers_arr", "SELECT provider_id, insurers FROM facts")
def insurers_arr(d):
    return K.flag_summary(d.flags, d.as_of).select("provider_id", F.array_join("insurers", ",").alias("insurers"))


@query("D13_specialties_arr", "SELECT provider_id, string_agg(specialty_slug, ',' ORDER BY specialty_slug) AS specialties FROM bridge GROUP BY 1")
def specialties_arr(d):
    return K.specialty_lists(d.bridge).select("provider_id", F.array_join("specialties", ",").alias("specialties"))


@query("B2_active_located", "SELECT region, count(*) AS n FROM providers WHERE active AND lat IS NOT NULL GROUP BY 1")
def active_located(d):
    return d.providers.filter("active AND lat IS NOT NULL").groupBy("region").agg(F.count("*").alias("n"))


@query("B8_city_regex", "SELECT provider_id, city_slug FROM providers WHERE regexp_matches(city_slug, '^praha(-[0-9]+)?$')")
def city_regex(d):
    return d.providers.filter(X.is_prague(F.col("city_slug"))).select("provider_id", "city_slug")


@query("B9_specialty_any", """
    SELECT provider_id, specialty_slug FROM bridge WHERE specialty_slug IN ('zubar', 'hygienistka')""")
def specialty_any(d):
    wanted = ["zubar", "hygienistka"]
    return d.bridge.filter(F.col("specialty_slug").isin(wanted)) if wanted else d.bridge


@query("B11_status_filter", """
    SELECT g AS grp, count(*) AS n FROM spec_cards CROSS JOIN (VALUES ('accepting'), ('unknown'), ('not_accepting'), ('english')) t(g)
     WHERE CASE g WHEN 'accepting' THEN status IN ('accepting', 'waitlist') WHEN 'unknown' THEN status IN ('unknown', 'mixed')
                  WHEN 'not_accepting' THEN status = 'not_accepting' ELSE english END GROUP BY 1""")
def status_filter(d):
    groups = ["accepting", "unknown", "not_accepting", "english"]
    hit = F.array_compact(F.array(*[F.when(S.in_group(F.col("status"), F.col("english"), g), F.lit(g)) for g in groups]))
    return d.spec_cards.select(F.explode(hit).alias("grp")).groupBy("grp").agg(F.count("*").alias("n"))


@query("B12_coord_bbox", """
    SELECT provider_id, lat BETWEEN 48.5e0 AND 51.1e0 AND lng BETWEEN 12.0e0 AND 18.9e0 AS register_box,
           lat > 48.4e0 AND lat < 51.2e0 AND lng > 12.0e0 AND lng < 19.0e0 AS signup_box,
           lat > 48.0e0 AND lat < 51.5e0 AND lng > 12.0e0 AND lng < 19.5e0 AS near_box,
           lat > 48.5e0 AND lat < 51.1e0 AND lng > 12.0e0 AND lng < 18.9e0 AS geocode_box
      FROM (SELECT provider_id, coalesce(lat, 0e0) + (provider_id % 3) * 0.3e0 AS lat, coalesce(lng, 0e0) AS lng FROM providers)""")
def coord_bbox(d):
    lat = F.coalesce("lat", F.lit(0.0)) + (F.col("provider_id") % 3) * F.lit(0.3)
    lng = F.coalesce("lng", F.lit(0.0))
    box = lambda b, name: G.in_box(lat, lng, b).alias(name)
    return d.providers.select(
        "provider_id", box(V.BOX_REGISTER, "register_box"), box(V.BOX_SIGNUP, "signup_box"),
        box(V.BOX_NEAR_PAGE, "near_box"), box(V.BOX_GEOCODE, "geocode_box"),
    )


@query("B13_effective_web", "SELECT provider_id, coalesce(nullif(web, ''), web_found) AS web FROM providers")
def effective_web(d):
    return d.providers.select("provider_id", C.effective_web(F.col("web"), F.col("web_found")).alias("web"))


@query("B14_flag_fresh", f"""
    SELECT flag, source, count(*) AS n, count(*) FILTER (WHERE source <> 'user' OR observed_us > epoch_us(TIMESTAMP '{D.AS_OF}' - INTERVAL 1 YEAR)) AS fresh
      FROM flags GROUP BY 1, 2""")
def flag_fresh(d):
    ok = S.flag_counts(F.col("source"), F.col("observed_at"), d.now)
    return d.flags.groupBy("flag", "source").agg(F.count("*").alias("n"), F.count_if(ok).alias("fresh"))


@query("E12_newest_flag", "SELECT provider_id, flag, source, observed_us FROM flags")
def newest_flag(d):
    return d.flags.select("provider_id", "flag", "source", us("observed_at"))


# ------------------------------------------------------------------------------- around a point
@query("M1_near", f"""
    SELECT p.provider_id, p.name, p.city, round({km_sql('49.8e0', '15.4e0', 'p.lat', 'p.lng')}, 2) AS km,
           coalesce(s.status, 'unknown') AS status, s.last_signal_us
      FROM providers p JOIN bridge b ON b.provider_id = p.provider_id AND b.specialty_slug = 'zubar'
      LEFT JOIN status_full s ON s.provider_id = p.provider_id
     WHERE p.active AND {km_sql('49.8e0', '15.4e0', 'p.lat', 'p.lng')} <= 60
     ORDER BY CASE coalesce(s.status, 'unknown') WHEN 'accepting' THEN 0 WHEN 'mixed' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END, 4, 1
     LIMIT 20""")
def near(d):
    here = serve.around(d.providers, *POINT, 60)
    status = ST.provider_status(K.of_these(d.signals, here), d.as_of)
    hits = serve.near(here, d.bridge, status, "zubar", *POINT, km=60, limit=20)
    return hits.select("provider_id", "name", "city", "km", "status", us("last_signal_at"))


@query("F3_near_order", f"""
    SELECT row_number() OVER (ORDER BY CASE status WHEN 'accepting' THEN 0 WHEN 'mixed' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END, km, provider_id) AS pos, provider_id, status, km FROM (
        SELECT p.provider_id, coalesce(s.status, 'unknown') AS status, round({km_sql('49.8e0', '15.4e0', 'p.lat', 'p.lng')}, 2) AS km
          FROM providers p JOIN bridge b ON b.provider_id = p.provider_id AND b.specialty_slug = 'zubar' LEFT JOIN status_full s ON s.provider_id = p.provider_id
         WHERE p.active AND {km_sql('49.8e0', '15.4e0', 'p.lat', 'p.lng')} <= 150)""")
def near_order(d):
    here = serve.around(d.providers, *POINT, 150)
    status = ST.provider_status(K.of_these(d.signals, here), d.as_of)
    return serve.near_order(here, d.bridge, status, "zubar", *POINT, km=150).select("pos", "provider_id", "status", "km")


@query("M2_nearby", f"""
    SELECT {CARD_SQL}, km FROM (
        SELECT *, round({km_sql('49.8e0', '15.4e0', 'lat', 'lng')}, 1) AS km FROM spec_cards
         WHERE specialty = 'zubar' AND {km_sql('49.8e0', '15.4e0', 'lat', 'lng')} <= 80 ORDER BY rank, km, provider_id LIMIT 30)""")
def nearby(d):
    here = serve.around(d.providers, *POINT, 80)
    cards = K.by_specialty(K.cards_of(here, d.bridge, d.signals, d.flags, d.as_of))
    return serve.nearby(cards, "zubar", *POINT, km=80).select(*card_cols(), "km")


@query("C4_near_circle", f"""
    SELECT provider_id, round({km_sql('49.8e0', '15.4e0', 'lat', 'lng')}, 6) AS km FROM providers
     WHERE {km_sql('49.8e0', '15.4e0', 'lat', 'lng')} <= 30""")
def near_circle(d):
    return serve._within(d.providers, *POINT, 30).select("provider_id", F.round("km", 6).alias("km"))


@query("H10_distance_km", f"SELECT provider_id, round({km_sql('50.0755e0', '14.4378e0', 'lat', 'lng')}, 6) AS km FROM providers")
def distance(d):
    lat, lng = V.PRAGUE_POINT
    return d.providers.select(
        "provider_id", F.round(G.distance_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")), 6).alias("km")
    )


@query("F1_status_rank_cli", """
    SELECT status, CASE status WHEN 'accepting' THEN 0 WHEN 'mixed' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END AS rank, count(*) AS n
      FROM cards GROUP BY 1""")
def status_rank_cli(d):
    return d.cards.groupBy("status").agg(F.first(S.rank_cli(F.col("status"))).alias("rank"), F.count("*").alias("n"))


@query("F2_status_rank_web", "SELECT status, rank, count(*) AS n FROM spec_cards GROUP BY 1, 2")
def status_rank_web(d):
    return d.listing.groupBy("status", S.rank_web(F.col("status")).alias("rank")).agg(F.count("*").alias("n"))


PAIR_SQL = f"""
    SELECT a.specialty, a.provider_id, c.provider_id AS other_id, c.rank, round({km_sql('a.lat', 'a.lng', 'c.lat', 'c.lng')}, 1) AS km
      FROM spec_cards a JOIN spec_cards c ON c.specialty = a.specialty AND c.provider_id <> a.provider_id
     WHERE {km_sql('a.lat', 'a.lng', 'c.lat', 'c.lng')} <= """


@query("C10_alternatives", f"""
    SELECT specialty, provider_id, other_id, rank, km, CAST(rn AS INT) AS rn FROM (
        SELECT *, row_number() OVER (PARTITION BY specialty, provider_id ORDER BY rank, km, other_id) AS rn FROM ({PAIR_SQL} 5)) WHERE rn <= 5""")
def alternatives(d):
    return serve.alternatives(d.listing)


@query("C11_accepting_nearby", f"""
    SELECT specialty, provider_id, other_id, rank, km, CAST(rn AS INT) AS rn FROM (
        SELECT *, row_number() OVER (PARTITION BY specialty, provider_id ORDER BY km, other_id) AS rn FROM ({PAIR_SQL} 10 AND c.rank = 0)) WHERE rn <= 3""")
def accepting_nearby(d):
    return serve.accepting_nearby(d.listing)


TOWN_PAIR = f"""
    SELECT t.specialty, t.city_slug, c.provider_id AS other_id, c.rank, c.english AS c_english, c.city_slug AS c_town,
           round({km_sql('t.lat', 't.lng', 'c.lat', 'c.lng')}, 1) AS km, {km_sql('t.lat', 't.lng', 'c.lat', 'c.lng')} AS exact, t.open, t.english
      FROM town_page_counts t JOIN spec_cards c ON c.specialty = t.specialty"""


@query("C15_practices_around", f"""
    SELECT specialty, city_slug, other_id, rank, km, CAST(rn AS INT) AS rn FROM (
        SELECT *, row_number() OVER (PARTITION BY specialty, city_slug ORDER BY rank, km, other_id) AS rn FROM ({TOWN_PAIR})
         WHERE exact <= CASE WHEN city_slug LIKE 'praha%' THEN 2 ELSE 5 END AND c_town IS DISTINCT FROM city_slug) WHERE rn <= 6""")
def practices_around(d):
    return serve.practices_around(d.listing)


@query("C16_open_fallback", f"""
    SELECT specialty, city_slug, other_id, rank, km, CAST(row_number() OVER (PARTITION BY specialty, city_slug ORDER BY rank, km, other_id) AS INT) AS rn FROM (
        SELECT *, row_number() OVER (PARTITION BY specialty, city_slug ORDER BY rank, km, other_id) AS pool FROM ({TOWN_PAIR})
         WHERE exact <= 30 AND open = 0) WHERE pool <= 12 AND rank <= 1 QUALIFY rn <= 4""")
def open_fallback(d):
    return serve.open_fallback(d.listing)


@query("M13_english_search", f"""
    SELECT specialty, city_slug, other_id, rank, km, CAST(row_number() OVER (PARTITION BY specialty, city_slug ORDER BY rank, km, other_id) AS INT) AS rn
      FROM ({TOWN_PAIR}) WHERE exact <= 25 AND english = 0 AND c_english AND c_town IS DISTINCT FROM city_slug QUALIFY rn <= 12""")
def english_search(d):
    return serve.english_nearby(d.spec_cards)


@query("M13_english_in_town", "SELECT specialty, city_slug, provider_id, rank FROM spec_cards WHERE english AND city_slug IS NOT NULL")
def english_in_town(d):
    return serve.english_in_town(d.spec_cards).select("specialty", "city_slug", "provider_id", S.rank_web(F.col("status")).alias("rank"))


@query("M13_english_prague", f"""
    SELECT provider_id, status, round({km_sql('50.0755e0', '14.4378e0', 'lat', 'lng')}, 1) AS km FROM spec_cards
     WHERE specialty = 'praktik' AND {km_sql('50.0755e0', '14.4378e0', 'lat', 'lng')} <= 25
       AND english AND regexp_matches(city_slug, '^praha(-[0-9]+)?$')""")
def english_prague(d):
    return serve.english_prague(d.spec_cards, "praktik").select("provider_id", "status", "km")


@query("F7_english_first", f"""
    SELECT provider_id, status, english, english_site, km FROM (
        SELECT *, round({km_sql('49.8e0', '15.4e0', 'lat', 'lng')}, 1) AS km FROM spec_cards
         WHERE specialty = 'praktik' AND {km_sql('49.8e0', '15.4e0', 'lat', 'lng')} <= 120)
     WHERE english ORDER BY rank, english_site DESC, km, provider_id LIMIT 30""")
def english_first(d):
    rows = serve.english_first(d.spec_cards, "praktik", *POINT, km=120, english_only=True)
    return rows.select("provider_id", "status", "english", "english_site", "km")


@query("F10_near_params", """
    SELECT subscription_id, least(greatest(coalesce(CAST(nullif(radius_km, 50) AS DOUBLE), 5e0), 1e0), 30e0) AS km FROM subscriptions""")
def near_params(d):
    return d.subscriptions.select(
        "subscription_id", serve.clamp_km(F.nullif("radius_km", F.lit(50)).cast("double")).alias("km")
    )


# ------------------------------------------------------------------------------- towns and areas
@query("M3_city_providers", f"""
    SELECT CAST(row_number() OVER (ORDER BY rank, self_pay, last_signal_us DESC NULLS LAST, name, provider_id) AS INT) AS pos, {CARD_SQL}
      FROM spec_cards WHERE specialty = 'zubar' AND city_slug = 'praha-1'""")
def city_providers(d):
    rows = serve.town_list(d.spec_cards, "zubar", "praha-1")
    # one town's list, numbered so that the check sees the order
    from pyspark.sql import Window as W

    place = W.partitionBy("specialty", "city_slug").orderBy(*serve.town_order())
    return rows.withColumn("pos", F.row_number().over(place)).select("pos", *card_cols())


@query("F4_town_order", """
    SELECT specialty, city_slug, provider_id, CAST(rn AS INT) AS rn FROM (
        SELECT *, row_number() OVER (PARTITION BY specialty, city_slug ORDER BY rank, self_pay, last_signal_us DESC NULLS LAST, name, provider_id) AS rn
          FROM spec_cards WHERE city_slug IS NOT NULL)""")
def town_order(d):
    from pyspark.sql import Window as W

    place = W.partitionBy("specialty", "city_slug").orderBy(*serve.town_order())
    rows = d.spec_cards.filter("city_slug IS NOT NULL").withColumn("rn", F.row_number().over(place))
    return rows.select("specialty", "city_slug", "provider_id", "rn")


@query("E7_town_page_cut", """
    SELECT specialty, city_slug, provider_id, status FROM (
        SELECT *, row_number() OVER (PARTITION BY specialty, city_slug ORDER BY rank, self_pay, last_signal_us DESC NULLS LAST, name, provider_id) AS rn,
               count(*) FILTER (WHERE rank <= 1) OVER (PARTITION BY specialty, city_slug) AS open
          FROM spec_cards WHERE city_slug IS NOT NULL) WHERE rn <= greatest(30, open + 6)""")
def town_page_cut(d):
    return serve.town_page(d.spec_cards)


TOWN_SQL = """specialty, city_slug, city, region, district, n, round(lat, 6) AS lat, round(lng, 6) AS lng, accepting"""


def town_cols():
    return [
        "specialty", "city_slug", "city", "region", "district", "n", F.round("lat", 6).alias("lat"),
        F.round("lng", 6).alias("lng"), "accepting",
    ]


LABEL_SQL = """CASE WHEN district IS NOT NULL AND city_slug <> trim(regexp_replace(lower(strip_accents(city)), '[^a-z0-9]+', '-', 'g'), '-')
                    THEN city || ' (okres ' || district || ')' ELSE city END"""


@query("D2_cities", f"SELECT {TOWN_SQL}, {LABEL_SQL} AS label FROM town_rows")
def cities(d):
    return serve.towns(d.listing).select(*town_cols(), "label")


@query("D2_cities_ranked", f"SELECT {TOWN_SQL} FROM town_rows WHERE specialty = 'zubar' AND n >= 2 ORDER BY n DESC, city, city_slug LIMIT 10000")
def cities_ranked(d):
    return serve.towns_ranked(serve.towns(d.listing, 2), "zubar").select(*town_cols())


@query("H20_place_label", f"SELECT provider_id, {LABEL_SQL} AS label FROM providers WHERE city IS NOT NULL")
def place_label(d):
    return d.providers.filter("city IS NOT NULL").select(
        "provider_id", X.place_label(F.col("city"), F.col("city_slug"), F.col("district")).alias("label")
    )


@query("D3_availability", "SELECT specialty, region, district, status, count(*) AS n FROM spec_cards GROUP BY 1, 2, 3, 4")
def availability(d):
    return serve.availability(d.listing)


TALLY_SQL = """
    SELECT specialty, region, district, CASE grouping_id(specialty, region, district) WHEN 0 THEN 'district' WHEN 1 THEN 'region' ELSE 'country' END AS level,
           count(*) AS n, count(*) FILTER (WHERE status = 'accepting') AS accepting, count(*) FILTER (WHERE status = 'waitlist') AS waitlist,
           count(*) FILTER (WHERE status = 'not_accepting') AS not_accepting, count(*) FILTER (WHERE status <> 'unknown') AS known
      FROM (SELECT specialty, region, coalesce(district, '') AS district, status FROM spec_cards WHERE region IS NOT NULL)
     GROUP BY GROUPING SETS ((specialty), (specialty, region), (specialty, region, district))"""


@query("D4_availability_tally", TALLY_SQL)
def availability_tally(d):
    return serve.availability_tally(serve.availability(d.listing))


@query("H28_share_pct", f"""
    SELECT specialty, region, district, level, round(share, 6) AS share,
           CASE WHEN share >= 10 THEN 4 WHEN share >= 5 THEN 3 WHEN share >= 2 THEN 2 WHEN share >= 0.0001e0 THEN 1 ELSE 0 END AS shade
      FROM (SELECT *, CASE WHEN n = 0 THEN 0e0 ELSE 100e0 * accepting / n END AS share FROM ({TALLY_SQL}))""")
def share_pct(d):
    share = X.share_pct(F.col("accepting"), F.col("n"))
    t = serve.availability_tally(serve.availability(d.listing)).withColumn("share", share)
    return t.select("specialty", "region", "district", "level", F.round("share", 6).alias("share"), X.colour_bucket(F.col("share")).alias("shade"))


@query("M12_availability_report", f"""
    SELECT specialty, region, district, level, n, accepting, waitlist, not_accepting, known, round(100e0 * accepting / n, 6) AS share
      FROM ({TALLY_SQL}) WHERE specialty = 'zubar'""")
def availability_report(d):
    rows = d.listing.filter(F.col("specialty") == "zubar")
    t = serve.availability_tally(serve.availability(rows))
    return t.withColumn("share", F.round(X.share_pct(F.col("accepting"), F.col("n")), 6)).orderBy("level", *X.natural_order(F.col("region")), "district")


@query("D5_specialty_totals", "SELECT specialty, CAST(sum(n) AS BIGINT) AS n, CAST(sum(accepting) AS BIGINT) AS accepting FROM town_rows GROUP BY 1")
def specialty_totals(d):
    return serve.specialty_totals(serve.towns(d.listing))


@query("D6_english_counts", f"""
    SELECT b.specialty_slug AS specialty, count(DISTINCT p.provider_id) AS n
      FROM providers p JOIN bridge b ON b.provider_id = p.provider_id
      JOIN flags f ON f.provider_id = p.provider_id AND f.flag = 'english'
       AND (f.source <> 'user' OR f.observed_us > epoch_us(TIMESTAMP '{D.AS_OF}' - INTERVAL 1 YEAR))
     WHERE p.active GROUP BY 1""")
def english_counts(d):
    return serve.english_counts(d.bridge, d.providers, d.flags, d.as_of)


@query("D7_postcode_centroid", """
    SELECT postcode, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM providers WHERE active AND lat IS NOT NULL GROUP BY 1""")
def postcode_centroid(d):
    return serve.postcode_centroid(d.providers).select("postcode", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


def area_sql(by):
    return f"""SELECT specialty, {by}, count(*) AS towns, CAST(sum(n) AS BIGINT) AS n, CAST(sum(accepting) AS BIGINT) AS accepting
                 FROM town_rows WHERE {by} IS NOT NULL GROUP BY 1, 2"""


@query("D9_region_page", area_sql("region"))
def region_page(d):
    return serve.area_totals(serve.towns(d.listing), "region")


@query("D9_district_page", area_sql("district"))
def district_page(d):
    return serve.area_totals(serve.towns(d.listing), "district")


@query("D10_prague_hub", """
    SELECT specialty, count(*) AS parts, CAST(sum(n) AS BIGINT) AS n, CAST(sum(accepting) AS BIGINT) AS accepting
      FROM town_rows WHERE regexp_matches(city_slug, '^praha(-[0-9]+)?$') GROUP BY 1""")
def prague_hub(d):
    return serve.prague_totals(serve.towns(d.listing))


@query("D11_town_counts", """
    SELECT specialty, city_slug, n, accepting, waitlist, mixed, unknown, not_accepting, known, open, english,
           round(lat, 6) AS lat, round(lng, 6) AS lng FROM town_page_counts""")
def town_counts(d):
    return serve.town_counts(d.spec_cards).withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})


@query("D15_sitemap_towns", "SELECT specialty, city_slug, n FROM town_rows WHERE n >= 3")
def sitemap_towns(d):
    return serve.sitemap_towns(d.listing)


@query("D16_towns_per_district", """
    SELECT specialty, lower(replace(district, '_', '-')) AS district_slug, count(*) AS towns FROM town_rows
     WHERE district IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2""")
def towns_per_district(d):
    return serve.towns_per_district(serve.towns(d.listing))


@query("E8_top_towns", """
    SELECT specialty, district, city_slug, n, CAST(rn AS INT) AS rn FROM (
        SELECT *, row_number() OVER (PARTITION BY specialty, district ORDER BY n DESC, city, city_slug) AS rn FROM town_rows WHERE district IS NOT NULL)
     WHERE rn <= 8""")
def top_towns(d):
    return serve.top_towns(serve.towns(d.listing), "district").select("specialty", "district", "city_slug", "n", "rn")


OPEN_TOP = """
    SELECT specialty, {by} provider_id, status, CAST(rn AS INT) AS rn FROM (
        SELECT *, row_number() OVER (PARTITION BY specialty {part} ORDER BY rank, last_signal_us DESC NULLS LAST, provider_id) AS rn
          FROM spec_cards WHERE rank <= 1 {where}) WHERE rn <= {k}"""


@query("F5_accepting_prague", OPEN_TOP.format(by="", part="", k=24, where="AND regexp_matches(city_slug, '^praha(-[0-9]+)?$')"))
def accepting_prague(d):
    rows = d.spec_cards.filter(X.is_prague(F.col("city_slug")))
    return serve.accepting_top(rows, ["specialty"], 24).select("specialty", "provider_id", "status", "rn")


@query("F5_accepting_regions", OPEN_TOP.format(by="region,", part=", region", k=12, where=""))
def accepting_regions(d):
    return serve.accepting_top(d.spec_cards, ["specialty", "region"], 12).select("specialty", "region", "provider_id", "status", "rn")


@query("B10_district_filter", """
    SELECT provider_id, status, CAST(row_number() OVER (ORDER BY rank, last_signal_us DESC NULLS LAST, provider_id) AS INT) AS rn FROM spec_cards
     WHERE rank <= 1 AND specialty = 'zubar' AND region = 'EUROPE'
       AND district = (SELECT min(n_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')
   QUALIFY rn <= 12""")
def district_filter(d):
    """The twelve best open practices of one district."""
    first = (
        d.given("nation").join(d.given("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .filter("r_name = 'EUROPE'").agg(F.min("n_name")).scalar()
    )
    rows = d.spec_cards.filter("specialty = 'zubar' AND region = 'EUROPE'").filter(F.col("district") == first)
    return serve.accepting_top(rows, ["specialty", "region"], 12).select("provider_id", "status", "rn")


@query("F6_natural_place_order", """
    SELECT city_slug, CAST(row_number() OVER (ORDER BY city_slug = 'praha', CAST(nullif(regexp_extract(city, '([0-9]+)$', 1), '') AS INT) NULLS FIRST) AS INT) AS pos
      FROM town_rows WHERE specialty = 'zubar' AND regexp_matches(city_slug, '^praha(-[0-9]+)?$')""")
def natural_place_order(d):
    from pyspark.sql import Window as W

    rows = serve.prague_parts(serve.towns(d.listing), "zubar")
    order = W.partitionBy("specialty").orderBy(F.col("city_slug") == "praha", *X.natural_order(F.col("city")))
    return rows.withColumn("pos", F.row_number().over(order)).select("city_slug", "pos")


@query("G1_sitemap_entries", """
    SELECT 'city' AS kind, specialty, city_slug AS slug, '' AS name FROM town_rows WHERE n >= 3
    UNION ALL SELECT 'provider', NULL, CAST(provider_id AS VARCHAR), name FROM providers WHERE active""")
def sitemap_entries(d):
    return serve.sitemap_entries(d.listing, d.providers)


@query("A11_sitemap_sink", """
    SELECT CAST(ceil(pos / 50000) AS INT) AS file, 'https://example.org' || path AS url FROM (
        SELECT path, row_number() OVER (ORDER BY kind, path) AS pos FROM (
            SELECT 'city' AS kind, unnest(['/' || specialty || '/' || city_slug, '/en/' || specialty || '/' || city_slug]) AS path FROM town_rows WHERE n >= 3
            UNION ALL
            SELECT 'provider', '/lekar/' || CAST(provider_id AS VARCHAR) || '-' || trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '-', 'g'), '-')
              FROM providers WHERE active))""")
def sitemap_sink(d):
    return serve.sitemap_urls(serve.sitemap_entries(d.listing, d.providers), "https://example.org/")


@query("M4_provider_detail", f"""
    SELECT {CARD_SQL}, note AS crawl_note FROM cards c LEFT JOIN (
        SELECT provider_id AS pid, note, row_number() OVER (PARTITION BY provider_id ORDER BY observed_us DESC, signal_id DESC) AS rn
          FROM signals WHERE source = 'web_crawl' AND note IS NOT NULL) n ON n.pid = c.provider_id AND n.rn = 1
     WHERE c.provider_id = 8""")
def provider_detail(d):
    return serve.provider_detail(d.cards, ST.latest_crawl_note(d.signals), 8).select(*card_cols(), "crawl_note")


@query("M4_alternatives", f"""
    SELECT specialty, other_id, rank, km, CAST(row_number() OVER (PARTITION BY specialty ORDER BY rank, km, other_id) AS INT) AS rn FROM (
        SELECT o.specialty, o.provider_id AS other_id, o.rank, round({km_sql('m.lat', 'm.lng', 'o.lat', 'o.lng')}, 1) AS km
          FROM spec_cards m JOIN spec_cards o ON o.specialty = m.specialty AND o.provider_id <> m.provider_id
         WHERE m.provider_id = 8 AND {km_sql('m.lat', 'm.lng', 'o.lat', 'o.lng')} <= 40) QUALIFY rn <= 5""")
def one_alternatives(d):
    """Others of its kind around one practice; a wide circle, as the given points lie far apart."""
    return serve.provider_alternatives(d.spec_cards, 8, km=40).select("specialty", "other_id", "rank", "km", "rn")


# ------------------------------------------------------------------------------- sponsored
LIVE_SQL = f"""
    SELECT s.listing_id, s.provider_id, b.specialty_slug, p.city_slug, s.tagline, p.name, md5('0|' || CAST(s.listing_id AS VARCHAR)) AS dice
      FROM sponsored s JOIN providers p ON p.provider_id = s.provider_id AND p.active
      JOIN bridge b ON b.provider_id = s.provider_id
     WHERE DATE '{D.AS_OF_DATE}' BETWEEN s.starts_on AND s.ends_on AND p.city_slug IS NOT NULL"""


def _listings(d):
    """A listing is shown on its practice's own (specialty, town) pages."""
    place = d.providers.select("provider_id", "city_slug").filter("city_slug IS NOT NULL")
    return d.sponsored.join(place, "provider_id").join(d.bridge, "provider_id")


@query("B15_active_window", f"""
    SELECT listing_id FROM sponsored WHERE DATE '{D.AS_OF_DATE}' BETWEEN starts_on AND ends_on""")
def active_window(d):
    return serve.sponsored_now(d.sponsored, d.as_of).select("listing_id")


@query("C9_sponsored_join", f"SELECT specialty_slug, city_slug, count(*) AS n FROM ({LIVE_SQL}) GROUP BY 1, 2")
def sponsored_join(d):
    live = serve.sponsored_now(_listings(d), d.as_of).join(d.providers.filter("active").select("provider_id"), "provider_id", "left_semi")
    return live.groupBy("specialty_slug", "city_slug").agg(F.count("*").alias("n"))


@query("M14_sponsored", f"""
    SELECT specialty_slug, city_slug, listing_id, name, tagline, CAST(rn AS INT) AS rn FROM (
        SELECT *, row_number() OVER (PARTITION BY specialty_slug, city_slug ORDER BY dice, listing_id) AS rn FROM ({LIVE_SQL})) WHERE rn <= 2""")
def sponsored(d):
    rows = serve.sponsored(_listings(d), d.cards, d.as_of)
    return rows.select("specialty_slug", "city_slug", "listing_id", "name", "tagline", "rn")


@query("F8_random_k", f"SELECT listing_id FROM ({LIVE_SQL} AND b.specialty_slug = 'zubar' AND p.city_slug = 'praha-1') ORDER BY dice, listing_id LIMIT 2")
def random_k(d):
    page = serve.sponsored_now(_listings(d), d.as_of).filter("specialty_slug = 'zubar' AND city_slug = 'praha-1'")
    page = page.join(d.providers.filter("active").select("provider_id"), "provider_id", "left_semi")
    return page.orderBy(serve.shuffled("0", "listing_id"), "listing_id").limit(2).select("listing_id")


# ------------------------------------------------------------------------------- place search
SLUG_Q = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', '-', 'g'), '-')"


@query("E9_suggest_rank", f"""
    WITH asked AS (SELECT DISTINCT specialty, {SLUG_Q.format('q')} AS needle FROM searches),
    hits AS (
        SELECT a.specialty, a.needle, t.city_slug, t.n,
               CASE WHEN starts_with(t.city_slug, a.needle) THEN 0 WHEN contains(t.city_slug, '-' || a.needle) THEN 1
                    WHEN length(a.needle) >= 3 AND contains(replace(t.city_slug, '-', ''), replace(a.needle, '-', '')) THEN 2 END AS kind
          FROM asked a JOIN town_rows t ON t.specialty = a.specialty WHERE length(a.needle) >= 2
        UNION ALL SELECT specialty, needle, 'praha', 0, -1 FROM asked
         WHERE length(needle) >= 2 AND (starts_with('praha', needle) OR starts_with('prague', needle)))
    SELECT specialty, needle, city_slug, n, kind, CAST(rn AS INT) AS rn FROM (
        SELECT *, row_number() OVER (PARTITION BY specialty, needle ORDER BY kind, n DESC, city_slug) AS rn FROM hits WHERE kind IS NOT NULL) WHERE rn <= 8""")
def suggest_rank(d):
    return serve.suggest(d.searches, serve.towns(d.listing)).select("specialty", "needle", "city_slug", "n", "kind", "rn")


PARTS_SQL = "(VALUES " + ", ".join(
    f"('{name}', 'praha-{n}')" for n, names in V.PRAGUE_PARTS.items() for name in names
) + ") AS v(name, slug)"


@query("C17_lookup_join", f"""
    SELECT s.q, v.slug, count(*) AS n FROM searches s
      JOIN {PARTS_SQL} ON replace({SLUG_Q.format('v.name')}, '-', '') = regexp_replace(replace({SLUG_Q.format('s.q')}, '-', ''), '^praha', '')
     GROUP BY 1, 2""")
def lookup_join(d):
    from ..functions.text import flat

    part = F.regexp_replace(flat(F.col("q")), "^praha", "")
    parts = F.broadcast(serve.prague_dictionary(d.spark))  # fixed list
    return d.searches.withColumn("part", part).join(parts, "part").groupBy("q", "slug").agg(F.count("*").alias("n"))


@query("H29_postcode_query", """
    SELECT q, lat, lng FROM (SELECT DISTINCT q FROM searches) s
      JOIN (SELECT postcode, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM providers WHERE active AND lat IS NOT NULL GROUP BY 1) p
        ON p.postcode = regexp_replace(s.q, '\\s+', '', 'g') AND regexp_matches(p.postcode, '^[0-9]{5}$')""")
def postcode_query(d):
    code = F.regexp_replace("q", r"\s+", "")
    asked = d.searches.select("q").distinct().withColumn("postcode", code).filter(F.col("postcode").rlike(r"^\d{5}$"))
    hit = asked.join(serve.postcode_centroid(d.providers), "postcode")
    return hit.select("q", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query("M5_find_place", f"""
    WITH asked AS (
        SELECT *, regexp_replace(replace(slug, '-', ''), '^prague', 'praha') AS needle
          FROM (SELECT DISTINCT specialty, q, {SLUG_Q.format('q')} AS slug FROM searches)),
    named AS (
        SELECT *, row_number() OVER (PARTITION BY specialty, q ORDER BY fit, n DESC, city_slug) AS rn FROM (
            SELECT a.specialty, a.q, t.city_slug, t.n,
                   CASE WHEN replace(t.city_slug, '-', '') = a.needle THEN 0 WHEN starts_with(replace(t.city_slug, '-', ''), a.needle) THEN 1 ELSE 2 END AS fit
              FROM asked a JOIN town_rows t ON t.specialty = a.specialty AND contains(replace(t.city_slug, '-', ''), a.needle)
             WHERE a.needle <> '') ),
    hit AS (SELECT specialty, q, count(*) AS n_match, count(*) FILTER (WHERE fit = 0) AS n_exact,
                   string_agg(city_slug, ',' ORDER BY rn) FILTER (WHERE rn <= 30) AS matches FROM named GROUP BY 1, 2),
    ways AS (
        SELECT specialty, q, 0 AS step, 'praha-' || regexp_extract(slug, '^(?:praha|prague)-?([0-9]{{1,2}})(?:$|-)', 1) AS way FROM asked
        UNION ALL SELECT a.specialty, a.q, 1, v.slug FROM asked a
          JOIN {PARTS_SQL} ON replace({SLUG_Q.format('v.name')}, '-', '') = regexp_replace(a.needle, '^praha', '')
        UNION ALL SELECT specialty, q, 100 - k, array_to_string(list_slice(string_split(slug, '-'), 1, k), '-')
          FROM (SELECT *, unnest(range(1, len(string_split(slug, '-')))) AS k FROM asked)),
    other AS (SELECT w.specialty, w.q, min_by(way, step) AS way FROM ways w JOIN town_rows t ON t.specialty = w.specialty AND t.city_slug = w.way GROUP BY 1, 2),
    code AS (SELECT postcode, avg(lat) AS lat, avg(lng) AS lng FROM providers WHERE active AND lat IS NOT NULL GROUP BY 1),
    whole AS (
        SELECT a.specialty, a.q, a.needle, h.matches, o.way, c.lat, c.lng,
               CASE WHEN needle = '' THEN 'none' WHEN needle IN ('praha', 'prag') THEN 'city' WHEN n_match = 1 OR n_exact = 1 THEN 'city'
                    WHEN n_match > 0 THEN 'list' WHEN o.way IS NOT NULL THEN 'city' WHEN c.lat IS NOT NULL THEN 'near' ELSE 'none' END AS kind
          FROM asked a LEFT JOIN hit h ON h.specialty = a.specialty AND h.q = a.q LEFT JOIN other o ON o.specialty = a.specialty AND o.q = a.q
          LEFT JOIN code c ON c.postcode = regexp_replace(a.q, '\\s+', '', 'g'))
    SELECT specialty, q, kind,
           CASE WHEN kind = 'city' THEN CASE WHEN needle IN ('praha', 'prag') THEN 'praha' WHEN matches IS NOT NULL THEN split_part(matches, ',', 1) ELSE way END END AS city_slug,
           CASE WHEN kind = 'list' THEN matches END AS matches,
           CASE WHEN kind = 'near' THEN round(lat, 6) END AS lat, CASE WHEN kind = 'near' THEN round(lng, 6) END AS lng
      FROM whole""")
def find_place(d):
    found = serve.resolve_places(d.searches, serve.towns(d.listing), serve.postcode_centroid(d.providers))
    return found.withColumns(
        {"matches": F.array_join("matches", ","), "lat": F.round("lat", 6), "lng": F.round("lng", 6)}
    )
