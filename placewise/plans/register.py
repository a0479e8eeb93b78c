"""Registered queries: the register from raw rows to the next snapshot."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import values as V
from ..functions import contact as C
from ..functions import display as X
from ..functions import geo as G
from ..functions import text as T
from ..operators import register as R
from ..session import shared_folder, spread
from ..sources import domain as D
from ..sources import sinks
from ..sources.register import read_register, resolve_columns
from .registry import STEPS, query

quote = lambda s: "'" + s.replace("'", "''") + "'"
RULES_SQL = "(VALUES " + ", ".join(f"({quote(l)}, '{slug}')" for slug, _, labels in V.SPECIALTIES for l in labels) + ") AS r(label, slug)"
SPECIALISTS_SQL = ", ".join(f"'{s}'" for s in V.SPECIALISTS)
CLOSED_SQL = " OR ".join(f"contains(kind, {quote(c)})" for c in V.CLOSED_FACILITIES)
SINGLE_SQL = " ".join(
    f"WHEN contains(kind, {quote(k)}) THEN slug IN ({', '.join(quote(x) for x in keep)})" for k, keep in V.SINGLE_KIND
)
PSYCH_SQL = " OR ".join(f"contains(kind, {quote(c)})" for c in V.PSYCHIATRY_ONLY)
SLUG = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', '-', 'g'), '-')"
NUMBER = "TRY_CAST(replace(trim({}), ',', '.') AS DOUBLE)"

STEPS.update({
    "reg_clean": "SELECT row_no, " + ", ".join(
        f"nullif(trim({c}), '') AS {c}" for c in D.REGISTER_ROWS if c != "row_no"
    ) + " FROM register_rows",
    "reg_parsed": f"""
        SELECT *, CASE WHEN ok1 THEN a WHEN ok2 THEN b END AS la, CASE WHEN ok1 THEN b WHEN ok2 THEN a END AS ln FROM (
            SELECT *, coalesce(a BETWEEN 48.5e0 AND 51.1e0 AND b BETWEEN 12.0e0 AND 18.9e0, false) AS ok1,
                   coalesce(b BETWEEN 48.5e0 AND 51.1e0 AND a BETWEEN 12.0e0 AND 18.9e0, false) AS ok2 FROM (
                SELECT *, CASE WHEN n1 IS NULL OR n2 IS NULL THEN coalesce({NUMBER.format("g[1]")}, n1) ELSE n1 END AS a,
                       CASE WHEN n1 IS NULL OR n2 IS NULL THEN coalesce({NUMBER.format("g[2]")}, n2) ELSE n2 END AS b FROM (
                    SELECT * EXCLUDE (specialties), coalesce(place_id, concat_ws('|', coalesce(facility_id, ico, name), city, street, house_no)) AS pid,
                           CASE WHEN regexp_matches(lower(name), 'domov pro seniory') THEN '' ELSE coalesce(specialties, '') END AS raw,
                           lower(coalesce(facility_type, '')) AS kind, {NUMBER.format("lat")} AS n1, {NUMBER.format("lng")} AS n2,
                           string_split_regex(gps, '[\\s;]+|,\\s+') AS g,
                           {SLUG.format("city")} AS slug_plain, nullif(replace(coalesce(postcode, ''), ' ', ''), '') AS pc
                      FROM reg_clean WHERE name IS NOT NULL)))""",
    "reg_spec": f"""
        SELECT DISTINCT row_no, pid, slug FROM (
            SELECT row_no, pid, kind, care_form, unnest(string_split_regex(raw, '[,;|]')) AS label FROM reg_parsed) x
          JOIN {RULES_SQL} ON r.label = lower(trim(x.label))
         WHERE NOT ({CLOSED_SQL}) AND (care_form IS NULL OR contains(lower(care_form), 'ambulant') OR slug NOT IN ({SPECIALISTS_SQL}))
           AND CASE {SINGLE_SQL} WHEN {PSYCH_SQL} THEN slug = 'psychiatr' ELSE true END""",
    "reg_merged": """
        SELECT p.*, s.specialties, l.raw_specialties FROM (
            SELECT *, row_number() OVER (PARTITION BY pid ORDER BY row_no) AS rn FROM reg_parsed) p
          JOIN (SELECT pid, string_agg(DISTINCT slug, ',' ORDER BY slug) AS specialties FROM reg_spec GROUP BY 1) s ON s.pid = p.pid
          LEFT JOIN (SELECT pid, string_agg(raw, ', ' ORDER BY o) AS raw_specialties FROM (
                       SELECT pid, raw, min(row_no) AS o FROM reg_parsed WHERE raw <> '' GROUP BY 1, 2) GROUP BY 1) l ON l.pid = p.pid
         WHERE p.rn = 1""",
    "reg_counts": "SELECT slug_plain, district, count(*) AS n FROM reg_merged WHERE slug_plain IS NOT NULL AND district IS NOT NULL GROUP BY 1, 2",
    "reg_places": f"""
        SELECT m.* EXCLUDE (place_id), pid AS place_id, CASE WHEN k.districts > 1 AND m.district <> k.main THEN slug_plain || '-' || {SLUG.format("replace(m.district, '_', '-')")} ELSE slug_plain END AS city_slug
          FROM reg_merged m LEFT JOIN (
            SELECT slug_plain AS s, count(*) AS districts, arg_max(district, row(n, district)) AS main FROM reg_counts GROUP BY 1) k ON k.s = m.slug_plain""",
    "prev": f"""
        SELECT c_custkey AS provider_id, 'R' || CAST(c_custkey AS STRING) AS place_id, 'Starý ' || c_name AS name, c_acctbal > -500 AS active,
               CASE WHEN c_custkey % 2 = 0 THEN 'http://old' || CAST(c_custkey AS STRING) || '.cz/' END AS web_found FROM customer""",
})


def places_of(d):
    return R.places_from_rows(d.register_rows, F.col("row_no"))


def previous(d):
    """The snapshot before the import: every customer as an already known place."""
    old = d.given("customer").select(
        F.col("c_custkey").alias("provider_id"), F.concat(F.lit("R"), F.col("c_custkey").cast("string")).alias("place_id"),
        F.concat(F.lit("Starý "), "c_name").alias("name"), (F.col("c_acctbal") > -500).alias("active"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("http://old"), F.col("c_custkey").cast("string"), F.lit(".cz/"))).alias("web_found"),
    )
    blank = [c for c in R.ATTRIBUTES + ["raw_specialties"] if c not in ("name", "lat", "lng")]
    day = F.timestamp_micros(F.lit(D.AS_OF_US - 30 * D.DAY_US))
    return old.select(
        "*", *[F.lit(None).cast("string").alias(c) for c in blank + ["web_check_error", "web_found_source", "web_suggested"]],
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"),
        day.alias("first_seen_at"), day.alias("last_seen_at"),
        F.lit(None).cast("timestamp").alias("web_checked_at"), F.lit(None).cast("timestamp").alias("web_search_at"),
    )


PLACE_COLS = "place_id, name, facility_type, city, city_slug, postcode, district, lat, lng, email, web, specialties, raw_specialties"


def place_cols():
    return [
        "place_id", "name", "facility_type", "city", "city_slug", "postcode", "district", "lat", "lng", "email", "web",
        F.array_join("specialties", ",").alias("specialties"), "raw_specialties",
    ]


PLACES_SQL = "SELECT place_id, name, facility_type, city, city_slug, pc AS postcode, district, la AS lat, ln AS lng, email, web, specialties, raw_specialties FROM reg_places"


def register_files(d):
    """The register as two exports: UTF-8 with commas and old headers, windows-1250 with semicolons and new ones; several files each."""
    root = f"{shared_folder(d.spark)}/register/{uuid.uuid4().hex}"  # files of their own per run
    middle = d.register_rows.agg(F.max("row_no") / 2).scalar()
    for name, part, alias, options in (
        ("a", F.col("row_no") < middle, 0, {}), ("b", F.col("row_no") >= middle, -1, {"sep": ";", "encoding": "windows-1250"}),
    ):
        rows = d.register_rows.filter(part).repartitionByRange(4, "row_no").sortWithinPartitions("row_no")
        rows = rows.select(*[F.col(f).alias(V.FIELD_ALIASES[f][alias]) for f in V.FIELD_ALIASES if f in rows.columns])
        rows.write.options(header=True, escape='"', **options).csv(f"{root}/{name}")
    return [f"{root}/a", f"{root}/b"]


@query("A1_register_read", PLACES_SQL)
def register_read(d):
    """Files written, their encoding, separator and headers found out again, rows in file order, places merged."""
    return read_register(d.spark, register_files(d)).select(*place_cols())


@query("E3_place_merge", "SELECT pid AS place_id, name, specialties, raw_specialties FROM reg_merged")
def place_merge(d):
    m = R.merge_places(R.parse_rows(d.register_rows, F.col("row_no")))
    return m.select("place_id", "name", F.array_join("specialties", ",").alias("specialties"), "raw_specialties")


@query("A2_resolve_columns", "SELECT count(*) AS n, count(nullif(trim(name), '')) AS named, count(nullif(trim(specialties), '')) AS labelled FROM register_rows")
def bind_columns(d):
    """Rows under the register's own headers, bound back to canonical names."""
    headers = {f: V.FIELD_ALIASES[f][0] for f in V.FIELD_ALIASES if f in d.register_rows.columns}
    given = d.register_rows.select(*[F.col(f).alias(h) for f, h in headers.items()])
    bound = resolve_columns(given.columns)
    rows = given.select(*[F.col(h).alias(f) for f, h in bound.items()])
    has = lambda c: F.count(T.clean(F.col(c)))
    return rows.agg(F.count("*").alias("n"), has("name").alias("named"), has("specialties").alias("labelled"))


@query("A3_label_profile", f"""
    SELECT c.label, n, r.slug AS specialty_slug FROM (
        SELECT label, count(*) AS n FROM (SELECT lower(trim(unnest(string_split(coalesce(specialties, ''), ',')))) AS label FROM register_rows)
         WHERE label <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40) c LEFT JOIN {RULES_SQL} ON r.label = c.label""")
def label_profile(d):
    return R.label_profile(d.register_rows)


@query("A4_import_summary", """
    SELECT specialty, count(*) AS places, count(*) FILTER (WHERE ln IS NULL) AS without_gps
      FROM (SELECT unnest(string_split(specialties, ',')) AS specialty, ln FROM reg_places) GROUP BY 1""")
def import_summary(d):
    return R.import_summary(places_of(d))


DIM_SQL = "(VALUES " + ", ".join(f"('{s}', '{n}', {len(l)})" for s, n, l in V.SPECIALTIES) + ") AS s(slug, name_cs, labels)"


@query("A5_specialty_dim", f"""
    SELECT s.slug, s.name_cs, CAST(s.labels AS INT) AS labels, count(b.provider_id) AS providers
      FROM {DIM_SQL} LEFT JOIN bridge b ON b.specialty_slug = s.slug GROUP BY 1, 2, 3""")
def specialty_dim(d):
    counts = d.bridge.groupBy(F.col("specialty_slug").alias("slug")).agg(F.count("*").alias("providers"))
    dim = R.specialty_dim(d.spark).withColumn("labels", F.size("labels"))
    return dim.join(counts, "slug", "left").withColumn("providers", F.coalesce("providers", F.lit(0).cast("bigint")))


@query("A6_stage_load", "SELECT place_id, unnest(string_split(specialties, ',')) AS specialty_slug FROM reg_places")
def stage_load(d):
    return R.bridge_of(places_of(d))


@query("B1_clean", "SELECT row_no, place_id, name, email, web, lng FROM reg_clean")
def clean(d):
    c = lambda n: T.clean(F.col(n)).alias(n)
    return d.register_rows.select("row_no", c("place_id"), c("name"), c("email"), c("web"), c("lng"))


@query("B3_tracked_only", "SELECT p.pid AS place_id, s.pid IS NOT NULL AS tracked FROM (SELECT DISTINCT pid FROM reg_parsed) p LEFT JOIN (SELECT DISTINCT pid FROM reg_spec) s ON s.pid = p.pid")
def tracked_only(d):
    every = R.merge_places(R.parse_rows(d.register_rows, F.col("row_no")), only_tracked=False)
    return every.select("place_id", (F.size("specialties") > 0).alias("tracked"))


@query("B4_closed_names", "SELECT row_no, regexp_matches(lower(trim(name)), 'domov pro seniory') AS closed FROM register_rows")
def closed_names(d):
    return d.register_rows.select("row_no", R.closed_name(T.strip(F.col("name"))).alias("closed"))


ROW_SPECS = """
    SELECT r.row_no, s.specialties FROM register_rows r LEFT JOIN (
        SELECT row_no, string_agg(slug, ',' ORDER BY slug) AS specialties FROM reg_spec GROUP BY 1) s ON s.row_no = r.row_no
     WHERE trim(r.name) <> ''"""


def row_specs(d):
    p = R.parse_rows(d.register_rows, F.col("row_no"))
    return p.select(F.col("ord").alias("row_no"), F.nullif(F.array_join("specialties", ","), F.lit("")).alias("specialties"), "facility_type", "care_form")


@query("B5_closed_facilities", ROW_SPECS + " AND contains(lower(r.facility_type), 'lékárna')")
def closed_facilities(d):
    kind = F.lower("facility_type")
    return row_specs(d).filter(R._mentions(kind, V.CLOSED_FACILITIES)).select("row_no", "specialties")


@query("B6_outpatient_only", ROW_SPECS + " AND r.care_form IS NOT NULL AND NOT contains(lower(r.care_form), 'ambulant')")
def outpatient_only(d):
    rows = row_specs(d).filter(~F.lower("care_form").contains(V.OUTPATIENT_WORD))
    return rows.select("row_no", "specialties")


@query("B7_single_kind", ROW_SPECS)
def single_kind(d):
    return row_specs(d).select("row_no", "specialties")


@query("D14_slug_district_counts", "SELECT slug_plain AS city_slug, district, n FROM reg_counts")
def slug_district_counts(d):
    return R.slug_district_counts(R.merge_places(R.parse_rows(d.register_rows, F.col("row_no"))))


@query("E6_slug_disambiguate", "SELECT place_id, city_slug FROM reg_places")
def slug_disambiguate(d):
    return places_of(d).select("place_id", "city_slug")


@query("G3_merge_specialties", "SELECT pid AS place_id, slug AS specialty_slug FROM reg_spec GROUP BY 1, 2")
def merge_specialties(d):
    m = R.merge_places(R.parse_rows(d.register_rows, F.col("row_no")))
    return R.bridge_of(m)


# ------------------------------------------------------------------------------- scalars
@query("H1_unaccent", "SELECT c_custkey, regexp_replace(strip_accents(name), '[^\\x00-\\x7F]', '', 'g') AS plain FROM customer JOIN (SELECT provider_id, name || ' ' || coalesce(city, '') AS name FROM providers) ON provider_id = c_custkey")
def unaccent(d):
    text = F.concat("name", F.lit(" "), F.coalesce("city", F.lit("")))
    return d.providers.select(F.col("provider_id").alias("c_custkey"), T.unaccent(text).alias("plain"))


@query("H2_slugify", f"SELECT provider_id, {SLUG.format('name')} AS slug, {SLUG.format('city')} AS town FROM providers")
def slugify(d):
    return d.providers.select("provider_id", T.slugify(F.col("name")).alias("slug"), T.slugify(F.col("city")).alias("town"))


@query("H3_slugify_web", "SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def slugify_web(d):
    return spread(d.given("documents")).select("doc_id", T.slugify_web(F.col("text")).alias("slug"))


@query("H4_norm_header", """
    SELECT o_orderkey, regexp_replace(lower(regexp_replace(strip_accents('Č. ' || o_orderpriority || ' / ' || o_orderstatus), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]', '', 'g') AS header FROM orders""")
def norm_header(d):
    """Header names compared by their letters and digits alone."""
    given = F.concat(F.lit("Č. "), "o_orderpriority", F.lit(" / "), "o_orderstatus")
    return d.given("orders").select("o_orderkey", T.norm_name(given).alias("header"))


@query("H5_normalize_text", "SELECT doc_id, regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[ \\t\\r\\f\\v]+', ' ', 'g') AS text FROM documents")
def normalize_text(d):
    return spread(d.given("documents")).select("doc_id", T.normalize_text(F.col("text")).alias("text"))


@query("H6_parse_float", f"SELECT row_no, {NUMBER.format('lat')} AS lat, {NUMBER.format('lng')} AS lng FROM register_rows")
def parse_float(d):
    return d.register_rows.select("row_no", T.parse_number(F.col("lat")).alias("lat"), T.parse_number(F.col("lng")).alias("lng"))


@query("H7_parse_coords", "SELECT row_no, la AS lat, ln AS lng FROM reg_parsed")
def parse_coords(d):
    p = R.parse_rows(d.register_rows, F.col("row_no"))
    return p.select(F.col("ord").alias("row_no"), "lat", "lng")


@query("H8_postcode", "SELECT row_no, nullif(replace(postcode, ' ', ''), '') AS postcode FROM register_rows")
def postcode(d):
    return d.register_rows.select("row_no", T.postcode(F.col("postcode")).alias("postcode"))


@query("H9_synthetic_place_id", "SELECT row_no, pid AS place_id FROM reg_parsed")
def synthetic_place_id(d):
    p = R.parse_rows(d.register_rows, F.col("row_no"))
    return p.select(F.col("ord").alias("row_no"), "place_id")


EMAIL_OK = "^[^@\\s]+@[^@\\s]+\\.[a-z]{2,}$"


@query("H12_first_email", f"""
    SELECT provider_id, t[1] AS first_email, CAST(len(t) AS INT) AS n FROM (
        SELECT provider_id, list_filter(string_split_regex(coalesce(email, ''), '[\\s,;]+'), lambda x: regexp_matches(x, '{EMAIL_OK}', 'i')) AS t FROM providers)""")
def first_email(d):
    return d.providers.select("provider_id", C.first_email(F.col("email")).alias("first_email"), F.size(C.emails_of(F.col("email"))).alias("n"))


@query("H13_first_web", """
    SELECT provider_id, CASE WHEN t[1] IS NULL THEN NULL WHEN regexp_matches(t[1], '^https?://', 'i') THEN t[1] ELSE 'https://' || t[1] END AS web FROM (
        SELECT provider_id, list_filter(string_split_regex(coalesce(web, ''), '[\\s,;]+'), lambda x: contains(x, '.') AND NOT contains(x, '@')) AS t FROM providers)""")
def first_web(d):
    return d.providers.select("provider_id", C.first_web(F.col("web")).alias("web"))


@query("H14_phone_fmt", """
    SELECT provider_id, CASE WHEN length(m) = 9 THEN substr(m, 1, 3) || ' ' || substr(m, 4, 3) || ' ' || substr(m, 7, 3) ELSE trim(phone) END AS mail,
           CASE WHEN regexp_matches(w, '^[0-9]{9}$') THEN substr(w, 1, 3) || ' ' || substr(w, 4, 3) || ' ' || substr(w, 7, 3) ELSE trim(phone) END AS web FROM (
        SELECT provider_id, phone, CASE WHEN length(g) = 12 AND starts_with(g, '420') THEN substr(g, 4) ELSE g END AS m,
               regexp_replace(regexp_replace(phone, '[^0-9+]', '', 'g'), '^(\\+|00)420', '') AS w FROM (
            SELECT provider_id, phone, regexp_replace(split_part(phone, ',', 1), '[^0-9]', '', 'g') AS g FROM providers))""")
def phone_fmt(d):
    return d.providers.select("provider_id", C.phone_mail(F.col("phone")).alias("mail"), C.phone_web(F.col("phone")).alias("web"))


@query("H19_pseudonym", "SELECT user_id, count(*) AS n, substr(sha256('salt|' || CAST(user_id AS VARCHAR)), 1, 32) AS hash FROM events GROUP BY 1")
def pseudonym(d):
    per = d.given("events").groupBy("user_id").agg(F.count("*").alias("n"))
    return per.withColumn("hash", C.pseudonym("salt", F.col("user_id").cast("string")))


@query("H21_address_fmt", """
    SELECT provider_id, concat_ws(', ', nullif(concat_ws(' ', street, house_no), ''),
           nullif(concat_ws(chr(160), substr(postcode, 1, 3) || chr(160) || substr(postcode, 4), regexp_replace(city, ' ([0-9]+)$', chr(160) || '\\1')), '')) AS address
      FROM providers""")
def address_fmt(d):
    return d.providers.select("provider_id", X.address(*[F.col(c) for c in ("street", "house_no", "city", "postcode")]).alias("address"))


@query("H23_ago", f"""
    SELECT signal_id, CASE WHEN days > -1 THEN 0 WHEN days > -45 THEN days ELSE CAST(floor(days / 30.0e0 + 0.5e0) AS BIGINT) END AS n,
           CASE WHEN days > -1 THEN 'today' WHEN days > -45 THEN 'day' ELSE 'month' END AS unit
      FROM (SELECT signal_id, CAST(floor((observed_us - {D.AS_OF_US}) / 86400000000.0e0 + 0.5e0) AS BIGINT) AS days FROM signals)""")
def ago(d):
    a = X.ago(F.col("observed_at"), d.now)
    return d.signals.select("signal_id", a["n"].alias("n"), a["unit"].alias("unit"))


NAMES_SQL = "list_transform(string_split(insurers, ','), lambda c: CASE c " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in V.INSURER_NAMES.items()) + " END)"


@query("H24_insurers_short", f"""
    SELECT provider_id, CASE WHEN insurers IS NULL THEN NULL WHEN length(insurers) = 27 THEN 'všechny pojišťovny' ELSE array_to_string({NAMES_SQL}, ' · ') END AS insurers FROM facts""")
def insurers_short(d):
    from ..operators.cards import flag_summary

    return flag_summary(d.flags, d.as_of).select("provider_id", X.insurers_short(F.col("insurers")).alias("insurers"))


PROJ = {"lon0": 15.3, "k": 0.645, "lat1": 51.1, "scale": 300.0}
FRAME = {"x0": -640.0, "y0": 10.0, "z": 1.5, "pad": 8.0}


@query("H25_to_map", """
    SELECT provider_id, round(((lng - 15.3e0) * 0.645e0 * 300.0e0 + 640.0e0) * 1.5e0 + 8.0e0, 6) AS x, round(((51.1e0 - lat) * 300.0e0 - 10.0e0) * 1.5e0 + 8.0e0, 6) AS y
      FROM providers""")
def to_map(d):
    at = G.to_map(F.col("lat"), F.col("lng"), PROJ, FRAME)
    return d.providers.select("provider_id", F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"))


# ------------------------------------------------------------------------------- snapshot
UPSERT_SQL = f"""
    SELECT coalesce(p.place_id, n.place_id) AS place_id, coalesce(n.name, p.name) AS name,
           CASE WHEN n.place_id IS NOT NULL THEN true ELSE p.active AND (SELECT bef > 0 AND nn < 0.8e0 * bef FROM sizes) END AS active,
           coalesce(p.provider_id, (SELECT coalesce(max(provider_id), 0) FROM prev) + row_number() OVER (PARTITION BY p.place_id IS NULL ORDER BY n.place_id)) AS provider_id, p.web_found, CASE WHEN n.place_id IS NOT NULL THEN {D.AS_OF_US} ELSE {D.AS_OF_US - 30 * D.DAY_US} END AS last_seen_us,
           CASE WHEN p.place_id IS NULL THEN {D.AS_OF_US} ELSE {D.AS_OF_US - 30 * D.DAY_US} END AS first_seen_us
      FROM prev p FULL JOIN reg_places n ON n.place_id = p.place_id"""
STEPS["sizes"] = "SELECT (SELECT count(*) FROM prev WHERE active) AS bef, (SELECT count(*) FROM reg_places) AS nn"


def _snap(df):
    return df.select(
        "place_id", "name", "active", "provider_id", "web_found",
        F.unix_micros("last_seen_at").alias("last_seen_us"), F.unix_micros("first_seen_at").alias("first_seen_us"),
    )


@query("L1_upsert_providers", UPSERT_SQL)
def upsert_providers(d):
    return _snap(R.upsert(previous(d), places_of(d), d.as_of))


@query("A7_provider_snapshot", UPSERT_SQL)
def provider_snapshot(d):
    """Written as a version, read back through the pointer."""
    root = f"{shared_folder(d.spark)}/providers/{uuid.uuid4().hex}"  # a table of its own per run
    sinks.write_snapshot(R.upsert(previous(d), places_of(d), d.as_of), root, D.AS_OF_DATE)
    return _snap(sinks.read_snapshot(d.spark, root))


@query("L2_deactivate_guard", """
    SELECT min_ratio, CASE WHEN bef > 0 AND nn < min_ratio * bef THEN 0 ELSE gone END AS deactivated, bef > 0 AND nn < min_ratio * bef AS skipped_deactivation
      FROM sizes, (SELECT count(*) AS gone FROM prev p WHERE active AND NOT EXISTS (SELECT 1 FROM reg_places n WHERE n.place_id = p.place_id)), (VALUES (0.8e0), (0.2e0)) AS r(min_ratio)""")
def deactivate_guard(d):
    prev, new = previous(d), places_of(d)
    part = lambda r: R.import_stats(prev, new, r).select(F.lit(r).alias("min_ratio"), "deactivated", "skipped_deactivation")
    return part(0.8).unionByName(part(0.2))


@query("C8_not_in", "SELECT place_id FROM prev p WHERE active AND NOT EXISTS (SELECT 1 FROM reg_places n WHERE n.place_id = p.place_id)")
def not_in(d):
    return R.missing_places(previous(d), places_of(d)).select("place_id")


BRIDGE_SQL = """
    SELECT 'R' || CAST(b.provider_id AS STRING) AS place_id, specialty_slug FROM bridge b
     WHERE NOT EXISTS (SELECT 1 FROM reg_places n WHERE n.place_id = 'R' || CAST(b.provider_id AS STRING))
    UNION SELECT place_id, unnest(string_split(specialties, ',')) FROM reg_places"""


def new_bridge(d):
    prev = d.bridge.select(F.concat(F.lit("R"), F.col("provider_id").cast("string")).alias("place_id"), "specialty_slug")
    return R.replace_bridge(prev, places_of(d))


@query("C14_replace_bridge_join", BRIDGE_SQL)
def replace_bridge_join(d):
    return new_bridge(d)


@query("L3_replace_bridge", f"SELECT specialty_slug, count(*) AS n FROM ({BRIDGE_SQL}) GROUP BY 1")
def replace_bridge(d):
    return new_bridge(d).groupBy("specialty_slug").agg(F.count("*").alias("n"))


@query("D21_import_stats", """
    SELECT nn AS upserted, (SELECT count(*) FROM reg_places n WHERE NOT EXISTS (SELECT 1 FROM prev p WHERE p.place_id = n.place_id)) AS new,
           CASE WHEN bef > 0 AND nn < 0.8e0 * bef THEN 0 ELSE (SELECT count(*) FROM prev p WHERE active AND NOT EXISTS (SELECT 1 FROM reg_places n WHERE n.place_id = p.place_id)) END AS deactivated,
           bef > 0 AND nn < 0.8e0 * bef AS skipped_deactivation FROM sizes""")
def import_stats(d):
    return R.import_stats(previous(d), places_of(d))


@query("A8_signal_append", """
    SELECT signal_id, provider_id, source, status, observed_us FROM signals
     WHERE CAST(make_timestamp(observed_us) AS DATE) BETWEEN DATE '2023-11-02' AND DATE '2024-02-01'""")
def signal_append(d):
    """The log written by day and read back for one status day: older day folders are not opened."""
    root = f"{shared_folder(d.spark)}/signals/{uuid.uuid4().hex}"  # a log of its own per run
    sinks.append_signals(d.signals, root, D.AS_OF_DATE)
    sinks.append_signals(d.signals, root, D.AS_OF_DATE)  # a repeated run adds nothing
    back = sinks.read_signals(d.spark, root, D.AS_OF)
    return back.select("signal_id", "provider_id", "source", "status", F.unix_micros("observed_at").alias("observed_us"))
