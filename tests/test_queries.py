"""A cross-section of the registered queries against their SQL twins on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
SAMPLE = [
    "D1_provider_status", "C3_provider_cards", "M1_near", "D2_cities", "D4_availability_tally", "C5_alert_match", "M6_pending_alerts",
    "C10_alternatives", "C11_accepting_nearby", "E7_town_page_cut", "E9_suggest_rank", "M5_find_place", "A1_register_read", "L1_upsert_providers",
    "I1_page_text", "I8_page_verdict", "M10_crawl_evidence", "M9_crawl_targets", "I13_site_match", "J1_report_limit", "J8_status_stream",
    "L10_subscription_changes", "C13_point_in_polygon", "M8_digest",
]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, con, name):
    df = entry_module.queries()[name](spark, FOLDER)
    cur = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([plain(v) for v in row]) for row in cur.fetchall())
    got = sorted(repr([plain(v) for v in row]) for row in df.select(*[f"`{n}`" for n in names]).collect())
    assert got == want


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_names():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) > 140


def test_rollup_adds_up(spark):
    rows = entry_module.queries()["D4_availability_tally"](spark, FOLDER).collect()
    for r in rows:
        if r.level == "region":
            assert r.n == sum(x.n for x in rows if x.level == "district" and (x.specialty, x.region) == (r.specialty, r.region))
        if r.level == "country":
            assert r.n == sum(x.n for x in rows if x.level == "region" and x.specialty == r.specialty)
