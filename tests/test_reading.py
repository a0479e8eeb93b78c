"""Which pages of a site are read, in which order, and what the site says then."""

import re

import pytest
from pyspark.sql import functions as F

from placewise.operators import evidence as E
from placewise.operators import reading as R
from placewise.sources import pages as P

ROBOTS = "host string, prefix string, allow boolean"
ENGLISH = "You are at the site of our team and you are welcome to visit us. We are in the centre of the town and the office is open for you on Monday. "


def html(text, *links):
    return f"<html><body><p>{text}</p>" + "".join(f'<a href="{href}">{label}</a>' for href, label in links) + "</body></html>"


MENU = [("/novinky", "Novinky"), ("/registrace/", "Registrace"), ("/kontakt", "Kontakt"), ("en", "English")]
PAGES = [
    # a decisive page with the smallest id that no link leads to; the second link decides; the English version adds a fact
    (1, "http://a.cz/stare", html("Nebereme nové klienty.")),
    (2, "https://a.cz/kontakt/", html("Bereme nové klienty. We speak English.")),
    (3, "http://a.cz/registrace", html("Jsme nesmluvní ambulance.")),
    (4, "http://a.cz/novinky", html("Kapacita je naplněna. Appointments in English.")),
    (5, "http://a.cz/en/", html(ENGLISH * 2)),
    (6, "http://A.cz/#uvod", html("Vítejte.", *MENU)),
    # an older page of the same address does not count
    (7, "http://b.cz/", html("Nebereme nové klienty.", *MENU)),
    (8, "http://b.cz", html("Bereme nové klienty.", *MENU)),
    (9, "http://b.cz/registrace", html("Nebereme nové klienty. Smluvní pojišťovny 111 a 207.")),
    (10, "http://b.cz/en", html(ENGLISH * 2)),
    # the best link is closed by robots, the English version says that English is spoken
    (11, "http://c.cz/", html("Vítejte.", *MENU)),
    (12, "http://c.cz/registrace", html("Bereme nové klienty.")),
    (13, "http://c.cz/kontakt", html("Nebereme nové klienty.")),
    (14, "http://c.cz/en", html("We speak English.")),
    # home page closed; home page not fetched; English known already
    (15, "http://d.cz/", html("Bereme nové klienty.")),
    (16, "http://e.cz/kontakt", html("Bereme nové klienty.")),
    (17, "http://f.cz/", html("Bereme nové klienty a nebereme nové klienty. English spoken.", ("/en", "EN"))),
    (18, "http://f.cz/en", html(ENGLISH * 2)),
]
CLOSED = [("c.cz", "/reg*ce/$", False), ("d.cz", "/", False)]


@pytest.fixture(scope="module")
def read(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    sites = spark.createDataFrame([(f"{x}.cz", f"http://{x}.cz/") for x in "abcdef"], "site string, url string")
    robots = spark.createDataFrame(CLOSED, ROBOTS)
    order = R.reading_order(sites, pages, robots)
    evidence = E.page_evidence(P.readable_pages(pages.join(order.select("page_id").distinct(), "page_id", "left_semi")), 2024)
    return sites, robots, order, R.in_order(evidence, order)


def test_order(read):
    got = {(r.site, r.page_rank, r.role): r.page_id for r in read[2].collect()}
    assert got == {
        ("a.cz", 0, "home"): 6, ("a.cz", 1, "link"): 3, ("a.cz", 2, "link"): 2, ("a.cz", 3, "english"): 5,
        ("b.cz", 0, "home"): 8, ("b.cz", 1, "link"): 9, ("b.cz", 3, "english"): 10,
        ("c.cz", 0, "home"): 11, ("c.cz", 2, "link"): 13, ("c.cz", 3, "english"): 14,
        ("f.cz", 0, "home"): 17, ("f.cz", 3, "english"): 18,
    }


def test_errors(read):
    sites, robots, order, _ = read
    assert {(r.site, r.error) for r in R.site_errors(sites, order, robots).collect()} == {("d.cz", R.BLOCKED), ("e.cz", R.UNREAD)}


def test_verdicts_and_facts(read):
    rows = read[3]
    sites = E.site_verdicts(rows.filter("role <> 'english'"))
    assert {(r.site, r.status, r.conflicting, r.decisive_rank) for r in sites.collect()} == {
        ("a.cz", "accepting", False, 2), ("b.cz", "accepting", False, 0), ("c.cz", "not_accepting", False, 2), ("f.cz", None, True, 0)}
    own = E.site_flags(E.facts_of(rows.filter("role <> 'english'"), "site", "page_rank"), sites)
    facts = own.unionByName(R.english_version(rows, own))
    assert {(r.site, r.flag) for r in facts.collect()} == {
        ("a.cz", "self_pay"), ("a.cz", "english"), ("b.cz", "english_site"), ("c.cz", "english"), ("f.cz", "english")}


def test_one_pass_equals_two(spark):
    pages = P.readable_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    both = E.page_evidence(pages, 2024)
    cols = ["page_id", "status", "scope", "snippet", "conflicting"]
    assert sorted(map(str, both.select(*cols).collect())) == sorted(map(str, E.page_verdicts(pages, 2024).select(*cols).collect()))
    facts = ["page_id", "flag", "snippet"]
    assert sorted(map(str, E.facts_of(both, "page_id").select(*facts).collect())) == sorted(map(str, E.page_flags(pages).select(*facts).collect()))


RULES = [("/a", False), ("/a/b", True), ("/a/b/c$", False), ("/*.pdf$", False), ("/x*y", False), ("/x*yz", True), ("/q?p=", False), ("/(", False), ("/E\\E.", False), ("/same", False), ("/same", True)]
PATHS = ["", "/", "/a", "/ab", "/a/", "/a/b", "/a/bc", "/a/b/c", "/a/b/c/d", "/f.pdf", "/f.pdf2", "/a/b/f.pdf", "/x", "/x1y2", "/xxyz", "/q?p=1", "/q?r=1", "/(1)", "/E\\E.1", "/E1", "/same", "/other"]


def test_robots_against_plain_python(spark):
    def matches(rule, path):
        body, end = (rule[:-1], "$") if rule.endswith("$") else (rule, "")
        return re.match("(?s)" + ".*".join(map(re.escape, body.split("*"))) + end, path)

    want = set()
    for p in PATHS:
        found = max(((len(r), allow) for r, allow in RULES if matches(r, p or "/")), default=(0, True))
        if found[1]:
            want.add(f"http://h.cz{p}")
    urls = spark.createDataFrame([(f"http://h.cz{p}",) for p in PATHS] + [("http://free.cz/a",), ("http://h.cz/other",)], "url string")
    robots = spark.createDataFrame([("h.cz", r, a) for r, a in RULES] + [("h.cz", "", False), ("h.cz", None, False)], ROBOTS)
    got = R.allowed(urls, robots).groupBy("url").agg(F.count("*").alias("n")).collect()
    assert {r.url for r in got} == want | {"http://free.cz/a"} and {r.n for r in got if r.url.endswith("/other")} == {2}


def test_rows_follow_rule_lengths(spark):
    """A path of 5,000 signs is looked up twice when its host has rules of two lengths."""
    urls = spark.createDataFrame([("http://h.cz/" + "a" * 5000,)], "url string")
    robots = spark.createDataFrame([("h.cz", "/b", False), ("h.cz", "/c", False), ("h.cz", "/aaa", False), ("other.cz", "/aaaaaaaa", False)], ROBOTS)
    assert R.allowed(urls, robots).count() == 0
    plan = R.allowed(urls, robots)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan
