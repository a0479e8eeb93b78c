"""Status, radius joins, alerts, reconciliation, discovery and rate limits against known answers or brute force."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from placewise.functions.geo import distance_km
from placewise.operators import alerts as A
from placewise.operators import discover as DI
from placewise.operators import intake
from placewise.operators import reconcile as RC
from placewise.operators import spatial as SP
from placewise.operators.status import provider_status

NOW = dt.datetime(2024, 1, 31)
SIGNAL = "signal_id long, provider_id long, source string, status string, scope string, observed_at timestamp, note string, created_at timestamp"


def signals(spark, rows):
    out = []
    for i, (pid, source, status, days) in enumerate(rows):
        t = NOW - dt.timedelta(days=days)
        out.append((i, pid, source, status, "all", t, None, t))
    return spark.createDataFrame(out, SIGNAL)


def test_status_scoring(spark):
    s = signals(spark, [
        (1, "user", "accepting", 1), (2, "user", "accepting", 20), (2, "user", "accepting", 25), (2, "clinic", "not_accepting", 0),
        (3, "web_crawl", "accepting", 45), (4, "clinic", "accepting", 120), (5, "user", "waitlist", 1), (6, "clinic", "waitlist", 2),
        (7, "user", "accepting", 1), (7, "user", "not_accepting", 1), (8, "user", "accepting", -2),
    ])
    got = {r.provider_id: r.status for r in provider_status(s, NOW).collect()}
    assert got == {1: "accepting", 2: "not_accepting", 3: "unknown", 5: "mixed", 6: "waitlist", 7: "mixed"}


@pytest.fixture(scope="module")
def crowd(spark):
    """A third of all points within a few hundred metres, some on one exact spot."""
    i = F.col("id")
    return spark.range(900).select(
        i.alias("pid"), F.when(i % 2 == 0, "a").otherwise("b").alias("specialty"), (i % 3).cast("int").alias("rank"),
        F.when(i % 9 == 0, 50.1).when(i % 3 == 0, 50.1 + (i * 7 % 40) / 10000).otherwise(48.6 + (i * 7919 % 2400) / 1000).alias("lat"),
        F.when(i % 9 == 0, 14.4).when(i % 3 == 0, 14.4 + (i * 11 % 50) / 10000).otherwise(12.2 + (i * 104729 % 6500) / 1000).alias("lng"),
    ).cache()


def sides(crowd, km, need):
    q = crowd.select("specialty", F.col("pid").alias("qid"), F.col("lat").alias("q_lat"), F.col("lng").alias("q_lng"), km.alias("radius_km"))
    q = q.withColumn("need", F.lit(need)) if need else q
    c = crowd.select("specialty", "rank", F.col("pid").alias("c_id"), F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    return q, c


def brute(q, c):
    km = distance_km(F.col("q_lat"), F.col("q_lng"), F.col("c_lat"), F.col("c_lng"))
    return q.join(c, "specialty").withColumn("km", km).filter(F.col("km") <= F.col("radius_km"))


@pytest.mark.parametrize("slice_rows", [50_000, 10])
def test_radius_pairs(spark, crowd, slice_rows):
    km = F.when(F.col("pid") % 4 == 0, 100.0).when(F.col("pid") % 4 == 1, 20.0).otherwise(0.2)
    q, c = sides(crowd, km, None)
    got = SP.near_pairs(q, c, ["specialty"], slice_rows=slice_rows).select("qid", "c_id")
    want = brute(q, c).select("qid", "c_id")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


@pytest.mark.parametrize(("finest", "slice_rows", "asked_rows"), [(12, 50_000, 20_000), (3, 7, 5), (3, 50_000, 5), (0, 7, 20_000)])
def test_circle_pairs(spark, crowd, finest, slice_rows, asked_rows):
    """With slices of queries and candidates, in coarse and fine cells, beside rows that have no position or no radius."""
    nan = F.lit(float("nan"))
    km = F.when(F.col("pid") % 4 == 0, 250.0).when(F.col("pid") % 4 == 1, 20.0).when(F.col("pid") % 40 == 2, None).otherwise(0.2)
    q, c = sides(crowd, km, None)
    want = brute(q, c).select("qid", "c_id", "km")
    odd = lambda df, p: df.limit(20).withColumns({f"{p}_lat": F.when(F.rand(1) < 0.5, nan), f"{p}_lng": nan})
    q, c = q.unionByName(odd(q, "q")), c.unionByName(odd(c, "c"))
    got = SP.circle_pairs(q, c, ["specialty"], finest, slice_rows, asked_rows)
    assert set(got.columns) == {*q.columns, *c.columns, "km"}
    assert got.count() == want.count() and got.select("qid", "c_id", "km").exceptAll(want).count() == 0


@pytest.mark.parametrize("km", [0.3, 15.0, 90.0])
def test_nearest_in_a_crowd(spark, crowd, km):
    from pyspark.sql import Window as W

    q, c = sides(crowd, F.lit(km), 5)
    got = SP.nearest(q, c, 4, ["specialty"], ["qid"], [0, 1, 2], skip=F.col("c_id") == F.col("qid"), pile=5).select("qid", "c_id", "rn")
    order = W.partitionBy("qid").orderBy("rank", "km", "c_id")
    want = brute(q, c).filter("qid <> c_id").withColumn("km", F.round("km", 1)).withColumn("rn", F.row_number().over(order)).filter("rn <= 4")
    want = want.select("qid", "c_id", "rn")
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_pruning_meets_few_pairs(spark):
    """8,000 points in two by two kilometres: far fewer pairs than the 64 million in reach."""
    n = 8_000
    i = F.col("id")
    place = lambda p: [(50.0 + (i * 7919 % 1000) / 56000).alias(f"{p}_lat"), (14.4 + (i * 104729 % 997) / 36000).alias(f"{p}_lng")]
    q = spark.range(n).select(F.lit("a").alias("specialty"), i.alias("qid"), *place("q"), F.lit(90.0).alias("radius_km"), F.lit(3).alias("need"))
    c = spark.range(n).select(F.lit("a").alias("specialty"), i.alias("c_id"), *place("c"))
    assert SP.near_pairs(q, c, ["specialty"]).count() < n * n / 20


def subs(spark, rows):
    """(id, created days ago, verified days ago or None)"""
    ago = lambda n: None if n is None else NOW - dt.timedelta(days=n)
    data = [(i, f"{i}@x.cz", "zubar", 49.1951, 16.6068, 5, ago(c), ago(v), None, "h", f"t{i}", "Brno", "cs") for i, c, v in rows]
    return spark.createDataFrame(
        data, "subscription_id long, email string, specialty_slug string, lat double, lng double, radius_km int, created_at timestamp, "
        "verified_at timestamp, unsubscribed_at timestamp, requester_hash string, token string, place_label string, lang string")


def test_alerts_news_radius_once_budget(spark):
    listing = spark.createDataFrame(
        [(1, 49.1951, 16.6068), (2, 49.2040, 16.6068), (3, 49.8209, 18.2625)], "provider_id long, lat double, lng double"
    ).withColumns({"specialty": F.lit("zubar"), "status": F.lit("accepting")})
    s = signals(spark, [(1, "clinic", "accepting", 3), (2, "clinic", "accepting", 0), (3, "clinic", "accepting", 0)])
    ledger = spark.createDataFrame([], "subscription_id long, provider_id long, sent_at timestamp")
    people = subs(spark, [(1, 2, 1), (2, 1, None), (3, 8, None), (4, 2, 1), (5, 2, 1), (6, 2, 1)])
    due = A.pending_alerts(people, listing, s, ledger, NOW)
    assert {(r.subscription_id, r.provider_id) for r in due.collect()} == {(i, 2) for i in (1, 4, 5, 6)}
    told = A.mark_sent(ledger, due, NOW)
    assert A.pending_alerts(people, listing, s, told, NOW).count() == 0
    log = spark.createDataFrame([(i, "confirm", NOW) for i in range(8)], "mail_id long, kind string, sent_at timestamp")
    queue, failed = A.alert_queue(due), people.filter("subscription_id = 1").select("subscription_id")
    sent = A.within_budget(queue, failed, log, NOW, 10)
    assert sorted(r.subscription_id for r in sent.collect()) == [4, 5]
    assert tuple(A.run_stats(queue, sent, failed, A.expired_signups(people, NOW)).first()) == (4, 2, 1, 1, 1)
    assert {r.subscription_id for r in A.keep_subscriptions(people, NOW).collect()} == {1, 2, 4, 5, 6}


def test_news_and_told_decide_in_the_pairs_own_join(spark):
    """Pairs grow with the square of the tables, so nothing may be joined to them: the last join of the plan is that of the cells."""
    listing = spark.createDataFrame(
        [(i, 49.1951 + i / 1000, 16.6068) for i in range(4)], "provider_id long, lat double, lng double"
    ).withColumns({"specialty": F.lit("zubar"), "status": F.lit("accepting")})
    s = signals(spark, [(0, "clinic", "accepting", 3), (1, "clinic", "accepting", 0), (1, "clinic", "accepting", 5), (2, "clinic", "accepting", 0)])
    people = subs(spark, [(1, 2, 1), (2, 9, 4)])
    ledger = spark.createDataFrame(
        [(1, 1, NOW), (1, 1, NOW), (1, 2, NOW - dt.timedelta(days=61)), (2, 3, NOW), (7, 0, NOW)], "subscription_id long, provider_id long, sent_at timestamp")
    news = A.only_news(people, listing, s).select("subscription_id", "provider_id")
    untold = A.not_told(people, listing, ledger, NOW).select("subscription_id", "provider_id")
    assert sorted(map(tuple, news.collect())) == [(1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]
    assert sorted(map(tuple, untold.collect())) == [(1, 0), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2)]
    for df in (news, untold):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert "_cy" in next(line for line in plan if "Join " in line)


def test_subscriptions_are_not_repeated_for_the_cells_they_touch(spark):
    """What the join of the pairs shuffles is each subscription once, and practices."""
    listing = spark.range(50).select(
        F.col("id").alias("provider_id"), (49.19 + F.col("id") / 500).alias("lat"), F.lit(16.6068).alias("lng"), F.lit("zubar").alias("specialty"), F.lit("accepting").alias("status"))
    people = subs(spark, [(i, 2, 1) for i in range(40)])
    pairs = A.alert_match(people, listing)
    plan = pairs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    asking = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan.left())
    assert asking.count() == 40
    assert pairs.count() == 40 * sum(i / 500 + 49.19 <= 49.1951 + 5 / 111.32 for i in range(50))


@pytest.mark.parametrize("name", ["alert_match", "only_news", "not_told"])
def test_pairs_of_neighbouring_practices_stand_together(spark, name):
    """Tables too large to broadcast: rows in a row name the same few practices over and over, so the written result stays small where pairs are many."""
    i = F.col("id")
    listing = spark.range(1000).select(
        i.alias("provider_id"), (49.19 + i % 40 / 4000).alias("lat"), (16.6 + i % 25 / 4000).alias("lng"), F.lit("zubar").alias("specialty"), F.lit("accepting").alias("status"))
    s = spark.range(1000).select(i.alias("provider_id"), F.lit("accepting").alias("status"), F.lit(NOW).cast("timestamp").alias("created_at"))
    ledger = spark.createDataFrame([(3, 5, NOW)], "subscription_id long, provider_id long, sent_at timestamp")
    people = subs(spark, [(n, 2, 1) for n in range(100)])
    more = {"alert_match": (), "only_news": (s,), "not_told": (ledger, NOW)}[name]
    size = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(size)
    spark.conf.set(size, "-1")
    try:
        rows = [(r.subscription_id, r.provider_id) for r in getattr(A, name)(people, listing, *more).collect()]
    finally:
        spark.conf.set(size, was)
    assert len(rows) == len(set(rows)) == 100_000 - (name == "not_told")
    assert max(len({p for _, p in rows[at:at + 3200]}) for at in range(0, len(rows), 3200)) <= 2 * SP.BLOCK_ROWS + 1


@pytest.mark.parametrize("km", [300.0, 9_000.0])
def test_blocks_that_are_wholly_in_reach(spark, km):
    """All over the globe, poles among it: a block in reach by its corners is in reach by each of its pairs."""
    i = F.col("id")
    place = lambda p: [(F.lit(-90.0) + i * 37 % 181).alias(f"{p}_lat"), (F.lit(-60.0) + i * 53 % 121).alias(f"{p}_lng")]
    q = spark.range(0, 700, 9).select(F.lit("a").alias("specialty"), i.alias("qid"), *place("q"), F.lit(km).alias("radius_km"))
    c = spark.range(700).select(F.lit("a").alias("specialty"), i.alias("c_id"), *place("c"))
    want, got = brute(q, c).select("qid", "c_id", "km"), SP.circle_pairs(q, c, ["specialty"]).select("qid", "c_id", "km")
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_crawl_reconcile(spark):
    specs = spark.createDataFrame([(1, ["zubar"]), (2, ["zubar"])], "provider_id long, specialties array<string>")
    schema = "provider_id long, status string, scope string, snippet string, page_url string, error string"
    result = lambda status, snippet, error=None: spark.createDataFrame(
        [(p, status, "all", snippet, "http://x.cz/", error) for p in (1, 2)], schema)

    def run(log, res, when=NOW):
        return spark.createDataFrame(RC.apply_decisions(log, RC.decide(res, log, specs, when), when).collect(), SIGNAL)

    log = run(spark.createDataFrame([], SIGNAL), result("accepting", "přijímáme nové pacienty"))
    assert log.count() == 2
    log = run(log, result("accepting", "Přijímáme nové pacienty"), NOW + dt.timedelta(days=1))
    assert log.count() == 2 and {r.note for r in log.collect()} == {"„Přijímáme nové pacienty“ — http://x.cz/"}
    log = run(log, result("not_accepting", "nepřijímáme"), NOW + dt.timedelta(days=1))
    assert log.count() == 4
    assert run(log, result(None, None, "HTTP 503")).count() == 4
    assert run(log, result("accepting", "Přijímáme do diabetologické ambulance")).count() == 0
    assert run(log, result(None, None)).count() == 0


def test_flags_remembered_and_forgotten(spark):
    specs = spark.createDataFrame([(1, ["zubar"])], "provider_id long, specialties array<string>")
    res = spark.createDataFrame([(1, "s", "http://x/", None)], "provider_id long, site string, page_url string, error string")
    down = res.withColumn("error", F.lit("HTTP 503"))
    said = spark.createDataFrame([("s", "self_pay", "Nemáme smlouvy")], "site string, flag string, snippet string")
    flags = spark.createDataFrame([], "provider_id long, flag string, source string, observed_at timestamp")
    have = lambda f, facts, r: RC.reconcile_flags(f, RC.found_flags(facts, r, specs), r, NOW)
    once = have(flags, said, res)
    assert once.count() == 1 and have(once, said, res).count() == 1
    assert have(once, said.limit(0), down).count() == 1 and have(once, said.limit(0), res).count() == 0


def test_discovery(spark):
    names = [("MUDr. Anna Trnečková s.r.o.", None, ["trneckova"]), ("Zubní ordinace MUDr. Petr Novák a MUDr. Eva Malá", None, ["novak"]),
             ("ROSEADENT s.r.o.", None, ["roseadent"]), ("Zubní ordinace Praha s.r.o.", "Praha", [])]
    df = spark.createDataFrame(names, "name string, city string, want array<string>")
    assert df.filter(DI.name_tokens(F.col("name"), F.col("city")) != F.col("want")).collect() == []
    rows = [(1, "MUDr. Jana Nováková", None, "ordinace@novakova.cz", None, None), (2, "MUDr. Petr Kos", None, "kos@seznam.cz", None, None),
            (3, "MUDr. Eva Malá", None, "mala@mala.cz", "http://mala.cz", None), (4, "Amodent s.r.o.", "12345678", None, None, "www.amodent.cz")]
    rows += [(n, f"MUDr. Lékař {n}", None, f"l{n}@nemocnice-x.cz", None, None) for n in range(5, 10)]
    providers = spark.createDataFrame(rows, "provider_id long, name string, ico string, email string, web string, web_suggested string").withColumns(
        {"city": F.lit("Praha"), "active": F.lit(True), "web_found": F.lit(None).cast("string"), "web_search_at": F.lit(None).cast("timestamp")})
    cands = DI.site_candidates(providers, NOW)
    assert {(r.url, r.source, r.provider_id) for r in cands.collect()} == {("http://www.amodent.cz/", "user", 4), ("http://novakova.cz/", "email", 1)}
    pages = spark.createDataFrame(
        [(1, "http://novakova.cz/", "<p>Léčíme: MUDr. Janu Novákovou najdete v přízemí, ambulance</p>"),
         (2, "https://www.amodent.cz", "<p>Zubní péče.</p><a href='cenik'>Ceník</a><a href='/kde#x'>O nás</a><a href='/kontakt'>Kontakt</a>"),
         (3, "http://www.amodent.cz/kde", "<p>Firma 0012345678</p>"), (4, "http://www.amodent.cz/kontakt", "<p>nic</p>")], "page_id long, url string, html string")
    none = spark.createDataFrame([], "host string, prefix string, allow boolean")
    found = DI.match_sites(cands, pages, none)
    assert {(r.provider_id, r.matched, r.found_url) for r in found.collect()} == {(1, True, "http://novakova.cz/"), (4, True, "https://www.amodent.cz/")}
    closed = spark.createDataFrame([("www.amodent.cz", "/kde", False), ("novakova.cz", "/", False)], none.schema)
    # the contact page is closed there, but the domain's own name tells as well; a site closed altogether is not read
    assert {(r.provider_id, r.matched) for r in DI.match_sites(cands, pages, closed).collect()} == {(4, True)}
    after = DI.record_sites(providers, cands, found.filter("provider_id = 1"), NOW)
    got = {r.provider_id: (r.web_found, r.web_found_source, r.web_suggested) for r in after.collect()}
    assert got[1] == ("http://novakova.cz/", "email", None) and got[4] == (None, None, None)
    assert DI.site_candidates(after, NOW).count() == 0


def test_report_limit_brute_force(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 3 else f"r{i % 5}", i % 14, t0 + dt.timedelta(minutes=(i * 37) % 4000 + (5000 if i % 11 == 0 else 0))) for i in range(400)]
    reports = spark.createDataFrame(rows, "report_id long, reporter string, provider_id long, created_at timestamp")
    providers = spark.createDataFrame([(i, i != 13) for i in range(14)], "provider_id long, active boolean")
    got = {r.report_id: r.result for r in intake.limit_reports(reports, providers).collect()}
    want, state = {}, {}
    for i, who, pid, t in sorted(rows, key=lambda r: (r[3], r[0])):
        if pid == 13:
            want[i] = "no_provider"
            continue
        day = [a for a in state.get(who, []) if a[1] > t - dt.timedelta(hours=24)]
        want[i] = "duplicate" if any(p == pid for p, _ in day) else "too_many" if len(day) >= 10 else "ok"
        state[who] = day + ([(pid, t)] if want[i] == "ok" else [])
    assert got == want and {"ok", "duplicate", "too_many", "no_provider"} == set(want.values())


def test_names_in_texts(spark):
    """Company numbers with leading zeros, changed endings, whole words only, in the text or not; a portal's page serves all its practices."""
    text = "Ambulance s Trnečkou, dále Roseadentu, IČO 00071234. Firma_Kratka, lipovanské, 5552345678, Holub2"
    people = [(1, "Trnečka", None), (2, "ROSEADENT s.r.o.", None), (3, "X s.r.o.", "71234"), (4, "X s.r.o.", "0071 2349"), (5, "Kratka spol.", None), (6, "Lipovan", None), (7, "X", "2345678"),
              (8, "Holub", None), (9, "Roseade", None), (10, "Trnka", None), (11, "X s.r.o.", "5552345678")]
    cands = spark.createDataFrame([(i, n, c, None, "http://portal.cz/", "user") for i, n, c in people], "provider_id long, name string, ico string, city string, url string, source string")
    reading = spark.createDataFrame([("http://portal.cz/", 1, "http://portal.cz/")], "url string, page_id long, home_url string")
    index = DI.word_index(spark.createDataFrame([(1, text)], "page_id long, text string"))
    import re
    import unicodedata

    folded = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    want = set()
    for i, name, ico in people:
        number = re.sub(r"\D", "", ico or "").lstrip("0")
        words = re.findall(r"[a-z0-9]+", unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower())
        cut = [w[:-2] if len(w) >= 6 else w for w in words if len(w) >= 5]
        if (len(number) >= 6 and re.search(rf"\b0*{number}\b", folded)) or any(re.search(rf"\b{w}[a-z]{{0,3}}\b", folded) for w in cut):
            want.add(i)
    assert {r.provider_id for r in DI.named_on(cands, reading, index).collect()} == want and want >= {1, 2, 11}


def test_status_from_sums_by_day(spark, tmp_path):
    """Kept once, read at several moments: late ones, cut days, the practice's own word running out, an unknown source."""
    import random

    from placewise.operators.status import latest_crawl_note
    from placewise.streaming import reports as S

    rng = random.Random(3)
    rows = [(rng.randrange(9), rng.choice(["user", "clinic", "web_crawl", "region"]), rng.choice(["accepting", "waitlist", "not_accepting"]), rng.randrange(-4, 130 * 24) / 24) for _ in range(250)]
    log = signals(spark, rows)
    for k in (0, 1):
        log.filter(F.col("signal_id") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(SIGNAL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    S.status_stream(arriving, str(tmp_path / "log"), str(tmp_path / "days"), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    for later in (0, 0.4, 17.3, 45, 100):
        now = NOW + dt.timedelta(days=later)
        got = {r.provider_id: r for r in S.status_at(spark, str(tmp_path / "log"), str(tmp_path / "days"), now).collect()}
        want = {r.provider_id: r for r in provider_status(log, now).collect()}
        assert set(got) == set(want)
        for i, w in want.items():
            g = got[i]
            assert (g.last_signal_at, g.status, g.last_source) == (w.last_signal_at, w.status, w.last_source)
            assert abs(g.confidence - w.confidence) <= 0.001 and abs(g.score - w.score) <= 0.001
    odd = log.filter("false").unionByName(signals(spark, [(1, "web_crawl", "maybe", 1)]).withColumn("note", F.lit("x")))
    assert [r.note for r in latest_crawl_note(odd).collect()] == ["x"]


@pytest.mark.parametrize("km", [0.3, 15.0, 90.0])
def test_lists_pick_the_nearest(spark, crowd, km):
    """Grades as in the alerts: those up to ``max_grade`` count for sure, the next one by ``keep``; some partners are left out by id."""
    from pyspark.sql import Window as W

    q, c = sides(crowd, F.lit(km), 5)
    q = q.withColumns({"max_grade": (F.col("qid") % 4 - 1).cast("int"), "limit": F.col("qid") % 4 * 10 + 3, "skip": F.array("qid")})
    c = c.drop("rank").withColumn("news", F.col("c_id") % 50).withColumn("grade", F.floor(F.col("news") / 10).cast("int"))
    got = SP.nearest_lists(q, c, 4, ["specialty"], lambda p: (p["news"] < F.col("limit")) & ~F.array_contains("skip", p["c_id"]))
    got = got.select("qid", F.posexplode_outer("near").alias("at", "p")).filter("p IS NOT NULL").select("qid", "p.c_id", (F.col("at") + 1).alias("rn"))
    order = W.partitionBy("qid").orderBy("km", "c_id")
    want = brute(q, c).filter("news < limit and qid <> c_id").withColumn("rn", F.row_number().over(order)).filter("rn <= 4").select("qid", "c_id", "rn")
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_pending_alerts_shuffle_no_pairs(spark):
    """What reaches the alerts is picked within a subscription's row: no pair is sorted or joined with what was told."""
    listing = spark.range(500).select(
        F.col("id").alias("provider_id"), (49.19 + F.col("id") / 50_000).alias("lat"), F.lit(16.6068).alias("lng"), F.lit("zubar").alias("specialty"), F.lit("accepting").alias("status"))
    s = signals(spark, [(i, "clinic", "accepting", 0) for i in range(500)])
    ledger = spark.createDataFrame([(1, 1, NOW)], "subscription_id long, provider_id long, sent_at timestamp")
    due = A.pending_alerts(subs(spark, [(i, 2, 1) for i in range(1, 40)]), listing, s, ledger, NOW)
    plan = due._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "WindowGroupLimit" not in plan and "row_number" not in plan
    assert due.count() == 39 * 10 and 1 not in {r.provider_id for r in due.filter("subscription_id = 1").collect()}


def test_others_nearby_sort_no_pairs(spark, crowd):
    """Alternatives and accepting practices nearby are picked in the practice's own row."""
    from placewise.operators import serve

    cards = crowd.select(
        "specialty", F.col("pid").alias("provider_id"), "lat", "lng", F.lit("t").alias("city_slug"),
        F.element_at(F.array(F.lit("accepting"), F.lit("waitlist"), F.lit("unknown")), F.col("rank") + 1).alias("status"))
    for found in (serve.alternatives(cards), serve.accepting_nearby(cards)):
        assert "WindowGroupLimit" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() > 0


def test_points_on_an_outline_follow_the_areas_rule(spark):
    """A corner and a point of a slanted edge, which the even-odd test leaves to rounding."""
    from placewise.operators import areas

    ring = "array(struct(0.0D x, 0.0D y), struct(1.0D x, 1.0D y), struct(2.0D x, 0.0D y), struct(1.0D x, -1.0D y), struct(0.0D x, 0.0D y))"
    area = spark.range(1).selectExpr("'a' area", f"array({ring}) rings")
    points = spark.createDataFrame([(1, 1.0, 1.0 + 1e-15), (2, 1.7, 0.3), (3, 1.0, 0.0), (4, 3.0, 0.0), (5, 0.3, 0.3 + 1e-6)], "pid long, lng double, lat double")
    ids = lambda rule: sorted(r.pid for r in areas.inside(points, area, outline=F.lit(rule)).collect())
    assert ids(True) == [1, 2, 3] and ids(False) == [3]
