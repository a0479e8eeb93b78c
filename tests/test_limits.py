"""Rate limits decided in parallel slices and rounds, against one pass in order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from placewise.operators import intake
from placewise.operators.limits import DAY_US, report_start, report_step
from placewise.operators.serial import decided_in_slices
from placewise.streaming import reports as S

T0 = dt.datetime(2024, 1, 1)
REPORTS = "report_id long, reporter string, provider_id long, created_at timestamp"


def minutes(m):
    return T0 + dt.timedelta(minutes=m)


def one_pass(rows, closed=(13,)):
    want, state = {}, {}
    for i, who, pid, t in sorted(rows, key=lambda r: (r[3], r[0])):
        if pid in closed:
            want[i] = "no_provider"
            continue
        day = [a for a in state.get(who or "", []) if a[1] > t - dt.timedelta(hours=24)]
        want[i] = "duplicate" if any(p == pid for p, _ in day) else "too_many" if len(day) >= 10 else "ok"
        state[who or ""] = day + ([(pid, t)] if want[i] == "ok" else [])
    return want


def providers(spark):
    return spark.createDataFrame([(i, i != 13) for i in range(40)], "provider_id long, active boolean")


@pytest.mark.parametrize("slices", [1, 3, 16, 40])
def test_one_reporter_in_slices(spark, slices):
    """One reporter who never rests, and short slices: entries pass through several of them."""
    rng = random.Random(slices)
    rows = [(i, "hot" if i % 10 else None, rng.randrange(40), minutes(rng.randrange(6000))) for i in range(600)]
    got = intake.limit_reports(spark.createDataFrame(rows, REPORTS), providers(spark), slices)
    assert {r.report_id: r.result for r in got.collect()} == one_pass(rows)


def test_slices_of_a_hot_reporter_are_even(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("report_id"), F.lit("hot").alias("reporter"), (F.col("id") % 37).alias("provider_id"), (F.col("id") * 60_000_000).alias("ts_us"))
    done = decided_in_slices(rows, "reporter", "ts_us", ["report_id"], report_step, report_start, ["provider_id"], F.col("result") == "ok", DAY_US, 8)
    sizes = [r[0] for r in rows.repartitionByRange(8, "reporter", "ts_us", "report_id").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2] and done.count() == 20_000
    assert done.filter("result = 'ok'").count() == sum(v == "ok" for v in one_pass([(i, "hot", i % 37, minutes(i)) for i in range(20_000)]).values())


def test_no_reports(spark):
    assert intake.limit_reports(spark.createDataFrame([], REPORTS), providers(spark)).collect() == []


def test_stream_gives_every_report_a_result(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(4)
    rows = [(i, f"r{i % 3}" if i % 4 else None, rng.randrange(20), minutes(i * 11)) for i in range(300)]
    late = [(1000, "r1", 2, minutes(5)), (1001, "new", 2, minutes(5)), (1002, "r1", 13, minutes(5)), (1003, "w", 2, minutes(1630)), (1004, "w", 3, minutes(1500))]
    early = [(1005, "w", 1, minutes(1640))]
    for part in (rows[:150] + early, rows[150:] + late):
        spark.createDataFrame(part, REPORTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(REPORTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = S.limit_reports_stream(arriving, providers(spark), dt.timedelta(hours=1))
    out.writeStream.option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    got = {r.report_id: r.result for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {i: got[i] for i in range(300)} == one_pass(rows)
    assert (got[1000], got[1001], got[1002]) == ("late", "ok", "no_provider")
    assert (got[1003], got[1004], got[1005]) == ("ok", "late", "ok") and len(got) == 306


REQUESTS = "request_id long, email string, requester string, specialty string, radius_km int, lat double, lng double, created_at timestamp"
SUBS = (
    "subscription_id long, email string, requester_hash string, specialty_slug string, radius_km int, lat double, lng double, created_at timestamp, "
    "verified_at timestamp, unsubscribed_at timestamp, confirm_sends int"
)


def serial_signups(requests, subs, mails, most):
    """One request after the other, all limits read from all rows."""
    rows, result, sent = [], {}, list(mails)
    day = dt.timedelta(days=1)
    events = [(s[7], 0, s[0], s) for s in subs] + [(r[7], 1, r[0], r) for r in requests]
    for t, kind, i, e in sorted(events, key=lambda x: x[:3]):
        where = (e[3], e[4], round(e[5], 3), round(e[6], 3))
        if kind == 0:
            rows.append({"email": e[1].lower(), "owner": e[2], "where": where, "at": t, "v": e[8], "u": e[9], "sends": e[10]})
            continue
        mine = [r for r in rows if r["email"] == e[1].lower()]
        active = [r for r in mine if r["u"] is None or r["u"] > t]
        same = next((r for r in active if r["where"] == where), None)
        recent = lambda rs: sum(r["at"] > t - day for r in rs)  # noqa: E731, B023
        if same and same["v"] and same["v"] <= t:
            result[i] = "already"
        elif recent([r for r in rows if r["owner"] == e[2]]) >= 5 or recent(mine) >= 3 or len(active) >= 10 or sum(t - day < m <= t for m in sent) >= most:
            result[i] = "too_many"
        elif same and (same["at"] > t - dt.timedelta(minutes=10) or same["sends"] >= 3):
            result[i] = "already"
        else:
            result[i] = "send"
            sent.append(t)
            if same:
                same["at"], same["sends"] = t, same["sends"] + 1
            else:
                rows.append({"email": e[1].lower(), "owner": e[2], "where": where, "at": t, "v": None, "u": None, "sends": 1})
    return result


@pytest.mark.parametrize("seed, most", [(1, 450), (2, 14)])
def test_signups(spark, monkeypatch, seed, most):
    """Addresses shared by visitors, requests in bursts, renewed subscriptions of others, a mail budget that binds."""
    from placewise.operators import limits

    monkeypatch.setattr(limits, "DAILY_MAILS", most)
    rng = random.Random(seed)
    place = lambda: (rng.choice(["zubar", "ocni"]), rng.choice([5, 20]), 49.0 + rng.randrange(3) / 1000, 15.0)
    requests = [(i, f"{'A' if i % 2 else 'a'}{rng.randrange(6)}@x.cz", f"h{rng.randrange(4)}", *place(), minutes(rng.randrange(2 * 1440) // 7 * 7)) for i in range(70)]
    subs = []
    for i in range(12):
        t = minutes(rng.randrange(-900, 3000))
        subs.append((i, f"a{rng.randrange(6)}@x.cz", f"h{rng.randrange(4)}", *place(), t, t + dt.timedelta(hours=30) if i % 3 == 0 else None, t + dt.timedelta(hours=40) if i % 4 == 1 else None, 1 + i % 3))
    mails = [minutes(rng.randrange(-1440, 5000)) for _ in range(6)]
    got = intake.limit_signups(
        spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(subs, SUBS),
        spark.createDataFrame([(k, "alert", m) for k, m in enumerate(mails)], "mail_id long, kind string, sent_at timestamp"), slices=2,
    )
    assert {r.request_id: r.result for r in got.collect()} == serial_signups(requests, subs, mails, most)


@pytest.mark.parametrize("until, passes", [(5000, 0), (1500, None)])
def test_signups_when_the_log_fills_the_day(spark, monkeypatch, until, passes):
    """A full mail log decides by itself: no request goes through the rounds, or only those that come when it is not full."""
    from placewise.operators import limits

    monkeypatch.setattr(limits, "DAILY_MAILS", 6)
    calls, decide = [], intake.decided_in_slices
    monkeypatch.setattr(intake, "decided_in_slices", lambda *a, **k: calls.append(1) or decide(*a, **k))
    rng = random.Random(5)
    place = lambda: (rng.choice(["zubar", "ocni"]), 5, 49.0 + rng.randrange(2) / 1000, 15.0)
    requests = [(i, f"a{rng.randrange(i // 10 + 1)}@x.cz", f"h{rng.randrange(4)}", *place(), minutes(i * 45)) for i in range(60)]
    subs = []
    for i in range(20):
        t = minutes(rng.randrange(-900, 2700) // 45 * 45)
        subs.append((i, f"A{rng.randrange(7)}@x.cz", f"h{rng.randrange(4)}", *place(), t, t + dt.timedelta(hours=5) if i % 2 else None, t + dt.timedelta(hours=20) if i % 3 == 1 else None, 1))
    mails = [minutes(m) for m in range(-1440, until, 180)]
    got = intake.limit_signups(
        spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(subs, SUBS),
        spark.createDataFrame([(k, "alert", m) for k, m in enumerate(mails)], "mail_id long, kind string, sent_at timestamp"), slices=2,
    )
    want = serial_signups(requests, subs, mails, 6)
    assert {r.request_id: r.result for r in got.collect()} == want and len(set(want.values())) == (2 if passes == 0 else 3)
    assert len(calls) == 0 if passes == 0 else calls
