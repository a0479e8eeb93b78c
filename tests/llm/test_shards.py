"""The k-d tree of shards against a tree built in plain Python, and its promises on awkward tables."""

import zlib
from collections import defaultdict

import pytest

from placewise.llm import shards as sh
from placewise.llm.common import read_table

DOCS = "doc_id long, text string, lang string, source string, shard string, size string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)


def check(rows, got, shards, tolerance, torn=0):
    """Every row once, right sizes and checksums, gapless slots, near equal bytes, equal texts together but for ``torn`` of them."""
    size = lambda t: len((t or "").encode()) + 1
    want = sorted(((r[0] is None, r[0] or 0), size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.size, r.text_crc32) for r in got) == want
    slots, weights, homes = defaultdict(list), dict.fromkeys(range(shards), 0), defaultdict(set)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        weights[r.shard] += r.size
        homes[(r.text_crc32, r.size)].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(weights.values()) / shards
    assert all(abs(w - mean) <= tolerance for w in weights.values())
    assert sum(len(h) > 1 for h in homes.values()) == torn


@pytest.fixture(scope="module")
def small_rows(spark):
    base = [(r.doc_id, r.text, r.lang, r.source) for r in read_table(spark, "/root/testdata/sf0.001", "documents").collect()]
    odd = [(None, "no id", None, None), (None, None, None, None), (9000, "", "en", ""), (9001, "é" * 900, "fr", "é"), (9001, "é" * 900, "fr", "é"), (9002, base[0][1], None, "z")]
    return base + odd + [(9100 + k, "the same line", "en", "src0") for k in range(150)]


def test_given_and_awkward_rows(spark, small_rows):
    check(small_rows, sh.sharded(table(spark, small_rows), shards=16).collect(), 16, 600)


def test_a_group_above_a_shard_is_cut_by_rows(spark):
    rows = [(k, "copies " * 9, "en", "src0") for k in range(300)] + [(1000 + k, f"text {k} " * (k % 7 + 1), "en", f"s{k % 3}") for k in range(300)]
    check(rows, sh.sharded(table(spark, rows), shards=4).collect(), 4, 130, torn=1)


def test_only_copies_and_empty_tables(spark):
    rows = [(k, "one text", None, None) for k in range(40)]
    check(rows, sh.sharded(table(spark, rows), shards=8).collect(), 8, 0, torn=1)
    assert sh.sharded(table(spark, []), shards=16).collect() == []
    assert [(r.shard, r.slot) for r in sh.sharded(table(spark, [(5, None, None, None)]), shards=16).collect()][0][1] == 0


def test_target_bytes_set_the_number_of_shards(spark, small_rows):
    total = sum(len((r[1] or "").encode()) + 1 for r in small_rows)
    got = sh.sharded(table(spark, small_rows), target_bytes=total // 5).collect()
    check(small_rows, got, 6, 600)
    with pytest.raises(ValueError):
        sh.sharded(table(spark, small_rows), target_bytes=1)


def test_tree_equals_plain_python(spark, monkeypatch):
    """Light points only: each node is cut across its widest dimension, at the key nearest to its share of the bytes."""
    monkeypatch.setattr(sh, "HEAVY_SHARE", 1e-9)
    monkeypatch.setattr(sh, "HEAVY_ROWS", 1e-9)
    monkeypatch.setattr(sh, "PRECISION", 10**9)
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    points = [r.asDict() for r in sh.points_of(sh.rows_of(docs)).collect()]

    def split(points, first, leaves):
        if leaves == 1:
            return {(p["h"], p["crc"], p["size"]): first for p in points}
        width = [(max(p[f"k{d}"] for p in points) >> 32) - (min(p[f"k{d}"] for p in points) >> 32) for d in range(4)]
        d = width.index(max(width))
        points = sorted(points, key=lambda p: p[f"k{d}"])
        aim = sum(p["size"] * p["n"] for p in points) * (leaves // 2) // leaves
        seen, cut = 0, len(points)
        for k, p in enumerate(points):
            w = p["size"] * p["n"]
            if seen + w >= aim:
                cut = k + 1 if seen + w - aim <= aim - seen else k
                break
            seen += w
        half = leaves // 2
        return split(points[:cut], first, half) | split(points[cut:], first + half, leaves - half)

    want = split(points, 0, 6)
    rows = {r.doc_id: (r.text_crc32, r.size, r.shard) for r in sh.sharded(docs, shards=6).collect()}
    homes = {(crc, size): shard for (_, crc, size), shard in want.items()}
    assert all(homes[(crc, size)] == shard for crc, size, shard in rows.values())
