"""Importance resampling against plain Python, and the checksum algebra behind it."""

import hashlib
import re
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
import pytest

from placewise.llm import importance as im
from placewise.llm.common import read_table

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def buckets_of(text):
    w = words_of(text)
    return [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets_of(text))
    for text in target:
        t.update(buckets_of(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [floor(1000 * log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for i, text in docs:
        f = buckets_of(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = None if i is None else int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + floor(-1000 * log(-log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, len(words_of(text))])
    able = sorted((r for r in out if r[0] is not None and r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, score string, rank int, weight string")


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is None, v or 0) for v in r))


def test_whole_draw(spark):
    docs = [(r.doc_id, r.text) for r in read_table(spark, SMALL, "documents").collect()]
    long = " ".join(f"w{k * 7919 % 9991} Éa{k % 13}" for k in range(200_000))  # several pieces
    docs += [(None, "a text without an id " * 9), (None, None), (9000, ""), (9001, " \n.,"), (9002, "One"), (9003, long), (9004, "é" * 2_000_000), (9005, "a" * 70 + " " + "b" * 200),
             (9006, docs[3][1]), (9006, docs[4][1]), (9007, "same " * 19), (9008, "same " * 20), (9009, "same " * 21)]
    target = [r.text for r in read_table(spark, SMALL, "benchmark").collect()] + [None, ""]
    got = im.resampled(table(spark, docs), spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert order((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got) == order(r[:5] for r in brute(docs, target))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert im.resampled(table(spark, []), none).collect() == []
    docs = [(k, f"word{k} and more " * 10) for k in range(9)]
    got = im.resampled(table(spark, docs), none).collect()
    assert order((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got) == order(r[:5] for r in brute(docs, []))


def test_shifted_checksums():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 63, 64, 65, 1000, 70_001):
        a, b = rng.bytes(9), rng.bytes(n)
        got = im.shift(np.array([zlib.crc32(a)], np.uint32), np.array([n])) ^ np.uint32(zlib.crc32(b))
        assert int(got[0]) == zlib.crc32(a + b)


@pytest.mark.parametrize("most", [4, 50, 10_000])
def test_results_do_not_depend_on_the_dictionary(most, monkeypatch):
    monkeypatch.setattr(im, "SCAN_BYTES", 97)
    texts = [None, "", "x y z x", " ".join(f"a{k % 17}b" for k in range(300)), "é ü\nW-w", "z", "end of all " * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    known = im.Dictionary(most)
    for _ in range(3):
        found = {k: Counter() for k in range(len(texts))}
        for owner, words, pairs in im.features(batch, known):
            for own, bucket in ((owner, words), (owner[1:], pairs)):
                for o, b in zip(own, bucket, strict=True):
                    if b >= 0:
                        found[int(o)][int(b)] += 1
        assert [found[k] for k in range(len(texts))] == [Counter(buckets_of(t)) for t in texts]
