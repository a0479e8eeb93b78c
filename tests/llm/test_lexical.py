"""Ranked search against plain Python, the bounds of the trees, and awkward tables."""

import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from placewise.llm import lexical as lx
from placewise.llm.common import read_table

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    """Rows of every item row, in order; documents are told apart by place."""
    lists = [(i, Counter(terms_of(t))) for i, t in docs]
    lists = [(i, c, sum(c.values())) for i, c in lists if c]
    n_docs, length = len(lists), sum(n for _, _, n in lists)
    df = Counter(t for _, c, _ in lists for t in c)
    out = []
    for item, text in items:
        wanted, scores = Counter(terms_of(text)), []
        for i, c, n in lists:
            m = 75 + (25 * n * n_docs) // length
            s = sum(x * floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, x in wanted.items() if t in c)
            if s > 0 and i is not None and item is not None:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, item string"),
        spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, score string"),
    )


@pytest.fixture(scope="module")
def rows(spark):
    docs = [(r.doc_id, r.text) for r in read_table(spark, SMALL, "documents").collect()]
    items = [(r.item_id, r.text) for r in read_table(spark, SMALL, "benchmark").collect()]
    words = terms_of(items[0][1])
    docs += [(None, items[0][1]), (None, None), (9000, ""), (9001, " ., "), (9002, " ".join(words * 9000)), (9003, items[1][1] + " Éa_b"), (9003, items[1][1]), (9004, items[2][1].upper())]
    docs += [(9100 + k, items[3][1] + " same") for k in range(60)]  # ties beyond the k best
    items += [(None, words[0]), (900, None), (901, ""), (902, "nowhere-to-be-found"), (903, "éa B b SAME same"), (904, " ".join(words) * 2)]
    return docs, items


@pytest.mark.parametrize("block, group, leaf, at_once", [(200_000, 1 << 18, 8, 256), (90, 700, 1, 4)])
def test_best_documents(spark, rows, monkeypatch, block, group, leaf, at_once):
    """Also with several blocks of items, many small trees and single-document leaves."""
    docs, items = rows
    if block < 1000:
        items = items[:3] + items[-6:]
    for name, value in (("BLOCK_TERMS", block), ("GROUP_POSTINGS", group), ("LEAF", leaf), ("AT_ONCE", at_once)):
        monkeypatch.setattr(lx, name, value)
    got = lx.best_documents(*tables(spark, docs, items), k=20).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == sorted(brute(docs, items, 20))


def test_empty_tables_and_repeated_items(spark):
    docs, items = [(k, f"one two w{k % 3}") for k in range(9)], [(1, "two w1"), (1, "w2")]
    assert lx.best_documents(*tables(spark, [], items)).collect() == []
    assert lx.best_documents(*tables(spark, docs, [])).collect() == []
    got = lx.best_documents(*tables(spark, docs, items), k=4).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == sorted(brute(docs, items, 4))


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    n, width = 3000, 60
    owner, ranks = np.nonzero(rng.random((n, width)) < 0.5 / (1 + np.arange(width)) ** 0.5)
    counts = rng.integers(1, 9, len(owner))
    tree = lx.Tree(np.arange(n), rng.integers(75, 300, n), owner, ranks, counts, width)
    q, w = np.sort(rng.choice(width, 8, replace=False)), rng.integers(1, 9000, 8)
    bound, exact = tree.bounds(q, w), tree.scores(np.arange(n), q, w)
    assert all(bound[x] >= exact[tree.low[x] : tree.high[x]].max() for x in range(len(tree.low)))
    assert sorted(np.concatenate([np.arange(tree.low[x], tree.high[x]) for x in np.flatnonzero(tree.leaf)]).tolist()) == list(range(n))
    best = lx.Best(5)
    assert tree.search(q, w, best) < n
    want = sorted(zip((-exact).tolist(), tree.ids.tolist()))[:5]
    assert sorted((-s, -i) for s, i in best.heap) == want
