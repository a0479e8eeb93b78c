"""Scores stay exact where the group is small and the query large."""

import numpy as np
import pytest

from placewise.llm import topk


@pytest.mark.parametrize("group, query", [(2**21, 2**31 - 7), (2**10, 2**31 - 7), (3, 5), (2**26 + 1, 2**26 - 1)])
def test_exact_scores(group, query):
    rng = np.random.default_rng(group)
    x = rng.integers(group // 2, group + 1, (300, 64)).astype(np.float64)
    q = rng.integers(query - 3, query + 1, 64).astype(np.float64)
    most = float((x**2).sum(1).max())
    pivots = topk.choose_pivots(x[:40])
    extra = lambda v: np.sqrt(np.maximum(most - (v**2).sum(1), 0))
    table = topk.distances(x, extra(x), pivots, extra(pivots))
    to_pivots = topk.distances(q[None, :], np.zeros(1), pivots, extra(pivots))[0]
    ids, scores = topk.Search(np.arange(300), x, table, most, 5).run(-1, q, to_pivots, -np.inf)
    want = sorted(((-sum(int(a) * int(b) for a, b in zip(row, q)), i) for i, row in enumerate(x)))[:5]
    assert sorted((-int(s), int(i)) for i, s in zip(ids, scores)) == want
