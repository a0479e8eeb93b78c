"""Exact top-k by inner product with a pivot table.

Largest inner products are nearest neighbours after one more coordinate: with x' = (x, sqrt(M - |x|^2)) and q' = (q, 0), where
M is the largest squared length, |q' - x'|^2 = |q|^2 + M - 2 q.x. So for every pivot p the distances to p bound the score:
q.x <= (|q|^2 + M - (d(q', p) - d(x', p))^2) / 2, and the best of many pivots gives the tightest bound.

1. Pivots: rows far from one another, out of a bounded sample by hash. Each row keeps its distances to all pivots.
2. Rows are range-partitioned by (nearest pivot, distance to it, id) into groups of bounded size and stored. A vector that a
   third of all rows share is spread over many groups by its id.
3. Queries search their own group first, which gives each a k-th best score to beat.
4. Queries in slabs of bounded size then meet every group: one cell per (group, slab). In a cell a query skips the group if
   no bound inside reaches its k-th best; else it evaluates candidates in order of their bounds, and stops at the first bound
   below its k-th best. Bounds carry a margin for rounding, scores are exact integers, and equal bounds go on, so nothing is lost.
5. The best k of what the cells return.

The queries are a stated set (ids divisible by ``every``) against all rows, in blocks. Vectors that are null or hold null or
non-finite components take no part, nor do rows without an id, nor vectors with a component of 2**31 or more after scaling;
shorter vectors count as filled up with zeros; rows that repeat an id count once, with their smallest vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, setup

PIVOTS, SAMPLE = 32, 512
GROUP, SLAB = 4096, 512
SCALE = 256


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 * x) of every component, for the rows that take part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < 2.0**31 - 1))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).filter(sound)
    return rows.groupBy("vec_id").agg(F.min(F.transform("e", lambda x: F.floor(x * SCALE).cast("int"))).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    lengths = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width), np.float64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def choose_pivots(sample: np.ndarray) -> np.ndarray:
    """Rows of the sample, each far from those before it."""
    if not len(sample):
        return sample
    chosen = [int(np.argmax((sample**2).sum(1)))]
    far = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < PIVOTS and far.max() > 0:
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivots_extra: np.ndarray) -> np.ndarray:
    """Distances of the lengthened rows to all pivots."""
    squared = (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T + (extra[:, None] - pivots_extra) ** 2
    return np.sqrt(np.maximum(squared, 0))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


class Search:
    """The candidates of one group, searched by one query after another."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, table: np.ndarray, most: float, k: int):
        self.ids, self.x, self.table, self.most, self.k = ids, x, table, most, k
        self.largest, self.whole = float(np.abs(x).max()) if x.size else 0.0, None
        self.low, self.high = table.min(0), table.max(0)

    def bound(self, q2: float, gap: np.ndarray, size: np.ndarray) -> np.ndarray:
        gap = np.maximum(gap - 1e-6 * (1 + size), 0)
        return (q2 + self.most - gap**2) / 2 * (1 + 1e-9) + 1e-6 * (1 + abs(q2))

    def exact(self, q: np.ndarray) -> np.ndarray:
        """The vectors in numbers whose products with this query are exact: float64 below 2**53, else whole numbers."""
        if self.largest * float(np.abs(q).max(initial=0)) * self.x.shape[1] < 2.0**53:
            return self.x
        if self.whole is None:
            self.whole = self.x.astype(np.int64)
        return self.whole

    def run(self, q_id: int, q: np.ndarray, to_pivots: np.ndarray, beat: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best candidates that can still be among the query's best; ``beat`` is its k-th best so far."""
        q2 = float(q @ q)
        apart = np.maximum(np.maximum(to_pivots - self.high, self.low - to_pivots), 0).max()
        if self.bound(q2, apart, np.array(to_pivots.max() + self.high.max())) < beat:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bounds = self.bound(q2, np.abs(self.table - to_pivots).max(1), self.table.max(1) + to_pivots.max())
        order = np.argsort(-bounds, kind="stable")
        order = order[self.ids[order] != q_id]
        ids, scores, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 64
        exact = self.exact(q)
        query = q.astype(exact.dtype)
        while at < len(order) and bounds[order[at]] >= beat:
            part = order[at : at + step]
            ids = np.concatenate([ids, self.ids[part]])
            scores = np.concatenate([scores, (exact[part] @ query).astype(np.int64)])
            top = best(scores, ids, self.k)
            ids, scores = ids[top], scores[top]
            if len(ids) == self.k:
                beat = max(beat, float(scores[-1]))
            at, step = at + step, min(step * 2, 4096)
        keep = scores >= beat
        return ids[keep], scores[keep]


FOUND = "query_id long, vec_id long, score long"
FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products."""
    setup(embeddings.sparkSession)
    vectors = cut_lineage(integer_vectors(embeddings))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, width, most = vectors.select(square.alias("s"), F.size("v").alias("w")).agg(F.count("*"), F.max("w"), F.max("s")).first()
    width, most = max(width or 0, 1), most or 0.0
    sample = vectors.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).collect()
    fit = np.zeros((len(sample), width))
    for row, r in zip(fit, sample, strict=True):
        row[: len(r.v)] = r.v
    pivots = choose_pivots(fit)
    pivots_extra = np.sqrt(np.maximum(most - (pivots**2).sum(1), 0))

    def lengthened(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(most - (x**2).sum(1), 0))

    def near(batches):
        for batch in batches:
            d = distances(x := matrix(batch.column("v"), width), lengthened(x), pivots, pivots_extra)
            table = pa.FixedSizeListArray.from_arrays(pa.array(d.astype(np.float32).ravel()), len(pivots)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), table, pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))],
                ["vec_id", "v", "d", "pivot", "away"],
            )

    groups = max(1, -(-n // GROUP))
    rows = vectors.mapInArrow(near, "vec_id long, v array<int>, d array<float>, pivot int, away double")
    rows = rows.repartitionByRange(groups, "pivot", "away", "vec_id").select("vec_id", "v", "d", F.spark_partition_id().alias("group"))
    rows = cut_lineage(rows)
    groups = (rows.agg(F.max("group")).first()[0] or 0) + 1

    def own(key: tuple, table: pa.Table) -> pa.Table:
        ids, x = table["vec_id"].to_numpy(), matrix(table["v"].combine_chunks(), width)
        search = Search(ids, x, matrix(table["d"].combine_chunks(), len(pivots)), most, k)
        asked = np.flatnonzero(ids % every == 0)
        to_pivots = distances(x[asked], np.zeros(len(asked)), pivots, pivots_extra)
        return collected(search, ids[asked], x[asked], to_pivots, np.full(len(asked), -np.inf))

    def collected(search, q_ids, q, to_pivots, beat) -> pa.Table:
        out = [(q_id, *search.run(int(q_id), v, d, float(b))) for q_id, v, d, b in zip(q_ids, q, to_pivots, beat, strict=True)]
        if not out:
            return FOUND_ARROW.empty_table()
        query = np.repeat([o[0] for o in out], [len(o[1]) for o in out])
        return pa.table([pa.array(query, pa.int64()), pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out]))], schema=FOUND_ARROW)

    home = cut_lineage(rows.groupBy("group").applyInArrow(own, FOUND))
    reached = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    beat = F.when(F.col("n") >= k, F.col("low").cast("double")).otherwise(F.lit(float("-inf")))
    queries = rows.filter(F.col("vec_id") % every == 0).join(reached, F.col("vec_id") == F.col("query_id"), "left")
    queries = queries.select("vec_id", "v", F.col("group").alias("home"), F.coalesce(beat, F.lit(float("-inf"))).alias("beat"))
    slabs = max(1, -(-(n // every + 1) // SLAB))
    to_groups = queries.withColumn("slab", F.pmod(F.xxhash64("vec_id"), F.lit(slabs)).cast("int")).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    ).filter("group <> home")
    to_slabs = rows.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))

    def cell(asked: pa.Table, table: pa.Table) -> pa.Table:
        if not len(asked) or not len(table):
            return FOUND_ARROW.empty_table()
        x, q = matrix(table["v"].combine_chunks(), width), matrix(asked["v"].combine_chunks(), width)
        search = Search(table["vec_id"].to_numpy(), x, matrix(table["d"].combine_chunks(), len(pivots)), most, k)
        return collected(search, asked["vec_id"].to_numpy(), q, distances(q, np.zeros(len(q)), pivots, pivots_extra), asked["beat"].to_numpy())

    one = to_groups.select(*[F.col(c).alias(c) for c in ("group", "slab", "vec_id", "v", "beat")])
    other = to_slabs.select(*[F.col(c).alias(c) for c in ("group", "slab", "vec_id", "v", "d")])
    away = one.groupBy("group", "slab").cogroup(other.groupBy("group", "slab")).applyInArrow(cell, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return home.union(away).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
