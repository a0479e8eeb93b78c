"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning of signatures, exact check of the survivors.

1. *Sketch* (one pass over the texts): size and 128-bit fingerprint of the shingle set, and 192 min-hashes of 16 bits.
   Documents with equal sets form a class; only its smallest id goes on, so copies never make pairs.
2. *Bands*: 32 bands of 6 min-hashes; classes with an equal band share a bucket. A bucket is cut into blocks of bounded
   size, and each pair of its blocks is a *cell*, so a bucket of any size is spread over many tasks and no pair is left out.
3. *Sequential Bayesian verification*: in a cell, signatures are compared in batches of 32 min-hashes. After each batch a
   pair is dropped when the posterior probability that its similarity reaches the threshold is below the chosen miss
   probability. A pair that meets in several bands is looked at in the first one only. Cells name the classes that take
   part in a surviving pair, never the pairs themselves.
4. *Exact check*: only those classes get their full shingle sets, in the same cells; a cell returns the links that join
   different parts of it (a spanning forest), which is all that the components need.
5. Components over the links give each document the smallest id that it can reach.

A pair at similarity 0.85 shares none of the 32 bands with probability (1 - 0.85**6) ** 32 < 3e-7.

Defined cases: a null or blank text has an empty set and is linked with nothing; a null id takes no part, has no component
and is kept; rows that repeat an id count as one document with several texts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, mix64, setup, shingles, sliced, text_buffers, with_columns, word_hashes
from .components import components

BANDS, ROWS = 32, 6
HASHES = BANDS * ROWS
BATCH = 32
SEEDS = np.random.default_rng(7).integers(1, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 1 << 20
PAIRS_AT_ONCE = 1 << 16


def min_hashes(sets: np.ndarray) -> np.ndarray:
    """The low 16 bits of the smallest value under each of the hash functions."""
    low, high = sets.astype(np.uint32), (sets >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 2048):
        x = low[None, k : k + 2048] ^ SEEDS[:, None]
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x += high[None, k : k + 2048]
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        np.minimum(best, x.min(axis=1), out=best)
    return best.astype(np.uint16)


def fingerprint(sets: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set: equal sets have equal sums."""
    one = int(mix64(sets + np.uint64(1)).sum(dtype=np.uint64)) if len(sets) else 0
    two = int(mix64(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) if len(sets) else 0
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    return signed(one), signed(two)


def sets_of(batch: pa.RecordBatch, column: str, size: int) -> Iterator[np.ndarray]:
    """The shingle set of each text of a batch."""
    data, offsets = text_buffers(batch.column(column))
    hashes, owner = word_hashes(data, offsets)
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    for k in range(len(offsets) - 1):
        yield shingles(hashes[bounds[k] : bounds[k + 1]], size)


def sketch(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sig) of every row."""

    def run(batches):
        for batch in sliced(batches):
            n, f1, f2, sig = [], [], [], []
            for s in sets_of(batch, "text", size):
                a, b = fingerprint(s)
                n.append(len(s)), f1.append(a), f2.append(b)
                sig.append(min_hashes(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())],
                ["doc_id", "n_shingles", "f1", "f2", "sig"],
            )

    return with_columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, sig binary")


def buckets_of(sigs: np.ndarray) -> np.ndarray:
    """The key of each band of each signature: equal keys for equal bands."""
    bands = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = mix64(key ^ (bands[:, :, r] + np.uint64(r << 20)))
    return key.view(np.int64)


def with_buckets(reps: DataFrame) -> DataFrame:
    """One row per class and band: (bucket, f1, doc_id, n_shingles)."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                keys = buckets_of(signatures(part.column("sig")))
                take = pa.array(np.repeat(np.arange(part.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), *[part.column(c).take(take) for c in ("f1", "doc_id", "n_shingles")]],
                    ["bucket", "f1", "doc_id", "n_shingles"],
                )

    return reps.select("f1", "doc_id", "n_shingles", "sig").mapInArrow(run, "bucket long, f1 long, doc_id long, n_shingles long")


def signatures(column: pa.Array) -> np.ndarray:
    """A matrix of signatures from a binary column."""
    data, _ = text_buffers(column)
    return data.view(np.uint16).reshape(-1, HASHES)


def fewest_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on): below, P(similarity >= threshold | matches) < ``miss``.

    With a flat prior the posterior after m matches of k is Beta(m + 1, k - m + 1), whose upper tail at t equals
    P(Binomial(k + 1, t) <= m).
    """
    out = []
    for k in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out.append((k, m))
    return out


def surviving(sigs: np.ndarray, a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs (a[i], b[i]) outlast every batch of min-hashes."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    at = 0
    for k, least in steps:
        matches = matches + (sigs[a[alive], at:k] == sigs[b[alive], at:k]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        alive, matches, at = alive[keep], matches[keep], k
        if not len(alive):
            break
    return alive


def first_common_band(sigs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band in which both signatures agree."""
    same = (sigs[a].reshape(-1, BANDS, ROWS) == sigs[b].reshape(-1, BANDS, ROWS)).all(axis=2)
    return same.argmax(axis=1)


def pairs_in(sizes_a: np.ndarray, sizes_b: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(cell, row, row) of all pairs of many cells, in pieces: within the first block, or across two blocks."""
    small = (sizes_b == 0) & (sizes_a <= 64)
    for m in np.unique(sizes_a[small]):
        if m < 2:
            continue
        i, j = np.triu_indices(int(m), 1)
        cells = (small & (sizes_a == m)).nonzero()[0]
        step = max(1, PAIRS_AT_ONCE // len(i))
        for k in range(0, len(cells), step):
            c = cells[k : k + step]
            yield np.repeat(c, len(i)), (starts[c][:, None] + i).ravel(), (starts[c][:, None] + j).ravel()
    for c in (~small).nonzero()[0]:
        na, nb, at = int(sizes_a[c]), int(sizes_b[c]), int(starts[c])
        step = max(1, PAIRS_AT_ONCE // max(1, nb or na))
        for k in range(0, na, step):
            rows = np.arange(k, min(na, k + step))
            if nb:
                i, j = np.repeat(rows, nb), np.tile(np.arange(na, na + nb), len(rows))
            else:
                i, j = np.repeat(rows, na), np.tile(np.arange(na), len(rows))
                i, j = i[i < j], j[i < j]
            if len(i):
                yield np.full(len(i), c), at + i, at + j


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole cells from batches sorted by (bucket, cell, side)."""
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        rows += batch.num_rows
        if rows < 4096:
            continue
        table = pa.Table.from_batches(waiting)
        bucket, cell = table["bucket"].to_numpy(), table["cell"].to_numpy()
        last = int(((bucket != bucket[-1]) | (cell != cell[-1])).nonzero()[0].max(initial=-1)) + 1
        if last:
            yield table.slice(0, last)
            waiting, rows = table.slice(last).to_batches(), len(table) - last
    if rows:
        yield pa.Table.from_batches(waiting)


def candidate_pairs(table: pa.Table, steps) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(cell number, row, row) of the pairs of whole cells that outlast the batches and meet here first."""
    bucket, cell, side = (table[c].to_numpy() for c in ("bucket", "cell", "side"))
    new = np.ones(len(bucket), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])
    starts = new.nonzero()[0]
    sizes = np.diff(np.append(starts, len(bucket)))
    sizes_b = np.add.reduceat(side, starts)
    sigs = signatures(table["sig"])
    band_of = buckets_of(sigs[starts]) == bucket[starts][:, None]  # the band of a cell, from any of its members
    band = band_of.argmax(axis=1)
    for c, a, b in pairs_in(sizes - sizes_b, sizes_b, starts):
        alive = surviving(sigs, a, b, steps)
        c, a, b = c[alive], a[alive], b[alive]
        if len(a):
            mine = first_common_band(sigs, a, b) == band[c]
            yield c[mine], a[mine], b[mine]


def links(docs: DataFrame, sketched: DataFrame, size: int, percent: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """(classes, links): the class of every fingerprint, and links between class representatives that join components."""
    steps = fewest_matches(percent / 100, miss)
    full = sketched.filter("doc_id is not null and n_shingles > 0")
    classes = cut_lineage(full.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep")))
    reps = full.join(classes, ["n_shingles", "f1", "f2"]).filter("doc_id = rep").dropDuplicates(["f1", "f2"])
    reps = cut_lineage(reps.select("f1", "doc_id", "n_shingles", "sig"))

    rows = with_buckets(reps)
    crowd = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")).filter("n > 1")
    blocks = crowd.select(
        "bucket", F.greatest(F.ceil(F.col("n") / BLOCK_MEMBERS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    member = rows.select("bucket", "f1", "doc_id").join(blocks, "bucket")
    member = member.withColumn("block", F.pmod(F.xxhash64("f1", "doc_id"), F.col("blocks")).cast("int"))
    # block b meets block j in the cell (smaller, larger); side 1 is the larger of two different blocks
    cells = member.select(
        "bucket", "f1", "doc_id", "blocks", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select(
        "bucket", "f1", "doc_id",
        (F.least("block", "other").cast("long") * F.col("blocks") + F.greatest("block", "other")).alias("cell"),
        F.when(F.col("block") > F.col("other"), 1).otherwise(0).cast("int").alias("side"),
    )

    def named(batches):
        for table in whole_cells(batches):
            keep = np.zeros(len(table), bool)
            for _, a, b in candidate_pairs(table, steps):
                keep[a] = keep[b] = True
            found = table.filter(pa.array(keep)).drop_columns(["sig"])
            yield from found.to_batches()

    where = "bucket long, cell long, side int, f1 long, doc_id long"
    sorted_cells = (
        cells.join(reps.select("f1", "doc_id", "sig"), ["f1", "doc_id"])
        .select("bucket", "cell", "side", "f1", "doc_id", "sig").repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", "side")
    )
    taking_part = cut_lineage(sorted_cells.mapInArrow(named, where))

    def full_sets(batches):
        for batch in sliced(batches):
            f1, sig, kept, sets = [], [], [], []
            for k, s in enumerate(sets_of(batch, "text", size)):
                if len(s):
                    f1.append(fingerprint(s)[0]), sig.append(min_hashes(s).tobytes()), sets.append(s.tobytes()), kept.append(k)
            ids = batch.column("doc_id").take(pa.array(kept, pa.int64()))
            made = pa.RecordBatch.from_arrays(
                [pa.array(f1, pa.int64()), ids, pa.array(sig, pa.binary()), pa.array(sets, pa.binary())], ["f1", "doc_id", "sig", "shingles"]
            )
            yield from sliced([made])

    wanted = taking_part.select("doc_id").distinct()
    texts = with_columns(docs, doc_id="long", text="string").join(wanted, "doc_id", "left_semi")
    sets = texts.mapInArrow(full_sets, "f1 long, doc_id long, sig binary, shingles binary").dropDuplicates(["f1", "doc_id"])

    def checked(batches):
        for table in whole_cells(batches):
            root = np.arange(len(table))
            ids = table["doc_id"].to_numpy()
            data, offsets = text_buffers(table["shingles"])
            values, offsets = data.view(np.uint64), offsets // 8
            a_out, b_out = [], []

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for _, a, b in candidate_pairs(table, steps):
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    ri, rj = find(i), find(j)
                    if ri == rj:
                        continue
                    s, t = values[offsets[i] : offsets[i + 1]], values[offsets[j] : offsets[j + 1]]
                    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                        continue
                    both = len(s) + len(t) - len(np.union1d(s, t))
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        root[ri] = rj
                        a_out.append(ids[i]), b_out.append(ids[j])
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    exact = (
        taking_part.join(sets, ["f1", "doc_id"]).select("bucket", "cell", "side", "doc_id", "sig", "shingles")
        .repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", "side")
    )
    return classes, exact.mapInArrow(checked, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 85, miss: float = 1e-6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links of similarity ``percent`` / 100 and more; ``kept`` says that
    it is the document's own.
    """
    setup(docs.sparkSession)
    sketched = cut_lineage(sketch(docs, size))
    classes, linked = links(docs, sketched, size, percent, miss)
    members = sketched.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["n_shingles", "f1", "f2"], "left")
    members = members.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"))
    # an id with several texts ties the classes of its texts together
    several = members.filter("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high")
    tied = members.join(several.select("doc_id", "low"), "doc_id").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    found = components(linked.select("a", "b").union(tied))
    return (
        members.join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("component_id", F.coalesce("component", "rep", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 85) -> DataFrame:
    """``docs`` with one document of each group; of rows that repeat its id, the one with the smallest hash of its text stays."""
    found = near_duplicates(docs, size, percent).filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    found = cut_lineage(found)
    kept = docs.join(found.filter("n = 1").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    repeated = docs.join(found.filter("n > 1").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    order = F.row_number().over(_by_id())
    once = repeated.withColumn("__order", order).filter("__order = 1").select(docs.columns)
    return kept.union(once).union(docs.filter("doc_id is null"))


def _by_id():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
