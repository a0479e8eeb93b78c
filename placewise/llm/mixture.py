"""Mixing sources to target weights.

1. *Targets* (driver; one number per source): weights share the words of all sources; no target passes ``most`` times its
   source's words, and what is cut off is shared again by weight until none does.
2. *Blocks*: the words of a source, in the order of its documents, are packed into blocks of ``block`` words (the last one
   may be shorter). Unless given, ``block`` is a two-thousandth of a mean source, between 1 and 512 words, so that whole blocks
   come within a fraction of a per mille of any target. A document lies in the blocks that its stretch of the source covers; the stretch begins at the number of
   words before it, which is a sum over parts plus a sum within the part.
3. *Slots*: a source gives as many slots as its target needs, and never more than ``most`` times its blocks. The slots of
   all sources are dealt to output shards of ``shard`` slots. The counts of a shard are a multinomial draw given the totals
   (multivariate hypergeometric): the slots are halved again and again, each half draws its counts, and every shard walks
   down to its own leaf. So any shard is drawn alone, in any task, and all counts add up.
4. A source's slot k takes block P(k mod blocks) in round k div blocks, where P is a keyed permutation of the block numbers
   (a Feistel network that walks until it is within range). Blocks are joined to slots by (source, number).

Everything is a function of the rows and the seed, so reruns agree. Defined cases: null and blank texts have no words and are
in no block; a null source is a source, in the last place; documents with equal ids of a source lie side by side, by hash of
the text; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, mix64, setup, sliced

WEIGHTS = (5, 2, 1)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHARD, MOST = 4096, 3
PER_SOURCE, LONGEST = 2000, 512
# Above this many slots a half draws its counts in proportion: the chance part would be under one in ten thousand.
DRAWN = 100_000_000


def word_count(text):
    """Number of runs without ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """Words asked of each source, in order; weights repeat."""
    weight = np.resize(np.array(weights, float), len(sizes))
    size = np.array(sizes, float)
    out, free = np.zeros(len(sizes)), size > 0
    left = size.sum()
    while free.any() and left > 0:
        share = left * weight / weight[free].sum()
        over = free & (share > most * size)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = most * size[over]
        left -= out[over].sum()
        free &= ~over
    return out.tolist()


def permuted(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1, applied to ``k``."""
    if n < 2:
        return np.zeros(len(k), np.int64)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = k.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for turn in range(4):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
            left, right = right, left ^ (mix64(right ^ salt) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def shard_counts(shard: int, slots: list[int], per_shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before this shard, slots of each source in it)."""
    have, before = np.array(slots, np.int64), np.zeros(len(slots), np.int64)
    first, last = 0, max(1, -(-int(have.sum()) // per_shard))
    while last - first > 1:
        middle = (first + last) // 2
        take = (middle - first) * per_shard
        total = int(have.sum())
        if total > DRAWN:
            part = np.floor(have * (take / total)).astype(np.int64)
            order = np.argsort(part - have * (take / total), kind="stable")
            part[order[: take - int(part.sum())]] += 1
        else:
            part = np.random.default_rng([seed, first, last]).multivariate_hypergeometric(have, take, method="marginals")
        if shard < middle:
            have, last = part, middle
        else:
            before, have, first = before + part, have - part, middle
    return before, have


def block_length(sizes: list[int]) -> int:
    """Words in a block for sources of these sizes."""
    return max(1, min(LONGEST, sum(sizes) // (PER_SOURCE * max(1, len(sizes)))))


def placed(docs: DataFrame, block: int | None = None) -> tuple[DataFrame, list[dict], int]:
    """(documents with size, source number and first word; table of sources; words in a block)."""
    spark = setup(docs.sparkSession)
    rows = cut_lineage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"),
        F.xxhash64(F.col("text").cast("string")).alias("tie"),
    ))
    order = ["source", "doc_id", "tie"]
    parts = cut_lineage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    # words of each source in each part: a small table; its running sum is where the part's words begin
    share = parts.groupBy("part", "source").agg(F.sum("size").alias("words"))
    begin = share.select(
        F.col("part").alias("p"), F.col("source").alias("s"),
        (F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")).alias("begin"),
    )
    within = F.sum("size").over(
        Window.partitionBy("part", "source").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.col("size")
    found = parts.groupBy("source").agg(F.sum("size").alias("size")).collect()
    # by code point, which is the order of the bytes in UTF-8; null last
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    block = block or block_length([r["size"] for r in found])
    table = []
    for r, goal in zip(found, targets([r["size"] for r in found]), strict=True):
        blocks = -(-r["size"] // block)
        slots = min(MOST * blocks, round(goal * blocks / r["size"])) if r["size"] else 0
        table.append({"number": len(table), "source": r.source, "source_size": r["size"], "target": goal, "blocks": blocks, "slots": slots})
    schema = "number int, source string, source_size long, target double, blocks long, slots long"
    sources = spark.createDataFrame([tuple(t.values()) for t in table], schema)
    out = (
        parts.withColumn("within", within)
        .join(begin, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
        .join(sources.select("number", F.col("source").alias("n"), "source_size", "target"), F.col("source").eqNullSafe(F.col("n")))
        .select("doc_id", "tie", "source", "number", "size", "source_size", "target", (F.col("begin") + F.col("within")).alias("first"))
    )
    return cut_lineage(out), table, block


def slots_table(spark, table: list[dict], per_shard: int = SHARD, seed: int = 17) -> DataFrame:
    """(shard, slot, number, round, block): which block stands in each slot of each output shard."""
    slots, blocks = [t["slots"] for t in table], [t["blocks"] for t in table]
    shards = -(-sum(slots) // per_shard)

    def run(batches):
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                before, have = shard_counts(shard, slots, per_shard, seed)
                number = np.repeat(np.arange(len(have)), have)
                k = np.concatenate([np.arange(a, a + n) for a, n in zip(before, have, strict=True)]) if len(have) else np.zeros(0, np.int64)
                turn, block = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
                for s in np.flatnonzero(have):
                    mine = number == s
                    turn[mine], at = np.divmod(k[mine], blocks[s])
                    block[mine] = permuted(at, blocks[s], seed * 1_000_003 + int(s))
                place = np.random.default_rng([seed, shard, 1]).permutation(len(k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), shard, np.int64)), pa.array(place.astype(np.int32)), pa.array(number.astype(np.int32)),
                     pa.array(turn.astype(np.int32)), pa.array(block)],
                    ["shard", "slot", "number", "round", "block"],
                )

    tasks = max(1, min(shards, max(spark.sparkContext.defaultParallelism, shards // 64)))
    return spark.range(0, shards, 1, tasks).mapInArrow(run, "shard long, slot int, number int, round int, block long")


def mixed(docs: DataFrame, block: int | None = None, per_shard: int = SHARD, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): a piece is a document's part of the block in one slot.

    Documents: (doc_id, tie, source, number, size, source_size, target, first); a document with words is known by (number,
    first). Pieces: (shard, slot, round, number, first, from_word, words).
    """
    documents, table, block = placed(docs, block)
    end = F.col("first") + F.col("size")
    cover = documents.filter("size > 0").select(
        "number", "first", "size", F.explode(F.expr(f"sequence(first div {block}, (first + size - 1) div {block})")).alias("block")
    ).select(
        "number", "block", "first", F.greatest(F.lit(0), F.col("block") * block - F.col("first")).alias("from_word"),
        (F.least((F.col("block") + 1) * block, end) - F.greatest(F.col("block") * block, "first")).alias("words"),
    )
    # the planner takes the slots for as few rows as there are shards, and would broadcast them
    slots = slots_table(docs.sparkSession, table, per_shard, seed).hint("merge")
    return documents, slots.join(cover, ["number", "block"]).select("shard", "slot", "round", "number", "first", "from_word", "words")


def taken_words(docs: DataFrame, block: int | None = None, per_shard: int = SHARD, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of ``docs``."""
    documents, pieces = mixed(docs, block, per_shard, seed)
    taken = pieces.groupBy("number", "first").agg(F.sum("words").alias("taken"))
    none = documents.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    some = documents.filter("size > 0").join(taken, ["number", "first"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return some.select(columns).union(none.select(columns))


def mixed_documents(docs: DataFrame, block: int | None = None, per_shard: int = SHARD, seed: int = 17) -> DataFrame:
    """The mix as documents: one row per document and round, with the words of it that the round takes.

    A document taken whole keeps its text as it is; of others, the words taken stand in order with one space between.
    """
    documents, pieces = mixed(docs, block, per_shard, seed)
    takes = pieces.groupBy("number", "first", "round").agg(
        F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("from_word", "words"))).alias("parts")  # at most size / block
    )
    takes = takes.join(documents.filter("size > 0"), ["number", "first"]).select(
        F.col("taken").alias("__taken"), F.col("parts").alias("__parts"), F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), F.col("source").alias("__source"), F.col("size").alias("__size")
    )
    texts = docs.withColumn("__hash", F.xxhash64(F.col("text").cast("string")))
    if not documents.filter("size > 0").groupBy("doc_id", "tie", "source").count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(["doc_id", "__hash", "source"])
    joined = texts.join(
        takes,
        F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__tie")) & F.col("source").cast("string").eqNullSafe(F.col("__source")),
    )
    kept = docs.columns

    def run(batches):
        for batch in sliced(batches):
            texts = []
            for text, size, taken, parts in zip(*[batch.column(c).to_pylist() for c in ("text", "__size", "__taken", "__parts")], strict=True):
                if taken != size:
                    words = WORD.findall(text)
                    text = " ".join(chain.from_iterable(words[p["from_word"] : p["from_word"] + p["words"]] for p in parts))
                texts.append(text)
            out = batch.select(kept)
            for name, values in (("text", texts), ("n_chars", [len(t) for t in texts])):
                if name in kept:
                    at = out.schema.get_field_index(name)
                    out = out.set_column(at, out.schema.field(at), pa.array(values, out.schema.field(at).type))
            yield out

    return joined.select(*kept, "__size", "__taken", "__parts").mapInArrow(run, docs.schema)
