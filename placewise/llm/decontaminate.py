"""Benchmark decontamination with spaced seeds.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case. A *mask* is a fixed pattern over up to ten
neighbouring words that compares six of them, so a window still has its seed when words at the ignored places were exchanged.
Items of 5 to 11 words have masks of their own length that compare four or five words.

1. Every window of every benchmark item under every mask gives a seed: (hash, item, position).
2. A bit table of bounded size holds the seeds' hashes. Each task slides the masks over whole texts and keeps the windows whose
   bits are set, with the words around them: *regions*, disjoint, 64 words beyond the outermost hits.
3. The windows kept are joined with the seeds by hash: each match is a diagonal on which text and item may agree.
4. On each (region, item, diagonal) the words are compared one by one; the item counts when any stretch has at least ``least``
   equal words, or covers 80 % of a shorter item, and 80 % of it agree. Reported is the one with the most equal words, then the fewest words.

The bit table only saves work: what it lets through is settled by the join, so its size never changes a result. The masks leave no
stretch of 12 equal words at 80 % agreement, nor of 80 % of a shorter item, without a seed (the tests enumerate them), so at these
values seeds lose nothing either. Items of fewer than five words have to be whole; items of fewer than ``shortest`` words are not looked for.
Null or empty texts have no windows; a null doc_id is reported as null; rows that repeat an id are one document;
an empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_STEP, cut_lineage, mix64, setup, sliced, text_buffers, with_columns, word_hashes

# The masks; 1 is compared, 0 is ignored.
MASKS = ("111111", "1111011", "101100111", "1100010111")
SHORT_MASKS = {
    5: ("1111", "10111", "11011", "11101"), 6: ("1111", "11011"), 7: ("11011",), 8: ("11111", "111011"), 9: ("111011",),
    10: ("11111", "111011", "11010011"), 11: ("1101011", "1110011"),
}
SPAN = 10
AROUND = 64
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28

SIGN = np.ones(256, bool)
SIGN[48:58] = SIGN[65:91] = SIGN[97:123] = SIGN[128:] = False


def texts_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, document index) of a column of texts."""
    return word_hashes(*text_buffers(column), separator=SIGN)


def masks_of(n: int) -> tuple[str, ...]:
    """The masks for items of ``n`` words."""
    return SHORT_MASKS.get(n, MASKS) if n >= min(SHORT_MASKS) else ("1" * n,)


def seeds_of(words: np.ndarray, owner: np.ndarray, masks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every window under every one of the ``masks``."""
    hashes, places = [], []
    for mask in masks:
        n = len(words) - len(mask) + 1
        if n <= 0:
            continue
        at = (owner[:n] == owner[len(mask) - 1 :]).nonzero()[0]
        total = np.full(len(at), np.uint64(int(mask, 2)))
        for j, used in enumerate(mask):
            if used == "1":
                total = total * SHINGLE_STEP + words[at + j]
        hashes.append(mix64(total))
        places.append(at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def benchmark_items(benchmark: DataFrame, shortest: int) -> DataFrame:
    """(item_id, words): the word hashes of each item worth looking for."""

    def run(batches):
        for batch in sliced(batches):
            words, owner = texts_words(batch.column("text"))
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            keep = [k for k in range(batch.num_rows) if bounds[k + 1] - bounds[k] >= shortest]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(keep, pa.int64())), pa.array([words[bounds[k] : bounds[k + 1]].tobytes() for k in keep], pa.binary())],
                ["item_id", "words"],
            )

    return with_columns(benchmark, item_id="long", text="string").mapInArrow(run, "item_id long, words binary")


def item_seeds(items: DataFrame) -> DataFrame:
    """(hash, item_id, item_pos) of every seed of every item."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                words = np.frombuffer(batch.column("words")[k].as_py(), np.uint64)
                found, at = seeds_of(words, np.zeros(len(words), np.int64), masks_of(len(words)))
                ids = batch.column("item_id").slice(k, 1).take(pa.array(np.zeros(len(found), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), ids, pa.array(at.astype(np.int32))], ["hash", "item_id", "item_pos"])

    return items.mapInArrow(run, "hash long, item_id long, item_pos int")


def bit_table(seeds: DataFrame) -> np.ndarray:
    """Two bits per hash in a table of 2**20 to 2**28 bits, by the number of hashes."""
    distinct = cut_lineage(seeds.select("hash").distinct())
    size = LEAST_BITS
    while size < min(MOST_BITS, 64 * distinct.count()):
        size *= 2
    mask = F.lit(size - 1)
    bits = distinct.select(F.explode(F.array(F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 32).bitwiseAND(mask))).alias("bit"))
    cells = bits.groupBy(F.shiftright("bit", 5).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits"))
    table = np.zeros(size // 32, np.uint32)
    found = cells.toPandas()
    table[found["cell"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    return table


def maybe(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Indexes of the hashes whose two bits are set."""
    mask = np.uint64(len(table) * 32 - 1)
    one = hashes & mask
    at = ((table[one >> np.uint64(5)] >> (one & np.uint64(31)).astype(np.uint32)) & np.uint32(1)).nonzero()[0]
    two = (hashes[at] >> np.uint64(32)) & mask
    return at[((table[two >> np.uint64(5)] >> (two & np.uint64(31)).astype(np.uint32)) & np.uint32(1)) > 0]


def regions(docs: DataFrame, table: np.ndarray, masks: list[str]) -> DataFrame:
    """(key, doc_id, region, start, words, hits): the stretches of texts that hold windows worth a join."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in sliced(batches):
            words, owner = texts_words(batch.column("text"))
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            hashes, places = seeds_of(words, owner, masks)
            at = maybe(shared.value, hashes)
            hashes, places = hashes[at], places[at]
            order = np.argsort(places, kind="stable")
            hashes, places = hashes[order], places[order]
            if not len(places):
                continue
            own = owner[places]
            cut = np.flatnonzero((own[1:] != own[:-1]) | (places[1:] - places[:-1] > 2 * AROUND + SPAN)) + 1
            out = {c: [] for c in ("row", "region", "start", "words", "hits")}
            for part in np.split(np.arange(len(places)), cut):
                d = int(own[part[0]])
                low = max(int(bounds[d]), int(places[part[0]]) - AROUND)
                high = min(int(bounds[d + 1]), int(places[part[-1]]) + SPAN + AROUND)
                start = low - int(bounds[d])
                stretch = words[low:high]
                out["row"].append(d), out["start"].append(start), out["words"].append(stretch.tobytes())
                out["region"].append(int(mix64(np.array([stretch.sum(dtype=np.uint64) + np.uint64(start)]))[0].view(np.int64)))
                out["hits"].append([{"hash": int(h), "pos": int(p)} for h, p in zip(hashes[part].view(np.int64), places[part] - bounds[d], strict=True)])
            rows = pa.array(out["row"], pa.int64())
            hits = pa.array(out["hits"], pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(rows), batch.column("doc_id").take(rows), pa.array(out["region"], pa.int64()), pa.array(out["start"], pa.int32()),
                 pa.array(out["words"], pa.binary()), hits],
                ["key", "doc_id", "region", "start", "words", "hits"],
            )

    schema = "key string, doc_id long, region long, start int, words binary, hits array<struct<hash: long, pos: int>>"
    keyed = docs.select(document_key(docs).alias("key"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return keyed.mapInArrow(run, schema)


def document_key(docs: DataFrame):
    """What tells documents apart: the id, or the text where there is no id."""
    return F.coalesce(docs["doc_id"].cast("long").cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce(docs["text"], F.lit("")), 256)))


def best_stretch(equal: np.ndarray, need: int, agree: Fraction) -> tuple[int, int, int] | None:
    """(from, to, equal words) of the stretch with the most equal words, then the fewest words, of those where ``agree`` of the words
    and ``need`` of them at least are equal."""
    count = np.concatenate([[0], np.cumsum(equal)])
    score = agree.denominator * count - agree.numerator * np.arange(len(count))  # a stretch agrees when it does not end lower than it begins
    ahead = np.maximum.accumulate(score[::-1])[::-1]
    gain = count[np.searchsorted(-ahead, -score, side="right") - 1] - count  # to the last place that is not lower
    most = int(gain.max())
    if most < max(need, 1):
        return None
    at = np.flatnonzero(gain == most)
    to = np.searchsorted(count, count[at] + most)
    k = int(np.argmin(to - at))
    return int(at[k]), int(to[k]), most


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 12, shortest: int = 5, agree: float = 0.8) -> DataFrame:
    """(key, doc_id, item_id, start, n_words, n_equal): the best overlap of each document with each item it repeats."""
    setup(docs.sparkSession)
    items = cut_lineage(benchmark_items(benchmark, shortest))
    seeds = cut_lineage(item_seeds(items))
    lengths = items.select(F.least((F.octet_length("words") / 8).cast("int"), F.lit(max(SHORT_MASKS) + 1)).alias("n")).filter("n > 0").distinct()
    masks = sorted({m for r in lengths.collect() for m in masks_of(r.n)})  # at most 12 lengths
    found = cut_lineage(regions(docs, bit_table(seeds), masks))
    hits = found.select("key", "region", "start", F.explode("hits").alias("hit")).select("key", "region", "start", "hit.hash", "hit.pos")
    diagonals = (
        hits.join(seeds, "hash").select("key", "region", "start", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    )
    pairs = (
        diagonals.join(found.select("key", "doc_id", "region", "start", "words"), ["key", "region", "start"])
        .join(items.withColumnRenamed("words", "item"), "item_id").select("key", "doc_id", "item_id", "start", "diagonal", "words", "item")
    )

    share = Fraction(str(agree))

    def verify(batches):
        for batch in batches:
            start, diagonal = batch.column("start").to_numpy(), batch.column("diagonal").to_numpy()
            keep, begin, size, same = [], [], [], []
            for k in range(batch.num_rows):
                doc, item = (np.frombuffer(batch.column(c)[k].as_py(), np.uint64) for c in ("words", "item"))
                shift = int(diagonal[k]) - int(start[k])  # item word i stands at doc[i + shift]
                low, high = max(0, -shift), min(len(item), len(doc) - shift)
                if high <= low:
                    continue
                best = best_stretch(item[low:high] == doc[low + shift : high + shift], min(least, ceil(share * len(item))), share)
                if best is not None:
                    at, to, equal = best
                    keep.append(k), begin.append(low + at + int(diagonal[k])), size.append(to - at), same.append(equal)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(rows) for c in ("key", "doc_id", "item_id")], pa.array(begin, pa.int32()), pa.array(size, pa.int32()), pa.array(same, pa.int32())],
                ["key", "doc_id", "item_id", "start", "n_words", "n_equal"],
            )

    checked = pairs.mapInArrow(verify, "key string, doc_id long, item_id long, start int, n_words int, n_equal int")
    best = F.max(F.struct("n_equal", -F.col("n_words"), -F.col("start"))).alias("best")
    return checked.groupBy("key", "doc_id", "item_id").agg(best).select(
        "key", "doc_id", "item_id", (-F.col("best").getField("col3")).alias("start"), (-F.col("best").getField("col2")).alias("n_words"), F.col("best.n_equal").alias("n_equal")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, **rules) -> DataFrame:
    """``docs`` without the documents that repeat a benchmark item."""
    bad = cut_lineage(overlaps(docs, benchmark, **rules).select("key").distinct())
    return docs.withColumn("__key", document_key(docs)).join(bad.withColumnRenamed("key", "__key"), "__key", "left_anti").select(docs.columns)
