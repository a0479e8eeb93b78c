"""Importance resampling towards a target: hashed word features counted by an Aho-Corasick dictionary.

1. *Dictionary*: distinct words, each written between two delimiters, in an Aho-Corasick automaton. A word's payload is its CRC-32,
   the CRC-32 of the word with the joining space, and its length in bytes. A word cannot hold a delimiter, so at every delimiter at most one
   entry ends, and scanning a text emits the payloads of its words in order.
2. *Composition*: the bucket of two adjacent words comes from their payloads alone: crc(a b) = shift(crc(a_), len(b)) ^ crc(b), where shift
   moves a checksum over that many zero bytes by table look-ups. No joined text is ever made.
3. *Counting*: each task adds up its buckets and emits one row per bucket; Spark sums them, for all documents and for the target texts.
4. *Scoring*: gains per bucket (10,000 numbers) go to every task; a second scan adds up each document's gains.
5. *Drawing*: documents are ordered by score with Gumbel noise from a hash of their id, numbered by range partitions, and the first ones
   are drawn: sampling without replacement in proportion to the weights.

A worker learns its dictionary from the texts it meets: words that the automaton does not know are checksummed directly, and join it when
they are half as many as it holds. Beyond ``MOST_WORDS``, words that were not met again go, so its memory is bounded; results never
depend on what it knows.

Defined cases: a null or wordless text has no features and weight 0; a null id has no score and takes no part in the draw; rows that
repeat an id are judged by their own texts; an empty table gives an empty result; an empty target counts as one without features; other
columns are not read.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, setup, shared, sliced, text_buffers, with_columns

BUCKETS = 10_000
MOST_WORDS = 200_000
SCAN_BYTES = 1 << 20  # bytes scanned at once
DIRECT_LENGTHS = 64  # shifts by fewer bytes have a table of their own

SPACE = 0x20
# A-Z become a-z, every other ASCII sign that is no digit or lower-case letter becomes the delimiter; bytes beyond ASCII are letters.
DELIMITED = bytes(k if k >= 128 or chr(k).isdigit() or chr(k).islower() else k + 32 if chr(k).isupper() else SPACE for k in range(256))


def byte_step(crc: np.ndarray) -> np.ndarray:
    """A checksum's inner state after one more zero byte."""
    return (crc >> np.uint32(8)) ^ CRC_TABLE[(crc & np.uint32(0xFF)).astype(np.intp)]


def crc_table() -> np.ndarray:
    """The state after each single byte, from the checksum's polynomial."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & np.uint32(1), (state >> np.uint32(1)) ^ np.uint32(0xEDB88320), state >> np.uint32(1))
    return state


CRC_TABLE = crc_table()


def look_up(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Apply a linear map, given by its values on each of the four bytes."""
    out = table[..., 0, :].take((crc & np.uint32(0xFF)).astype(np.intp))
    for k in (1, 2, 3):
        out ^= table[..., k, :].take(((crc >> np.uint32(8 * k)) & np.uint32(0xFF)).astype(np.intp))
    return out


def shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """(maps for 0 to 63 zero bytes, maps for 64, 128, ... zero bytes)."""
    lane = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    direct = [lane]
    for _ in range(DIRECT_LENGTHS - 1):
        direct.append(byte_step(direct[-1]))
    power = [byte_step(direct[-1])]
    while len(power) < 25:  # texts end below 2**31 bytes
        power.append(look_up(power[-1], power[-1]))
    return np.ascontiguousarray(np.stack(direct)), power


DIRECT, POWER = shift_tables()
FLAT = DIRECT.reshape(DIRECT_LENGTHS, 4 * 256)


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums moved over ``length`` zero bytes each."""
    base = (length & (DIRECT_LENGTHS - 1)) * 1024
    flat = FLAT.ravel()
    out = flat.take(base + (crc & np.uint32(0xFF)))
    for k in (1, 2, 3):
        out ^= flat.take(base + 256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(0xFF)))
    rest = length >> 6
    k = 0
    while rest.any():
        at = np.flatnonzero(rest & 1)
        if len(at):
            out[at] = look_up(POWER[k], out[at])
        rest = rest >> 1
        k += 1
    return out


class Dictionary:
    """Distinct words between delimiters with their payloads, in an automaton that learns."""

    def __init__(self, most: int = MOST_WORDS):
        self.most = most
        self.automaton = None
        self.words: list[bytes] = []
        self.fresh: dict[bytes, int] = {}
        self.payload = np.zeros((0, 3), np.uint32)
        self.met = np.zeros(0, bool)  # words found again since they were learned

    def learn(self):
        """Take up the new words, once they are half as many as those known."""
        if len(self.fresh) * 2 < len(self.words) or not self.fresh:
            return
        if len(self.words) + len(self.fresh) > self.most:  # words that were not met again go
            stay = np.flatnonzero(self.met)[: self.most // 2]
            self.words, self.payload = [self.words[k] for k in stay], self.payload[stay]
        rows = np.array([payload_of(w) for w in self.fresh], np.uint32)
        self.payload = np.concatenate([self.payload, rows])
        self.words += self.fresh
        self.fresh, self.met = {}, np.zeros(len(self.words), bool)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, word in enumerate(self.words):
            self.automaton.add_word(f" {word.decode('latin-1')} ", k)
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(place of the delimiter after it, payload) of every word; ``text`` begins and ends with a delimiter, a byte is a letter."""
        signs = np.frombuffer(text, np.uint8)
        gap = signs == SPACE
        ends = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
        payload = np.zeros((len(ends), 3), np.uint32)
        missing = np.ones(len(ends), bool)
        if self.automaton is not None and len(ends):
            hits = np.fromiter(chain.from_iterable(self.automaton.iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)
            at = np.searchsorted(ends, hits[:, 0])
            payload[at] = self.payload[hits[:, 1]]
            self.met[hits[:, 1]] = True
            missing[at] = False
        rest = np.flatnonzero(missing)
        if len(rest):
            starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
            for k in rest:
                word = text[starts[k] : ends[k]]
                payload[k] = payload_of(word)
                if len(word) < DIRECT_LENGTHS and len(self.fresh) < self.most // 2:
                    self.fresh[word] = 1
            self.learn()
        return ends, payload


def payload_of(word: bytes) -> tuple[int, int, int]:
    crc = zlib.crc32(word)
    return crc, zlib.crc32(b" ", crc), len(word)


def dictionary() -> Dictionary:
    """The worker's own, kept from task to task: outside this module, whose code comes anew with every task."""
    home = sys.modules.setdefault("_worker_memory", types.ModuleType("_worker_memory"))
    if not hasattr(home, "dictionary"):
        home.dictionary = Dictionary()
    return home.dictionary


def features(batch: pa.RecordBatch, known: Dictionary) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owner of each word, buckets of words, buckets of adjacent pairs) in pieces of about a megabyte; pair k is words k and k + 1 of the
    piece where both have one owner, else -1. Long texts come in pieces that share one word, told apart by a first owner of -1."""
    data, offsets = text_buffers(batch.column("text"))
    size, at, carry = len(data), 0, None
    text = data.tobytes().translate(DELIMITED)
    signs = np.frombuffer(text, np.uint8)
    starts_text = np.zeros(size + 1, bool)
    starts_text[offsets] = True
    while at < size:
        to = min(at + SCAN_BYTES, size)
        while to < size and not starts_text[to] and signs[to] != SPACE:  # a piece ends with a word
            ahead = np.flatnonzero((signs[to : to + 4096] == SPACE) | starts_text[to : min(to + 4096, size)])
            to += int(ahead[0]) if len(ahead) else min(4096, size - to)
        inner = np.flatnonzero(starts_text[at:to]) + at
        inner = inner[inner > at]
        bounds = [at, *inner.tolist(), to]
        piece = b" " + b" ".join([text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]) + b" "
        ends, payload = known.scan(piece)
        begins = np.array([a - at + 1 + k for k, a in enumerate(bounds[:-1])])  # where each part begins in the piece
        part = np.searchsorted(begins, ends, side="right") - 1
        owner = np.searchsorted(offsets, np.array(bounds[:-1])[part], side="right") - 1 if len(part) else np.zeros(0, np.int64)
        if carry is not None and len(owner) and owner[0] == carry[0]:
            owner = np.concatenate([[carry[0]], owner])
            payload = np.concatenate([carry[1], payload])
            pair_only = True
        else:
            pair_only = False
        if len(owner):
            crc, spaced, length = payload[:, 0], payload[:, 1], payload[:, 2].astype(np.int64)
            pairs = (shift(spaced[:-1], length[1:]) ^ crc[1:]) % np.uint32(BUCKETS)
            pairs = np.where(owner[:-1] == owner[1:], pairs.astype(np.int64), -1)
            words = (crc % np.uint32(BUCKETS)).astype(np.int64)
            carry = (int(owner[-1]), payload[-1:])
            if pair_only:
                words[0] = -1  # counted with the piece before
            yield owner, words, pairs
        at = to


def bucket_counts(docs: DataFrame, name: str) -> DataFrame:
    """(bucket, ``name``): how many features of all texts fall into each bucket."""

    def run(batches):
        known, total = dictionary(), np.zeros(BUCKETS, np.int64)
        for batch in sliced(batches):
            for _, words, pairs in features(batch, known):
                total += np.bincount(words[words >= 0], minlength=BUCKETS) + np.bincount(pairs[pairs >= 0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    found = with_columns(docs, text="string").mapInArrow(run, "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias(name))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Each bucket's gain in thousandths: the log of how much likelier it is in the target than in the documents."""
    spark = docs.sparkSession
    both = cut_lineage(
        spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(bucket_counts(docs, "s"), "bucket", "left")
        .join(bucket_counts(target, "t"), "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    )
    whole = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    real = lambda c: c.cast("double")
    ratio = (real(F.col("t") + 1) * float(whole.s + BUCKETS)) / (real(F.col("s") + 1) * float(whole.t + BUCKETS))
    rows = both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect()  # one row per bucket
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r.bucket] = r.gain
    return out


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, weight) of every row: weight is the floored mean gain of its features."""
    sent = shared(docs.sparkSession, gain)

    def run(batches):
        known, gain = dictionary(), sent()
        for batch in sliced(batches):
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for owner, words, pairs in features(batch, known):
                for own, bucket in ((owner, words), (owner[1:], pairs)):
                    own, bucket = own[bucket >= 0], bucket[bucket >= 0]
                    if len(own):
                        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                        n[own[first]] += np.diff(np.append(first, len(own)))
                        total[own[first]] += np.add.reduceat(gain[bucket], first)
            weight = np.floor_divide(total, np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(weight)], ["doc_id", "n_features", "weight"])

    return with_columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_features long, weight long")


def ranked(scored: DataFrame, wanted: int) -> DataFrame:
    """``rank`` from 1 by falling score, then smaller doc_id, for the first ``wanted`` of the rows with ``eligible``; null for all others.

    Rows are dealt by range of (score, doc_id), and a part's first rank is the count of the parts before it; no task holds them all.
    """
    order = [F.col("score").desc(), F.col("doc_id"), F.col("at")]
    dealt = scored.filter("eligible").select("at", "score", "doc_id").repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut_lineage(dealt.select("at", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    so_far = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)  # one row per part
    before = sizes.select("part", (F.sum("n").over(so_far) - F.col("n") - F.col("first") + 1).alias("step"))
    places = dealt.join(before, "part").select("at", (F.col("id") + F.col("step")).alias("rank")).filter(F.col("rank") <= wanted)
    return scored.join(places, "at", "left")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, salt: str = "7:") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``: ``percent`` of those with ``least_words`` words are drawn."""
    setup(docs.sparkSession)
    found = weighed(docs, gains(docs, target))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((noise + 0.5) / F.lit(4294967296.0))))
    scored = cut_lineage(
        found.withColumn("score", F.col("weight") + gumbel).withColumn("at", F.monotonically_increasing_id())
        .withColumn("eligible", F.col("doc_id").isNotNull() & (F.col("n_features") >= 2 * least_words - 1))
    )
    wanted = scored.filter("eligible").count() * percent // 100
    return ranked(scored, wanted).select("doc_id", "n_features", "weight", "score", "rank")
