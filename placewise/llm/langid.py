"""Language identification by language-bitmask n-gram filters.

*Learning.* Character n-grams (one to four letters, with the edges of words) are counted per language over a sample of labelled
texts: whole texts, about ``max_docs`` per language at most, chosen by a hash of the id. An n-gram belongs to every language in
which its share of all n-grams of that length is at least ``rare``, and at least ``near`` of its highest share in any language.
So a language has at most 1 / ``rare`` n-grams of each length, and the filter's size has a bound that no input can pass.

*Filter.* One table of bit masks, a bit per language: a bit-sliced Bloom filter. An n-gram sets its languages' bits in three
slots; the AND of its three slots gives all languages that may hold it, at once.

*Decision.* For every language the n-grams of a whole text are counted that the filter reports (a popcount per bit slice). A
slice that is filled to the part p reports p**3 of what it does not hold, so the count c of n n-grams is corrected to
(c - n * p**3) / (1 - p**3). The highest corrected count decides; ties go to the language that comes first by code point; the
score is its part of the sum of all corrected counts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a text of which the filter knows nothing gets the
language learned from most documents, with score 0; without any labelled text all are ``und``; a null id is never learned
from, and not held out; repeated rows are predicted each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_mod, cut_lineage, mix64, setup, shared, sliced, with_columns

ORDERS = (1, 2, 3, 4)
HASHES = 3
PIECE = 1 << 20  # characters worked on at once
UNKNOWN = "und"
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def pieces(texts: list[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """Texts in portions of about ``PIECE`` characters; a longer text is cut at white space into several."""
    part, owner, size = [], [], 0
    for k, text in enumerate(texts):
        rest = (text or "").lower()
        while rest:
            cut = len(rest)
            if cut > PIECE:
                cut = rest.rfind(" ", 0, PIECE) + 1 or PIECE
            part.append(rest[:cut]), owner.append(k)
            size += cut
            rest = rest[cut:]
            if size >= PIECE:
                yield part, owner
                part, owner, size = [], [], 0
    if part:
        yield part, owner


def grams(texts: list[str | None], is_letter: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, hashes, text numbers) of all n-grams; a run of other characters counts as one edge, and only edges are at ends."""
    for part, owner in pieces(texts):
        code = np.frombuffer(("\n" + "\n".join(part)).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum([0, *[len(p) + 1 for p in part[:-1]]])
        inside = is_letter[code]
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        keep[first] = True
        at = keep.nonzero()[0]
        whose = np.array(owner)[np.searchsorted(first, at, side="right") - 1]
        place = np.searchsorted(first, at, side="right")
        code = np.where(inside[at], code[at], 0).astype(np.uint64)
        for n in ORDERS:
            m = len(code) - n + 1
            if m <= 0:
                continue
            good = place[:m] == place[n - 1 :]
            if n == 1:
                good &= code > 0
            for j in range(1, n - 1):
                good &= code[j : j + m] > 0
            total = np.full(m, np.uint64(n))
            for j in range(n):
                total = total * MULTIPLY + code[j : j + m]
            yield n, mix64(total[good]), whose[:m][good]


class Filter:
    """The bit-sliced Bloom filter: ``table[slot, word]`` holds a bit per language."""

    def __init__(self, languages: list[str], most_usual: int, hashes: np.ndarray, language: np.ndarray):
        self.languages, self.most_usual = languages, most_usual
        words = max(1, -(-len(languages) // 64))
        self.bits = 10
        while (1 << self.bits) < 8 * max(1, int(np.bincount(language, minlength=1).max(initial=1))):
            self.bits += 1
        self.table = np.zeros((1 << self.bits, words), np.uint64)
        for slot in self.slots(hashes):
            np.bitwise_or.at(self.table, (slot, language // 64), np.uint64(1) << (language % 64).astype(np.uint64))
        filled = np.array([((self.table[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
        self.false = filled**HASHES

    def slots(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        for turn in range(HASHES):
            yield (hashes >> np.uint64(turn * (64 - self.bits) // (HASHES - 1))) & np.uint64((1 << self.bits) - 1)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """All languages of each n-gram, as rows of bit masks."""
        out = None
        for slot in self.slots(hashes):
            out = self.table[slot] if out is None else out & self.table[slot]
        return out

    def predict(self, texts: list[str | None], is_letter: np.ndarray) -> tuple[list[str], np.ndarray]:
        n, wide = len(texts), len(self.languages)
        count, total = np.zeros((n, wide)), np.zeros(n)
        for _, hashes, whose in grams(texts, is_letter):
            total += np.bincount(whose, minlength=n)
            mask = self.masks(hashes)
            for k in range(wide):
                count[:, k] += np.bincount(whose[(mask[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1) > 0], minlength=n)
        if not wide:
            return [UNKNOWN] * n, np.zeros(n)
        right = np.maximum((count - total[:, None] * self.false) / np.maximum(1 - self.false, 1e-9), 0)
        whole = right.sum(1)
        choice = np.where(whole > 0, right.argmax(1), self.most_usual)
        score = np.where(whole > 0, right.max(1) / np.maximum(whole, 1e-9), 0)
        return [self.languages[c] if t else UNKNOWN for c, t in zip(choice, total, strict=True)], np.where(total > 0, score, 0)


def learn(docs: DataFrame, max_docs: int, rare: float, near: float) -> Filter:
    """The filter, from labelled rows whose id is not held out."""
    rows = with_columns(docs, doc_id="long", text="string", lang="string").filter("lang is not null and text is not null")
    rows = rows.filter(crc32_mod("doc_id", 4) != 2)
    usual = sorted((r["lang"], r["count"]) for r in rows.groupBy("lang").count().collect())  # one row per language
    languages = [name for name, _ in usual]
    if not languages:
        return Filter([], 0, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    number = {name: k for k, name in enumerate(languages)}
    part = F.create_map(*[x for name, n in usual for x in (F.lit(name), F.lit(min(1.0, max_docs / n)))])
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(part, F.col("lang")) * 1_000_000)

    def count(batches):
        is_letter = letters()
        for batch in sliced(batches, 4 << 20):
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()])
            for n, hashes, whose in grams(batch.column("text").to_pylist(), is_letter):
                for k in np.unique(lang[whose]):
                    found, times = np.unique(hashes[lang[whose] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), k, np.int32)), pa.array(np.full(len(found), n, np.int32)), pa.array(found.view(np.int64)), pa.array(times)],
                        ["lang", "n", "gram", "times"],
                    )

    counts = sample.select("lang", "text").mapInArrow(count, "lang int, n int, gram long, times long").groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    counts = cut_lineage(counts)
    totals = counts.groupBy("lang", "n").agg(F.sum("times").alias("total"))
    shares = counts.join(F.broadcast(totals), ["lang", "n"]).select("lang", "gram", (F.col("times") / F.col("total")).alias("share"))
    top = shares.withColumn("top", F.max("share").over(Window.partitionBy("gram")))
    chosen = top.filter((F.col("share") >= rare) & (F.col("share") >= near * F.col("top"))).select("lang", "gram").toPandas()
    most_usual = max(range(len(usual)), key=lambda k: usual[k][1])
    return Filter(languages, most_usual, chosen["gram"].to_numpy(np.int64).view(np.uint64), chosen["lang"].to_numpy(np.int64))


def languages(docs: DataFrame, max_docs: int = 4000, rare: float = 1e-5, near: float = 0.5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of ``docs``."""
    spark = setup(docs.sparkSession)
    found_filter = shared(spark, learn(docs, max_docs, rare, near))

    def run(batches):
        is_letter, model = letters(), found_filter()
        for batch in sliced(batches, 4 << 20):
            names, score = model.predict(batch.column("text").to_pylist(), is_letter)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    found = with_columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
