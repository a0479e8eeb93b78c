"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with a temperature.

*Random indexing.* Every token has a fixed sparse index vector of +1 and -1. The context vector of a token is the sum of
the index vectors of the two tokens on either side of it, over all occurrences in all documents. Tokens are hashed to a fixed
number of buckets, so the table of vectors has a fixed size; each task adds up its share and Spark sums the shares.
A token is a run of letters, digits or one repeated sign; a run of capitals counts by its length only, so that shouted text
meets itself again.

*Pooling.* Over the tokens of the whole text: mean and spread of the unit-length context vectors, and the mean cosine
between a token's vector and those of the next two, which is near one where words repeat.

*Network.* Fitted on a bounded sample of labelled rows (``max_rows``, whole texts, chosen by a hash of the id); a fifth of the
sample is set apart to choose the temperature that makes the probabilities honest.

Defined cases: null and empty texts pool to zeros and get a score like any other; null ids and ids without a label are scored
but never learned from; labels that disagree about an id are averaged; without labels of both kinds every score is the share
of label 1 (0.5 if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE, FOLD, STEP, crc32_mod, cut_lineage, mix64, setup, shared, sliced, text_buffers, with_columns

BUCKETS, WIDTH, MARKS, REACH = 1 << 15, 32, 2, 2
RESERVED = 1024  # buckets of runs of capitals, digits and signs
HIDDEN = 32
PIECE = 2 << 20
PER_STEP = 1 << 14
POOLED = 2 * WIDTH + REACH  # numbers per document

# Class of a byte: 0 white space, 1 lower-case letter or part of a longer character, 2 capital, 3 digit, else the sign itself.
KIND = np.arange(256, dtype=np.int16)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[97:123] = 1
KIND[128:] = 1
KIND[65:91] = 2
KIND[48:58] = 3
KIND[1:4] = 4
VALUE = (BYTE_VALUE | np.uint64(1))[FOLD]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the marks of each bucket's index vector."""
    rng = np.random.default_rng(11)
    places = np.argsort(rng.random((BUCKETS, WIDTH)), axis=1)[:, :MARKS]
    return places.astype(np.int64), rng.choice([-1.0, 1.0], (BUCKETS, MARKS))


def pieces(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``PIECE`` bytes that end at white space or at the end of a text."""
    at, n = 0, len(data)
    while at < n:
        to = min(at + PIECE, n)
        if to < n:
            end = int(offsets[np.searchsorted(offsets, to, side="right") - 1])
            if end > at:
                to = end
            else:  # one text longer than a piece: up to its next white space, or its end
                end = int(offsets[np.searchsorted(offsets, to, side="right")])
                while to < end:
                    gap = (KIND[data[to : min(to + 4096, end)]] == 0).nonzero()[0]
                    if len(gap):
                        to += int(gap[0])
                        break
                    to = min(to + 4096, end)
        yield at, to
        at = to


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document index) of the tokens of a batch, in order."""
    buckets, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    for at, to in pieces(offsets, data):
        part = data[at:to]
        kind = KIND[part]
        capital = kind == 2
        alone = capital.copy()
        alone[1:] &= ~capital[:-1]
        alone[:-1] &= ~capital[1:]
        kind[alone] = 1
        start = kind != 0
        start[1:] &= (kind[1:] != kind[:-1]) | begins[at + 1 : to]
        starts = start.nonzero()[0]
        if not len(starts):
            continue
        owner = np.maximum(np.cumsum(start) - 1, 0)
        inside = kind != 0
        length = np.add.reduceat(inside, starts, dtype=np.int64)
        place = np.where(inside, np.arange(len(part)) - starts[owner], 0)
        power = np.multiply.accumulate(np.full(int(max(place.max(), 0)) + 1, STEP))
        text = np.add.reduceat(np.where(inside, VALUE[part] * power[np.maximum(place, 0)], np.uint64(0)), starts)
        bucket = RESERVED + (mix64(text) % np.uint64(BUCKETS - RESERVED)).astype(np.int64)
        first = kind[starts].astype(np.int64)
        short = np.minimum(length, 3)
        bucket = np.where(first == 2, np.minimum(length, 7), bucket)
        bucket = np.where(first == 3, 8 + np.minimum(length, 7), bucket)
        bucket = np.where(first > 3, 16 + first * 3 + short, bucket)
        buckets.append(bucket)
        owners.append(np.searchsorted(offsets, starts + at, side="right") - 1)
    return np.concatenate(buckets), np.concatenate(owners)


def context_counts(docs: DataFrame) -> DataFrame:
    """(bucket, n, c0 ...): occurrences and context vector of each bucket over all documents."""
    names = [f"c{k}" for k in range(WIDTH)]

    def run(batches):
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * WIDTH)
        seen = np.zeros(BUCKETS, np.int64)
        for batch in sliced(batches):
            bucket, owner = tokens(*text_buffers(batch.column("text")))
            seen += np.bincount(bucket, minlength=BUCKETS)
            for far in range(1, REACH + 1):
                same = owner[far:] == owner[:-far]
                a, b = bucket[:-far][same], bucket[far:][same]
                for left, right in ((a, b), (b, a)):
                    for m in range(MARKS):
                        total += np.bincount(left * WIDTH + places[right, m], signs[right, m], minlength=len(total))
        some = seen.nonzero()[0]
        table = total.reshape(BUCKETS, WIDTH)[some].astype(np.int64)
        for k in range(0, len(some), 4096):
            yield pa.RecordBatch.from_arrays(
                [pa.array(some[k : k + 4096]), pa.array(seen[some[k : k + 4096]]), *[pa.array(table[k : k + 4096, j]) for j in range(WIDTH)]],
                ["bucket", "n", *names],
            )

    schema = "bucket long, n long, " + ", ".join(f"{c} long" for c in names)
    return docs.select("text").mapInArrow(run, schema).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ["n", *names]])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """A unit-length context vector per bucket, without the direction that all share; the table has a fixed size."""
    found = context_counts(docs).toPandas()
    table, seen = np.zeros((BUCKETS, WIDTH)), np.zeros(BUCKETS)
    at = found["bucket"].to_numpy(np.int64)
    seen[at] = found["n"]
    table[at] = found.iloc[:, 2:].to_numpy(float)
    unit = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    unit -= (unit * seen[:, None]).sum(0) / max(seen.sum(), 1)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    unit[seen == 0] = 0
    return unit.astype(np.float32)


def pool(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text of a column, and how far each word agrees with the next ones."""
    data, offsets = text_buffers(column)
    n = len(offsets) - 1
    total, square, agree, count = np.zeros((n, WIDTH)), np.zeros((n, WIDTH)), np.zeros((n, REACH)), np.zeros(n)
    bucket, owner = tokens(data, offsets)
    for k in range(0, len(bucket), PER_STEP):
        wide, own = vectors[bucket[k : k + PER_STEP + REACH]], owner[k : k + PER_STEP]
        v = wide[: len(own)]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        total[own[first]] += np.add.reduceat(v, first)
        square[own[first]] += np.add.reduceat(v * v, first)
        for far in range(1, REACH + 1):
            m = min(len(own), len(wide) - far)
            if m > 0:
                alike = np.einsum("ij,ij->i", v[:m], wide[far : far + m]) * (own[:m] == owner[k + far : k + far + m])
                agree[:, far - 1] += np.bincount(own[:m], alike, minlength=n)
        count += np.bincount(own, minlength=n)
    count = np.maximum(count, 1)[:, None]
    mean = total / count
    return np.hstack([mean, np.sqrt(np.maximum(square / count - mean * mean, 0)), agree / count]).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, pooled): the pooled vectors of each text, as float32."""
    sent = shared(docs.sparkSession, vectors)

    def run(batches):
        table = sent()
        for batch in sliced(batches):
            rows = pool(batch.column("text"), table)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "pooled"])

    return with_columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, pooled binary")


class Network:
    """Two layers in numpy: tanh, then a logit; fitted by Adam, then scaled by a temperature."""

    def __init__(self, width: int, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = np.zeros(width), np.ones(width), 1.0
        self.weights = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 3000, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4) -> Network:
        aside = np.arange(len(y)) % 5 == 4
        x_set, y_set, x, y = x[aside], y[aside], x[~aside], y[~aside]
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        rng = np.random.default_rng(3)
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        z = (x - self.mean) / self.scale
        for t in range(1, steps + 1):
            take = rng.integers(0, len(y), min(batch, len(y)))
            w1, b1, w2, b2 = self.weights
            inner = np.tanh(z[take] @ w1 + b1)
            err = (1 / (1 + np.exp(-np.clip(inner @ w2 + b2[0], -40, 40))) - y[take]) / len(take)
            back = np.outer(err, w2) * (1 - inner**2)
            slopes = [z[take].T @ back + decay * w1, back.sum(0), inner.T @ err + decay * w2, np.array([err.sum()])]
            pace = rate * (1 - 0.9 * t / steps)
            for k, g in enumerate(slopes):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                self.weights[k] = self.weights[k] - pace * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        if len(y_set):
            logits = self.logit(x_set)
            loss = lambda t: np.logaddexp(0, np.where(y_set > 0, -1, 1) * logits / t).mean()
            self.temperature = float(min(np.geomspace(0.25, 8, 141), key=loss))
        return self


def labelled(features: DataFrame, labels: DataFrame, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of about ``max_rows`` labelled rows at most, chosen by a hash of the id."""
    marks = with_columns(labels, doc_id="long", quality="double").filter("doc_id is not null and quality is not null")
    marks = marks.filter(crc32_mod("doc_id", 5) != 0).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("quality"))
    total = marks.count()
    part = min(1.0, max_rows / total) if total else 0.0
    marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000))
    rows = sorted((r.doc_id, bytes(r.pooled), r.quality) for r in features.join(marks, "doc_id").select("doc_id", "pooled", "quality").collect())
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(-1, POOLED).astype(float)
    return x, np.array([r[2] for r in rows])


class Model:
    """A fitted classifier: word vectors and network; ``share`` is the score of all where nothing could be learned."""

    def __init__(self, vectors: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.vectors, self.share = vectors, float(y.mean()) if len(y) else 0.5
        self.network = Network(POOLED).fit(x, y) if len(y) and 0 < self.share < 1 else None

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.network.score(x.astype(float)) if self.network else np.full(len(x), self.share)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> tuple[Model, DataFrame]:
    """The model, and the pooled vectors of all documents."""
    setup(docs.sparkSession)
    vectors = word_vectors(docs)
    features = cut_lineage(pooled(docs, vectors))
    return Model(vectors, *labelled(features, labels, max_rows)), features


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""
    model, features = fit(docs, labels, max_rows)

    def run(batches):
        for batch in batches:
            data, _ = text_buffers(batch.column("pooled"))
            score = model.score(data.view(np.float32).reshape(-1, POOLED))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = features.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(crc32_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= cut, 1).otherwise(0).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` whose text scores ``cut`` or more; nothing is joined or shuffled."""
    model, _ = fit(docs, labels, max_rows)
    sent = shared(docs.sparkSession, model)

    def run(batches):
        known = sent()
        for batch in sliced(batches):
            good = known.score(pool(batch.column("text"), known.vectors)) >= cut
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
