"""What the operators share: settings, table access, Arrow text buffers and vectorised word hashes."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, cut_lineage, shared_folder

# Tasks carry the code of this package with them: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

__all__ = [
    "ROWS_PER_BATCH", "crc32_mod", "cut_lineage", "mix64", "read_table", "run_folder", "setup", "shared", "shared_folder", "shingles", "sliced", "text_buffers",
    "word_hashes", "with_columns",
]

# Rows and bytes of one Arrow batch: what a Python task holds at once.
ROWS_PER_BATCH = 2000
BYTES_PER_BATCH = 16 << 20

# ASCII white space, as in [\x20\x09-\x0D].
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[list(WHITE)] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
# One random 64-bit value per byte; separators weigh nothing.
BYTE_VALUE = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUE[SEPARATOR] = 0
STEP = np.uint64(0x9E3779B97F4A7C15)
SHINGLE_STEP = np.uint64(0xD6E8FEB86659FD93)
CHUNK = 4 << 20  # bytes hashed at once


def setup(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on: small Arrow batches bound the memory of a Python task."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))
    return spark


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables; the path is read by Spark only."""
    return setup(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run's files, in the folder every executor can reach."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared(spark: SparkSession, value):
    """Send a value of fixed size to all tasks once; a task calls the result to get it. Carries this package's classes too."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(sent.value)


def with_columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, each cast to the given type; other columns of the table never matter."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()])


def crc32_mod(column: str, modulus: int):
    """crc32 of an id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def sliced(batches: Iterator[pa.RecordBatch], limit: int = BYTES_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``limit`` bytes at most, or one row."""
    for batch in batches:
        pieces = min(batch.num_rows, -(-batch.nbytes // limit)) or 1
        step = -(-batch.num_rows // pieces) or 1
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, fold: bool = True, separator: np.ndarray = SEPARATOR
) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document index) of every word of a batch, in order.

    A word is a maximal run of bytes that are no separators; ``fold`` lower-cases A-Z first. Works through the bytes
    in pieces that end at a separator, so memory does not follow the longest text.
    """
    value = BYTE_VALUE if separator is SEPARATOR else np.where(separator, np.uint64(0), BYTE_VALUE | np.uint64(1))
    if fold:
        value = value[FOLD]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    hashes, places, at = [], [], 0
    while at < len(data):
        to = min(at + CHUNK, len(data))
        if to < len(data):
            gap = separator[data[at:to]] | begins[at:to]
            cut = gap.nonzero()[0]
            if len(cut) and cut[-1]:
                to = at + int(cut[-1])
            else:  # one word longer than a piece
                while to < len(data) and not (separator[data[to]] or begins[to]):
                    to += 1
        part, first = data[at:to], begins[at:to]
        inside = ~separator[part]
        start = inside.copy()
        start[1:] &= ~inside[:-1] | first[1:]
        starts = start.nonzero()[0]
        if len(starts):
            owner = np.cumsum(start) - 1
            place = np.arange(len(part)) - starts[np.maximum(owner, 0)]
            np.maximum(place, 0, out=place)
            place[~inside] = 0
            power = np.multiply.accumulate(np.full(int(place.max()) + 1, STEP))
            hashes.append(mix64(np.add.reduceat(value[part] * power[place], starts)))
            places.append(starts + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    where = np.concatenate(places)
    return np.concatenate(hashes), np.searchsorted(offsets, where, side="right") - 1


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of one text; a shorter text is one shingle as a whole."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < size:
        total = np.array([len(words)], np.uint64)
        for j in range(len(words)):
            total = total * SHINGLE_STEP + words[j : j + 1]
        return mix64(total)
    n = len(words) - size + 1
    total = np.full(n, np.uint64(size))
    for j in range(size):
        total = total * SHINGLE_STEP + words[j : j + n]
    return np.unique(mix64(total))
