"""Token ids in binary shards: one concatenated id array per shard, document boundaries in Elias-Fano code.

A shard file holds, one after another: ``MAGIC``; all ids as little-endian unsigned integers of 2 or 4 bytes, document after
document; the boundaries (number of ids before each document, and the total) in Elias-Fano code; the documents' ids, sorted, in
Elias-Fano code as distances from the first; a JSON footer; the footer's length; ``MAGIC``. So the offset of any document is
one ``select`` away, and neither list needs a table of 64-bit numbers. Shards follow one another in ascending id order.

Encoding: a text is cut before each single space that is followed by something else than white space, which is where the
tokenizer's own pre-tokens begin, and each distinct piece goes through the tokenizer once per task. Texts with runs of
spaces, or of white space after a space, go through it whole. The ids are those of encoding the whole text.

A task writes its files under names of its own attempt and returns their names; only what finished attempts returned is read, so
lost or repeated tasks leave no trace in the result. Defined cases: a null or empty text is its end id alone; null ids
come first; equal ids follow one another by hash of the text; an empty table writes nothing.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, run_folder, setup, sliced
from .eliasfano import EliasFano

MAGIC = b"PWIDS1\r\n"
SHARD_IDS = 1 << 25
# Latin letters with a space or without, then ASCII signs but no apostrophe: two pre-tokens of the byte-level pattern.
WORD = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")
# White space of any kind, as the pattern and Python see it.
BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace()]
# The byte-level alphabet: printable bytes show as themselves, all others as the characters from 256 on, in order.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(PRINTED)))}
CACHE_PIECES = 400_000


def open_store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, and the folder's path in it."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


class Encoder:
    """The tokenizer with a bounded memory of pieces it has already encoded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        cut = made.get("pre_tokenizer") or {}
        #: whether the tokenizer cuts texts by the byte-level pattern and changes nothing before
        self.by_pieces = (
            made.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
            and made["model"].get("type") == "BPE" and not made["model"].get("dropout")
        )
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def part(self, text: str) -> list[int]:
        """Ids of one pre-token, by the tokenizer's model."""
        ids = self.parts.get(text)
        if ids is None:
            if text.isascii():
                shown = "\u0120" + text[1:] if text[0] == " " else text
            else:
                shown = text.encode().decode("latin-1").translate(SHOWN)
            ids = self.parts[text] = [t.id for t in self.tokenizer.model.tokenize(shown)]
        return ids

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that are new: words with signs after them by their two parts, all others by the whole tokenizer."""
        if not pieces:
            return
        self.parts: dict[str, list[int]] = {}
        found = list(map(WORD.fullmatch, pieces))
        others = iter(self.tokenizer.encode_batch_fast([w for w, m in zip(pieces, found, strict=True) if not m], add_special_tokens=False))
        part = self.part
        ids = [(part(m[1]) + part(m[2]) if m[2] else part(m[1])) if m else next(others).ids for m in found]
        length = np.array(list(map(len, ids)), np.int64)
        flat = np.array(list(chain.from_iterable(ids)), np.uint32)
        self.parts = {}
        first = len(self.length)
        self.known.update(zip(pieces, range(first, first + len(pieces)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, flat])

    def encode_whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(column.to_pylist(), add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        texts = pc.fill_null(column, "")
        if not self.by_pieces:
            return self.encode_whole(texts)
        n = len(texts)
        words = pc.split_pattern(texts, " ")
        per = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        owner = np.repeat(np.arange(n), per)
        head = np.zeros(len(code), bool)
        head[(np.cumsum(per) - per)[per > 0]] = True
        # a piece that is empty or begins with white space would lean on the spaces before it: such texts go whole
        first = pc.utf8_slice_codeunits(coded.dictionary, 0, 1)
        blank = pc.is_in(first, value_set=pa.array(["", *BLANKS])).to_numpy(zero_copy_only=False)
        whole = np.bincount(owner, blank[code] & ~head, minlength=n) > 0
        # pieces: with their space in front, or as the first of a text; whole texts are one piece
        usual = ~whole[owner]
        key = code.astype(np.int64) * 2 + head
        place = np.zeros(2 * len(names), np.int64)
        place[key[usual]] = 1
        used = place.nonzero()[0]
        named = [names[k >> 1] if k & 1 else " " + names[k >> 1] for k in used.tolist()]
        if len(self.known) + len(named) > CACHE_PIECES:
            self.forget()
        self.learn([w for w in named if w not in self.known])
        place[used] = list(map(self.known.__getitem__, named))
        piece = place[key[usual]]
        length, start = self.length[piece], self.start[piece]
        total = int(length.sum())
        ids = self.flat[np.arange(total) + np.repeat(start - (np.cumsum(length) - length), length)]
        size = np.bincount(owner[usual], length, minlength=n).astype(np.int64)
        if whole.any():
            odd = whole.nonzero()[0]
            extra, sizes = self.encode_whole(texts.take(pa.array(odd)))
            ids = np.insert(ids, np.repeat((np.cumsum(size) - size)[odd], sizes), extra)
            size[odd] = sizes
        return ids, size


def packed(offsets: np.ndarray) -> tuple[int, bytes]:
    """Start and Elias-Fano code of a sorted list of integers."""
    base = int(offsets[0]) if len(offsets) else 0
    return base, EliasFano.of((offsets.astype(object) - base).astype(np.uint64) if base < 0 else (offsets - base).astype(np.uint64)).to_bytes()


class ShardWriter:
    """Writes one shard file: ids as they come, boundaries and footer at the end."""

    def __init__(self, store: fs.FileSystem, path: str, width: int):
        self.out, self.path, self.kind = store.open_output_stream(path), path, f"<u{width}"
        self.out.write(MAGIC)
        self.sizes: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.nulls = self.n_ids = self.n_docs = 0

    def add(self, docs: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.out.write(ids.astype(self.kind).tobytes())
        self.sizes.append(sizes)
        self.nulls += docs.null_count
        self.docs.append(docs.drop_null().to_numpy())
        self.n_ids, self.n_docs = self.n_ids + len(ids), self.n_docs + len(sizes)

    def close(self) -> None:
        bounds = EliasFano.of(np.concatenate([[0], np.cumsum(np.concatenate(self.sizes))])).to_bytes()
        base, docs = packed(np.concatenate(self.docs))
        foot = json.dumps({
            "width": int(self.kind[2]), "n_ids": self.n_ids, "n_docs": self.n_docs, "null_docs": self.nulls, "first_doc": base,
            "bounds_bytes": len(bounds), "docs_bytes": len(docs),
        }).encode()
        self.out.write(bounds + docs + foot + len(foot).to_bytes(8, "little") + MAGIC)
        self.out.close()


class Shard:
    """Reads one shard file; offsets come from the select structure, ids from their place in the file."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        tail = self._read(size - 16, 16)
        if tail[8:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError(f"{path} is no complete shard")
        foot = int.from_bytes(tail[:8], "little")
        self.meta = json.loads(self._read(size - 16 - foot, foot))
        at = 8 + self.meta["n_ids"] * self.meta["width"]
        self.bounds = EliasFano.from_bytes(self._read(at, self.meta["bounds_bytes"]))
        self.docs = EliasFano.from_bytes(self._read(at + self.meta["bounds_bytes"], self.meta["docs_bytes"]))

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids at places ``first`` to ``last`` of the concatenated array."""
        width = self.meta["width"]
        return np.frombuffer(self._read(8 + first * width, (last - first) * width), f"<u{width}")

    def document(self, index: int) -> np.ndarray:
        return self.ids(self.bounds.select(index), self.bounds.select(index + 1))

    def doc_ids(self) -> list[int | None]:
        return [None] * self.meta["null_docs"] + [self.meta["first_doc"] + d for d in self.docs.all().tolist()]

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, width: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode all texts and write shards under ``folder``; returns (part, piece, path, n_docs, n_ids), stored."""
    memory = setup(docs.sparkSession).sparkContext.broadcast({})

    def run(batches: Iterator[pa.RecordBatch]):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        # what a Python worker has learned serves its next tasks too: a broadcast value lives as long as the worker
        known = memory.value
        encoder = known["encoder"] = known.get("encoder") or Encoder(tokenizer)
        attempt = uuid.uuid4().hex
        writer, piece, part = None, 0, None

        def done():
            writer.close()
            return pa.RecordBatch.from_pydict(
                {"part": [part], "piece": [piece], "path": [writer.path], "n_docs": [writer.n_docs], "n_ids": [writer.n_ids]},
                pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

        for batch in sliced(batches):
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            ids, sizes = encoder.encode(batch.column("text"))
            ends = np.cumsum(sizes)
            ids, sizes = np.insert(ids, ends, np.uint32(end_id)), sizes + 1
            if len(ids) and int(ids.max()) >= 1 << (8 * width):
                raise ValueError(f"id {int(ids.max())} needs more than {width} bytes")
            writer = writer or ShardWriter(store, f"{base}/ids-{part:06d}-{piece:06d}-{attempt}.bin", width)
            writer.add(batch.column("doc_id"), ids, sizes)
            if writer.n_ids >= shard_ids:
                yield done()
                writer, piece = None, piece + 1
        if writer:
            yield done()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return cut_lineage(ranged.mapInArrow(run, "part int, piece int, path string, n_docs long, n_ids long"))


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files; ``start`` counts the ids before it."""
    before = F.sum("n_ids").over(Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_ids")
    placed = shards.withColumn("before", before).repartition("path")

    def run(batches):
        store, _ = open_store(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                shard = Shard(store, path)
                bounds, ids = shard.bounds.all(), shard.doc_ids()
                for k in range(0, len(ids), 20_000):
                    edges = bounds[k : k + 20_001]
                    crc, at = [], 0
                    while at < len(edges) - 1:  # about four million ids at once
                        to = max(at + 1, int(np.searchsorted(edges, edges[at] + (1 << 22), side="right")) - 1)
                        words = shard.ids(int(edges[at]), int(edges[to])).astype("<u4")
                        crc += [zlib.crc32(words[a:b]) for a, b in zip((edges[at:to] - edges[at]).tolist(), (edges[at + 1 : to + 1] - edges[at]).tolist(), strict=True)]
                        at = to
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[k : k + 20_000], pa.int64()), pa.array(base + edges[:-1], pa.int64()), pa.array(np.diff(edges), pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                shard.close()

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = 2, width: int = 2) -> DataFrame:
    """Write all documents as shards in the shared folder, and read them back."""
    folder = run_folder(docs.sparkSession, "token-ids")
    return read_shards(write_shards(docs, folder, tokenizer, end_id, width), folder)
