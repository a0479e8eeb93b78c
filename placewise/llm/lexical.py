"""Ranked lexical search: each item's best documents, by branch and bound over document FP-trees.

1. *Restriction* (one pass over the texts): each document becomes its length and its (term, count) vector over the items' terms only. From
   them come the number of documents, the total length and each term's document frequency.
2. *FP-tree*: a task cuts its documents into groups of bounded size. With terms ordered from the most to the least frequent, documents
   with a common beginning share a path of the group's trie; paths without a branch are one node, and documents with one path, or a few
   documents, are a leaf. Each node keeps the largest count of every term below it and the smallest length norm m below it.
3. *Branch and bound*: a score rises with counts and falls with m, so a node's maxima and minimum bound all scores below it. The maxima are
   stored term by term, so an item's terms give the bounds of a tree's nodes in one pass over their lists. The tree is then walked
   depth first, children with the best bound first; a subtree goes when its bound is below the item's k-th best score so far, and the
   documents of the leaves that stay are scored exactly, 256 or so at a time. Best scores carry over from tree to tree of a task.
4. The best of each task are merged by score and id, in two steps, so that no item meets in one task with all its candidates.

Items come in blocks of at most ``BLOCK_TERMS`` terms (one item at least): a block's terms go to every task, whatever the number of items.
Terms are told apart by 64-bit hashes.

Defined cases: a null or wordless text is no document of the collection and is never found; rows with a null id count in the statistics
and are not returned; rows that repeat an id are documents of their own; an item without an id or without terms that occur has no
rows; repeated item rows are items of their own, with ranks each; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, setup, shared, sliced, text_buffers, with_columns, word_hashes

BLOCK_TERMS, BLOCK_ITEMS = 200_000, 2000
GROUP_POSTINGS, GROUP_DOCS = 1 << 18, 8192
DEPTH = 32  # terms of a path that make branches
LEAF = 8
AT_ONCE = 256
TEXT_BYTES = 4 << 20  # bytes of text turned into terms at once

# ASCII signs that are neither letters nor digits end a term.
GAPS = np.array([k < 128 and not chr(k).isalnum() for k in range(256)])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms, counts): the distinct term hashes of each item."""

    def run(batches):
        for batch in sliced(batches, TEXT_BYTES):
            hashes, owner = word_hashes(*text_buffers(batch.column("text")), separator=GAPS)
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            found = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array([t.tobytes() for t, _ in found], pa.binary()), pa.array([c.tobytes() for _, c in found], pa.binary())],
                ["item_id", "terms", "counts"],
            )

    return with_columns(items, item_id="long", text="string").filter("item_id is not null").mapInArrow(run, "item_id long, terms binary, counts binary")


def blocks(items: DataFrame) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """The items, streamed through the driver in blocks of bounded size."""
    block, held = [], 0
    for r in cut_lineage(items).toLocalIterator():
        terms = np.frombuffer(r.terms, np.uint64)
        if block and (held + len(terms) > BLOCK_TERMS or len(block) == BLOCK_ITEMS):
            yield block
            block, held = [], 0
        block.append((r.item_id, terms, np.frombuffer(r.counts, np.int64)))
        held += len(terms)
    if block:
        yield block


def restricted(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, vector) of each document with a term: n counts all its terms, the vector holds term << 32 | count."""
    sent = shared(docs.sparkSession, vocabulary)

    def run(batches):
        known = sent()
        for batch in sliced(batches, TEXT_BYTES):
            hashes, owner = word_hashes(*text_buffers(batch.column("text")), separator=GAPS)
            n = np.bincount(owner, minlength=batch.num_rows)
            at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            hit = np.flatnonzero(known[at] == hashes) if len(known) else np.zeros(0, np.int64)
            pairs, counts = np.unique((owner[hit] << 32) | at[hit], return_counts=True)
            keep = np.flatnonzero(n)
            place = np.searchsorted(pairs >> 32, np.append(keep, batch.num_rows))
            vectors = pa.ListArray.from_arrays(pa.array(place.astype(np.int32)), pa.array(((pairs & 0xFFFFFFFF) << 32) | counts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(keep)), pa.array(n[keep]), vectors], ["doc_id", "n", "vector"])

    return with_columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n long, vector array<long>")


class Tree:
    """The FP-tree of a group of documents: ``ids``, their ``norms`` m, and postings (``owner``, ``ranks``, ``counts``) in order of owner and rank."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, owner: np.ndarray, ranks: np.ndarray, counts: np.ndarray, width: int):
        n, self.width = len(ids), width
        starts = np.searchsorted(owner, np.arange(n + 1))
        place = np.arange(len(owner)) - starts[owner]
        path = np.full((n, DEPTH + 1), -1, np.int64)  # -1 ends a path
        short = place < DEPTH
        path[owner[short], place[short]] = ranks[short]
        order = np.lexsort(path.T[::-1])
        path = path[order]
        self.ids, self.norms = ids[order], norms[order]
        moved = np.empty(n, np.int64)
        moved[order] = np.arange(n)
        key = moved[owner] * width + ranks
        by = np.argsort(key, kind="stable")
        self.doc_keys, self.doc_counts = key[by], counts[by]
        alike = np.concatenate([[0], (np.cumprod(path[1:] == path[:-1], axis=1)).sum(axis=1)])  # terms in common with the document before
        self._grow(alike, n)
        self._gather(n)

    def _grow(self, alike: np.ndarray, n: int) -> None:
        """Nodes as ranges of documents; a node's children divide it where the shared path is shortest."""
        low, high, parent, level, leaf, children = [0], [n], [-1], [0], [], [[]]
        waiting = [0]
        while waiting:
            node = waiting.pop()
            a, b = low[node], high[node]
            inner = alike[a + 1 : b]
            depth = int(inner.min()) if b - a > LEAF else DEPTH + 1
            if depth > DEPTH:
                leaf.append(node)
                continue
            cuts = [a, *(np.flatnonzero(inner == depth) + a + 1).tolist(), b]
            for x, y in zip(cuts, cuts[1:], strict=False):
                children[node].append(len(low))
                waiting.append(len(low))
                low.append(x), high.append(y), parent.append(node), level.append(level[node] + 1), children.append([])
        self.low, self.high, self.parent, self.level = (np.array(x) for x in (low, high, parent, level))
        self.children = [np.array(c) for c in children]
        self.leaf = np.zeros(len(low), bool)
        self.leaf[leaf] = True

    def _gather(self, n: int) -> None:
        """The largest count of every term below each node, term by term, and the smallest norm below it."""
        leaves = np.flatnonzero(self.leaf)
        leaves = leaves[np.argsort(self.low[leaves])]
        self.least = np.zeros(len(self.low), np.int64)
        self.least[leaves] = np.minimum.reduceat(self.norms, self.low[leaves])
        home = leaves[np.searchsorted(self.low[leaves], self.doc_keys // self.width, side="right") - 1]
        nodes, terms, most = merged(home, self.doc_keys % self.width, self.doc_counts, self.width)
        all_ = []
        waiting = (nodes, terms, most)
        for depth in range(int(self.level.max()), -1, -1):
            here = self.level[waiting[0]] == depth
            found = [x[here] for x in waiting]
            all_.append(found)
            rest = [x[~here] for x in waiting]
            if depth:
                up = merged(self.parent[found[0]], found[1], found[2], self.width)
                waiting = tuple(np.concatenate([a, b]) for a, b in zip(rest, up, strict=True))
                at = np.flatnonzero(self.level == depth)
                low = np.full(len(self.low), np.iinfo(np.int64).max)
                np.minimum.at(low, self.parent[at], self.least[at])
                above = self.parent[at]
                self.least[above] = low[above]
        nodes, terms, most = (np.concatenate(x) for x in zip(*all_, strict=True))
        by = np.argsort(terms, kind="stable")
        self.term_nodes, self.term_most = nodes[by], most[by]
        self.term_starts = np.searchsorted(terms[by], np.arange(self.width + 1))

    def bounds(self, ranks: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For every node, a score that no document below it can pass."""
        out = np.zeros(len(self.low), np.int64)
        for r, w in zip(ranks.tolist(), weights.tolist(), strict=True):
            at = slice(self.term_starts[r], self.term_starts[r + 1])
            node, most = self.term_nodes[at], self.term_most[at]
            out[node] += w * part(most, self.least[node])  # a node is there once per term
        return out

    def scores(self, docs: np.ndarray, ranks: np.ndarray, weights: np.ndarray) -> np.ndarray:
        key = docs[:, None] * self.width + ranks[None, :]
        at = np.minimum(np.searchsorted(self.doc_keys, key), len(self.doc_keys) - 1)
        tf = np.where(self.doc_keys[at] == key, self.doc_counts[at], 0)
        return (part(tf, self.norms[docs][:, None]) * weights[None, :]).sum(axis=1)

    def search(self, ranks: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Puts the documents that belong there into ``best``; returns how many were scored."""
        if not len(self.doc_keys):
            return 0
        bound = self.bounds(ranks, weights)
        stack, held, size, seen = [0], [], 0, 0
        while stack or held:
            if stack:
                node = stack.pop()
                if bound[node] < best.least:
                    continue
                if self.leaf[node]:
                    held.append(node)
                    size += self.high[node] - self.low[node]
                else:
                    below = self.children[node]
                    below = below[bound[below] >= best.least]
                    stack.extend(below[np.argsort(bound[below], kind="stable")].tolist())
            if held and (size >= AT_ONCE or not stack):
                docs = np.concatenate([np.arange(self.low[x], self.high[x]) for x in held if bound[x] >= best.least] or [np.zeros(0, np.int64)])
                for k in range(0, len(docs), 4 * AT_ONCE):
                    some = docs[k : k + 4 * AT_ONCE]
                    best.add(self.scores(some, ranks, weights), self.ids[some])
                seen += len(docs)
                held, size = [], 0
        return seen


def merged(nodes: np.ndarray, terms: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry per node and term, with the largest count."""
    key = nodes * width + terms
    by = np.argsort(key, kind="stable")
    key = key[by]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(counts[by], first) if len(first) else np.zeros(0, np.int64)
    return key[first] // width, key[first] % width, most


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's share of a score before its weight; rises with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Best:
    """The k best (score, id) so far: highest scores, equal ones by smaller id."""

    def __init__(self, k: int):
        self.k, self.heap, self.least = k, [], 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for at in np.flatnonzero(scores >= self.least).tolist():
            entry = (int(scores[at]), -int(ids[at]))
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)
        if len(self.heap) == self.k:
            self.least = max(self.heap[0][0], 1)


def groups(batches: Iterator[pa.RecordBatch], rank: np.ndarray, norm) -> Iterator[Tree]:
    """Trees over the documents of a task, each of bounded size."""
    held, docs, size = [], 0, 0

    def tree():
        ids, n, vector = (np.concatenate([h[k] for h in held]) for k in (0, 1, 3))
        lengths = np.concatenate([h[2] for h in held])
        owner = np.repeat(np.arange(len(ids)), lengths)
        ranks = rank[vector >> 32]
        by = np.lexsort((ranks, owner))
        return Tree(ids, norm(n), owner, ranks[by], (vector & 0xFFFFFFFF)[by], len(rank))

    for batch in batches:
        lengths_all = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values, before = batch.column("vector").flatten().to_numpy(zero_copy_only=False), 0
        at = 0
        while at < batch.num_rows:
            room = np.searchsorted(np.cumsum(lengths_all[at:]), GROUP_POSTINGS - size, side="right")
            to = min(max(at + int(room), at + (0 if held else 1)), at + GROUP_DOCS - docs, batch.num_rows)
            if to > at:
                part_ = batch.slice(at, to - at)
                lengths = lengths_all[at:to]
                held.append((part_.column("doc_id").to_numpy(zero_copy_only=False), part_.column("n").to_numpy(zero_copy_only=False), lengths, values[before : before + int(lengths.sum())]))
                docs, size, before, at = docs + to - at, size + int(lengths.sum()), before + int(lengths.sum()), to
            if at < batch.num_rows:
                yield tree()
                held, docs, size = [], 0, 0
    if held:
        yield tree()


def search_block(docs: DataFrame, block: list, first: int, k: int) -> DataFrame:
    """(item, doc_id, score) candidates for the items of a block: the k best of every task."""
    spark = docs.sparkSession
    vocabulary = np.unique(np.concatenate([t for _, t, _ in block]))
    vectors = cut_lineage(restricted(docs, vocabulary))
    whole = vectors.agg(F.count("*").alias("n"), F.sum("n").alias("length")).first()
    entries = vectors.select(F.explode("vector").alias("v")).groupBy(F.shiftright("v", 32).cast("int").alias("term")).agg(F.count("*").alias("df"))
    df = np.zeros(len(vocabulary), np.int64)
    for r in entries.collect():  # a block's terms at most
        df[r.term] = r.df
    n_docs, length = whole.n, whole.length or 1
    weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    rank = np.empty(len(df), np.int64)
    rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    items = []
    for k_, (_, terms, counts) in enumerate(block):
        at = np.searchsorted(vocabulary, terms)
        live = (df[at] > 0) & (weight[at] > 0)
        items.append((first + k_, rank[at[live]], (weight[at] * counts)[live]))
    sent = shared(spark, (rank, items, n_docs, length))

    def run(batches):
        rank, items, n_docs, length = sent()
        norm = lambda n: 75 + (25 * n * n_docs) // length
        found = {item: Best(k) for item, _, _ in items}
        for tree in groups(batches, rank, norm):
            for item, ranks, weights in items:
                if len(ranks):
                    tree.search(ranks, weights, found[item])
        rows = [(item, -i, s) for item, best in found.items() for s, i in best.heap]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    usable = vectors.filter("doc_id is not null and size(vector) > 0")
    return usable.mapInArrow(run, "item long, doc_id long, score long")


def best_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item."""
    spark = setup(docs.sparkSession)
    parts, first = [], 0
    for block in blocks(item_terms(items)):
        ids = pa.table({"item": pa.array(range(first, first + len(block)), pa.int64()), "item_id": pa.array([i for i, _, _ in block], pa.int64())})
        if any(len(t) for _, t, _ in block):
            found = search_block(docs, block, first, k)
            order = [F.col("score").desc(), F.col("doc_id")]
            for key in (["item", "share"], ["item"]):
                place = F.row_number().over(W.partitionBy(*key).orderBy(*order))
                found = found.withColumn("share", F.pmod(F.hash("doc_id"), F.lit(64))).withColumn("rank", place).filter(F.col("rank") <= k)
            parts.append(found.join(F.broadcast(spark.createDataFrame(ids)), "item").select("item_id", "rank", "doc_id", "score"))
        first += len(block)
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, [cut_lineage(p) for p in parts] if len(parts) > 1 else parts)
