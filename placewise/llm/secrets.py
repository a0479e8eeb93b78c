"""Secret scan: fixed patterns, and probabilistic automata inferred from what the patterns found.

One pass over the texts finds the *base* spans, the credentials in them, and all other *candidates*: runs of credential
characters, sixteen or longer, that hold a letter and a digit. Then the grammar inference, per kind, on a bounded sample of
distinct credentials (``sample`` per kind, the smallest by hash): a prefix tree of the strings with counts; states are merged
in breadth-first order when the frequencies of their symbols and ends, and those of all states below, differ by no more than
the Hoeffding bound allows; merging folds the subtrees. What remains is a probabilistic automaton. It scores every candidate:
the mean log-likelihood of its symbols and end must reach the lowest that the sample itself had (``quantile`` of it), and beat a
uniform choice among the characters. Candidates that pass, and touch no base span, become spans of kind ``format``.

Positions are code points, ends exclusive. Base spans are never changed by the inference. Defined cases: null and empty texts
have no spans; a null id is reported as null; repeated rows are scanned each; without credentials nothing is inferred.
"""

from __future__ import annotations

import re
from collections import deque
from hashlib import sha256
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, setup, sliced, with_columns

# The patterns of the three kinds, in their order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # a run of 24 and more is found whole
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE, LEAST_ACCESS = 6, 20

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
SYMBOLS = 67  # characters a candidate is made of, and the end
ALPHA, UNSEEN, LONGEST = 0.05, 1e-4, 512


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, credential) of the fixed patterns, by start and kind."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def other_candidates(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, string) of the candidates that touch no span."""
    out = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and not any(a < m.end() and m.start() < b for a, _, b, _ in spans):
            out.append((m.start(), m.end(), s))
    return out


class Automaton:
    """A probabilistic automaton: ``seen[q]`` strings passed state q, ``end[q]`` ended there, ``next[q][symbol]`` is (state, count)."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, list[int]]] = [{}]
        self.seen, self.end = [0], [0]
        for s in strings:
            q = 0
            self.seen[0] += 1
            for c in s:
                if c not in self.next[q]:
                    self.next[q][c] = [len(self.next), 0]
                    self.next.append({}), self.seen.append(0), self.end.append(0)
                step = self.next[q][c]
                step[1] += 1
                q = step[0]
                self.seen[q] += 1
            self.end[q] += 1
        self.width = sqrt(0.5 * log(2 / alpha))
        self._merge()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.width * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether two states, and all that lies below both, look alike."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.seen[a], self.seen[b]
            if not n or not m:
                continue
            if self._differ(self.end[a], n, self.end[b], m):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(c), self.next[b].get(c)
                if self._differ(x[1] if x else 0, n, y[1] if y else 0, m):
                    return False
                if x and y and x[0] != y[0]:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the counts of ``tree``, which is still a tree, to ``into`` and below."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.end[a] += self.end[b]
            for c, (q, n) in self.next[b].items():
                if c in self.next[a]:
                    self.next[a][c][1] += n
                    todo.append((self.next[a][c][0], q))
                else:
                    self.next[a][c] = [q, n]

    def _merge(self) -> None:
        kept, waiting = [0], deque((0, c) for c in sorted(self.next[0]))
        while waiting:
            parent, c = waiting.popleft()
            q = self.next[parent][c][0]
            if q in kept:
                continue
            match = next((r for r in kept if self._compatible(r, q)), None)
            if match is None:
                kept.append(q)
                waiting.extend((q, s) for s in sorted(self.next[q]))
                continue
            self.next[parent][c][0] = match
            before = {r: set(self.next[r]) for r in kept}
            self._fold(match, q)
            waiting.extend((r, s) for r in kept for s in sorted(set(self.next[r]) - before[r]))
        # number the kept states anew
        name = {q: k for k, q in enumerate(kept)}
        self.next = [{c: [name[q], n] for c, (q, n) in self.next[r].items()} for r in kept]
        self.seen, self.end = [self.seen[r] for r in kept], [self.end[r] for r in kept]

    def likelihood(self, s: str) -> float:
        """Mean log-probability of the symbols of ``s`` and its end; what was never seen counts little."""
        q, total = 0, 0.0
        for c in s:
            n = sum(v[1] for v in self.next[q].values()) + self.end[q] if q is not None else 0
            step = self.next[q].get(c) if q is not None else None
            total += log(step[1] / n) if step and step[1] else log(UNSEEN)
            q = step[0] if step else 0
        n = sum(v[1] for v in self.next[q].values()) + self.end[q]
        return (total + (log(self.end[q] / n) if n and self.end[q] else log(UNSEEN))) / (len(s) + 1)


def infer(credentials: dict[str, list[str]], quantile: float = 0.02) -> list[tuple[Automaton, float]]:
    """(automaton, least likelihood) of each kind with credentials."""
    out = []
    for kind in KINDS:
        strings = sorted(credentials.get(kind, []))
        if strings:
            automaton = Automaton(strings)
            own = sorted(map(automaton.likelihood, strings))
            out.append((automaton, max(own[int(quantile * len(own))], -log(SYMBOLS))))
    return out


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, found, others) of every text."""
    span = "struct<start: long, kind: string, end: long, value: string>"

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("value", pa.string())]))
        for batch in sliced(batches):
            counts, found, others = ([], [], []), [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text or "")
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in spans))
                found.append([{"start": a, "kind": KINDS[k], "end": b, "value": v} for a, k, b, v in spans])
                others.append([{"start": a, "kind": "", "end": b, "value": v} for a, b, v in other_candidates(text or "", spans)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(found, kind), pa.array(others, kind)],
                ["doc_id", "n_assign", "n_access", "n_hex", "found", "others"],
            )

    schema = f"doc_id long, n_assign long, n_access long, n_hex long, found array<{span}>, others array<{span}>"
    return with_columns(docs, doc_id="long", text="string").mapInArrow(run, schema)


def find_secrets(docs: DataFrame, sample: int = 400) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format), one row per row of ``docs``."""
    setup(docs.sparkSession)
    scanned = cut_lineage(scan(docs))
    known = scanned.select(F.explode("found").alias("f")).select("f.kind", "f.value").filter(F.length("value") <= LONGEST).distinct()
    order = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    credentials: dict[str, list[str]] = {}
    for r in known.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample).select("kind", "value").collect():  # at most 3 x sample rows
        credentials.setdefault(r["kind"], []).append(r["value"])
    automata = infer(credentials)

    def run(batches):
        for batch in batches:
            digests, spans, added = [], [], []
            for found, others in zip(batch.column("found").to_pylist(), batch.column("others").to_pylist(), strict=True):
                base = [(f["start"], f["kind"], f["end"]) for f in found]
                new = [(o["start"], "format", o["end"]) for o in others if any(a.likelihood(o["value"]) >= least for a, least in automata)]
                digests.append(sha256(joined(base).encode()).hexdigest())
                spans.append(joined(sorted(base + new, key=lambda s: (s[0], [*KINDS, "format"].index(s[1])))))
                added.append(len(new))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "n_assign", "n_access", "n_hex")], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"],
            )

    return scanned.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")
