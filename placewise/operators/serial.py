"""Decisions that depend on earlier decisions of the same key, taken in parallel time slices.

Rows are dealt by range of (key, order), so a busy key spreads over many slices. Every slice is decided at once, as if
nothing had come before; then each slice's last entries are handed to the next one of its key, and only slices whose
incoming entries changed are decided again, until none changes. That is the result of one pass in order: the first
slice of a key is right from the start, and a slice is right once the one before it is.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stepper(key: str, step: Callable, start: Callable, coming: dict[int, tuple[str, list]]):
    """For ``mapInPandas`` over one slice: ``step(state, row)`` gives each row's result; only one key's state is held.

    ``coming``: by slice, the key that goes on from the slice before, and what it brings along.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                k = getattr(row, key)
                if k != current:
                    brought = coming.get(row.part, (None, ()))
                    current, state = k, start(brought[1] if brought[0] == k else ())
                out.append(step(state, row))
            yield batch.assign(result=pd.Series(out, index=batch.index, dtype="object"))

    return run


def decided_in_slices(
    rows: DataFrame, key: str, time: str, order: list[str], step: Callable, start: Callable, entry: list[str], counts: Column, reach: int, slices: int | None = None,
) -> DataFrame:
    """``rows`` with a ``result``: ``step(state, row)`` over the rows of each (string) ``key`` in the order of ``time`` and ``order``.

    Rows for which ``counts`` is true are what later decisions depend on, for ``reach`` units of ``time``: their ``time`` and
    ``entry`` columns go to the next slice, whose state is ``start(entries)``. The limits that ``step`` keeps bound how
    many entries a slice has; the driver holds them, and two rows about each slice.
    """
    sort = [key, time, *order]
    dealt = rows.repartitionByRange(slices, *sort) if slices else rows.repartitionByRange(*sort)
    dealt = cut_lineage(dealt.sortWithinPartitions(*sort).withColumn("part", F.spark_partition_id()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", result string"
    keys = dealt.groupBy("part", key).agg(F.min(time).alias("begin"), F.max(time).alias("end"))
    ends = keys.groupBy("part").agg(F.min_by(F.struct(key, "begin"), key).alias("first"), F.max_by(F.struct(key, "end"), key).alias("last"))
    spans = {r["part"]: r for r in ends.collect()}
    parts = sorted(spans)
    before = {p: b for b, p in zip(parts, parts[1:], strict=False) if spans[b]["last"][0] == spans[p]["first"][0]}
    table = lambda **columns: F.broadcast(dealt.sparkSession.createDataFrame(pa.table(columns)))

    def firsts(of: list[int]) -> DataFrame:
        return table(part=pa.array(of, pa.int32()), **{key: pa.array([spans[p]["first"][0] for p in of], pa.string())})

    def decide(some: DataFrame, coming: dict) -> DataFrame:
        """A slice is one partition and stays one: nothing is shuffled."""
        return cut_lineage(some.sortWithinPartitions(*sort).mapInPandas(stepper(key, step, start, coming), schema))

    def endings(done: DataFrame, of: list[int]) -> dict[int, list[tuple]]:
        """What the last key of each slice leaves to the next one."""
        asked = table(
            part=pa.array(of, pa.int32()), least=pa.array([spans[p]["last"][1] - reach for p in of], pa.int64()),
            **{key: pa.array([spans[p]["last"][0] for p in of], pa.string())},
        )
        out: dict[int, list[tuple]] = {p: [] for p in of}
        for r in done.filter(counts).join(asked, ["part", key]).filter(F.col(time) > F.col("least")).select("part", time, *entry).collect():
            out[r[0]].append(tuple(r)[1:])
        for p in of:
            if spans[p]["first"][0] == spans[p]["last"][0]:  # one key throughout: what came in may still count at its end
                out[p] += [e for e in used.get(p, ()) if e[0] > spans[p]["last"][1] - reach]
        return out

    used: dict[int, list[tuple]] = {p: [] for p in before}
    base = decide(dealt, {})
    left = endings(base, sorted(set(before.values()))) if before else {}
    rounds: list[tuple[list[int], DataFrame]] = []
    while True:
        coming = {p: sorted(e for e in left[b] if e[0] > spans[p]["first"][1] - reach) for p, b in before.items()}
        changed = [p for p in before if coming[p] != used[p]]
        if not changed:
            break
        used |= {p: coming[p] for p in changed}
        again = dealt.join(firsts(changed), ["part", key], "left_semi").select(*dealt.columns)
        done = decide(again, {p: (spans[p]["first"][0], coming[p]) for p in changed})
        rounds.append((changed, done))
        onward = [p for p in changed if p in left and spans[p]["first"][0] == spans[p]["last"][0]]
        if onward:
            left |= endings(done, onward)
    last = {p: k for k, (changed, _) in enumerate(rounds) for p in changed}  # the round that settled each slice
    whole = base.join(firsts(list(last)), ["part", key], "left_anti").select(*base.columns) if last else base
    for k, (changed, done) in enumerate(rounds):
        if final := [p for p in changed if last[p] == k]:
            whole = whole.unionByName(done.join(firsts(final), ["part", key], "left_semi").select(*base.columns))
    return whole.drop("part")
