"""Streams of reports and observations."""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import values as V
from ..operators.limits import report_step
from ..operators.status import at, day_sums, days, hours, status_of_days

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the limiter below runs in Python workers

class ReportLimiter(StatefulProcessor):
    """Per reporter: the reports accepted in the last 24 hours, at most ten of them, and the newest time decided.

    There is no watermark, because Spark drops rows behind it without a result; so a reporter's few numbers stay.
    """

    def __init__(self, late_us: int, chunk: int = 10_000):
        self.late_us, self.chunk = late_us, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getListState("accepted", "provider_id long, ts_us long")
        self.newest = handle.getValueState("newest", "ts_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [(int(r[0]), int(r[1])) for r in self.accepted.get()] if self.accepted.exists() else []
        newest = int(self.newest.get()[0]) if self.newest.exists() else None
        # three numbers a row are held for the rows of one reporter in one micro-batch, to take them in order of time
        columns = ("report_id", "provider_id", "ts_us")
        held = [[batch[c].to_numpy("int64") for c in columns] for batch in rows]
        ids, providers, times = (np.concatenate([h[k] for h in held]) for k in range(3))
        order = np.lexsort((ids, times))
        limit = None if newest is None else newest - self.late_us  # set before the micro-batch, not by it
        for at_ in range(0, len(order), self.chunk):
            some = order[at_ : at_ + self.chunk]
            out = []
            for i in some:
                row = Report(int(providers[i]), int(times[i]))
                out.append("late" if limit is not None and row.ts_us < limit else report_step(kept, row))
            yield pd.DataFrame({"report_id": ids[some], "result": out})
        self.accepted.clear()
        if kept:
            self.accepted.put(kept)
        self.newest.update((max(newest or 0, int(times[order[-1]])),))

    def close(self) -> None:
        pass


class Report(NamedTuple):
    provider_id: int
    ts_us: int


def limit_reports_stream(reports: DataFrame, providers: DataFrame, late: dt.timedelta = dt.timedelta(minutes=10)) -> DataFrame:
    """(report_id, result) for every row of a stream of (report_id, reporter, provider_id, created_at).

    Decided as in the batch form where a reporter's reports arrive in order of micro-batches; ``late`` are those older, by
    more than ``late``, than the newest one decided in an earlier micro-batch, ``no_provider`` those on practices that
    ``providers`` does not hold or holds as closed. Needs the RocksDB state store provider.
    """
    open_ = providers.filter("active").select("provider_id", F.lit(True).alias("open"))
    known = reports.select(
        "report_id", F.coalesce("reporter", F.lit("")).alias("reporter"), "provider_id", F.unix_micros("created_at").alias("ts_us")
    ).join(open_, "provider_id", "left")
    nobody = known.filter("open is null").select("report_id", F.lit("no_provider").alias("result"))
    decided = known.filter("open").select("report_id", "reporter", "provider_id", "ts_us").groupBy("reporter").transformWithStateInPandas(
        ReportLimiter(int(late.total_seconds() * 1_000_000)), outputStructType="report_id long, result string", outputMode="Append", timeMode="None"
    )
    return decided.unionByName(nobody)


def status_stream(signals: DataFrame, log_path: str, days_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the signal log by day, and each provider's sums by day.

    Every micro-batch writes only its own rows, under its own folder, so a replayed batch replaces itself; nothing
    written earlier is read again. ``status_at`` reads the sums.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("on", F.to_date("observed_at"))
        rows.write.mode("overwrite").partitionBy("on").parquet(f"{log_path}/batch={batch_id}")
        day_sums(batch).write.mode("overwrite").parquet(f"{days_path}/batch={batch_id}")

    return signals.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def status_at(spark: SparkSession, log_path: str, days_path: str, as_of) -> DataFrame:
    """The status of all providers at any moment, from the sums by day; of the log only the two days that the window cuts are read."""
    now = at(as_of)
    edges = [F.to_date(now - days(V.HORIZON_DAYS)), F.to_date(now + hours(V.FUTURE_HOURS))]
    log = spark.read.option("basePath", log_path).parquet(log_path).filter(F.col("on").isin(*edges))
    return status_of_days(spark.read.parquet(days_path), log.drop("on", "batch"), as_of)
