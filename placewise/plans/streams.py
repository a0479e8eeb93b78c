"""Registered queries: the stateful jobs run as streams over the given events."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import reports as S
from .intake import REPORT_FOLD
from .registry import query
from .serving import us


def files(d, df, name: str, parts: int = 3):
    """Domain rows written as a folder of files that a stream picks up in order of time."""
    folder = f"{shared_folder(d.spark)}/streams/{uuid.uuid4().hex}"
    df.repartitionByRange(parts, name).write.parquet(f"{folder}/in")
    return folder, d.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@query("J1_report_limit_stream", REPORT_FOLD)
def report_limit_stream(d):
    """The whole report stream in three micro-batches through the stateful limiter; every report has one result, as in the batch form."""
    rocks = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    d.spark.conf.set("spark.sql.streaming.stateStore.providerClass", rocks)
    folder = f"{shared_folder(d.spark)}/streams/{uuid.uuid4().hex}"
    third = F.ntile(3).over(W.orderBy("day"))
    days = d.reports.select(F.to_date("created_at").alias("day")).distinct().withColumn("third", third)  # one row per day
    for k in (1, 2, 3):  # one file after the other, so that the stream picks them up in order of time
        part = d.reports.join(days.filter(F.col("third") == k), F.to_date("created_at") == F.col("day"), "left_semi")
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    arriving = d.spark.readStream.schema(d.reports.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = S.limit_reports_stream(arriving, d.providers)
    run = out.writeStream.option("checkpointLocation", f"{folder}/cp").option("path", f"{folder}/out").trigger(availableNow=True).start()
    run.awaitTermination()
    return d.spark.read.parquet(f"{folder}/out")


@query("J8_status_stream", """
    SELECT provider_id, round(confidence, 3) AS confidence, round(score, 3) AS score, last_signal_us, status, last_source FROM status_full""")
def status_stream(d):
    """Signals arriving in three batches, kept as sums by day; the status read from them equals the one computed at once."""
    folder, arriving = files(d, d.signals, "observed_at")
    S.status_stream(arriving, f"{folder}/log", f"{folder}/days", f"{folder}/cp", availableNow=True).awaitTermination()
    rows = S.status_at(d.spark, f"{folder}/log", f"{folder}/days", d.as_of)
    return rows.select("provider_id", "confidence", "score", us("last_signal_at"), "status", "last_source")
