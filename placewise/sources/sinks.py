"""Where results go: versioned snapshots, the append-only log, outbox files, the sitemap."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "_current"


def write_snapshot(df: DataFrame, root: str, version: str) -> str:
    """Write one version of a table, then point readers at it.

    A version is complete before its pointer is written, and a pointer is a new folder that no
    other write touches; readers take the newest one. So a failed job leaves readers where they
    were, and a repeated one overwrites its own version.
    """
    folder = f"{root}/version={version}"
    df.write.mode("overwrite").parquet(folder)
    row = df.sparkSession.createDataFrame([(version,)], "version string").coalesce(1)
    row.write.json(f"{root}/{POINTER}/written={time.time_ns()}")
    return folder


def read_snapshot(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    if version is None:
        pointers = spark.read.schema("version string, written long").json(f"{root}/{POINTER}")
        version = pointers.orderBy(F.col("written").desc()).first()["version"]
    return spark.read.parquet(f"{root}/version={version}")


def append_signals(signals: DataFrame, root: str, run_id: str) -> None:
    """Append observations, one folder per run and day of observation; a repeated run replaces its own folder."""
    days = signals.withColumn("obs_date", F.to_date("observed_at"))
    # a day is written by as many tasks as its size asks for
    days.hint("rebalance", F.col("obs_date")).write.mode("overwrite").partitionBy("obs_date").parquet(f"{root}/run={run_id}")


def read_signals(spark: SparkSession, root: str, as_of=None, days: int = 90) -> DataFrame:
    """The log, or only the day folders a status at ``as_of`` can need."""
    df = spark.read.parquet(root)
    if as_of is None:
        return df
    day = F.to_date(F.lit(as_of))
    return df.filter(F.col("obs_date").between(F.date_sub(day, days), F.date_add(day, 1)))


def write_outbox(df: DataFrame, root: str, run_id: str) -> str:
    """Messages to send, as JSON lines; a repeated run replaces its own folder."""
    folder = f"{root}/run={run_id}"
    df.write.mode("overwrite").json(folder)
    return folder


def write_sitemap(urls: DataFrame, path: str) -> None:
    """One folder per sitemap file of at most 50,000 addresses, and the list of them."""
    urls.select("file", "url").repartition("file").write.mode("overwrite").partitionBy("file").text(f"{path}/files")
    urls.select(F.concat(F.lit("files/file="), F.col("file").cast("string")).alias("value")).distinct().write.mode("overwrite").text(f"{path}/index")
