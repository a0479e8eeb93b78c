"""Session settings every job relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # charset names beyond the default list (windows-1250 register files and pages)
    "spark.sql.legacy.javaCharsets": "true",
    # a byte without a meaning becomes a replacement sign instead of ending the job
    "spark.sql.legacy.codingErrorAction": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build(app: str = "placewise", master: str | None = None, **conf: str) -> SparkSession:
    """A session for scripts and tests; on a cluster the submitter's settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        b = b.config(key, value)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session that names none gets a fresh temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def spread(scan: DataFrame) -> DataFrame:
    """Give every core a share of a scan that has fewer splits than cores.

    Only small inputs (one short file) are touched; a scan with enough splits is returned as is,
    so nothing large is ever shuffled for this. For plain scans in front of costly row work.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute once, keep the rows in the shared folder: survives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
