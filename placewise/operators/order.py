"""Numbering rows in a total order without gathering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def numbered(df: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """Rows numbered from 1 in a total order, without gathering them in one task.

    Rows are dealt by range; a part's first number is the count of the parts before it.
    """
    key = F.struct(*order)
    dealt = cut_lineage(df.withColumn("__key", key).repartitionByRange("__key").withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select(
        "__part", (F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__n")).alias("__before")
    )
    place = F.row_number().over(W.partitionBy("__part").orderBy("__key"))
    return dealt.join(before, "__part").withColumn(name, (F.col("__before") + place).cast("bigint")).drop("__key", "__part", "__n", "__before")
