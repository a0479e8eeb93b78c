"""Reading area outlines from GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GEOJSON = (
    "features array<struct<properties:map<string,string>, geometry:struct<type:string, coordinates:string>>>"
)
POLYGON, MULTI = "array<array<array<double>>>", "array<array<array<array<double>>>>"


def read_polygons(spark: SparkSession, path: str, name_property: str, multi_line: bool = True) -> DataFrame:
    """(area, rings): one row per feature; parts of a multi-polygon are rings of the same area.

    One document per file, or one per line with ``multi_line=False``.
    """
    rows = spark.read.schema(GEOJSON).json(path, multiLine=multi_line).select(F.explode("features").alias("f"))
    text, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    raw = F.when(kind == "MultiPolygon", F.flatten(F.from_json(text, MULTI))).otherwise(F.from_json(text, POLYGON))
    rings = F.transform(raw, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))))
    return rows.select(F.col("f.properties")[name_property].alias("area"), rings.alias("rings"))
