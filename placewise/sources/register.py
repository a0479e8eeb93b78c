"""Reading register exports: CSV in UTF-8 or windows-1250, any usual separator, old or new headers, each file by itself."""

from __future__ import annotations

import csv
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import values as V
from ..functions.text import norm_header
from ..operators.register import places_from_rows
from ..session import configure


def file_kinds(spark: SparkSession, path: str | list[str]) -> list[tuple[str, str, str, str]]:
    """(file, encoding, separator, header line) of every file: UTF-8 if all its lines are, else windows-1250; separator by its first line.

    Two narrow passes over the lines; one row per file comes back.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.is_valid_utf8("value").alias("ok"), "value",
    )
    heads = lines.filter("block = 0")
    first = heads.groupBy("file").agg(F.min("line").alias("line"))
    header = heads.join(first, ["file", "line"]).select("file", F.col("value").cast("binary").alias("header"))
    found = lines.groupBy("file").agg(F.bool_and("ok").alias("utf8")).join(header, "file").collect()
    if not found:
        raise ValueError(f"{path} is empty")
    out = []
    for r in sorted(found, key=lambda r: r["file"]):
        encoding = "UTF-8" if r["utf8"] else "windows-1250"
        head = bytes(r["header"]).decode(encoding, "replace").lstrip("\ufeff")
        counts = {sep: head.count(sep) for sep in ",;\t|"}
        sep = max(counts, key=counts.get) if any(counts.values()) else ","
        out.append((r["file"], encoding, sep, head))
    return out


def header_names(head: str, sep: str) -> list[str]:
    """The names in a header line; a name that comes again gets its place added, so that every column has one of its own."""
    names = next(csv.reader([head.rstrip("\r\n")], delimiter=sep))
    seen: set[str] = set()
    out = []
    for k, name in enumerate(names):
        out.append(name if name.strip() and name.lower() not in seen else f"{name}_{k}")
        seen.add(out[-1].lower())
    return out


def resolve_columns(headers: list[str], overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Which header holds which field."""
    overrides = overrides or {}
    if unknown := [f for f in overrides if f not in V.FIELD_ALIASES]:
        raise ValueError(f"unknown field {unknown[0]!r}; known: {', '.join(V.FIELD_ALIASES)}")
    if absent := [(f, h) for f, h in overrides.items() if h not in headers]:
        raise ValueError(f"{absent[0][0]}={absent[0][1]}: no such column in the file")
    present = {norm_header(h): h for h in headers}
    bound = {}
    for field, aliases in V.FIELD_ALIASES.items():
        hits = [present[norm_header(a)] for a in aliases if norm_header(a) in present]
        if hits:
            bound[field] = hits[0]
    bound.update(overrides)
    if missing := [f for f in V.REQUIRED_FIELDS if f not in bound]:
        raise ValueError(f"could not find column(s) for {missing}; name them with overrides")
    return bound


def file_order() -> Column:
    """A key that follows the lines of the files: Spark rows have no order of their own."""
    return F.struct(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )


def read_rows(spark: SparkSession, path: str | list[str], overrides: dict[str, str] | None = None, multi_line: bool = False) -> DataFrame:
    """Register rows with canonical column names, all strings, and their file order ``ord``.

    Files of one encoding, separator and header are read together; a folder may hold several kinds.
    """
    configure(spark)
    kinds: dict[tuple, list[str]] = {}
    for file, encoding, sep, head in file_kinds(spark, path):
        kinds.setdefault((encoding, sep, head), []).append(file)
    parts = []
    for (encoding, sep, head), files in kinds.items():
        names = header_names(head, sep)
        bound = resolve_columns(names, overrides)
        schema = StructType([StructField(f"c{k}", StringType()) for k in range(len(names))])
        # columns by place: the names are this group's own, so nothing has to be inferred or compared
        reader = spark.read.schema(schema).options(header=True, enforceSchema=True, escape='"', multiLine=multi_line, sep=sep, encoding=encoding)
        parts.append(reader.csv(files).select(file_order().alias("ord"), *[F.col(f"c{names.index(h)}").alias(f) for f, h in bound.items()]))
    return functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def read_register(spark: SparkSession, path: str | list[str], overrides: dict[str, str] | None = None, only_tracked: bool = True, multi_line: bool = False) -> DataFrame:
    """One row per place with its ``specialties``."""
    rows = read_rows(spark, path, overrides, multi_line)
    return places_from_rows(rows, F.col("ord"), only_tracked)
