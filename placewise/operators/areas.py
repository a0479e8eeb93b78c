"""Polygons: which region holds a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import crosses_left, on_edge

CELL = 0.16
HAIR = 1e-9  # degrees, about a tenth of a millimetre: so close to an outline a point is on it


def polygon_cells(polygons: DataFrame) -> DataFrame:
    """Polygons under every grid cell their bounds touch, with the bounds.

    ``polygons``: (area, rings) where rings is array<array<struct<x,y>>>; holes are further rings.
    """
    points = F.flatten("rings")
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    span = lambda lo, hi: F.sequence(F.floor((lo - HAIR) / F.lit(CELL)), F.floor((hi + HAIR) / F.lit(CELL)))
    boxed = polygons.withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)})
    rows = boxed.withColumn("_cx", F.explode(span(F.col("x0"), F.col("x1"))))
    return rows.withColumn("_cy", F.explode(span(F.col("y0"), F.col("y1"))))


def inside(points: DataFrame, polygons: DataFrame, x: str = "lng", y: str = "lat", outline: Column | None = None) -> DataFrame:
    """(point row, area) where the area contains the point: cell equality, bounds, then even-odd test.

    Rounding decides whether the test counts a point on an outline; where the area has a rule of its own, ``outline``
    (from columns of both sides) decides for these points.
    """
    px, py = F.col(x), F.col(y)
    located = points.filter(px.isNotNull() & py.isNotNull()).withColumns(
        {"_cx": F.floor(px / F.lit(CELL)), "_cy": F.floor(py / F.lit(CELL))}
    )
    near = located.join(polygon_cells(polygons), ["_cx", "_cy"]).filter(px.between(F.col("x0") - HAIR, F.col("x1") + HAIR) & py.between(F.col("y0") - HAIR, F.col("y1") + HAIR))
    # every ring is walked edge by edge; a hole flips the parity back
    crossings = F.aggregate(
        "rings", F.lit(0),
        lambda n, ring: n + F.size(F.filter(
            F.sequence(F.lit(0), F.size(ring) - 2),
            lambda i: F.coalesce(crosses_left(F.get(ring, i), F.get(ring, i + 1), px, py), F.lit(False)),
        )),
    )
    held = crossings % 2 == 1
    if outline is not None:
        on_outline = F.exists("rings", lambda ring: F.exists(
            F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.coalesce(on_edge(F.get(ring, i), F.get(ring, i + 1), px, py, HAIR), F.lit(False))
        ))
        held = F.when(on_outline, outline).otherwise(held)
    return near.filter(held).drop("_cx", "_cy", "x0", "x1", "y0", "y1", "rings")
