"""Radius joins on a grid of cells.

A radius join becomes an equality join on (group columns, cell level, cell row, cell column):
candidates are filed under the cell they lie in, queries under every cell their circle touches, and
the exact distance decides at the end. Cells come in levels, each a quarter of the size of the one
before. Two things keep crowded places cheap:

* a query that only wants its ``need`` best partners first looks up cell counts and shrinks its
  circle to the smallest cell around it that is known to hold enough of them;
* a cell with more candidates than one task should take is cut into slices, and only the queries
  that touch it are repeated per slice.

Both are exact: the circle never shrinks below what the counts prove to be enough, and a slice is
just a part of the same cell.

``nearest_lists`` is for many queries that each want a few partners. Queries of one cell share the
list of candidates that any of their circles reaches, and pick from it within their own row, so no
pair is ever a row of a shuffle: what moves are the queries and one short list per cell.

``circle_pairs`` is for all pairs. There too queries stay in the cell they lie in, and the candidates
in reach of a cell's queries are brought to it, so a query is not repeated for the cells it touches.
Pairs come out by blocks of neighbouring candidates, the queries of a cell one after the other within
a block: rows that name the same ids in the same order, which Parquet stores in little room.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..values import EARTH_KM
from ..functions.geo import distance_km, half_box
from ..session import cut_lineage

TOP_HEIGHT = 0.64  # degrees of latitude, about 71 km
N_LEVELS = 7  # down to about 17 m
STRETCH = 1.6  # cells this much wider than high are about square at 50 degrees
SLICE_ROWS = 50_000  # candidates of one cell a single task should meet
ASKED_ROWS = 20_000  # queries of one cell that should ask for all of them in a single task
BLOCK_ROWS = 64  # candidates side by side that the pairs of one query name in a row
KM_PER_DEGREE = EARTH_KM * math.pi / 180
FINE = TOP_HEIGHT / 4 ** (N_LEVELS - 1)
HEIGHTS = [TOP_HEIGHT / 4**i for i in range(N_LEVELS)]


def _fine_row(lat: Column) -> Column:
    return F.floor(lat / F.lit(FINE)).cast("bigint")


def _fine_col(lng: Column) -> Column:
    return F.floor(lng / F.lit(FINE * STRETCH)).cast("bigint")


def _coarser(fine: Column, level: Column) -> Column:
    """Row or column of the enclosing cell at ``level``."""
    return F.call_function("shiftright", fine, (F.lit(N_LEVELS - 1) - level) * F.lit(2))


def _height(level: Column) -> Column:
    return F.lit(TOP_HEIGHT) * F.pow(F.lit(0.25), level)


def _cell_span_km(level: Column, lat: Column) -> Column:
    """Upper bound of the distance between two points of one cell: its diagonal at its widest row.

    The hair on top covers the bend of the sphere over the largest cell.
    """
    h = _height(level)
    widest = F.cos(F.radians(F.greatest(F.abs(lat) - h, F.lit(0.0))))
    return F.lit(1.001 * KM_PER_DEGREE) * h * F.sqrt(F.lit(1.0) + F.pow(F.lit(STRETCH) * widest, 2))


def _level_for(half_height: Column) -> Column:
    """Finest level at which a circle touches only a handful of cells."""
    out = F.lit(0)
    for level, h in enumerate(HEIGHTS[1:], start=1):
        out = F.when(F.lit(h) >= half_height / 2, F.lit(level)).otherwise(out)
    return out


def _filed(candidates: DataFrame, levels) -> DataFrame:
    """Candidates under their cell, once per level."""
    return (
        candidates.withColumns({"_fy": _fine_row(F.col("c_lat")), "_fx": _fine_col(F.col("c_lng"))})
        .withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels])))
        .withColumns({"_cy": _coarser(F.col("_fy"), F.col("_level")), "_cx": _coarser(F.col("_fx"), F.col("_level"))})
        .drop("_fy", "_fx")
    )


def _enough(queries: DataFrame, counts: DataFrame, on: list[str], graded: bool) -> DataFrame:
    """Finest level at which a query's own cell holds all it needs. One row per distinct asker."""
    who = on + ["_fy", "_fx", "need"] + (["max_grade"] if graded else [])
    cell = on + ["_level", "_cy", "_cx"]
    askers = (
        queries.select(*who)
        .distinct()
        .withColumn("_level", F.explode(F.array(*[F.lit(v) for v in range(N_LEVELS)])))
        .withColumns({"_cy": _coarser(F.col("_fy"), F.col("_level")), "_cx": _coarser(F.col("_fx"), F.col("_level"))})
    )
    met = askers.join(counts, cell)
    if graded:
        met = met.filter(F.col("grade") <= F.col("max_grade")).groupBy(*who, "_level").agg(F.sum("n").alias("n"))
    return met.filter(F.col("n") >= F.col("need")).groupBy(*who).agg(F.max("_level").alias("_enough"))


def near_pairs(
    queries: DataFrame,
    candidates: DataFrame,
    on: list[str],
    margin_km: float = 0.0,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Pairs within each query's ``radius_km``, with the exact distance ``km``.

    ``queries`` has the ``on`` columns, ``q_lat``, ``q_lng`` and ``radius_km``; ``candidates`` the
    ``on`` columns, ``c_lat`` and ``c_lng``. Other columns pass through.

    With a ``need`` column in ``queries`` the result is complete only up to each query's ``need``
    nearest partners (plus ties within ``margin_km``), which is what a top-k wants. If candidates
    carry a ``grade``, only those up to the query's ``max_grade`` count towards ``need``; the
    others are still returned. Without ``need`` all pairs are wanted: see ``circle_pairs``.
    """
    if "need" not in queries.columns:
        return circle_pairs(queries, candidates, on, slice_rows=slice_rows)
    graded = "grade" in candidates.columns
    levels = list(range(N_LEVELS))
    cell = on + ["_level", "_cy", "_cx"]
    # Both sides are read several times below (counts, pruning, the join itself): compute them once.
    candidates = cut_lineage(candidates.filter(F.col("c_lat").isNotNull() & F.col("c_lng").isNotNull()))
    q = cut_lineage(queries.filter(F.col("q_lat").isNotNull() & F.col("q_lng").isNotNull()))
    filed = _filed(candidates, levels)
    counts = filed.groupBy(*cell, *(["grade"] if graded else [])).agg(F.count("*").alias("n"))

    q = q.withColumns({"_fy": _fine_row(F.col("q_lat")), "_fx": _fine_col(F.col("q_lng"))})
    who = on + ["_fy", "_fx", "need"] + (["max_grade"] if graded else [])
    q = q.join(_enough(q, counts, on, graded), who, "left")
    reach = F.col("radius_km").cast("double")
    span = _cell_span_km(F.col("_enough"), F.col("q_lat")) + F.lit(margin_km)
    reach = F.least(reach, F.coalesce(span, reach))
    q = q.withColumn("_reach", reach).drop("_fy", "_fx", "_enough")

    dlat, dlng = half_box(F.col("q_lat"), F.col("_reach") * F.lit(1.000001))
    q = q.withColumns({"_dlat": dlat, "_dlng": dlng})
    q = q.withColumn("_level", _level_for(F.col("_dlat")))
    span = lambda f, c, d: F.sequence(
        _coarser(f(F.col(c) - F.col(d)), F.col("_level")), _coarser(f(F.col(c) + F.col(d)), F.col("_level"))
    )
    q = q.withColumn("_cy", F.explode(span(_fine_row, "q_lat", "_dlat")))
    q = q.withColumn("_cx", F.explode(span(_fine_col, "q_lng", "_dlng"))).drop("_dlat", "_dlng")

    # Crowded cells only: a short table, one row per cell beyond the slice size.
    crowded = (
        counts.groupBy(*cell)
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") > slice_rows)
        .select(*cell, F.ceil(F.col("n") / slice_rows).cast("int").alias("_slices"))
    )
    one = F.coalesce("_slices", F.lit(1))
    q = q.join(crowded, cell, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), one - 1))).drop("_slices")
    c = (
        filed.join(crowded, cell, "left")
        .withColumn("_slice", F.pmod(F.xxhash64(*candidates.columns), one).cast("int"))
        .drop("_slices")
    )
    km = distance_km(F.col("q_lat"), F.col("q_lng"), F.col("c_lat"), F.col("c_lng"))
    return (
        q.join(c, cell + ["_slice"])
        .withColumn("km", km)
        .filter(F.col("km") <= F.col("_reach"))
        .drop("_level", "_cy", "_cx", "_slice", "_reach")
    )


def nearest(
    queries: DataFrame,
    candidates: DataFrame,
    k: int | Column,
    on: list[str],
    query_id: list[str],
    ranks: list[int],
    digits: int | None = 1,
    skip: Column | None = None,
    pile: int | None = None,
) -> DataFrame:
    """The ``k`` best partners of every query by (rank, rounded distance, id), with their ``rn``.

    ``candidates`` carry ``rank`` and ``c_id``. Each rank is searched on its own, so a query never
    meets more than about ``k`` partners per rank, then the few survivors are ordered together.
    ``skip`` marks pairs to leave out (a provider itself); ``need`` must already allow for them.
    Where many candidates share one exact point (a hospital, a postcode centre) only the ``pile``
    lowest ids of it can win, so the others are cut before the join; ``pile`` must be at least the
    largest ``need``.
    """
    margin = 0.0 if digits is None else 10.0**-digits
    candidates = candidates.filter(F.col("rank").isin(ranks))
    if pile is not None:
        spot = W.partitionBy(*on, "rank", "c_lat", "c_lng").orderBy("c_id")
        candidates = candidates.withColumn("_pile", F.row_number().over(spot)).filter(F.col("_pile") <= pile).drop("_pile")
    asked = queries.withColumn("rank", F.explode(F.array(*[F.lit(r) for r in ranks])))
    pairs = near_pairs(asked, candidates, on + ["rank"], margin_km=margin)
    if skip is not None:
        pairs = pairs.filter(~skip)
    if digits is not None:
        pairs = pairs.withColumn("km", F.round("km", digits))
    best = W.partitionBy(*query_id).orderBy("rank", "km", "c_id")
    return pairs.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k)


# ------------------------------------------------------------------------------- queries that share a cell
HALVINGS = 12  # cells of these searches halve from level to level, from TOP_HEIGHT down to FINE
LIST_LEVELS = range(HALVINGS + 1)


def _halved(fine: Column, level: Column) -> Column:
    return F.call_function("shiftright", fine, F.lit(HALVINGS) - level)


def _cells(level: Column, fy: Column, fx: Column) -> dict[str, Column]:
    return {"_cy": _halved(fy, level), "_cx": _halved(fx, level)}


def _bounds() -> dict[str, Column]:
    """The box around a query's circle of ``_reach``."""
    dlat, dlng = half_box(F.col("q_lat"), F.col("_reach") * F.lit(1.000001))
    return {"_y0": F.col("q_lat") - dlat, "_y1": F.col("q_lat") + dlat, "_x0": F.col("q_lng") - dlng, "_x1": F.col("q_lng") + dlng}


def _widest_bounds() -> list[Column]:
    return [F.min("_y0").alias("_y0"), F.max("_y1").alias("_y1"), F.min("_x0").alias("_x0"), F.max("_x1").alias("_x1")]


def _within_bounds() -> Column:
    return F.col("c_lat").between(F.col("_y0"), F.col("_y1")) & F.col("c_lng").between(F.col("_x0"), F.col("_x1"))


def _in_bounds(c: Column) -> Column:
    return c["c_lat"].between(F.col("_y0"), F.col("_y1")) & c["c_lng"].between(F.col("_x0"), F.col("_x1"))


def _fitting_level() -> Column:
    """Level whose cells are at least a quarter as high as the query's box."""
    half = F.greatest(F.col("_y1") - F.col("_y0"), (F.col("_x1") - F.col("_x0")) / F.lit(STRETCH)) / 2
    return F.least(F.greatest(F.floor(F.log2(F.lit(2 * TOP_HEIGHT) / half)), F.lit(0)), F.lit(HALVINGS)).cast("int")


def _over_cells(box: DataFrame, up: int = 0) -> DataFrame:
    """Boxes once per cell they touch, of cells ``up`` levels above their own."""
    span = lambda f, lo, hi: F.explode(F.sequence(*[_halved(f(F.col(c)), F.col("_level") - up) for c in (lo, hi)]))
    return box.withColumn("_cy", span(_fine_row, "_y0", "_y1")).withColumn("_cx", span(_fine_col, "_x0", "_x1"))


def _finest_enough(q: DataFrame, filed: DataFrame, on: list[str], grades: range) -> DataFrame:
    """``q`` with the finest level ``_enough`` at which its own cell holds the ``need`` candidates up to its ``max_grade``."""
    cell = on + ["max_grade", "_level", "_cy", "_cx"]
    least = q.agg(F.min("need")).scalar()
    per_grade = filed.groupBy(*on, "_level", "_cy", "_cx", "grade").agg(F.count("*").alias("n"))
    upward = per_grade.withColumn("max_grade", F.explode(F.filter(F.array(*[F.lit(g) for g in grades]), lambda g: g >= F.col("grade"))))
    counts = upward.groupBy(*cell).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    who = on + ["_fy", "_fx", "need", "max_grade"]
    askers = q.select(*who).distinct().withColumn("_level", F.explode(F.array(*[F.lit(v) for v in LIST_LEVELS])))
    met = askers.withColumns(_cells(F.col("_level"), F.col("_fy"), F.col("_fx"))).join(counts, cell).filter(F.col("n") >= F.col("need"))
    return q.join(met.groupBy(*who).agg(F.max("_level").alias("_enough")), who, "left")


def _corner_km(level: Column, lat: Column, lng: Column, fy: Column, fx: Column) -> Column:
    """Upper bound of the distance from a point to any other of its cell: to the farthest corner, at the cell's widest row."""
    h = F.lit(TOP_HEIGHT) * F.pow(F.lit(0.5), level)
    north, east = lat - _halved(fy, level) * h, lng - _halved(fx, level) * h * F.lit(STRETCH)
    dy, dx = F.greatest(north, h - north), F.greatest(east, h * F.lit(STRETCH) - east)
    widest = F.cos(F.radians(F.greatest(F.abs(lat) - dy, F.lit(0.0))))
    return F.lit(1.001 * KM_PER_DEGREE) * F.sqrt(dy * dy + F.pow(dx * widest, 2))


def nearest_lists(
    queries: DataFrame, candidates: DataFrame, k: int, on: list[str], keep: Callable[[Column], Column], digits: int | None = None,
) -> DataFrame:
    """``queries`` with ``near``: array<struct<km, c_id>> of the ``k`` nearest candidates within ``radius_km``, ties by ``c_id``.

    ``keep(candidate)`` tells, from a query's columns and a candidate's, which pairs count. Any ``need`` candidates with a
    ``grade`` up to the query's ``max_grade`` must hold ``k`` that count, and none above ``max_grade + 1`` may count;
    without grades all are alike. Queries with no candidate around them are left out. To unfold ``near`` use an outer explode:
    the inner one is planned with a filter that works the list out again.
    """
    if "grade" not in candidates.columns:
        candidates, queries = candidates.withColumn("grade", F.lit(0)), queries.withColumn("max_grade", F.lit(0))
    candidates = cut_lineage(candidates.filter(F.col("c_lat").isNotNull() & F.col("c_lng").isNotNull()))
    q = queries.filter(F.col("q_lat").isNotNull() & F.col("q_lng").isNotNull())
    q = cut_lineage(q.withColumns({"_fy": _fine_row(F.col("q_lat")), "_fx": _fine_col(F.col("q_lng"))}))
    top = max(candidates.agg(F.max("grade")).first()[0] or 0, q.agg(F.max("max_grade")).first()[0] or 0)
    filed = candidates.withColumns({"_level": F.explode(F.array(*[F.lit(v) for v in LIST_LEVELS]))})
    filed = filed.withColumns(_cells(F.col("_level"), _fine_row(F.col("c_lat")), _fine_col(F.col("c_lng"))))

    # The circle that is sure to hold enough, and the cell that its query shares with others.
    q = _finest_enough(q, filed, on, range(top + 1))
    corner = _corner_km(F.col("_enough"), F.col("q_lat"), F.col("q_lng"), F.col("_fy"), F.col("_fx"))
    reach = F.col("radius_km").cast("double")
    q = q.withColumn("_reach", F.least(reach, F.coalesce(corner + F.lit(0.0 if digits is None else 10.0**-digits), reach)))
    q, fit = q.withColumns(_bounds()), _fitting_level()
    shrunk = F.col("_reach") < F.col("radius_km")
    q = q.withColumn("_level", F.when(shrunk, F.least(fit, "_enough")).otherwise(fit))
    q = q.withColumns(_cells(F.col("_level"), F.col("_fy"), F.col("_fx"))).drop("_enough", "_fy", "_fx")
    q = cut_lineage(q)  # read twice: for the cells' boxes and to pick from their lists

    # One list per asking cell: the candidates in the box around its circles.
    asking = on + ["max_grade", "_level", "_ay", "_ax"]
    q = q.withColumnsRenamed({"_cy": "_ay", "_cx": "_ax"})
    box = _over_cells(q.groupBy(*asking).agg(*_widest_bounds(), F.max("need").alias("need")))
    met = (
        box.join(filed, on + ["_level", "_cy", "_cx"])
        .filter(_within_bounds())
        .filter(F.col("grade") <= F.col("max_grade") + 1)
    )
    fields = [c for c in candidates.columns if c not in [*on, "grade"]]
    sure = F.when(F.col("grade") <= F.col("max_grade"), 1).otherwise(0)
    # on one exact point the lowest ids go first, so whoever comes after enough of them cannot be chosen
    before = W.partitionBy(*asking, "c_lat", "c_lng").orderBy("c_id").rowsBetween(W.unboundedPreceding, -1)
    lists = (
        met.select(*asking, "need", sure.alias("sure"), *fields).repartition(*asking)
        .withColumn("_before", F.coalesce(F.sum("sure").over(before), F.lit(0)))
        .filter(F.col("_before") < F.col("need"))
        .groupBy(*asking).agg(F.collect_list(F.struct(*fields)).alias("_list"))
    )
    km = lambda c: distance_km(F.col("q_lat"), F.col("q_lng"), c["c_lat"], c["c_lng"])
    near = F.filter("_list", lambda c: _in_bounds(c) & keep(c))
    near = F.filter(F.transform(near, lambda c: F.struct(km(c).alias("km"), c["c_id"].alias("c_id"))), lambda p: p["km"] <= F.col("_reach"))
    if digits is not None:
        near = F.transform(near, lambda p: F.struct(F.round(p["km"], digits).alias("km"), p["c_id"].alias("c_id")))
    return q.join(lists, asking).select(*queries.columns, F.slice(F.sort_array(near), 1, k).alias("near"))


def _placed(rows: DataFrame, *places: str) -> DataFrame:
    """Rows with a position, in columns that cannot be null."""
    rows = rows.filter(" and ".join(f"{c} is not null and not isnan({c})" for c in places))
    return rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in places})


def circle_pairs(
    queries: DataFrame, candidates: DataFrame, on: list[str], finest: int = HALVINGS, slice_rows: int = SLICE_ROWS, asked_rows: int = ASKED_ROWS,
) -> DataFrame:
    """All pairs within each query's ``radius_km``, with ``km``; columns as in ``near_pairs``.

    A query moves once, to the cell it lies in. Candidates go to every cell with a query that may reach them. ``finest`` is
    the last level of cells in use: more queries share the candidates of a cell, but meet more that they do not reach.
    """
    cell = on + ["_level", "_cy", "_cx"]
    home = on + ["_level", "_ay", "_ax"]
    reach = F.coalesce(F.col("radius_km").cast("double"), F.lit(-1.0))
    candidates = cut_lineage(_placed(candidates, "c_lat", "c_lng"))  # read twice: to count and to join
    q = _placed(queries, "q_lat", "q_lng").withColumn("_reach", reach).withColumns(_bounds())
    q = q.withColumn("_level", F.least(_fitting_level(), F.lit(finest)))
    # never null: the join's checks for null would work out level and cell once more for each key
    at = _cells(F.col("_level"), _fine_row(F.col("q_lat")), _fine_col(F.col("q_lng")))
    q = q.withColumns({name: F.coalesce(v, F.lit(0)) for name, v in at.items()})

    # A box holds few cells two levels up, and such a cell is touched by few boxes: the side that the join keeps in memory.
    box = q.withColumnsRenamed({"_cy": "_ay", "_cx": "_ax"}).groupBy(*home).agg(*_widest_bounds(), F.count("*").alias("_asked"))
    box = cut_lineage(box)
    used = [r["_level"] for r in box.select("_level").distinct().collect()]
    filed = candidates.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in used]).cast("array<int>")))
    filed = filed.withColumns(_cells(F.col("_level") - 2, _fine_row(F.col("c_lat")), _fine_col(F.col("c_lng"))))
    met = filed.join(_over_cells(box, up=2), cell).filter(_within_bounds())

    # Crowded cells only: less than one row for ``asked_rows`` queries or ``slice_rows`` candidates met.
    slices = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    crowded = (
        met.groupBy(*home).agg(F.max("_asked").alias("_asked"), F.count("*").alias("_met"))
        .select(*home, slices("_asked", asked_rows).alias("_q"), slices("_met", slice_rows).alias("_c"))
        .filter((F.col("_q") > 1) | (F.col("_c") > 1))
    )
    crowded = F.broadcast(cut_lineage(crowded).withColumnsRenamed({"_ay": "_cy", "_ax": "_cx"}))
    q_slices, c_slices = F.coalesce("_q", F.lit(1)), F.coalesce("_c", F.lit(1))
    own = lambda df, n: F.coalesce(F.when(n > 1, F.pmod(F.xxhash64(*df.columns), n)), F.lit(0)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    q = q.select(*cell, *[c for c in queries.columns if c not in on]).join(crowded, cell, "left")
    q = q.withColumn("_cs", each(c_slices)).withColumn("_slice", own(queries, q_slices) * c_slices + F.col("_cs")).drop("_q", "_c", "_cs")
    c = met.select(*on, "_level", F.col("_ay").alias("_cy"), F.col("_ax").alias("_cx"), *[c for c in candidates.columns if c not in on])
    c = c.join(crowded, cell, "left")
    c = c.withColumn("_qs", each(q_slices)).withColumn("_slice", F.col("_qs") * c_slices + own(candidates, c_slices)).drop("_q", "_c", "_qs")
    # Few bytes stand for many pairs, so partitions are not put together by their size.
    n = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q, c = (df.repartition(n, *cell, "_slice") for df in (q, c))
    q = q.withColumn("_reach", reach).withColumns(_bounds())
    blocks = _blocks(c, cell + ["_slice"], [f for f in candidates.columns if f not in on])
    # Blocks pass by one after the other and each meets all queries of its cell, so like rows of the result stand together.
    # With ``exists`` the join hands on its rows singly; compiled into one step with the unfolding, all pairs of a block would be held.
    met = q.hint("shuffle_hash").join(blocks, cell + ["_slice"]).filter(_box_touches() & F.exists("_block", _in_bounds))
    met = met.withColumn("_whole", _box_reached()).select(*queries.columns, "_reach", "_y0", "_y1", "_x0", "_x1", "_whole", F.inline("_block"))
    km = distance_km(F.col("q_lat"), F.col("q_lng"), F.col("c_lat"), F.col("c_lng"))
    return (
        met.withColumn("km", km)
        .filter(F.col("_whole") | (_within_bounds() & (F.col("km") <= F.col("_reach"))))
        .drop("_reach", "_y0", "_y1", "_x0", "_x1", "_whole")
    )


def _blocks(candidates: DataFrame, home: list[str], fields: list[str]) -> DataFrame:
    """Lists ``_block`` of up to ``BLOCK_ROWS`` neighbours of one ``home``, with the box around them."""
    # binary digits read in base 4 leave room for the other's: rows follow a curve through ever smaller cells
    apart = lambda v: F.conv(F.bin(F.pmod(v, F.lit(1 << 22))), 4, 10).cast("bigint")
    curve = apart(_fine_row(F.col("c_lat"))) * 2 + apart(_fine_col(F.col("c_lng")))
    at = F.row_number().over(W.partitionBy(*home).orderBy("_curve"))
    numbered = candidates.withColumn("_curve", curve).withColumn("_at", F.floor((at - 1) / BLOCK_ROWS))
    box = [F.min("c_lat").alias("_south"), F.max("c_lat").alias("_north"), F.min("c_lng").alias("_west"), F.max("c_lng").alias("_east")]
    return numbered.groupBy(*home, "_at").agg(F.collect_list(F.struct(*fields)).alias("_block"), *box).drop("_at")


def _box_touches() -> Column:
    """May a query reach any of a block?"""
    south, north, west, east = (F.col(c) for c in ("_south", "_north", "_west", "_east"))
    return (south <= F.col("_y1")) & (north >= F.col("_y0")) & (west <= F.col("_x1")) & (east >= F.col("_x0"))


def _box_reached() -> Column:
    """Does a query reach all of a block? Within a quarter of the globe nothing in a box is farther than its farthest corner."""
    inside = (F.col("_south") >= F.col("_y0")) & (F.col("_north") <= F.col("_y1")) & (F.col("_west") >= F.col("_x0")) & (F.col("_east") <= F.col("_x1"))
    corner = lambda lat, lng: distance_km(F.col("q_lat"), F.col("q_lng"), F.col(lat), F.col(lng))
    farthest = F.greatest(*[corner(lat, lng) for lat in ("_south", "_north") for lng in ("_west", "_east")])
    return inside & (farthest < F.least(F.col("_reach"), F.lit(90 * KM_PER_DEGREE)) - F.lit(1e-6))
