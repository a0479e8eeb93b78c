"""Shards of near equal bytes: a k-d tree over the documents' metadata.

1. *Points*: rows with equal texts form one point of the tree, weighed by its bytes; its coordinates (source, language, size, place in
   the id range) are the smallest of its rows, each scaled to 31 bits and followed by 32 bits of the text's hash, so that no two points tie.
2. *Splits*: level by level, each node is cut across its widest dimension at the distributed weighted median: the weights of a node's
   points are summed by 1,024 bins of the dimension, then by 1,024 bins of the keys in the bin that holds the median, until one bin
   hardly weighs anything. A node that stands for k leaves is cut at (k // 2) / k of its bytes, until every leaf has the target bytes.
3. *Heavy points*: a point above 1/64 of a leaf (or 1/1024 of all rows) could tip a split. They are few by definition; each goes whole to
   the side of its coordinate, or to the other if there is no room, and the light points are cut at what is left of the share. Only a
   group of copies that fits on neither side is cut, by row numbers.
4. *Slots*: rows are dealt by range of (shard, doc_id) and numbered from the counts of the parts before them; no shard meets in one task.

Every pass over the points is one aggregation to at most nodes x 1,024 rows; the tree and the heavy points are all the driver sees.

Defined cases: a null text counts as empty (size 1, crc32 0) and is one point with empty texts; a null doc_id sorts first; repeated rows are
rows of one group; an empty table gives an empty result; other columns are not read. Fewer points than leaves leave shards empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, setup

DIMENSIONS = ("source", "lang", "size", "doc_id")
SCALE_BITS, TIE_BITS = 31, 32
BIN_BITS = 10
HEAVY_SHARE, HEAVY_ROWS = 64, 1024
MOST_LEAVES = 4096
PRECISION = 4096  # a bin of less than this part of a node is fine enough to cut beside it


@dataclass
class Node:
    """A box of the tree: the leaves it stands for and the heavy points in it, as (point, from row, to row)."""

    number: int
    first: int
    leaves: int
    heavy: list = field(default_factory=list)
    light: int = 0  # bytes of its light points
    dimension: int = 0
    cut: int = 0  # light points with a key up to this one go left
    sides: tuple[list, list] = ((), ())  # its heavy points, left and right

    def weight(self) -> int:
        return self.light + sum(bytes_of(h) for h in self.heavy)


def bytes_of(heavy) -> int:
    point, low, high = heavy
    return point["size"] * (high - low)


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, at, h, crc, size, k0 ...) of every row, without its text; kept in the shared folder."""
    names = set(docs.columns)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    label = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name in names else F.lit("")
    scaled = lambda name: F.when(label(name) == "", F.lit(0)).otherwise(F.xxhash64(label(name)).bitwiseAND((1 << SCALE_BITS) - 1))
    return cut_lineage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.crc32(text.cast("binary")).alias("crc"),
            (F.octet_length(text).cast("long") + 1).alias("size"), scaled("source").alias("s0"), scaled("lang").alias("s1"),
        ).withColumn("at", F.monotonically_increasing_id())
    )


def points_of(rows: DataFrame) -> DataFrame:
    """(h, crc, size, n, k0 ... k3, node): one point per distinct text, with a 63-bit key for each dimension; all in node 1."""
    span = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, width = span.low or 0, max((span.high or 0) - (span.low or 0), 1)
    grouped = rows.groupBy("h", "crc", "size").agg(F.count("*").alias("n"), F.min("doc_id").alias("d"), F.min("s0").alias("s0"), F.min("s1").alias("s1"))
    top = float(1 << SCALE_BITS)
    place = lambda x: F.least(F.floor(x * top), F.lit((1 << SCALE_BITS) - 1))
    coordinates = [
        F.col("s0"), F.col("s1"), place(F.log2(F.col("size").cast("double")) / 32),
        place((F.coalesce("d", F.lit(low)).cast("double") - float(low)) / float(width)),
    ]
    tie = F.xxhash64("h", "crc").bitwiseAND((1 << TIE_BITS) - 1)
    keys = [(F.shiftleft(c.cast("long"), TIE_BITS) + tie).alias(f"k{k}") for k, c in enumerate(coordinates)]
    return cut_lineage(grouped.select("h", "crc", "size", "n", *keys, F.lit(1).cast("long").alias("node")))


def small(spark, rows, schema: str) -> DataFrame:
    """A table of the tree's own size for a broadcast join: at most one row per node, bin or heavy point."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    names = [f.split() for f in schema.split(", ")]
    columns = [pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(names)]
    return F.broadcast(spark.createDataFrame(pa.Table.from_arrays(columns, names=[name for name, _ in names])))


def below(points: DataFrame, levels: list[list[Node]]) -> DataFrame:
    """The points with the number of the node they have come to after the splits made so far."""
    found = points
    for level in levels:
        cuts = small(points.sparkSession, [(n.number, n.dimension, n.cut) for n in level if n.leaves > 1], "node long, dim int, cut long")
        key = F.element_at(F.array(*[f"k{k}" for k in range(len(DIMENSIONS))]), F.col("dim") + 1)
        side = F.when(key > F.col("cut"), 1).otherwise(0)
        found = found.join(cuts, "node", "left").withColumn("node", F.when(F.col("dim").isNull(), F.col("node")).otherwise(F.col("node") * 2 + side)).drop("dim", "cut")
    return found


def choose_dimensions(here: DataFrame, nodes: list[Node]) -> dict[int, tuple[int, int]]:
    """Sets each node's weight and widest dimension; returns the range of its light points' keys there."""
    ends = [f(f"k{k}").alias(f"{name}{k}") for k in range(len(DIMENSIONS)) for name, f in (("low", F.min), ("high", F.max))]
    found = {r.node: r for r in here.groupBy("node").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), *ends).collect()}
    ranges = {}
    for node in nodes:
        r = found.get(node.number)
        node.light = r["bytes"] if r else 0
        lows = [[r[f"low{k}"]] if r else [] for k in range(len(DIMENSIONS))]
        highs = [[r[f"high{k}"]] if r else [] for k in range(len(DIMENSIONS))]
        for point, _, _ in node.heavy:
            for k in range(len(DIMENSIONS)):
                lows[k].append(point[f"k{k}"]), highs[k].append(point[f"k{k}"])
        widths = [(max(h) >> TIE_BITS) - (min(low) >> TIE_BITS) if low else 0 for low, h in zip(lows, highs, strict=True)]
        node.dimension = widths.index(max(widths))
        if r:
            ranges[node.number] = (r[f"low{node.dimension}"], r[f"high{node.dimension}"])
    return ranges


def seek(here: DataFrame, nodes: list[Node], ranges: dict[int, tuple[int, int]], wanted) -> None:
    """Sets each node's cut to the key below which its light points weigh what ``wanted(node, keys, sums)`` asks for.

    ``wanted`` is called once per node with the first histogram (upper ends of the bins, bytes up to them).
    """
    spark = here.sparkSession
    open_ = {n.number: (n, *ranges[n.number], 0) for n in nodes if n.number in ranges}
    for n in nodes:
        if n.number not in ranges:
            wanted(n, [], [])
            n.cut = -1
    aims: dict[int, int] = {}
    while open_:
        shifts = {i: max((high - low).bit_length() - BIN_BITS, 0) for i, (_, low, high, _) in open_.items()}
        asked = small(spark, [(i, n.dimension, low, high, shifts[i]) for i, (n, low, high, _) in open_.items()], "node long, dim int, low long, high long, shift int")
        key = F.element_at(F.array(*[f"k{k}" for k in range(len(DIMENSIONS))]), F.col("dim") + 1)
        binned = here.join(asked, "node").withColumn("key", key).filter("key between low and high")
        sums = binned.groupBy("node", F.expr("shiftright(key - low, shift)").alias("bin"))
        sums = sums.agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        bins: dict[int, list] = {i: [] for i in open_}
        for r in sorted(sums, key=lambda r: (r.node, r.bin)):
            bins[r.node].append(r)
        going = {}
        for i, (n, low, high, before) in open_.items():
            upper = [r.high for r in bins[i]]
            up_to = list(accumulate((r.bytes for r in bins[i]), initial=before))[1:]
            if i not in aims:
                aims[i] = min(max(wanted(n, upper, up_to), 0), n.light)
            aim = aims[i]
            j = next(j for j, t in enumerate(up_to) if t >= aim)
            start = up_to[j - 1] if j else before
            if bins[i][j].low == upper[j] or (up_to[j] - start) * PRECISION <= n.light or up_to[j] == aim:
                n.cut = upper[j] if up_to[j] - aim <= aim - start else (upper[j - 1] if j else low - 1)
            else:
                going[i] = (n, bins[i][j].low, upper[j], start)
        open_ = going


def place_heavy(node: Node, keys: list[int], sums: list[int]) -> int:
    """Deals a node's heavy points to its two sides; returns the bytes of light points that belong to the left one."""
    total = node.weight()
    aim = total * (node.leaves // 2) // node.leaves
    room = [aim, total - aim]
    marks = sorted([(k, w - (sums[j - 1] if j else 0)) for j, (k, w) in enumerate(zip(keys, sums, strict=True))] + [(h[0][f"k{node.dimension}"], bytes_of(h)) for h in node.heavy])
    middle, seen = -1, 0
    for k, w in marks:
        if seen + w / 2 > aim:
            break
        middle, seen = k, seen + w
    sides: list[list] = [[], []]
    for heavy in sorted(node.heavy, key=lambda h: (-bytes_of(h), h[0][f"k{node.dimension}"], h[1])):
        point, low, high = heavy
        side = 0 if point[f"k{node.dimension}"] <= middle else 1
        if bytes_of(heavy) > room[side]:
            side = 1 - side
        if bytes_of(heavy) > room[side] and high - low > 1:  # fits nowhere: copies are cut by row numbers, or go where there is more room
            left = min(max(round(room[0] / point["size"]), 0), high - low)
            for s, a, b in ((0, low, low + left), (1, low + left, high)):
                if b > a:
                    sides[s].append((point, a, b))
                    room[s] -= point["size"] * (b - a)
            continue
        if bytes_of(heavy) > room[side]:
            side = 0 if room[0] >= room[1] else 1
        sides[side].append(heavy)
        room[side] -= bytes_of(heavy)
    node.sides = (sides[0], sides[1])
    return room[0]


def grow(points: DataFrame, heavy: list[dict], leaves: int) -> tuple[list[list[Node]], list[Node]]:
    """The levels of the tree over the light points ``points`` and the ``heavy`` ones, and its leaves in order."""
    level = [Node(1, 0, leaves, [(p, 0, p["n"]) for p in heavy])]
    levels, done = [], []
    while level:
        here = below(points, levels)
        ranges = choose_dimensions(here, level)
        done += [n for n in level if n.leaves == 1]
        inner = [n for n in level if n.leaves > 1]
        if not inner:
            break
        seek(here, inner, {n.number: ranges[n.number] for n in inner if n.number in ranges}, place_heavy)
        levels.append(inner)
        half = lambda n: n.leaves // 2
        level = [
            child for n in inner for child in (Node(2 * n.number, n.first, half(n), n.sides[0]), Node(2 * n.number + 1, n.first + half(n), n.leaves - half(n), n.sides[1]))
        ]
    return levels, sorted(done, key=lambda n: n.first)


def sharded(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; ``target_bytes`` sets the number of shards when it is given."""
    spark = setup(docs.sparkSession)
    rows = rows_of(docs)
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    leaves = -(-(total.bytes or 0) // target_bytes) if target_bytes else shards
    leaves = max(int(leaves), 1)
    if leaves > MOST_LEAVES:
        raise ValueError(f"{leaves} shards; a tree has {MOST_LEAVES} at most: ask for more bytes in a shard")
    points = points_of(rows)
    least_bytes, least_rows = (total.bytes or 0) / leaves / HEAVY_SHARE, (total.n or 0) / HEAVY_ROWS
    is_heavy = (F.col("size") * F.col("n") > least_bytes) | (F.col("n") > least_rows)
    heavy = [r.asDict() for r in points.filter(is_heavy).collect()]  # at most 64 for each leaf and 1,024
    light = points.filter(~is_heavy)
    levels, ends = grow(light, heavy, leaves)
    numbers = small(spark, [(n.number, n.first) for n in ends], "node long, shard int")
    placed = below(light, levels).join(numbers, "node").select("h", "crc", "size", "shard")
    parts = [(p["h"], p["crc"], p["size"], n.first, a, b, b - a == p["n"]) for n in ends for p, a, b in n.heavy]
    group = ["h", "crc", "size"]
    heavy_parts = small(spark, parts, "h long, crc long, size long, shard int, low long, high long, whole boolean")
    known = heavy_parts.select(*group, F.when(F.col("whole"), F.col("shard")).alias("of"), F.lit(True).alias("heavy")).distinct()
    marked = rows.join(F.broadcast(known), group, "left")
    same = ["doc_id", "at", *group, "shard"]
    out = marked.filter("heavy is null").join(placed, group).select(*same)
    out = out.unionByName(marked.filter("of is not null").withColumn("shard", F.col("of")).select(*same))
    if any(not p[-1] for p in parts):
        torn = numbered_in_groups(marked.filter("heavy and of is null").select("doc_id", "at", *group), group)
        out = out.unionByName(torn.join(heavy_parts, group).filter("pos >= low and pos < high").select(*same))
    return slots(out).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def numbered_in_groups(rows: DataFrame, group: list[str]) -> DataFrame:
    """``pos`` from 0 within each group, in the order of (doc_id, at)."""
    return counted(rows, group, ["doc_id", "at"], "pos")


def slots(rows: DataFrame) -> DataFrame:
    """``slot`` from 0 within each shard, in the order of (doc_id, at)."""
    return counted(rows, ["shard"], ["doc_id", "at"], "slot")


def counted(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 within their group without gathering a group: dealt by range, numbered from the counts of the parts before."""
    dealt = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    dealt = cut_lineage(dealt.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part", *group).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    so_far = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, W.currentRow)  # a group's parts, not its rows
    gone = F.sum("__n").over(so_far) - F.col("__n")
    before = sizes.select("__part", *group, (gone - F.col("__first")).alias("__shift"))
    return dealt.join(before, ["__part", *group]).withColumn(name, F.col("__id") + F.col("__shift")).drop("__id", "__part", "__shift")

