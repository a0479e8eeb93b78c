"""Geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import BOX_REGISTER, EARTH_KM
from .text import let, parse_number, strip


def distance_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance on a sphere, haversine form."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lng2 - lng1) / 2), 2
    )
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def half_box(lat: Column, km: Column) -> tuple[Column, Column]:
    """Half height and half width, in degrees, of the box around a circle of ``km``."""
    angle = km / F.lit(EARTH_KM)
    dlat = F.degrees(angle)
    # atan2 keeps NaN out when the circle reaches a pole
    reach = F.sin(angle) / F.cos(F.radians(lat))
    dlng = F.when(reach < 1, F.degrees(F.asin(F.least(reach, F.lit(1.0))))).otherwise(F.lit(180.0))
    return dlat, dlng


def in_circle_box(lat: Column, lng: Column, at_lat: float, at_lng: float, km: float) -> Column:
    """Constant bounds around one point: plain comparisons that reach the Parquet scan."""
    import math

    angle = km / EARTH_KM
    dlat = math.degrees(angle)
    reach = math.sin(angle) / math.cos(math.radians(at_lat))
    dlng = math.degrees(math.asin(reach)) if reach < 1 else 180.0
    # a hair wider, so rounding never drops a point on the rim
    dlat, dlng = dlat * 1.000001, dlng * 1.000001
    return lat.between(at_lat - dlat, at_lat + dlat) & lng.between(at_lng - dlng, at_lng + dlng)


def in_box(lat: Column, lng: Column, box: tuple) -> Column:
    """Is the point inside a named box? NaN never is."""
    south, north, west, east, closed = box
    if closed:
        inside = lat.between(south, north) & lng.between(west, east)
    else:
        inside = (lat > south) & (lat < north) & (lng > west) & (lng < east)
    return F.coalesce(inside & ~F.isnan(lat) & ~F.isnan(lng), F.lit(False))


def parse_coords(lat: Column, lng: Column, gps: Column, box: tuple = BOX_REGISTER) -> Column:
    """struct<lat,lng>: own columns, else the combined field; swapped pairs are turned round."""
    none = F.lit(None).cast("double")
    pair = lambda x, y: F.struct(x.alias("lat"), y.alias("lng"))
    own = pair(parse_number(lat), parse_number(lng))

    def from_gps(p: Column) -> Column:
        parts = F.split(strip(gps), r"[\s;]+|,\s+")
        both = let(parts, lambda g: F.when(F.size(g) == 2, pair(parse_number(F.get(g, 0)), parse_number(F.get(g, 1)))))
        return F.when((p["lat"].isNull() | p["lng"].isNull()) & gps.isNotNull(), F.coalesce(both, p)).otherwise(p)

    def placed(p: Column) -> Column:
        a, b = p["lat"], p["lng"]
        return F.when(in_box(a, b, box), p).when(in_box(b, a, box), pair(b, a)).otherwise(pair(none, none))

    return let(let(own, from_gps), placed)


def to_map(lat: Column, lng: Column, proj: dict, frame: dict) -> Column:
    """struct<x,y>: equirectangular position inside a map frame."""
    x = (lng - F.lit(proj["lon0"])) * F.lit(proj["k"]) * F.lit(proj["scale"])
    y = (F.lit(proj["lat1"]) - lat) * F.lit(proj["scale"])
    place = lambda v, edge: (v - F.lit(frame[edge])) * F.lit(frame["z"]) + F.lit(frame["pad"])
    return F.struct(place(x, "x0").alias("x"), place(y, "y0").alias("y"))


def crosses_left(edge_from: Column, edge_to: Column, x: Column, y: Column) -> Column:
    """Does a ray from (x, y) to the right cross this edge? (even-odd test)"""
    x1, y1, x2, y2 = edge_from["x"], edge_from["y"], edge_to["x"], edge_to["y"]
    return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)


def on_edge(edge_from: Column, edge_to: Column, x: Column, y: Column, hair: float) -> Column:
    """Is (x, y) within a hair of this edge?"""
    x1, y1, x2, y2 = edge_from["x"], edge_from["y"], edge_to["x"], edge_to["y"]
    between = lambda v, a, b: (v >= F.least(a, b) - hair) & (v <= F.greatest(a, b) + hair)
    across = F.abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1))
    return between(x, x1, x2) & between(y, y1, y2) & (across <= hair * F.hypot(x2 - x1, y2 - y1))
