"""Lines and rings against boxes, as Column functions: exact tests of meeting, and cuts.

Points are structs of lon and lat; a box is a struct of west, south, east and north, its border included. Everything is
planar in degrees. A point with a null coordinate meets nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrafold.functions.geo import closed, in_rings

POINTS = "array<struct<lon:double,lat:double>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def steps(points: Column, body: Callable[[Column, Column], Column]) -> Column:
    """Array of ``body(p, q)`` over neighbouring points."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(F.slice(points, F.lit(1), n), F.slice(points, F.lit(2), n), body)


def in_box(p: Column, box: Column) -> Column:
    return F.coalesce(p["lon"].between(box["west"], box["east"]) & p["lat"].between(box["south"], box["north"]), F.lit(False))


def segment_meets_box(p: Column, q: Column, box: Column) -> Column:
    """Whether a segment has a point in the box: their bounds meet, and the box's corners aren't all on one side of it."""
    bounds = (
        (F.least(p["lon"], q["lon"]) <= box["east"]) & (F.greatest(p["lon"], q["lon"]) >= box["west"])
        & (F.least(p["lat"], q["lat"]) <= box["north"]) & (F.greatest(p["lat"], q["lat"]) >= box["south"])
    )
    side = lambda x, y: (q["lon"] - p["lon"]) * (box[y] - p["lat"]) - (q["lat"] - p["lat"]) * (box[x] - p["lon"])
    sides = [side(x, y) for x in ("west", "east") for y in ("south", "north")]
    return F.coalesce(bounds & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0), F.lit(False))


def line_meets_box(points: Column, box: Column) -> Column:
    """Whether any part of a line (or its only point) is in the box."""
    return F.exists(points, lambda p: in_box(p, box)) | F.exists(steps(points, lambda p, q: segment_meets_box(p, q, box)), lambda met: met)


def polygon_meets_box(rings: Column, box: Column) -> Column:
    """Whether a polygon and a box share a point: a border meets the box, or the whole box is inside. Rings may be open."""
    border = F.exists(rings, lambda r: line_meets_box(closed(r), box))
    return border | F.coalesce(in_rings(box["south"], box["west"], rings), F.lit(False))


def _cut(ring: Column, axis: str, bound: Column, sign: int) -> Column:
    """The part of an open ring on one side of a line parallel to an axis (``sign`` 1: at least ``bound``)."""
    other = "lat" if axis == "lon" else "lon"
    inside = lambda p: (p[axis] >= bound) if sign > 0 else (p[axis] <= bound)

    def crossing(p: Column, q: Column) -> Column:
        on = p[other] + F.try_divide(bound - p[axis], q[axis] - p[axis]) * (q[other] - p[other])
        return point(bound, on) if axis == "lon" else point(on, bound)

    def step(p: Column, q: Column) -> Column:
        own = point(q["lon"], q["lat"])
        return (
            F.when(inside(p) & inside(q), F.array(own)).when(inside(q), F.array(crossing(p, q), own)).when(inside(p), F.array(crossing(p, q)))
            .otherwise(F.array().cast(POINTS)).cast(POINTS)
        )

    n = F.size(ring)
    before = F.concat(F.slice(ring, F.greatest(n, F.lit(1)), F.lit(1)), F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))))
    return F.flatten(F.zip_with(before, ring, step))


def clip_ring(ring: Column, box: Column) -> Column:
    """The closed ring of what a box leaves of a ring; empty if nothing. Parts that a cut separates stay joined along the box."""
    n = F.size(ring)
    same = (n > 1) & (F.get(ring, F.lit(0)) == F.get(ring, n - 1))
    out = F.slice(ring, F.lit(1), F.when(same, n - 1).otherwise(n)).cast(POINTS)
    for axis, side, sign in (("lon", "west", 1), ("lon", "east", -1), ("lat", "south", 1), ("lat", "north", -1)):
        out = let(out, partial(_cut, axis=axis, bound=box[side], sign=sign))
    return let(out, closed)


def clip_line(points: Column, box: Column) -> Column:
    """The segments (arrays of two points) of a line inside the box."""

    def cut(p: Column, q: Column) -> Column:
        dx, dy = q["lon"] - p["lon"], q["lat"] - p["lat"]
        walls = [(-dx, p["lon"] - box["west"]), (dx, box["east"] - p["lon"]), (-dy, p["lat"] - box["south"]), (dy, box["north"] - p["lat"])]
        enters = F.greatest(F.lit(0.0), *(F.when(speed < 0, room / speed) for speed, room in walls))
        leaves = F.least(F.lit(1.0), *(F.when(speed > 0, room / speed) for speed, room in walls))
        outside = F.greatest(*(F.when((speed == 0) & (room < 0), 1).otherwise(0) for speed, room in walls)) == 1
        at = lambda t: point(p["lon"] + t * dx, p["lat"] + t * dy)
        return F.when(~outside & (enters <= leaves), F.array(at(enters), at(leaves)).cast(POINTS))

    return F.filter(steps(points, cut), lambda s: s.isNotNull())


def planar_length(points: Column) -> Column:
    """Length of a line in degrees."""
    return F.aggregate(steps(points, lambda p, q: F.hypot(q["lon"] - p["lon"], q["lat"] - p["lat"])), F.lit(0.0), lambda s, x: s + x)


def planar_area(ring: Column) -> Column:
    """Area inside a closed ring in square degrees."""
    return F.abs(F.aggregate(steps(ring, lambda p, q: p["lon"] * q["lat"] - q["lon"] * p["lat"]), F.lit(0.0), lambda s, x: s + x)) / 2
