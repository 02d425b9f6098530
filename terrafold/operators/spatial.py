"""Spatial joins on grid cells, nearest rows, tile assignment and hulls."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.operators.density import dbscan  # noqa: F401  the clusters whose hulls are made here
from terrafold.operators.storage import materialize

KM_PER_DEGREE = 110.5  # a little below the true length, so that a box never cuts a circle


def _columns(cell_km: float) -> int:
    return max(1, int(360 / (cell_km / KM_PER_DEGREE)))


def cell_of(lat: Column, lon: Column, cell_km: float) -> list[Column]:
    """Row and column of a point's grid cell; columns wrap at 180 degrees."""
    n = _columns(cell_km)
    return [F.floor(lat / (360 / n)).alias("cell_y"), F.pmod(F.floor((lon + 180) / (360 / n)), F.lit(n)).alias("cell_x")]


def cells_around(lat: Column, lon: Column, km: Column, cell_km: float) -> list[Column]:
    """Arrays of rows and columns of the cells that a circle can touch; near the poles every column."""
    n = _columns(cell_km)
    size = 360 / n
    dlat = km / KM_PER_DEGREE
    rows = F.sequence(F.floor((lat - dlat) / size), F.floor((lat + dlat) / size))
    reach = F.abs(lat) + dlat
    dlon = F.least(F.when(reach >= 89, F.lit(180.0)).otherwise(dlat / F.cos(F.radians(F.least(reach, F.lit(89.0))))), F.lit(180.0))
    lo, hi = F.floor((lon + 180 - dlon) / size), F.floor((lon + 180 + dlon) / size)
    return [rows, F.array_distinct(F.transform(F.sequence(lo, F.least(hi, lo + n - 1)), lambda x: F.pmod(x, F.lit(n))))]


def within_join(left: DataFrame, right: DataFrame, km: Column, *, cell_km: float = 50.0, left_at=("lat", "lon"), right_at=("lat", "lon")) -> DataFrame:
    """Pairs of rows of at most ``km`` (a column of ``left``) great-circle kilometres, with ``distance_km``.

    Right rows have one cell; left rows are copied to the cells that their circle touches. Column names must differ.
    """
    rows, cols = cells_around(F.col(left_at[0]), F.col(left_at[1]), km, cell_km)
    spread = left.withColumn("_km", km).withColumn("cell_y", F.explode(rows)).withColumn("cell_x", F.explode(cols))
    placed = right.select("*", *cell_of(F.col(right_at[0]), F.col(right_at[1]), cell_km))
    near = spread.join(placed, ["cell_y", "cell_x"]).withColumn("distance_km", geo.haversine_km(F.col(left_at[0]), F.col(left_at[1]), F.col(right_at[0]), F.col(right_at[1])))
    return near.where(F.col("distance_km") <= F.col("_km")).drop("_km", "cell_y", "cell_x")


def within_degrees(left: DataFrame, right: DataFrame, degrees: Column, *, cell: float, left_at=("lat", "lon"), right_at=("lat", "lon")) -> DataFrame:
    """Pairs of rows of at most ``degrees`` (a column of ``left``, ``cell`` or less) in the plane, with ``distance_deg``."""
    around = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("_reach")) / cell), F.floor((F.col(c) + F.col("_reach")) / cell)))
    spread = left.withColumn("_reach", degrees).withColumn("_y", around(left_at[0])).withColumn("_x", around(left_at[1]))
    placed = right.withColumn("_y", F.floor(F.col(right_at[0]) / cell)).withColumn("_x", F.floor(F.col(right_at[1]) / cell))
    near = spread.join(placed, ["_y", "_x"]).withColumn("distance_deg", F.hypot(F.col(left_at[0]) - F.col(right_at[0]), F.col(left_at[1]) - F.col(right_at[1])))
    return near.where(F.col("distance_deg") <= F.col("_reach")).drop("_reach", "_y", "_x")


#: A ring's radius is this many times the one before; in even density a place meets about as many rows again as its square.
GROWTH = 3


def rings(left: DataFrame, right: DataFrame, cutoff: str, k: int, planar: bool, right_at: tuple[str, str]) -> list[float]:
    """Radii of the search: the last is the largest cutoff; the first fits the cell that holds most rows."""
    largest = left.agg(F.max(cutoff)).first()[0]
    if largest is None:
        return []
    far = max(float(largest), 1e-6)
    lat, lon = (F.col(c) for c in right_at)
    cells = [F.floor(lat / far), F.floor(lon / far)] if planar else cell_of(lat, lon, far)
    most = right.groupBy(*cells).count().agg(F.max("count")).first()[0] or 0
    cuts = max(0, min(20, math.ceil(math.log(max(most / k, 1), GROWTH * GROWTH))))
    return [far / GROWTH**j for j in range(cuts, -1, -1)]


def nearest_k(left: DataFrame, right: DataFrame, key: str, right_key: str, reach: Column, *, k: int = 1, planar: bool = False, left_at=("lat", "lon"), right_at=("lat", "lon")) -> DataFrame:
    """Per left ``key`` (unique) its ``k`` nearest right rows within ``reach``, with ``place`` from 1; ties go to the smallest ``right_key``.

    The search goes by rings: everything within a small radius first, and only places that found fewer than ``k`` rows
    there, and reach further, look within a larger one. The first radius comes from the rows of the densest cell, so a
    place meets a bounded number of rows however dense they are. ``reach`` is in kilometres, or in degrees if ``planar``.
    """
    at, distance = "_cutoff", "distance_deg" if planar else "distance_km"
    waiting = left.withColumn(at, reach.cast("double")).where(F.col(at).isNotNull())
    found = None
    radii = rings(waiting, right, at, k, planar, right_at)
    for radius in radii or [1.0]:
        span = F.least(F.col(at), F.lit(radius))
        if planar:
            near = within_degrees(waiting, right, span, cell=radius, left_at=left_at, right_at=right_at)
        else:
            near = within_join(waiting, right, span, cell_km=radius, left_at=left_at, right_at=right_at)
        if k == 1:
            best = near.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*near.columns), F.struct(distance, right_key)).alias("best")).select("best.*", F.lit(1).alias("place"), F.lit(1).alias("_n"))
        else:
            by = W.partitionBy(key)
            ranked = near.withColumn("place", F.row_number().over(by.orderBy(distance, right_key))).where(F.col("place") <= k)
            best = ranked.withColumn("_n", F.count("*").over(by))
        if radius == (radii or [1.0])[-1]:
            return (best if found is None else found.unionByName(best)).drop(at, "_n")
        best = materialize(best)
        done = best.where((F.col("_n") >= k) | (F.col(at) <= radius))
        found = done if found is None else found.unionByName(done)
        waiting = materialize(waiting.where(F.col(at) > radius).join(best.where(F.col("_n") >= k).select(key).distinct(), key, "left_anti").select(*waiting.columns))
        if waiting.isEmpty():
            return found.drop(at, "_n")


def nearest_join(left: DataFrame, right: DataFrame, key: str, right_key: str, km: Column, *, left_at=("lat", "lon"), right_at=("lat", "lon")) -> DataFrame:
    """Per left ``key`` its nearest right row within ``km``. No row without one."""
    return nearest_k(left, right, key, right_key, km, left_at=left_at, right_at=right_at).drop("place")


def nearest_planar(left: DataFrame, right: DataFrame, key: str, right_key: str, degrees: float, *, left_at=("lat", "lon"), right_at=("lat", "lon")) -> DataFrame:
    """As ``nearest_join`` with the planar distance in degrees."""
    return nearest_k(left, right, key, right_key, F.lit(degrees), planar=True, left_at=left_at, right_at=right_at).drop("place")


def box_join(points: DataFrame, boxes: DataFrame, *, cell: float = 1.0, at=("lat", "lon")) -> DataFrame:
    """Points inside boxes (``west, south, east, north``, borders included), by degree cells."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    spread = boxes.withColumn("_y", span("south", "north")).withColumn("_x", span("west", "east"))
    placed = points.withColumn("_y", F.floor(F.col(at[0]) / cell)).withColumn("_x", F.floor(F.col(at[1]) / cell))
    inside = F.col(at[0]).between(F.col("south"), F.col("north")) & F.col(at[1]).between(F.col("west"), F.col("east"))
    return placed.join(spread, ["_y", "_x"]).where(inside).drop("_y", "_x")


def polygon_join(points: DataFrame, polygons: DataFrame, *, rings: str = "rings", cell: float = 1.0, at=("lat", "lon")) -> DataFrame:
    """Points inside polygons (even-odd over all rings), by the cells of the polygons' bounds."""
    bounded = polygons.withColumn("_box", geo.rings_bbox(F.col(rings))).select("*", "_box.west", "_box.south", "_box.east", "_box.north").drop("_box")
    met = box_join(points, bounded, cell=cell, at=at)
    return met.where(geo.in_rings(F.col(at[0]), F.col(at[1]), F.col(rings))).drop("west", "south", "east", "north")


def boxes_overlap(left: DataFrame, right: DataFrame, *, cell: float = 1.0, prefix: str = "r_") -> DataFrame:
    """Pairs of overlapping boxes; the right box's bounds carry ``prefix``. Each pair appears once."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    a = left.withColumn("_y", span("south", "north")).withColumn("_x", span("west", "east"))
    b = right.withColumn("_y", span(f"{prefix}south", f"{prefix}north")).withColumn("_x", span(f"{prefix}west", f"{prefix}east"))
    over = (F.col("west") <= F.col(f"{prefix}east")) & (F.col("east") >= F.col(f"{prefix}west")) & (F.col("south") <= F.col(f"{prefix}north")) & (F.col("north") >= F.col(f"{prefix}south"))
    low = lambda lo, lo2: F.floor(F.greatest(F.col(lo), F.col(lo2)) / cell)
    first = (F.col("_y") == low("south", f"{prefix}south")) & (F.col("_x") == low("west", f"{prefix}west"))  # the shared cell at the lower corner
    return a.join(b, ["_y", "_x"]).where(over & first).drop("_y", "_x")


def tiles_of_points(points: DataFrame, zoom: int, *, at=("lat", "lon")) -> DataFrame:
    """J6 for points: tile ``x`` and ``y`` of every row at ``zoom``."""
    z = F.lit(zoom)
    return points.withColumns({"z": z, "x": geo.tile_x(F.col(at[1]), z), "y": geo.tile_y(F.col(at[0]), z)})


def hull_of(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise and open; collinear points give the two ends, one point itself."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def chain(order: list) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(pts[::-1])


def hull_corners(points: DataFrame, *keys: str, cell: float = 0.01, salts: int = 16) -> DataFrame:
    """``keys``, ``lat``, ``lon``: corners of partial hulls, which hold all corners of each group's hull.

    Every latitude keeps its westmost and eastmost points; a row of fine cells is dealt over ``salts`` parts, and each
    part keeps the corners of its own hull.
    """
    ends = points.groupBy(*keys, F.floor(F.col("lat") / cell).alias("_band"), "lat").agg(F.min("lon").alias("w"), F.max("lon").alias("e"))
    few = ends.select(*keys, "_band", F.pmod(F.xxhash64("lat"), F.lit(salts)).alias("_salt"), "lat", F.explode(F.array_distinct(F.array("w", "e"))).alias("lon"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*keys).schema.fields)

    def part(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull_of(list(zip(pdf["lon"].tolist(), pdf["lat"].tolist(), strict=True)))
        return pd.DataFrame([[*key[:-2], y, x] for x, y in h], columns=[*keys, "lat", "lon"])

    return few.groupBy(*keys, "_band", "_salt").applyInPandas(part, f"{kinds}, lat double, lon double")


def convex_hulls(points: DataFrame, *keys: str, cell: float = 0.01) -> DataFrame:
    """G9 per group: ``kind`` (Point, LineString or Polygon) and ``ring`` (closed for a polygon).

    Partial hulls are made first (``hull_corners``), so a group's task gets their corners, however many points and
    distinct latitudes the group has.
    """
    few = hull_corners(points, *keys, cell=cell)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*keys).schema.fields)

    def hull(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull_of(list(zip(pdf["lon"].tolist(), pdf["lat"].tolist(), strict=True)))
        kind = ("Point", "LineString", "Polygon")[min(len(h), 3) - 1]
        ring = [{"lon": x, "lat": y} for x, y in (h + h[:1] if len(h) > 2 else h)]
        return pd.DataFrame([[*key, kind, ring]], columns=[*keys, "kind", "ring"])

    return few.groupBy(*keys).applyInPandas(hull, f"{kinds}, kind string, ring array<struct<lon:double,lat:double>>")
