"""Density clusters on a graph of cells, so that dense places need no pairs of points.

Cells have the diagonal eps, so points of a cell are neighbours of each other. A cell of enough weight has only core
points, and nothing is counted there; points of lighter cells are few in each, and are compared with the cells around.
Core points of a cell are one node. Two cells are linked if any two of their core points are within eps. Most such
pairs show at the outermost points of both. What these leave open between cells not yet connected is decided by boxes:
all of it near, all of it far, or neither, and then the boxes are cut in four along each axis.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.operators.components import components
from terrafold.operators.storage import materialize

#: A box is cut in four along each axis this many times at most; then its points are compared.
CUTS = 12


def index(c: str, size: float) -> Column:
    """A point's place along an axis in the finest boxes; cells are 4^CUTS of them wide."""
    return F.floor(F.col(c) * ((1 << 2 * CUTS) / size)).cast("long")


def at_cut(fine: str, cut: int) -> Column:
    return F.shiftright(fine, 2 * (CUTS - cut))


def gap(low_a: str, high_a: str, low_b: str, high_b: str) -> Column:
    """Least distance of two spans."""
    return F.greatest(F.col(low_b) - F.col(high_a), F.col(low_a) - F.col(high_b), F.lit(0.0))


def reach(low_a: str, high_a: str, low_b: str, high_b: str) -> Column:
    """Largest distance of two spans."""
    return F.greatest(F.col(high_b) - F.col(low_a), F.col(high_a) - F.col(low_b))


def offsets(half: bool) -> Column:
    """Steps to the cells that can hold points within eps: 20 around, or one of each two that are opposite."""
    steps = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if abs(dy) + abs(dx) < 4 and ((dy, dx) > (0, 0) if half else True)]
    return F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps))


def boxes(cores: DataFrame, cut: int) -> DataFrame:
    """Bounds of each cell's core points after ``cut`` cuts, with the box of the cut before."""
    by = cores.select("rep", at_cut("fy", cut).alias("by"), at_cut("fx", cut).alias("bx"), at_cut("fy", max(cut - 1, 0)).alias("oy"), at_cut("fx", max(cut - 1, 0)).alias("ox"), "lat", "lon")
    return by.groupBy("rep", "by", "bx", "oy", "ox").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))


#: The outermost points of a cell: its bounds, and the other coordinate of a point at each of them.
OUTERMOST = (("n", "lat", F.max, F.max_by), ("s", "lat", F.min, F.min_by), ("e", "lon", F.max, F.max_by), ("w", "lon", F.min, F.min_by))


def outermost() -> list[Column]:
    other = {"lat": "lon", "lon": "lat"}
    return [c for name, axis, most, by in OUTERMOST for c in (most(axis).alias(name), by(other[axis], axis).alias(f"{name}_{other[axis]}"))]


def touching(eps: float) -> Column:
    """Whether an outermost point of cell ``a`` is within eps of one of cell ``b``."""
    at = lambda side, name, axis: (F.col(f"{side}_{name}"), F.col(f"{side}_{name}_lon")) if axis == "lat" else (F.col(f"{side}_{name}_lat"), F.col(f"{side}_{name}"))
    ends = [(at("a", *p[:2]), at("b", *q[:2])) for p in OUTERMOST for q in OUTERMOST]
    return reduce(lambda x, y: x | y, [F.hypot(p[0] - q[0], p[1] - q[1]) <= eps for p, q in ends])


def near_cells(cells: DataFrame, eps: float) -> DataFrame:
    """Pairs ``a``, ``b`` of cells whose core points can be within eps; ``sure`` if outermost points are. ``cells``: part, y, x, rep and ``outermost``."""
    named = lambda side: [F.col("rep").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in cells.columns if c not in ("part", "y", "x", "rep"))]
    moved = cells.select("part", "y", "x", *named("a"), F.explode(offsets(True)).alias("o")).withColumns({"y": F.col("y") + F.col("o.dy"), "x": F.col("x") + F.col("o.dx")}).drop("o")
    pairs = moved.join(cells.select("part", "y", "x", *named("b")), ["part", "y", "x"])
    least = F.hypot(gap("a_s", "a_n", "b_s", "b_n"), gap("a_w", "a_e", "b_w", "b_e"))
    return pairs.where(least <= eps).select("a", "b", touching(eps).alias("sure"))


def cell_links(cores: DataFrame, open_pairs: DataFrame, eps: float) -> DataFrame:
    """Those of the pairs ``a``, ``b`` of cells (by their least core point) with core points within eps. ``cores``: rep, fy, fx, lat, lon."""
    named = lambda side, cut: boxes(cores, cut).select(F.col("rep").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("by", "bx", "oy", "ox", "s", "n", "w", "e")))
    links = None
    for cut in range(CUTS + 1):
        on = (lambda side: [side]) if cut == 0 else (lambda side: [side, f"{side}_oy", f"{side}_ox"])
        pairs = open_pairs.join(named("a", cut), on("a")).join(named("b", cut), on("b"))
        least = F.hypot(gap("a_s", "a_n", "b_s", "b_n"), gap("a_w", "a_e", "b_w", "b_e"))
        most = F.hypot(reach("a_s", "a_n", "b_s", "b_n"), reach("a_w", "a_e", "b_w", "b_e"))
        judged = materialize(pairs.where(least <= eps).select("a", "b", "a_by", "a_bx", "b_by", "b_bx", (most <= eps).alias("sure")))
        found = judged.where("sure").select("a", "b").distinct()
        links = found if links is None else links.unionByName(found)
        left = judged.where("not sure").join(found, ["a", "b"], "left_anti")
        open_pairs = materialize(left.select("a", "b", F.col("a_by").alias("a_oy"), F.col("a_bx").alias("a_ox"), F.col("b_by").alias("b_oy"), F.col("b_bx").alias("b_ox")))
        if open_pairs.isEmpty():
            return links
    points = lambda side: cores.select(F.col("rep").alias(side), F.col("fy").alias(f"{side}_oy"), F.col("fx").alias(f"{side}_ox"), F.col("lat").alias(f"{side}_lat"), F.col("lon").alias(f"{side}_lon"))
    last = open_pairs.join(points("a"), ["a", "a_oy", "a_ox"]).join(points("b"), ["b", "b_oy", "b_ox"])
    return links.unionByName(last.where(F.hypot(F.col("a_lat") - F.col("b_lat"), F.col("a_lon") - F.col("b_lon")) <= eps).select("a", "b").distinct())


def dbscan(points: DataFrame, *, part: str, eps: float, min_points: int) -> DataFrame:
    """Density clusters per ``part`` (columns ``id, lat, lon``); noise is left out. ``cluster`` is the least core id.

    Points of equal place are one with a weight. A border point joins the smallest neighbouring cluster.
    """
    cell = ["part", "y", "x"]
    size = eps / math.sqrt(2) * (1 - 1e-9)
    fine = {"fy": index("lat", size), "fx": index("lon", size)}
    rows = materialize(points.select(F.col(part).alias("part"), "id", "lat", "lon").withColumns(fine).withColumns({"y": at_cut("fy", 0), "x": at_cut("fx", 0)}))
    cells = materialize(rows.groupBy(*cell).agg(F.count("*").alias("total"), F.min("id").alias("rep"), *outermost()))
    heavy, light = cells.where(F.col("total") >= min_points).drop("total"), cells.where(F.col("total") < min_points).select(*cell)
    around = light.select("part", "y", "x", F.explode(offsets(False)).alias("o")).select("part", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()
    spots = materialize(rows.join(around, cell, "left_semi").groupBy(*cell, "fy", "fx", "lat", "lon").agg(F.min("id").alias("spot"), F.count("*").alias("weight")))
    own = materialize(spots.join(light, cell, "left_semi"))
    each = own.select("part", F.col("spot").alias("a"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.col("y").alias("ay"), F.col("x").alias("ax"), F.explode(offsets(False)).alias("o"))
    each = each.select("part", "a", "a_lat", "a_lon", (F.col("ay") + F.col("o.dy")).alias("y"), (F.col("ax") + F.col("o.dx")).alias("x"))
    near = each.join(spots.select(*cell, F.col("spot").alias("b"), "weight", "lat", "lon"), cell)
    near = materialize(near.where(F.hypot(F.col("a_lat") - F.col("lat"), F.col("a_lon") - F.col("lon")) <= eps).select(*cell, "a", "b", "weight"))
    counted = materialize(near.groupBy("a").agg(F.sum("weight").alias("n")).where(F.col("n") >= min_points).select(F.col("a").alias("spot")))
    few = own.join(counted, "spot", "left_semi")
    nodes = materialize(heavy.withColumn("full", F.lit(True)).unionByName(few.groupBy(*cell).agg(F.min("spot").alias("rep"), *outermost()).withColumn("full", F.lit(False))))
    pairs = materialize(near_cells(nodes.drop("full"), eps))
    known = components(pairs.where("sure").select("a", "b"))
    label = lambda node, to: known.select(F.col("node").alias(node), F.col("label").alias(to))
    left = pairs.where("not sure").join(label("a", "a_label"), "a", "left").join(label("b", "b_label"), "b", "left")
    left = materialize(left.withColumns({"a_label": F.coalesce("a_label", "a"), "b_label": F.coalesce("b_label", "b")}).where("a_label <> b_label"))
    labels = nodes.join(label("rep", "first"), "rep", "left").select(*cell, "full", F.coalesce("first", "rep").alias("cluster"))
    if not left.isEmpty():
        both = nodes.join(left.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep", "left_semi").select(*cell, "rep", "full")
        cores = rows.join(both.where("full"), cell).unionByName(few.join(both.where("not full"), cell), allowMissingColumns=True)
        cores = materialize(cores.select("rep", "fy", "fx", "lat", "lon").distinct())
        joined = cell_links(cores, left.select("a", "b"), eps).join(left, ["a", "b"]).select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
        last = components(joined).select(F.col("node").alias("cluster"), "label")
        labels = labels.join(last, "cluster", "left").select(*cell, "full", F.coalesce("label", "cluster").alias("cluster"))
    labels = materialize(labels)
    reached = near.join(counted.withColumnRenamed("spot", "a"), "a", "left_anti").join(labels, cell)
    reached = reached.where("full").select("a", "cluster").unionByName(reached.where("not full").join(counted.withColumnRenamed("spot", "b"), "b", "left_semi").select("a", "cluster"))
    border = reached.groupBy(F.col("a").alias("spot")).agg(F.min("cluster").alias("cluster"))
    single = few.join(labels, cell).select("spot", "cluster").unionByName(border).join(own, "spot").select(F.col("part").alias(part), "lat", "lon", F.col("cluster").alias("_own"))
    whole = labels.where("full").select(F.col("part").alias(part), F.col("y").alias("_y"), F.col("x").alias("_x"), "cluster")
    placed = points.withColumns({"_y": F.shiftright(fine["fy"], 2 * CUTS), "_x": F.shiftright(fine["fx"], 2 * CUTS)})
    found = placed.join(whole, [part, "_y", "_x"], "left").join(single, [part, "lat", "lon"], "left").withColumn("cluster", F.coalesce("cluster", "_own")).where("cluster is not null")
    first = [part, "lat", "lon"]
    return found.select(*first, *(c for c in points.columns if c not in first), "cluster")
