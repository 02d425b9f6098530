"""How many polygons share a point with each box, and the largest value among them, without a row for each pair.

Boxes are cut into strips of latitude with about ``BOXES`` each, and a polygon goes once to each strip that it can touch.
In a strip the boxes stand in a tree, halved along the longer side. A polygon whose border keeps clear of all boxes of a
node has them all inside or none, and one whose border meets what they all share meets them all; both are counted at
the node. Only boxes of leaves that a border passes are tested one by one, so the work grows with the borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.clip import let, steps
from terrafold.functions.geo import closed
from terrafold.operators.storage import materialize

#: Boxes of a strip's part, edges of a part, boxes of a leaf, edges that are tested at once, and values that are counted apart at once.
BOXES, EDGES, LEAF, TESTED, VALUES = 32_768, 131_072, 8, 1 << 18, 256
#: Fine bins of latitude, of which strips are made.
BINS = 4096
#: Degrees around a node's boxes that a border has to keep clear of, so that rounding decides nothing.
CLEAR = 1e-9
SIDES = ("west", "south", "east", "north")


def edges_of(rings: Column) -> Column:
    """Array of ``ax, ay, bx, b_y``: the edges of all rings; a vertex without a next one is an edge of its own."""
    pair = lambda p, q: F.struct(p["lon"].alias("ax"), p["lat"].alias("ay"), F.when(q["lat"].isNull() | q["lon"].isNull(), p["lon"]).otherwise(q["lon"]).alias("bx"), F.when(q["lat"].isNull() | q["lon"].isNull(), p["lat"]).otherwise(q["lat"]).alias("b_y"))
    edges = lambda c: F.when(F.size(c) == 1, F.transform(c, lambda p: pair(p, p))).otherwise(steps(c, pair))
    every = F.flatten(F.transform(rings, lambda r: let(closed(r), edges)))
    return F.filter(every, lambda e: e["ax"].isNotNull() & e["ay"].isNotNull())


class Polygons:
    """Edges of polygons one after the other. Where a corner is missing (not ``whole``) a border doesn't part inside from outside."""

    def __init__(self, edges: pa.ListArray, whole: np.ndarray) -> None:
        self.whole = whole
        ends, flat = edges.offsets.to_numpy(), edges.values
        self.first, self.n = ends[:-1].astype(np.int64), np.diff(ends).astype(np.int64)
        self.ax, self.ay, self.bx, self.by = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("ax", "ay", "bx", "b_y"))
        cut = lambda best, x, y: best.reduceat(best(x, y), self.first)
        self.west, self.south, self.east, self.north = cut(np.fmin, self.ax, self.bx), cut(np.fmin, self.ay, self.by), cut(np.fmax, self.ax, self.bx), cut(np.fmax, self.ay, self.by)

    def each(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every edge of the polygons ``p`` its place in ``p`` and among all edges."""
        n = self.n[p]
        of = np.repeat(np.arange(len(p)), n)
        return of, np.arange(len(of)) + np.repeat(self.first[p] - np.cumsum(n) + n, n)

    def border(self, of: np.ndarray, e: np.ndarray, box: tuple[np.ndarray, ...]) -> np.ndarray:
        """Whether any edge meets the box, as ``clip.segment_meets_box``; ``box`` has a row for each place of ``of``."""
        w, s, x, n = box
        hit = np.zeros(len(w), bool)
        ax, ay, bx, by = self.ax[e], self.ay[e], self.bx[e], self.by[e]
        near = (np.minimum(ax, bx) <= x[of]) & (np.maximum(ax, bx) >= w[of]) & (np.minimum(ay, by) <= n[of]) & (np.maximum(ay, by) >= s[of])
        ax, ay, bx, by, k = ax[near], ay[near], bx[near], by[near], of[near]
        dx, dy = bx - ax, by - ay
        sides = [dx * (lat[k] - ay) - dy * (lon[k] - ax) for lon in (w, x) for lat in (s, n)]
        hit[k[(np.minimum.reduce(sides) <= 0) & (np.maximum.reduce(sides) >= 0)]] = True
        return hit

    def holds(self, of: np.ndarray, e: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """Whether a point is inside by the even-odd rule, as ``geo.in_rings``."""
        ay, by = self.by[e], self.ay[e]
        some = (ay > lat[of]) != (by > lat[of])
        e, k, ay, by = e[some], of[some], ay[some], by[some]
        right = lon[k] < (self.ax[e] - self.bx[e]) * (lat[k] - ay) / (by - ay) + self.bx[e]
        return np.bincount(k[right], minlength=len(lon)) % 2 == 1


class Tree:
    """Boxes in an order in which those of a node stand together, and what the boxes of each node cover and share."""

    def __init__(self, sides: dict[str, np.ndarray]) -> None:
        n = len(sides["west"])
        self.depth = max(0, int(np.log2(max(n // LEAF, 1))))
        x, y = sides["west"] + sides["east"], sides["south"] + sides["north"]
        order, self.starts, self.cover, self.shared = np.arange(n), [], [], []
        for level in range(self.depth + 1):
            starts = np.arange(1 << level) * n >> level
            if level:
                node = np.repeat(np.arange(len(above)), np.diff(np.append(above, n)))
                wide = [np.maximum.reduceat(c[order], above) - np.minimum.reduceat(c[order], above) for c in (x, y)]
                order = order[np.lexsort((np.where((wide[0] >= wide[1])[node], x[order], y[order]), node))]
            above = starts
            self.starts.append(np.append(starts, n))
            least = {c: np.minimum.reduceat(sides[c][order], starts) for c in SIDES}
            most = {c: np.maximum.reduceat(sides[c][order], starts) for c in SIDES}
            self.cover.append((least["west"], least["south"], most["east"], most["north"]))
            self.shared.append((most["west"], most["south"], least["east"], least["north"]))
        self.order, self.box = order, tuple(sides[c][order] for c in SIDES)

    def met(self, polygons: Polygons, value: np.ndarray, kinds: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Counts by box (in the tree's order) and value (from 0 to before ``kinds``)."""
        known = [np.zeros((1 << level, kinds), np.int64) for level in range(self.depth + 1)]
        single = np.zeros((len(self.order), kinds), np.int32)
        waiting = [(0, np.zeros(len(value), np.int64), np.arange(len(value)))]
        while waiting:
            level, node, p = waiting.pop()
            edges = np.cumsum(polygons.n[p])
            if len(p) > 1 and edges[-1] > TESTED:
                cut = min(max(1, int(np.searchsorted(edges, TESTED, "right"))), len(p) - 1)
                waiting.append((level, node[cut:], p[cut:]))
                node, p = node[:cut], p[:cut]
            last = level > self.depth  # one box each
            cover = tuple(b[node] for b in (self.box if last else self.cover[level]))
            w, s, e, n = cover
            near = (polygons.west[p] <= e + CLEAR) & (polygons.east[p] >= w - CLEAR) & (polygons.south[p] <= n + CLEAR) & (polygons.north[p] >= s - CLEAR)
            node, p, cover = node[near], p[near], tuple(b[near] for b in cover)
            if not len(p):
                continue
            of, edge = polygons.each(p)
            if last:
                meets = polygons.border(of, edge, cover) | polygons.holds(of, edge, cover[0], cover[1])
                np.add.at(single, (node[meets], value[p[meets]]), 1)
                continue
            w, s, e, n = cover
            passes = ~polygons.whole[p] | polygons.border(of, edge, (w - CLEAR, s - CLEAR, e + CLEAR, n + CLEAR))
            common = tuple(b[node] for b in self.shared[level])
            every = passes & (common[0] <= common[2]) & (common[1] <= common[3])
            every &= polygons.border(of, edge, common)
            every |= ~passes & polygons.holds(of, edge, w, s)
            np.add.at(known[level], (node[every], value[p[every]]), 1)
            left = passes & ~every
            node, p = node[left], p[left]
            if level < self.depth:
                waiting.append((level + 1, np.concatenate([2 * node, 2 * node + 1]), np.concatenate([p, p])))
            else:
                first, size = self.starts[level][node], np.diff(self.starts[level])[node]
                box = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
                waiting.append((level + 1, box, np.repeat(p, size)))
        for level in range(1, self.depth + 1):
            known[level] += np.repeat(known[level - 1], 2, axis=0)
        for k in range(1 << self.depth):
            a, b = self.starts[-1][k : k + 2]
            yield self.order[a:b], single[a:b] + known[-1][k]


def counted(boxes: pa.Table, polygons: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Number and largest value of the polygons that meet each box, of values between its ``low`` and ``high``."""
    tree = Tree({c: boxes.column(c).to_numpy() for c in SIDES})
    low, high = boxes.column("low").to_numpy(), boxes.column("high").to_numpy()
    n, top = np.zeros(len(low), np.int64), np.full(len(low), np.iinfo(np.int64).min)
    polygons = polygons.sort_by("value").combine_chunks()
    kinds, first = np.unique(polygons.column("value").to_numpy(), return_index=True)
    first = np.append(first, polygons.num_rows)
    with np.errstate(invalid="ignore", divide="ignore"):
        for k in range(0, len(kinds), VALUES):
            some = kinds[k : k + VALUES]
            part = polygons.slice(first[k], first[k + len(some)] - first[k]).combine_chunks()
            edges = part.column("edges").combine_chunks()
            edges = pa.concat_arrays(edges.chunks) if isinstance(edges, pa.ChunkedArray) else edges
            edges = pa.ListArray.from_arrays(pa.array(edges.offsets.to_numpy() - edges.offsets[0].as_py()), edges.flatten())
            a, b = np.searchsorted(some, low, "left"), np.searchsorted(some, high, "right")
            for at, counts in tree.met(Polygons(edges, part.column("whole").to_numpy()), np.searchsorted(some, part.column("value").to_numpy()), len(some)):
                mine = np.where((np.arange(len(some)) >= a[at, None]) & (np.arange(len(some)) < b[at, None]), counts, 0)
                n[at] += mine.sum(axis=1)
                any_ = mine.any(axis=1)
                top[at[any_]] = some[len(some) - 1 - mine[any_, ::-1].astype(bool).argmax(axis=1)]
    return n, top


def polygons_met(boxes: DataFrame, polygons: DataFrame, key: str) -> DataFrame:
    """``key``, ``n`` and ``largest``: how many polygons (``rings``, ``value``) share a point with a box (``west, south, east, north``)
    and have a value from its ``low`` to its ``high``, and the largest such value; no row without one.

    ``key`` is unique, values are whole numbers. Borders count; a vertex without a coordinate meets nothing, and such a polygon is tested at each box that its bounds meet.
    """
    asked = boxes.select(key, *(F.col(c).cast("double").alias(c) for c in SIDES), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))
    for c in SIDES:
        asked = asked.where(F.col(c).isNotNull() & ~F.isnan(c))
    asked = materialize(asked.where("west <= east and south <= north and low <= high"))
    middle = (F.col("south") + F.col("north")) / 2
    least, most, low, high = asked.agg(F.min(middle), F.max(middle), F.min("low"), F.max("high")).first()
    least, most, low, high = (0.0, 0.0, 0, -1) if least is None else (least, most, low, high)
    step = max((most - least) / BINS, 1e-9)
    bin_of = F.least(F.greatest(F.floor((middle - least) / step), F.lit(0)), F.lit(BINS - 1)).cast("int")
    ends = [f(c).alias(c) for f, c in ((F.min, "west"), (F.min, "south"), (F.max, "east"), (F.max, "north"))]
    bins = asked.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), *ends).orderBy("bin").collect()  # at most BINS rows
    strips: list[list] = []
    strip_of = [0] * BINS
    for r in bins:
        if not strips or strips[-1][0] + r["n"] > BOXES:
            strips.append([0, r["west"], r["south"], r["east"], r["north"]])
        s = strips[-1]
        strips[-1] = [s[0] + r["n"], min(s[1], r["west"]), min(s[2], r["south"]), max(s[3], r["east"]), max(s[4], r["north"])]
        strip_of[r["bin"]] = len(strips) - 1
    bounds = F.array(*(F.struct(F.lit(k).alias("strip"), *(F.lit(v).alias(c) for c, v in zip(SIDES, s[1:], strict=True))) for k, s in enumerate(strips or [[0, 0.0, 0.0, 0.0, 0.0]])))
    drawn = polygons.select(F.col("value").cast("long").alias("value"), edges_of(F.col("rings")).alias("edges"), F.forall(F.flatten("rings"), lambda p: p["lon"].isNotNull() & p["lat"].isNotNull()).alias("whole")).where(F.col("value").between(low, high) & (F.size("edges") > 0))
    side = lambda best, *cs: best(F.flatten(F.array(*(F.col("edges")[c] for c in cs))))
    drawn = drawn.withColumns({"w": side(F.array_min, "ax", "bx"), "s": side(F.array_min, "ay", "b_y"), "e": side(F.array_max, "ax", "bx"), "n": side(F.array_max, "ay", "b_y")})
    touched = F.filter(bounds, lambda b: (b["west"] <= F.col("e") + CLEAR) & (b["east"] >= F.col("w") - CLEAR) & (b["south"] <= F.col("n") + CLEAR) & (b["north"] >= F.col("s") - CLEAR))
    drawn = materialize(drawn.select("value", "edges", "whole", touched["strip"].alias("strips"))).withColumn("strip", F.explode("strips")).drop("strips")
    met = {r["strip"]: r["n"] for r in drawn.groupBy("strip").agg(F.sum(F.size("edges")).alias("n")).collect()}  # a row for each strip
    dealt = lambda counts, size: F.element_at(F.array(*(F.lit(max(1, -(-c // size))) for c in counts or [1])), F.col("strip") + 1)
    b_parts, p_parts = dealt([s[0] for s in strips], BOXES), dealt([met.get(k, 0) for k in range(len(strips))], EDGES)
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = lambda n, *cs: F.pmod(F.xxhash64(*cs), n).cast("int")
    asked = asked.withColumn("strip", F.element_at(F.array(*map(F.lit, strip_of)), bin_of + 1)).withColumn("b_part", mine(b_parts, key)).withColumn("p_part", each(p_parts))
    drawn = drawn.withColumn("p_part", mine(p_parts, "value", "edges")).withColumn("b_part", each(b_parts))
    kind = asked.schema[key].dataType

    def run(b: pa.Table, p: pa.Table) -> pa.Table:
        if b.num_rows and p.num_rows:
            n, top = counted(b, p)
        else:
            n, top = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        some = np.flatnonzero(n)
        return pa.table({key: b.column(key).take(pa.array(some)), "n": n[some], "largest": top[some]})

    keys = ["strip", "b_part", "p_part"]
    parts = asked.groupBy(*keys).cogroup(drawn.groupBy(*keys)).applyInArrow(run, f"`{key}` {kind.simpleString()}, n long, largest long")
    return parts.groupBy(key).agg(F.sum("n").alias("n"), F.max("largest").alias("largest"))
