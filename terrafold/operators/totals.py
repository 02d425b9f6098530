"""Counts, sums and largest values of the points inside boxes or circles, without a row for each pair.

Points of one place are added up first. They are cut into strips of latitude with about ``POINTS`` places each, and a box
or circle goes once to each strip that it touches. In a strip the points stand in bands, ordered by longitude: what
a band has within a range of longitudes is a difference of running sums, and only points of bands that a box's border
crosses, or near a circle's border, are tested one by one. So the work of a query grows with the bands and its border.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.geo import EARTH_KM
from terrafold.operators.storage import materialize

#: Places of a strip's part, queries of a part, places of a band, and points that are tested at once.
POINTS, ASKED, BAND, TESTED = 131_072, 65_536, 4096, 1 << 20
#: Fine bins of latitude, of which strips are made.
BINS = 4096
#: Degrees of longitude by which a circle's range is made smaller or larger before points are tested.
MARGIN = 1e-5
LEAST = np.iinfo(np.int64).min


class Band:
    """Points of one kind and narrow range of latitude by rising longitude, with running sums and largest values."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, by_lon: np.ndarray, sums: list[np.ndarray], largest: list[np.ndarray]) -> None:
        order = np.argsort(by_lon, kind="stable")
        self.lat, self.lon, self.by_lon = lat[order], lon[order], by_lon[order]
        self.south, self.north = lat.min(), lat.max()
        self.sums, self.largest = [s[order] for s in sums], [m[order] for m in largest]
        self.running = [np.r_[0, np.cumsum(s)] for s in self.sums]
        self.levels = [[m] for m in self.largest]
        for table in self.levels:
            while (1 << len(table)) <= len(lat):
                half = 1 << (len(table) - 1)
                table.append(np.maximum(table[-1][:-half], table[-1][half:]))

    def add(self, to: Found, who: np.ndarray, first: np.ndarray, end: np.ndarray) -> None:
        """All points at positions from ``first`` to before ``end``."""
        some = end > first
        who, first, end = who[some], first[some], end[some]
        for out, run in zip(to.sums, self.running, strict=True):
            out[who] += run[end] - run[first]
        level = np.frexp((end - first).astype(np.float64))[1] - 1
        for out, table in zip(to.largest, self.levels, strict=True):
            for k in np.unique(level):
                at = level == k
                out[who[at]] = np.maximum(out[who[at]], np.maximum(table[k][first[at]], table[k][end[at] - (1 << k)]))

    def test(self, to: Found, who: np.ndarray, first: np.ndarray, end: np.ndarray, inside) -> None:
        """Those of these points for which ``inside(who, point)`` holds; a query stands here once."""
        some = end > first
        who, first, end = who[some], first[some], end[some]
        total = np.cumsum(end - first)
        start = 0
        while start < len(who):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + TESTED, "right")))
            n = end[start:stop] - first[start:stop]
            at = np.cumsum(n) - n
            point = np.arange(n.sum()) + np.repeat(first[start:stop] - at, n)
            ok = inside(np.repeat(who[start:stop], n), point)
            for out, s in zip(to.sums, self.sums, strict=True):
                out[who[start:stop]] += np.add.reduceat(np.where(ok, s[point], 0), at)
            for out, m in zip(to.largest, self.largest, strict=True):
                out[who[start:stop]] = np.maximum(out[who[start:stop]], np.maximum.reduceat(np.where(ok, m[point], LEAST), at))
            start = stop


class Found:
    def __init__(self, n: int, sums: int, largest: int) -> None:
        self.sums, self.largest = [np.zeros(n, np.int64) for _ in range(sums)], [np.full(n, LEAST) for _ in range(largest)]


def in_boxes(band: Band, q: dict[str, np.ndarray], to: Found) -> None:
    who = np.nonzero((q["south"] <= band.north) & (q["north"] >= band.south))[0]
    first, end = np.searchsorted(band.by_lon, q["west"][who], "left"), np.searchsorted(band.by_lon, q["east"][who], "right")
    whole = (q["south"][who] <= band.south) & (q["north"][who] >= band.north)
    band.add(to, who[whole], first[whole], end[whole])
    band.test(to, who[~whole], first[~whole], end[~whole], lambda k, p: (band.lat[p] >= q["south"][k]) & (band.lat[p] <= q["north"][k]))


def km_between(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """G1, as ``geo.haversine_km``."""
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(1 - a, 0.0)))


def widths(lat0: np.ndarray, reach: np.ndarray, south: float, north: float) -> tuple[np.ndarray, np.ndarray]:
    """Degrees of longitude on each side that lie in a circle (radians) all over a band, or anywhere in it; -1 for none.

    A circle's width rises to one latitude and falls from there, so the narrowest place is an end of the band. Circles
    that hold a pole are tested point by point.
    """
    ends = [np.radians(south), np.radians(north)]
    with np.errstate(divide="ignore", invalid="ignore"):
        at = [np.degrees(np.arccos(np.clip((np.cos(reach) - np.sin(lat0) * np.sin(x)) / (np.cos(lat0) * np.cos(x)), -1, 1))) for x in ends]
        top = np.arcsin(np.clip(np.sin(lat0) / np.cos(reach), -1, 1))
        most = np.degrees(np.arcsin(np.clip(np.sin(reach) / np.cos(lat0), -1, 1)))
    pole = np.abs(lat0) + reach >= np.pi / 2 - 1e-6
    wide = np.where((top >= ends[0]) & (top <= ends[1]), most, np.maximum(*at))
    within = (ends[0] > lat0 - reach) & (ends[1] < lat0 + reach) & ~pole
    return np.where(within, np.minimum(*at) - MARGIN, -1.0), np.where(pole, 180.0, wide + MARGIN)


def in_circles(band: Band, q: dict[str, np.ndarray], to: Found) -> None:
    lat0, reach = np.radians(q["lat"]), q["km"] / EARTH_KM
    who = np.nonzero((q["km"] >= 0) & (np.radians(band.south) <= lat0 + reach + 1e-9) & (np.radians(band.north) >= lat0 - reach - 1e-9))[0]
    narrow, wide = widths(lat0[who], reach[who], band.south, band.north)
    middle = (q["lon"][who] + 180) % 360 - 180
    inside = lambda k, p: km_between(q["lat"][k], q["lon"][k], band.lat[p], band.lon[p]) <= q["km"][k]
    round_ = wide >= 180
    band.test(to, who[round_], np.zeros(round_.sum(), np.int64), np.full(round_.sum(), len(band.lat)), inside)
    for turn in (0.0, -360.0, 360.0):  # circles over the date line
        x = middle + turn
        near = ~round_ & (x - wide <= band.by_lon[-1]) & (x + wide >= band.by_lon[0])
        if near.any():
            k, x, n, w = who[near], x[near], narrow[near], wide[near]
            first, end = np.searchsorted(band.by_lon, x - w, "left"), np.searchsorted(band.by_lon, x + w, "right")
            a, b = np.searchsorted(band.by_lon, x - n, "left"), np.searchsorted(band.by_lon, x + n, "right")
            b = np.where(n > 0, np.maximum(a, b), end)
            a = np.where(n > 0, a, end)  # no inner part: all are tested on the left side
            band.add(to, k, a, b)
            band.test(to, k, first, a, inside)
            band.test(to, k, b, end, inside)


def bands(p: pa.Table, by: str | None, sums: list[str], largest: list[str], circle: bool) -> Iterator[tuple[object, list[Band]]]:
    """Bands of each kind (None without kinds)."""
    lat, lon = p.column("p_lat").to_numpy(), p.column("p_lon").to_numpy()
    by_lon = (lon + 180) % 360 - 180 if circle else lon
    values = [p.column(c).to_numpy() for c in (*sums, *largest)]
    kinds = p.column(by).combine_chunks().dictionary_encode(null_encoding="encode") if by else None
    kinds = pa.concat_arrays(kinds.chunks) if isinstance(kinds, pa.ChunkedArray) else kinds
    code = kinds.indices.to_numpy() if by else np.zeros(len(lat), np.int32)
    for c in np.unique(code):
        at = np.nonzero(code == c)[0]
        at = at[np.argsort(lat[at], kind="stable")]
        parts = np.array_split(at, -(-len(at) // BAND))
        yield kinds.dictionary[int(c)].as_py() if by else None, [Band(lat[k], lon[k], by_lon[k], [v[k] for v in values[: len(sums)]], [v[k] for v in values[len(sums) :]]) for k in parts]


def totals(queries: DataFrame, points: DataFrame, key: str, *, by: str | None = None, sums: tuple[str, ...] = (), largest: tuple[str, ...] = (), circle: bool = False) -> DataFrame:
    """``key`` (and ``by``), ``n``, the ``sums`` and the ``largest`` of whole numbers over the points (``lat, lon``) of each query that has any.

    Queries are boxes (``west, south, east, north``) or circles (``lat, lon, km`` great-circle kilometres), borders included;
    ``key`` is unique. Nulls count as 0 in sums and are left out of the largest.
    """
    bounds = ["lat", "lon", "km"] if circle else ["west", "south", "east", "north"]
    kinds = [by] if by else []
    known = lambda cs: [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cs]
    for test in known(["lat", "lon"]):
        points = points.where(test)
    for test in known(bounds):
        queries = queries.where(test)
    queries = queries.select(key, *(F.col(c).cast("double").alias(c) for c in bounds))
    counted = ["n", *(f"s_{c}" for c in sums)]
    biggest = [f"m_{c}" for c in largest]
    places = materialize(points.groupBy(F.col("lat").cast("double").alias("p_lat"), F.col("lon").cast("double").alias("p_lon"), *kinds).agg(
        F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"s_{c}") for c in sums), *(F.coalesce(F.max(F.col(c).cast("long")), F.lit(int(LEAST))).alias(f"m_{c}") for c in largest)))
    low, high = places.agg(F.min("p_lat"), F.max("p_lat")).first()
    low, high = (low, high) if low is not None else (0.0, 0.0)
    step = max((high - low) / BINS, 1e-9)
    bin_of = lambda lat: F.least(F.greatest(F.floor((lat - low) / step), F.lit(0)), F.lit(BINS - 1)).cast("int")
    filled = {r["b"]: r["count"] for r in places.groupBy(bin_of(F.col("p_lat")).alias("b")).count().collect()}  # at most BINS rows
    strip, sizes = np.zeros(BINS, np.int64), [0]
    for b in range(BINS):
        if sizes[-1] and sizes[-1] + filled.get(b, 0) > POINTS:
            sizes.append(0)
        strip[b], sizes[-1] = len(sizes) - 1, sizes[-1] + filled.get(b, 0)
    strip_of = lambda lat: F.element_at(F.array(*(F.lit(int(s)) for s in strip)), bin_of(lat) + 1)
    more = F.degrees(F.col("km") / EARTH_KM) + 1e-6
    south, north = (F.col("lat") - more, F.col("lat") + more) if circle else (F.col("south"), F.col("north"))
    asked = queries.where((south <= high) & (north >= low) & (south <= north)).withColumn("strip", F.explode(F.sequence(strip_of(south), strip_of(north))))
    met = {r["strip"]: r["count"] for r in asked.groupBy("strip").count().collect()}  # a row for each strip
    dealt = lambda counts, size: F.element_at(F.array(*(F.lit(max(1, -(-counts[s] // size))) for s in range(len(sizes)))), F.col("strip") + 1)
    p_parts, q_parts = dealt(sizes, POINTS), dealt([met.get(s, 0) for s in range(len(sizes))], ASKED)
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = lambda n, *cs: F.pmod(F.xxhash64(*cs), n).cast("int")
    asked = asked.withColumn("q_part", mine(q_parts, key)).withColumn("p_part", each(p_parts))
    placed = places.withColumn("strip", strip_of(F.col("p_lat"))).withColumn("p_part", mine(p_parts, "p_lat", "p_lon")).withColumn("q_part", each(q_parts))
    visit = in_circles if circle else in_boxes
    kind = lambda df, c: df.schema[c].dataType

    def run(q: pa.Table, p: pa.Table) -> pa.Table:
        out = []
        if q.num_rows and p.num_rows:
            shape = {c: q.column(c).to_numpy() for c in bounds}
            for name, parts in bands(p, by, counted, biggest, circle):
                found = Found(q.num_rows, len(counted), len(biggest))
                for band in parts:
                    visit(band, shape, found)
                some = np.nonzero(found.sums[0] > 0)[0]
                cols = {key: q.column(key).take(pa.array(some))}
                if by:
                    cols[by] = pa.array([name] * len(some), p.schema.field(by).type)
                out.append(pa.table(cols | {c: v[some] for c, v in zip((*counted, *biggest), (*found.sums, *found.largest), strict=True)}))
        return pa.concat_tables(out) if out else empty.slice(0)

    fields = [(key, kind(queries, key)), *((c, kind(places, c)) for c in kinds)]
    schema = ", ".join([*(f"`{c}` {t.simpleString()}" for c, t in fields), *(f"`{c}` long" for c in (*counted, *biggest))])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    keys = ["strip", "p_part", "q_part"]
    parts = asked.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(run, schema)
    top: Column = lambda c: F.nullif(F.max(f"m_{c}"), F.lit(int(LEAST))).alias(c)
    return parts.groupBy(key, *kinds).agg(F.sum("n").alias("n"), *(F.sum(F.col(f"s_{c}").cast("decimal(38,0)")).alias(c) for c in sums), *(top(c) for c in largest))
