"""Lines and polygons against boxes and tiles; bounded searches; clusters of dense places."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrafold.functions import clip
from terrafold.operators import density, shapes, spatial

GEOMETRY = "id long, is_area boolean, paths array<array<struct<lon:double,lat:double>>>"
BOX = "box struct<west:double,south:double,east:double,north:double>"


def test_cut_rings_add_up_to_the_whole(spark):
    """The parts of a ring in the cells of a grid have its area together, also of a concave one."""
    rng = random.Random(2)
    rings = []
    for k in range(12):
        n = rng.randrange(3, 9)
        star = [(math.cos(2 * math.pi * i / n) * (rng.uniform(0.2, 3)) + 5, math.sin(2 * math.pi * i / n) * (rng.uniform(0.2, 3)) + 5) for i in range(n)]
        rings.append((k, [star + star[:1] if k % 2 else star]))
    df = spark.createDataFrame([(k, True, [[{"lon": x, "lat": y} for x, y in r] for r in rs]) for k, rs in rings], GEOMETRY)
    cells = spark.createDataFrame([((x * 1.7, y * 1.7, x * 1.7 + 1.7, y * 1.7 + 1.7),) for x in range(6) for y in range(6)], BOX)
    ring = F.col("paths")[0]
    parts = df.crossJoin(cells).withColumn("part", clip.clip_ring(ring, F.col("box")))
    got = {r["id"]: r["a"] for r in parts.groupBy("id").agg(F.sum(clip.planar_area(F.col("part"))).alias("a")).collect()}
    from terrafold.functions.geo import closed

    want = {r["id"]: r["a"] for r in df.select("id", clip.planar_area(closed(ring)).alias("a")).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    touched = parts.select("id", "box", clip.polygon_meets_box(F.col("paths"), F.col("box")).alias("meets"), clip.planar_area(F.col("part")).alias("a"))
    assert touched.where("a > 1e-9 and not meets").count() == 0
    outside = touched.where("meets and a = 0").count()  # only those that touch at a border could be here
    assert outside == 0


def test_cut_lines_add_up(spark):
    rng = random.Random(4)
    lines = [(k, False, [[{"lon": rng.uniform(0, 10), "lat": rng.uniform(0, 10)} for _ in range(rng.randrange(1, 6))]]) for k in range(30)] + [(99, False, [[{"lon": 3.4, "lat": 1.0}, {"lon": 3.4, "lat": 9.0}]])]
    df = spark.createDataFrame(lines, GEOMETRY)
    cells = spark.createDataFrame([((x * 1.7, y * 1.7, x * 1.7 + 1.7, y * 1.7 + 1.7),) for x in range(6) for y in range(6)], BOX)
    length = F.aggregate(clip.clip_line(F.col("paths")[0], F.col("box")), F.lit(0.0), lambda s, p: s + clip.planar_length(p))
    got = {r["id"]: r["a"] for r in df.crossJoin(cells).groupBy("id").agg(F.sum(length).alias("a")).collect()}
    want = {r["id"]: r["a"] for r in df.select("id", clip.planar_length(F.col("paths")[0]).alias("a")).collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want if k != 99) and abs(got[99] - 2 * want[99]) < 1e-9  # 99 runs along a border of two cells


def test_meeting_a_box(spark):
    box = (1.0, 1.0, 2.0, 2.0)
    square = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    cases = [
        (True, [square(0, 0, 9, 9)], True), (True, [square(0, 0, 9, 9), square(0.5, 0.5, 3, 3)], False), (True, [square(1.2, 1.2, 1.3, 1.3)], True), (True, [square(2, 2, 3, 3)], True),
        (True, [square(2.1, 1, 3, 3)], False), (True, [[(0.0, 1.4), (0.0, 3.4), (1.9, 3.4)]], False), (False, [[(0.0, 0.0), (3.0, 3.0)]], True), (False, [[(0.0, 1.9), (1.9, 3.9)]], False),
        (False, [[(1.5, 1.5)]], True), (False, [[(5.0, 5.0), (6.0, 6.0)], [(1.0, 0.0), (1.0, 1.0)]], True), (False, [[]], False), (True, [[]], False), (False, [[(None, 1.5)]], False),
    ]
    rows = [(k, area, [[{"lon": None if x is None else float(x), "lat": float(y)} for x, y in p] for p in paths]) for k, (area, paths, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, GEOMETRY).withColumn("box", F.struct(*(F.lit(v).alias(n) for v, n in zip(box, ("west", "south", "east", "north"), strict=True))))
    line = F.exists("paths", lambda p: clip.line_meets_box(p, F.col("box")))
    got = {r["id"]: r["m"] for r in df.select("id", F.when(F.col("is_area"), clip.polygon_meets_box(F.col("paths"), F.col("box"))).otherwise(line).alias("m")).collect()}
    assert got == {k: m for k, (_, _, m) in enumerate(cases)}


def test_a_continent_has_few_cells(spark):
    ring = lambda w, s, e, n: [[{"lon": w, "lat": s}, {"lon": e, "lat": s}, {"lon": e, "lat": n}, {"lon": w, "lat": n}]]
    rows = [(1, True, ring(-130.0, 20.0, -60.0, 60.0)), (2, True, ring(10.0, 10.0, 10.00001, 10.00001)), (3, True, ring(-180.0, -89.0, 180.0, 89.0)), (4, True, ring(-0.0001, -0.0001, 0.0001, 0.0001))]
    df = spark.createDataFrame(rows, GEOMETRY)
    cells = {r["id"]: (r["own"], r["n"]) for r in shapes.shape_cells(df, "id").groupBy("id").agg(F.count_if("own").alias("own"), F.count("*").alias("n")).collect()}
    assert all(own <= 9 and n <= 9 * 21 for own, n in cells.values()) and cells[1][0] <= 9
    tiles = spark.createDataFrame([(14, x, 6000 + x % 50) for x in range(3000, 5000)] + [(0, 0, 0), (20, 553460, 494976)], "z int, x long, y long")
    met = shapes.shapes_in_tiles(df, tiles, "id", areas=F.col("is_area")).select("z", "x", "y", "id").collect()
    assert len(met) == len(set(met)) and {r["id"] for r in met if r["z"] == 0} == {1, 2, 3, 4}
    assert sum(r["id"] == 1 for r in met if r["z"] == 14) == sum(1 for x in range(3000, 5000) if -130 <= (x + 1) / 2**14 * 360 - 180 and x / 2**14 * 360 - 180 <= -60)
    assert shapes.shapes_in_tiles(df.limit(0), tiles, "id").count() == 0


def km(a, b):
    (y1, x1), (y2, x2) = [tuple(map(math.radians, p)) for p in (a, b)]
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 12742 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_by_brute_force_and_bounded(spark, monkeypatch, k):
    """Ten times the density doesn't mean ten times the pairs."""
    pairs, within = [], spatial.within_join

    def counted(*args, **kwargs):
        out = within(*args, **kwargs)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(spatial, "within_join", counted)
    rng = random.Random(9)
    places = [(i, rng.uniform(40, 41), rng.uniform(-120, -119), rng.choice([5, 60, 150])) for i in range(60)] + [(100, 89.9, 10.0, 50), (101, 0.0, 179.99, 50), (102, None, 1.0, 50), (103, 40.5, -119.5, None)]
    left = spark.createDataFrame(places, "id long, lat double, lon double, km int")
    per_place = {}
    for n in (400, 4000):
        spots = [(i, rng.uniform(39.5, 41.5), rng.uniform(-120.5, -118.5)) for i in range(n)] + [(n, 89.95, -170.0), (n + 1, 0.0, -179.99), (n + 2, 0.0, -179.99)]
        right = spark.createDataFrame(spots, "rid long, r_lat double, r_lon double")
        pairs.clear()
        got = spatial.nearest_k(left, right, "id", "rid", F.col("km"), k=k, right_at=("r_lat", "r_lon")).collect()
        per_place[n] = sum(pairs) / 62
        for i, lat, lon, cut in places:
            if lat is None or cut is None:
                assert not [r for r in got if r["id"] == i]
                continue
            near = sorted((km((lat, lon), s[1:]), s[0]) for s in spots)
            want = [s for d, s in near if d <= cut][:k]
            assert [r["rid"] for r in sorted((r for r in got if r["id"] == i), key=lambda r: r["place"])] == want
    assert per_place[4000] < 60 * k and per_place[400] < 60 * k
    assert spatial.nearest_k(left, right.limit(0), "id", "rid", F.lit(9.0), right_at=("r_lat", "r_lon")).count() == 0
    assert spatial.nearest_k(left.limit(0), right, "id", "rid", F.lit(9.0), right_at=("r_lat", "r_lon")).count() == 0


def brute_clusters(points, eps, least):
    near = lambda a, b: math.hypot(a[1] - b[1], a[2] - b[2]) <= eps
    out = {}
    core = {p[0]: p for p in points if sum(near(p, q) for q in points) >= least}
    label = {i: i for i in core}
    changed = True
    while changed:
        changed = False
        for i, p in core.items():
            m = min(label[j] for j, q in core.items() if near(p, q))
            if m < label[i]:
                label[i], changed = m, True
    for p in points:
        reach = [label[i] for i, q in core.items() if near(p, q)]
        if reach:
            out[p[0]] = label[p[0]] if p[0] in label else min(reach)
    return out


def test_clusters_by_brute_force(spark):
    rng = random.Random(11)
    points = [(i, *(rng.gauss(c, 0.05) for c in rng.choice([(0, 0), (0.3, 0.1), (1, 1), (-0.5, 0.2)]))) for i in range(220)]
    points += [(300 + i, 2 + 0.1 * i, 2.0) for i in range(6)] + [(400 + i, 3.0, 3.0) for i in range(4)] + [(500, 9.0, 9.0), (501, 9.0, 9.05)]
    points += [(600 + i, 5 + (i % 20) * 1e-4, 5 + (i // 20) * 1e-4) for i in range(60)] + [(700 + i, 5 + (i % 20) * 1e-4, 5.1001 + (i // 20) * 1e-4) for i in range(60)]  # two dense places at about eps
    df = spark.createDataFrame([("a", *p) for p in points] + [("b", 1000 + p[0], *p[1:]) for p in points[:5]], "kind string, id long, lat double, lon double")
    for eps, least in ((0.1, 3), (0.1, 8), (0.0999, 5)):
        got = {r["id"]: r["cluster"] for r in density.dbscan(df.where("kind = 'a'"), part="kind", eps=eps, min_points=least).collect()}
        assert got == brute_clusters(points, eps, least)
    assert density.dbscan(df.limit(0), part="kind", eps=0.1, min_points=3).count() == 0


def test_a_dense_cell_writes_no_pairs(spark, monkeypatch):
    written, keep = [], density.materialize

    def counted(df, *args, **kwargs):
        out = keep(df, *args, **kwargs)
        written.append((set(out.columns), out.count()))
        return out

    monkeypatch.setattr(density, "materialize", counted)
    df = spark.range(10_000).select(F.lit("a").alias("kind"), "id", (40 + F.pmod(F.xxhash64("id"), F.lit(99_991)) / 5_000_000).alias("lat"), (-120 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(99_989)) / 5_000_000).alias("lon"))
    more = spark.createDataFrame([("a", 20_000 + i, 40.01, -119.97 + 0.04 * i) for i in range(5)], df.schema)
    got = density.dbscan(df.unionByName(more), part="kind", eps=0.05, min_points=3)
    assert got.agg(F.count_distinct("cluster")).first()[0] == 1 and got.count() == 10_005
    pairs = max(n for columns, n in written if {"a", "b"} <= columns)
    assert pairs <= 4 * 10_005 and all(n <= 4 * 10_005 for _, n in written)


def test_dense_places_are_written_once(spark, monkeypatch):
    written, keep = [], density.materialize

    def counted(df, *args, **kwargs):
        out = keep(df, *args, **kwargs)
        written.append(out.count())
        return out

    monkeypatch.setattr(density, "materialize", counted)
    df = spark.range(8_000).select(F.lit("a").alias("kind"), "id", (40 + F.pmod(F.xxhash64("id"), F.lit(99_991)) / 500_000).alias("lat"), (-120 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(99_989)) / 500_000).alias("lon"))
    got = density.dbscan(df, part="kind", eps=0.05, min_points=3)
    assert got.agg(F.min("cluster"), F.max("cluster"), F.count("*")).first() == (0, 0, 8_000)
    assert sum(written) <= 2 * 8_000


def test_shapes_that_a_tile_holds_are_not_tested(spark):
    point = lambda lon, lat: (lon, lat)
    rows = [(1, [[point(1.0, 1.0), point(2.0, 2.0)]]), (2, [[point(1.0, None), point(None, 2.0)]]), (3, [[point(-5.0, 1.0), point(5.0, 1.0)]]), (4, [[point(9.0, 9.0)]])]
    df = spark.createDataFrame(rows, "id int, paths array<array<struct<lon:double,lat:double>>>")
    tiles = spark.createDataFrame([(3, 4, 3)], "z int, x long, y long")  # 0 to 45 east, 0 to 41 north
    assert {(r["id"], r["held"]) for r in shapes.shapes_in_tiles(df, tiles, "id").collect()} == {(1, True), (3, False), (4, True)}
