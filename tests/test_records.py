"""As-of joins, kept partials, the vector index and label tables against brute force."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import models
from terrafold.operators import vectors
from terrafold.operators.asof import as_of
from terrafold.operators.vectors import VectorIndex, top_similar
from terrafold.plans import QUERIES
from terrafold.streaming.partials import PartialStore


def test_as_of_by_brute_force(spark):
    rng = random.Random(6)
    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(days=k)
    left = [(i, rng.choice(["hot", "hot", "a", "b", None]), day(rng.randrange(-20, 200)), "x") for i in range(150)] + [(900, "a", None, "x"), (901, "none", day(3), "x")]
    right = [(rng.choice(["hot", "a", "b", None]), day(rng.randrange(0, 180)), rng.randrange(9), i) for i in range(90)] + [("a", None, 1, -1), ("b", day(5), None, -2)]
    a = spark.createDataFrame(left, "id int, k string, at date, v string")
    b = spark.createDataFrame(right, "k string, seen_on date, v int, w int")
    for days in (7, 30, 1000):
        got = {r["id"]: (r["seen"], r["level"], r["w"]) for r in as_of(a, b.withColumnRenamed("v", "level"), ["k"], "at", "seen_on", ["level", "w"], days=days).collect()}
        want = {}
        for i, k, at, _ in left:
            known = [(t, (-1 if v is None else v), w) for kk, t, v, w in right if k is not None and kk == k and t is not None and at is not None and t <= at]
            last = max(known, default=None)
            want[i] = (None, None, None) if last is None else (last[0], None if last[1] < 0 else last[1], last[2])
        assert got == want
    assert as_of(a, b.withColumnRenamed("v", "level").limit(0), ["k"], "at", "seen_on", ["level"]).where("seen is not null").count() == 0
    assert as_of(a.limit(0), b.withColumnRenamed("v", "level"), ["k"], "at", "seen_on", ["level"]).count() == 0


def test_partials_stay_right_with_late_and_repeated_batches(spark, tmp_path):
    rng = random.Random(8)
    rows = [(datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randrange(600)), rng.choice([None, rng.uniform(-9, 99)])) for _ in range(300)]
    df = lambda part: spark.createDataFrame(part, "t timestamp, v double")
    store, hour = PartialStore(f"{tmp_path}/p"), F.date_trunc("hour", "t")
    assert store.read(spark).count() == 0
    for n in range(3):
        store.add(df(rows[n * 60 : n * 60 + 60]), n, hour, "v")
    store.add(df(rows[60:120]), 1, hour, "v")  # again
    store.compact(spark)
    store.compact(spark)
    store.add(df(rows[120:180]), 2, hour, "v")  # merged already
    store.add(df(rows[180:]), 3, hour, "v")
    got = {r["bucket"]: (round(r["mean"], 9), r["least"], r["most"], r["n"]) for r in store.read(spark).collect() if r["n"]}
    want = {}
    for t, v in rows:
        if v is not None:
            want.setdefault(t.replace(minute=0), []).append(v)
    assert {k: (v[1:], abs(v[0] - sum(want[k]) / len(want[k])) < 1e-6) for k, v in got.items()} == {k: ((min(v), max(v), len(v)), True) for k, v in want.items()}


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 1, (12, 16))
    x = middles[rng.integers(0, 12, 1500)] + rng.normal(0, 0.15, (1500, 16))
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)] + [(2000 + k, x[3].astype(np.float32).tolist()) for k in range(40)] + [(3000, None), (3001, []), (3002, [float("nan")] * 16), (None, [1.0] * 16)]
    return spark.createDataFrame(rows, "id long, v array<float>")


def test_index_recall_and_exact_way(spark, clustered):
    queries = clustered.where("id % 20 = 0 and id < 3000")
    index = VectorIndex.fit(clustered, sample=700, cells=30)
    assert index.rows.count() == 1540 and index.probes < 15
    order = lambda df: {(r["id"], r["place"], r["other"]) for r in df.collect()}
    truth = order(top_similar(queries, clustered.where("id < 3000")))
    assert order(index.search(queries, exact=True)) == truth
    near = {(i, o) for i, _, o in order(index.search(queries))}
    assert len(near & {(i, o) for i, _, o in truth}) >= 0.9 * len(truth)
    assert VectorIndex.fit(clustered.limit(0)).search(queries).count() == 0


def test_index_recall_on_the_sample_table(spark, sf_dir):
    rows = QUERIES["x2_index_recall"](spark, sf_dir).collect()
    assert sum(r["found"] for r in rows) >= 0.9 * sum(r["wanted"] for r in rows) > 0


def test_wordings_and_badges(spark):
    df = spark.createDataFrame([(k,) for k in (None, -1, 0, 3, 4, 5, 9)], "dm int")
    got = [tuple(r) for r in df.select(*(models.drought_label(F.col("dm"), w) for w in ("layer", "record", "interface", "export"))).collect()]
    assert got[0] == ("None", None, None, "None") and got[1] == ("None", None, "D-1", "None")
    assert got[2] == ("D0 Abnormally Dry", "D0 (Abnormally Dry)", "D0 - Abnormally Dry", "None")
    assert got[4] == ("D4 Exceptional Drought", "D4 (Exceptional Drought)", "D4 - Exceptional", "D3 Extreme")
    assert got[5][2:] == ("D5", "D4 Exceptional") and got[6][3] == "D4 Exceptional"
    edges = spark.createDataFrame([(60.0, 3.0, 20.0, 21), (30.0, 2.0, 40.0, 6), (29.0, 1.0, 41.0, 5), (None, None, None, 0)], "r double, d double, p double, n int")
    assert [r[0] for r in edges.select(F.concat_ws(" ", *(models.badges(*map(F.col, "rdpn"))[c] for c in ("risk", "drought", "streamflow", "fires")))).collect()] == [
        "High/red Severe/red Critically Low/red High/red", "Moderate/yellow Moderate/yellow Below Normal/yellow Elevated/yellow", "Low/green Normal/green Normal/green Normal/green", "Low/green Normal/green Normal/green Normal/green"]


def test_candidates_are_few_more_than_fits(spark):
    from terrafold.plans import recommend

    rng = random.Random(12)
    places = spark.createDataFrame([(k, rng.randrange(1, 14), rng.uniform(100, 1900), rng.uniform(4.5, 9)) for k in range(600)] + [(900, 3, None, 6.0)], "id int, zone int, precip double, ph double")
    kinds = []
    for k in range(400):
        zone, rain, ph = rng.randrange(1, 12), rng.uniform(100, 1500), rng.uniform(4, 8)
        kinds.append((k, zone, zone + rng.randrange(4), rain, rain + rng.uniform(50, 900), ph, ph + rng.uniform(0.1, 2), k % 6 == 0))
    species = spark.createDataFrame([*kinds, (900, 1, 5, None, 900.0, 4.0, 8.0, False)], "id int, zone_low int, zone_high int, min_precip double, max_precip double, min_ph double, max_ph double, nitrogen_fixer boolean")
    met = recommend.in_same_cell(places, species)
    fits = met.where("precip BETWEEN min_precip AND max_precip AND ph BETWEEN min_ph AND max_ph")
    want = {(p["id"], s[0]) for p in places.collect() if p["precip"] for s in kinds if s[1] <= p["zone"] <= s[2] and s[3] <= p["precip"] <= s[4] and s[5] <= p["ph"] <= s[6]}
    assert {(r["id"], r["species_id"]) for r in fits.select("id", "species_id").collect()} == want
    assert met.count() <= 2 * len(want) and met.count() < 0.25 * sum(s[1] <= p["zone"] <= s[2] for p in places.collect() for s in kinds)


def test_december_is_beside_january(spark):
    from terrafold.plans.profiles import seasonal_depth

    rows = [(1, datetime.date(2020, 12, 5), 10.0), (1, datetime.date(2021, 1, 5), 20.0), (1, datetime.date(2021, 2, 5), None), (1, datetime.date(2022, 6, 1), 7.0)]
    got = {r["month"]: (r["depth"], r["n"]) for r in seasonal_depth(spark.createDataFrame(rows, "well_id int, read_on date, depth double")).collect()}
    assert got == {11: (10.0, 1), 12: (15.0, 2), 1: (15.0, 2), 2: (20.0, 1), 5: (7.0, 1), 6: (7.0, 1), 7: (7.0, 1)}


def test_zone_messages(spark):
    import json

    from terrafold.plans.profiles import zone_messages

    zones = spark.createDataFrame([(4, "keyline", 3, 9, -1.0, 2.0, 0.5, 3.0, 2.5, -0.2)], "zone_id long, strategy_type string, requests long, votes long, west double, south double, east double, north double, lat double, lon double")
    r = zone_messages(zones, "2024-01-31T00:00:00Z").first()
    assert r["channel"] == "zones" and json.loads(r["value"]) == {"event": "priority_zones_updated", "zone_id": 4, "strategy_type": "keyline", "requests": 3, "votes": 9, "bbox": [-1.0, 2.0, 0.5, 3.0], "lat": 2.5, "lon": -0.2, "timestamp": "2024-01-31T00:00:00Z"}


def test_simplified_tracks_by_brute_force(spark, sf_dir):
    """Of each asset's day the points that a plain recursion keeps."""
    from terrafold.plans.views import view

    def kept(points, lo, hi, eps):
        (x0, y0), (x1, y1) = points[lo], points[hi]
        dx, dy = x1 - x0, y1 - y0

        def away(k):
            x, y = points[k]
            u = 0.0 if dx == dy == 0 else max(0.0, min(1.0, ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy)))
            return np.hypot(x - x0 - u * dx, y - y0 - u * dy)

        far = max(range(lo + 1, hi), key=lambda k: (away(k), -k), default=None)
        if far is None or away(far) <= eps:
            return {lo, hi}
        return kept(points, lo, far, eps) | kept(points, far, hi, eps)

    days = {}
    for r in view(spark, sf_dir, "positions").orderBy("time", "id").collect():
        days.setdefault((r["asset_id"], r["time"].date()), []).append(r)
    want = {rows[k]["id"] for rows in days.values() for k in (kept([(r["lon"], r["lat"]) for r in rows], 0, len(rows) - 1, 0.05) if len(rows) > 1 else {0})}
    assert {r["id"] for r in QUERIES["g10_simplified_tracks"](spark, sf_dir).collect()} == want


def test_hulls_of_clusters_by_brute_force(spark, sf_dir):
    """Every corner of a hull is a point of the cluster, every point is inside, and the ring turns one way."""
    import json

    from terrafold.operators import spatial
    from terrafold.plans.views import view

    rows = view(spark, sf_dir, "strategy_requests").where("status <> 'completed'").select("id", "strategy_type", "lat", "lon")
    members = {}
    for r in spatial.dbscan(rows, part="strategy_type", eps=0.05, min_points=3).collect():
        members.setdefault(r["cluster"], []).append((r["lon"], r["lat"]))
    got = QUERIES["a22_cluster_rollup"](spark, sf_dir).collect()
    assert {r["cluster"]: r["requests"] for r in got} == {c: len(p) for c, p in members.items()}
    for r in got:
        ring, points = [(p["lon"], p["lat"]) for p in json.loads(r["ring"])], members[r["cluster"]]
        assert set(ring) <= set(points)
        if r["kind"] == "Polygon":
            turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
            assert ring[0] == ring[-1] and all(turn(a, b, p) >= -1e-12 for a, b in zip(ring, ring[1:], strict=False) for p in points)
        else:
            assert len(ring) == min(2, len(set(points)))


def test_search_parts_are_bounded_and_never_broadcast(spark, clustered, monkeypatch):
    rows = clustered.where("id < 3000")
    queries = rows.where("id % 20 = 0")
    order = lambda df: {(r["id"], r["place"], r["other"]) for r in df.collect()}
    truth = order(vectors.top_similar(queries, rows, part=5000))
    sizes = []
    monkeypatch.setattr(vectors, "ASKED", 50)
    index = VectorIndex.fit(clustered, sample=700, cells=30, part=100)
    assert index.rows.groupBy("bundle").count().agg(F.max("count")).first()[0] <= 160
    for found in (vectors.top_similar(queries, rows, part=100), index.search(queries, exact=True)):
        assert order(found) == truth
        sizes.append(found._jdf.queryExecution().executedPlan().toString())
    assert all("CoGroup" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan for plan in sizes)


def test_tracks_over_several_batches(spark):
    import numpy as np

    from terrafold.operators.tracks import kept_points, simplify

    rng = random.Random(8)
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, rng.choice([1, 2, 3, None]) if k % 5 else 9, start + datetime.timedelta(minutes=rng.randrange(4000)), rng.uniform(0, 1), rng.uniform(0, 1)) for k in range(700)]
    df = spark.createDataFrame(rows, "id long, asset_id long, time timestamp, lat double, lon double")
    tracks = {}
    for r in sorted(df.collect(), key=lambda r: (r["time"], r["id"])):
        tracks.setdefault((r["asset_id"], r["time"].date()), []).append(r)
    want = {r["id"] for t in tracks.values() for r, stays in zip(t, kept_points(np.array([r["lon"] for r in t]), np.array([r["lat"] for r in t]), 0.3), strict=True) if stays}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = simplify(df, 0.3)
        assert {r["id"] for r in found.collect()} == want and len(want) < 600
        assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equal_species_and_places_share_their_lists(spark):
    from terrafold.plans import recommend

    rng = random.Random(3)
    kinds = [(z, z + 1 + k % 3, 100.0 * k, 100.0 * k + 500, 4.0 + k / 10, 6.0 + k / 10) for k in range(12) for z in (2, 4)]
    species = [(k, *kinds[k * k % len(kinds)], None if k % 11 == 0 else k % 5 == 0) for k in range(500)]
    places = [(k, rng.randrange(2, 8), 100.0 * rng.randrange(16), 4.5 + rng.randrange(20) / 10) for k in range(150)] + [(900, None, 300.0, 5.0)]
    want = {}
    for i, zone, rain, ph in places[:-1]:
        fits = [s for s in species if s[1] <= zone <= s[2] and s[3] <= rain <= s[4] and s[5] <= ph <= s[6]]
        rare = sum(bool(s[7]) for s in fits) * 4 < len(fits)
        mid = lambda v, a, b: 1 - abs(v - (a + b) / 2) / (b - a)
        scored = [(-((min(1.0, (mid(zone, s[1], s[2]) + mid(rain, s[3], s[4]) + mid(ph, s[5], s[6])) / 3 + (0.1 if s[7] and rare else 0.0)) * 10000 + 0.5) // 1 / 10000), s[0]) for s in fits]
        want |= {(i, place + 1): (s, -score) for place, (score, s) in enumerate(sorted(scored)[:20])}
    found = recommend.suited(spark.createDataFrame(places, "id long, zone int, precip double, ph double"), spark.createDataFrame(species, "id long, zone_low int, zone_high int, min_precip double, max_precip double, min_ph double, max_ph double, nitrogen_fixer boolean"))
    assert {(r["id"], r["position"]): (r["species_id"], r["score"]) for r in found.collect()} == want and len(want) > 1000
    columns = "id long, zone_low int, zone_high int, min_precip double, max_precip double, min_ph double, max_ph double"
    met = recommend.in_same_cell(spark.createDataFrame(places, "id long, zone int, precip double, ph double"), spark.createDataFrame([s[:7] for s in species], columns))
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [1 << 19, 0])
def test_pairs_of_lists_and_places_are_not_broadcast(spark, monkeypatch, most):
    """Their tables are far larger than the files by which Spark sizes them."""
    from terrafold.plans import recommend

    monkeypatch.setattr(recommend, "MAX_EDGES", most, raising=False)
    places = spark.range(40).selectExpr("id", "CAST(1 + id % 5 AS INT) AS zone", "CAST(300 + 20 * (id % 30) AS DOUBLE) AS precip", "CAST(6 + (id % 4) / 4 AS DOUBLE) AS ph")
    species = spark.range(60).selectExpr("id", "CAST(1 + id % 2 AS INT) AS zone_low", "CAST(4 + id % 3 AS INT) AS zone_high", "100D + id AS min_precip", "1000D AS max_precip", "5D AS min_ph", "CAST(8 + id % 3 AS DOUBLE) AS max_ph", "id % 6 = 0 AS nitrogen_fixer")
    pairs = spark.createDataFrame([(a, a + d, "companion" if (a + d) % 4 else "antagonist") for a in range(60) for d in (0, 1, 3, 7, 20)], "a long, b long, relation string")
    found = recommend.companions(places, species, pairs)
    lists, friends, want = {}, {}, set()
    for r in recommend.suited(places, species).collect():
        lists.setdefault(r["id"], []).append((r["position"], r["species_id"]))
    for r in pairs.where("relation = 'companion'").collect():
        friends.setdefault(r["a"], set()).add(r["b"])
        friends.setdefault(r["b"], set()).add(r["a"])
    for i, own in lists.items():
        for _, s in own:
            want |= {(i, s, o, k) for k, o in enumerate([o for _, o in sorted(own) if o in friends.get(s, ())][:3], 1)}
    assert {tuple(r) for r in found.collect()} == want and len(want) > 1000
    plan = found._jdf.queryExecution().executedPlan().initialPlan().toString().split("\n")  # by the sizes of files
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    for k, line in enumerate(plan):
        if "BroadcastExchange" in line:
            end = next((j for j in range(k + 1, len(plan)) if depth[j] <= depth[k]), len(plan))
            assert not any("inline(" in x for x in plan[k:end])
    broadcast = [line for line in plan if "BroadcastHashJoin [" in line]
    assert not any("[zone" in line for line in broadcast) and any("[a#" in line for line in broadcast) == bool(most)
