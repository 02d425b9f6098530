"""Geometry and models against hand-derived vectors and properties."""

import math

import pytest
from pyspark.sql import functions as F

from terrafold.functions import geo, models
from terrafold.operators import fire_series, maintenance, spatial, tracks

RING = "array(struct(0D as lon, 0D as lat), struct(1D as lon, 0D as lat), struct(1D as lon, 1D as lat), struct(0D as lon, 1D as lat))"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_distances(spark):
    lit = F.lit
    assert abs(value(spark, geo.haversine_m(lit(0.0), lit(0.0), lit(0.0), lit(1.0))) - 111194.927) < 0.01
    assert abs(value(spark, geo.haversine_m(lit(-122.4194), lit(37.7749), lit(-120.5078), lit(46.5982))) - 993581.509) < 0.01
    assert value(spark, geo.haversine_km(lit(5.0), lit(6.0), lit(5.0), lit(6.0))) == 0
    assert abs(value(spark, geo.bearing(lit(0.0), lit(0.0), lit(1.0), lit(0.0))) - 90) < 1e-9
    line = F.expr("array(struct(0D as lon, 0D as lat), struct(0D as lon, 1D as lat), struct(0D as lon, 2D as lat))")
    assert abs(value(spark, geo.line_length_m(line)) - 2 * 111194.927) < 0.02
    assert value(spark, geo.line_length_m(F.slice(line, 1, 1))) == 0


def test_rings(spark):
    ring = F.expr(RING)
    assert abs(value(spark, geo.ring_area_m2(ring)) - 12363683990.261) < 1
    assert value(spark, geo.ring_area_m2(F.slice(ring, 1, 2))) == 0
    inside = lambda y, x: value(spark, geo.in_rings(F.lit(y), F.lit(x), F.array(ring)))
    assert inside(0.5, 0.5) and not inside(0.5, 1.5) and not inside(-0.1, 0.5)
    hole = F.expr(RING.replace("1D", "0.5D"))
    assert not value(spark, geo.in_rings(F.lit(0.25), F.lit(0.25), F.array(ring, hole)))
    assert value(spark, F.size(geo.closed(ring))) == 5 == value(spark, F.size(geo.closed(geo.closed(ring))))
    assert value(spark, F.size(geo.edge_midpoints(ring))) == 3
    assert value(spark, geo.ring_centroid(ring)).asDict() == {"lon": 0.5, "lat": 0.5}
    assert value(spark, F.size(geo.circle_ring(F.lit(1.0), F.lit(2.0), F.lit(0.1)))) == 65
    assert value(spark, geo.rings_bbox(F.array(ring))).asDict() == {"west": 0, "south": 0, "east": 1, "north": 1}


@pytest.mark.parametrize("m, unit, text", [(1000.0, "metric", "1.00 km"), (500.0, "metric", "500 m"), (0.0, "metric", "0 m"), (1609.344, "imperial", "1.00 mi"), (1609.0, "imperial", "5279 ft"), (100.0, "imperial", "328 ft"), (999.6, "metric", "1000 m")])
def test_formats(spark, m, unit, text):
    assert value(spark, geo.format_distance(F.lit(m), unit)) == text


def test_tiles_and_wind(spark):
    z = F.lit(3)
    box = value(spark, geo.tile_bounds(geo.tile_x(F.lit(-120.0), z), geo.tile_y(F.lit(38.0), z), z))
    assert box["west"] <= -120 < box["east"] and box["south"] <= 38 < box["north"]
    assert [value(spark, geo.wind_sector(F.lit(d))) for d in (180.0, 0.0, 270.0, 359.0)] == ["N", "S", "E", "S"]


def test_fire_risk(spark):
    risk = lambda *a: value(spark, models.fire_risk(F.lit("x"), *map(F.lit, a[1:]), fuel=F.lit(a[0])))
    assert risk(0.95, 45.0, 180.0, 10.0, 15.0) == 89
    assert risk(0.85, 10.0, 180.0, 40.0, 6.0) == 58
    assert risk(0.5, 0.0, 0.0, 100.0, 0.0) == 15


WEATHER = [((17.0, 42.0, 25.0, 0.0), (87.7, 8.5, 19.0), 2.3, 8.4, 1.9), ((20.0, 21.0, 25.0, 2.4), (86.2, 10.4, 23.6), 1.8, 10.4, 1.4), ((8.5, 40.0, 17.0, 0.0), (87.0, 11.8, 26.1), 1.4, 11.7, 0.9), ((6.5, 25.0, 6.0, 0.0), (88.8, 13.2, 28.2), 1.0, 13.1, 0.7)]


def test_fire_weather_series(spark):
    state = (85.0, 6.0, 15.0)
    for day, codes, isi, bui, fwi in WEATHER:
        state = fire_series.next_state(*day, 4, state)
        assert state == codes
    rows = [(1, f"2024-04-{k + 1:02d}", *w[0]) for k, w in enumerate(WEATHER)]
    days = spark.createDataFrame(rows, "station_id long, day string, temp double, rh double, wind_kmh double, rain double").withColumn("day", F.to_date("day"))
    got = fire_series.fire_weather_series(days, variant="as_written").orderBy("day").collect()
    assert [(r["isi"], r["bui"], r["fwi"]) for r in got] == [w[2:] for w in WEATHER]
    first = days.limit(1).select(models.fire_weather(*(F.col(c) for c in ("temp", "rh", "wind_kmh", "rain")), F.month("day")).alias("f")).first()["f"]
    assert (first["ffmc"], first["dmc"], first["dc"], first["isi"], first["fwi"]) == (87.7, 8.5, 19.0, 10.9, 10.1)
    assert value(spark, models.bui(F.lit(0.0), F.lit(0.0))) == 0


def test_day_and_series_agree(spark, sf_dir):
    from terrafold.plans.views import view

    days = view(spark, sf_dir, "weather_days")
    for r in days.select("*", models.fire_weather(*(F.col(c) for c in ("temp", "rh", "wind_kmh", "rain")), F.month("day")).alias("f")).limit(80).collect():
        want = fire_series.next_state(r["temp"], r["rh"], r["wind_kmh"], r["rain"], r["day"].month, (85.0, 6.0, 15.0))
        assert all(abs(a - b) < 0.11 for a, b in zip(r["f"][:3], want))


@pytest.mark.parametrize("oc, bd, degrees, cover, score", [(10.0, 1.3, 5.0, "cropland", 34), (10.0, 1.3, 5.0, "forest", 0), (10.0, 1.3, 5.0, "pasture", 2), (2.0, 1.4, 10.0, "grassland", 18)])
def test_erosion(spark, oc, bd, degrees, cover, score):
    assert value(spark, models.erosion_score(F.lit(oc), F.lit(bd), F.lit(degrees), F.lit(cover))) == score


@pytest.mark.parametrize("oc, cover, rain, gain, years", [(15.0, "reforestation", 600.0, 1.58, 32), (15.0, "biochar", 1000.0, 3.0, 17), (70.0, "biochar", 600.0, 0, 100)])
def test_carbon(spark, oc, cover, rain, gain, years):
    got = value(spark, models.carbon_potential(F.lit(oc), F.lit(1.2), F.lit(cover), F.lit(rain)))
    assert (got["gain"], got["years"]) == (gain, years)


def test_bands(spark):
    cond = [value(spark, models.streamflow_condition(F.lit(p))) for p in (4, 5, 9, 10, 24, 25, 75, 76)]
    assert cond == ["critically_low", "low", "low", "below_normal", "below_normal", "normal", "normal", "above_normal"]
    assert value(spark, models.streamflow_condition(F.lit(None).cast("int"))) == "unknown"
    assert [value(spark, models.distance_severity(F.lit(k))) for k in (9.99, 10.0, 29.99, 30.0)] == ["critical", "warning", "warning", "info"]
    assert [value(spark, models.erosion_class(F.lit(s))) for s in (9, 10, 29, 30, 54, 55, 74, 75)] == ["very_low", "low", "low", "moderate", "moderate", "high", "high", "very_high"]
    assert [value(spark, models.drainage_class(F.lit(x))) for x in ("Moderately well drained", "Very poorly drained", "Well drained", "", None)] == ["moderately_well", "very_poorly", "well", "unknown", "unknown"]
    assert value(spark, models.piecewise(F.lit(5.0), ((0, 6), (10, 20)))) == 13
    assert value(spark, models.osm_height(F.create_map(F.lit("building:levels"), F.lit("4")))) == 14


def test_hull_and_simplify():
    assert spatial.hull_of([(0, 0), (1, 1), (2, 2)]) == [(0, 0), (2, 2)]
    assert spatial.hull_of([(0, 0)]) == [(0, 0)]
    assert sorted(spatial.hull_of([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0)])) == [(0, 0), (0, 2), (2, 0), (2, 2)]
    import numpy as np

    assert tracks.kept_points(np.array([0.0, 1, 2, 3]), np.array([0.0, 0.00001, 1, 0]), 1e-4).tolist() == [True, True, True, True]
    assert tracks.kept_points(np.array([0.0, 1, 2]), np.array([0.0, 0.00001, 0]), 1e-4).tolist() == [True, False, True]


def test_hulls_keep_every_corner(spark):
    import random

    random.seed(2)
    rows = [("a", random.random(), random.random()) for _ in range(500)] + [("b", 1.0, 1.0), ("c", 1.0, 1.0), ("c", 2.0, 3.0)]
    got = {r["k"]: r for r in spatial.convex_hulls(spark.createDataFrame(rows, "k string, lat double, lon double"), "k").collect()}
    want = spatial.hull_of([(lon, lat) for k, lat, lon in rows if k == "a"])
    assert sorted((p["lon"], p["lat"]) for p in got["a"]["ring"][:-1]) == sorted(want)
    assert (got["b"]["kind"], got["c"]["kind"], got["a"]["kind"]) == ("Point", "LineString", "Polygon")


def test_dbscan_ignores_row_order(spark, sf_dir):
    from terrafold.plans.views import view

    rows = view(spark, sf_dir, "strategy_requests").select("id", "strategy_type", "lat", "lon")
    run = lambda df: sorted(map(tuple, spatial.dbscan(df, part="strategy_type", eps=0.1, min_points=3).select("id", "cluster").collect()))
    assert run(rows) == run(rows.orderBy(F.desc("id")).repartition(7))


def test_within_join_at_the_date_line_and_poles(spark):
    import random

    random.seed(9)
    place = lambda: (random.choice([89.9, -89.5, 0.0, 60.0]) + random.uniform(-0.1, 0.1), random.choice([179.99, -179.99, 0.0]) + random.uniform(-0.3, 0.3))
    a, b = [(k, *place()) for k in range(60)], [(k, *place()) for k in range(60)]

    def km(p, q):
        x = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(x)))

    left = spark.createDataFrame(a, "id long, lat double, lon double")
    right = spark.createDataFrame(b, "rid long, r_lat double, r_lon double")
    got = {(r["id"], r["rid"]) for r in spatial.within_join(left, right, F.lit(40.0), right_at=("r_lat", "r_lon")).collect()}
    assert got == {(p[0], q[0]) for p in a for q in b if km(p, q) <= 40}


def test_quota_counts_allowed_requests_only(spark):
    rows = [("a", f"2024-01-01 00:{m:02d}:00", m) for m in range(0, 60, 2)] + [("a", "2024-01-01 01:01:00", 99)]
    df = spark.createDataFrame(rows, "asset_id string, time string, id long").withColumn("time", F.to_timestamp("time"))
    got = {r["id"]: r["allowed"] for r in maintenance.allowed_requests(df, limit=20).collect()}
    assert sum(got[m] for m in range(0, 60, 2)) == 20 and not got[58] and got[99]


def test_hulls_of_many_distinct_latitudes(spark):
    import random

    random.seed(3)
    points = [(random.uniform(0, 0.02), random.uniform(0, 0.02)) for _ in range(4000)]
    df = spark.createDataFrame([("a", y, x) for x, y in points], "k string, lat double, lon double")
    assert spatial.hull_corners(df, "k").count() < 1000
    ring = spatial.convex_hulls(df, "k").first()["ring"]
    assert {(p["lon"], p["lat"]) for p in ring} == set(spatial.hull_of(points))
