"""Polygons that meet boxes against brute force, with trees and parts of a few rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.functions.clip import polygon_meets_box
from terrafold.operators import meeting
from terrafold.operators.shapes import boxes_meet


@pytest.mark.parametrize("small", [False, True])
def test_polygons_met_by_brute_force(spark, monkeypatch, small):
    rng = random.Random(5)
    if small:
        for name, value in (("BOXES", 60), ("EDGES", 90), ("LEAF", 2), ("TESTED", 40), ("VALUES", 3)):
            monkeypatch.setattr(meeting, name, value)
    corner = lambda: {"lon": rng.randrange(40) / 4, "lat": rng.randrange(40) / 4}  # noqa: E731  many touch at borders
    star = lambda n, size: [{"lon": x + size * rng.random(), "lat": y + size * rng.random()} for x, y in [(rng.uniform(0, 10), rng.uniform(0, 10))] for _ in range(n)]
    rings = [[[corner() for _ in range(3)]] for _ in range(60)] + [[star(rng.randrange(3, 9), rng.choice([0.1, 2, 9]))] for _ in range(60)] + [[star(4, 9), star(4, 3)] for _ in range(20)]
    square = lambda x0, y0, x1, y1: [{"lon": float(x), "lat": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]
    rings += [[square(-50, -50, 50, 50)], [square(-50, -50, 50, 50), square(1, 1, 9, 9)], [[corner()]], [[]], [], [[corner(), {"lon": None, "lat": 3.0}, corner(), corner()]]]
    polygons = spark.createDataFrame([(1990 + k % 11, r) for k, r in enumerate(rings)], "value int, rings array<array<struct<lon:double,lat:double>>>")
    boxes = [(k, c["lon"], c["lat"], c["lon"] + w, c["lat"] + w, 1985 + k % 9, 1995 + k % 9) for k in range(150) for c in [corner() if k % 2 else star(1, 3)[0]] for w in [rng.choice([0.0, 0.25, 0.5, 3.0])]]
    boxes += [(500 + k, 5.0, 5.0, 5.5, 5.5, 0, 3000) for k in range(80)] + [(700, None, 0.0, 1.0, 1.0, 0, 3000), (701, 90.0, 80.0, 91.0, 81.0, 1990, 1995)]
    asked = spark.createDataFrame(boxes, "id int, west double, south double, east double, north double, low int, high int")
    got = {r["id"]: (r["n"], r["largest"]) for r in meeting.polygons_met(asked, polygons, "id").collect()}
    box = F.struct("west", "south", "east", "north")
    bounds = geo.rings_bbox(F.col("rings"))
    pairs = asked.crossJoin(polygons).where(boxes_meet(box, bounds) & F.col("value").between(F.col("low"), F.col("high")) & polygon_meets_box(F.col("rings"), box))
    want = {r["id"]: (r["n"], r["m"]) for r in pairs.groupBy("id").agg(F.count("*").alias("n"), F.max("value").alias("m")).collect() if r["id"] != 700}
    assert got == want and len(got) > 150
    assert meeting.polygons_met(asked.limit(0), polygons, "id").count() == 0 and meeting.polygons_met(asked, polygons.limit(0), "id").count() == 0


def test_most_boxes_need_no_test_of_their_own(monkeypatch):
    """Large polygons over a dense field: tests grow with the border (the square root of the boxes), not with the pairs."""
    import pyarrow as pa

    rng, tested = np.random.default_rng(3), []
    border = meeting.Polygons.border
    monkeypatch.setattr(meeting.Polygons, "border", lambda self, of, e, box: (tested.append(len(of)), border(self, of, e, box))[1])
    edges = [[{"ax": x, "ay": y, "bx": x + 6, "b_y": y + 1}, {"ax": x + 6, "ay": y + 1, "bx": x + 2, "b_y": y + 6}, {"ax": x + 2, "ay": y + 6, "bx": x, "b_y": y}] for x, y in rng.uniform(0, 10, (50, 2))]
    polygons = pa.table({"value": np.full(50, 2000), "edges": pa.array(edges), "whole": np.ones(50, bool)})
    work = []
    for n in (4_000, 64_000):
        x, y = rng.uniform(0, 16, (2, n))
        tested.clear()
        meeting.counted(pa.table({"west": x, "south": y, "east": x + 0.5, "north": y + 0.5, "low": np.full(n, 1990), "high": np.full(n, 2020)}), polygons)
        work.append(sum(tested))
    assert work[1] < 8 * work[0] and work[1] < 0.2 * 3 * 50 * 64_000
