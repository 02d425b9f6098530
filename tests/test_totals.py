"""Totals in boxes and circles against brute force, with bands and parts of a few points."""

import math
import random

import pytest

from terrafold.operators import totals as operator
from terrafold.operators.totals import km_between, totals


@pytest.mark.parametrize("circle", [False, True])
def test_totals_by_brute_force(spark, monkeypatch, circle):
    rng = random.Random(4)
    for name, value in (("POINTS", 90), ("BAND", 16), ("ASKED", 40), ("TESTED", 50)):
        monkeypatch.setattr(operator, name, value)
    place = lambda k: (40.0, -120.0) if k % 9 == 0 else (rng.uniform(-89, 89), rng.uniform(-180, 180)) if k % 3 else (rng.uniform(38, 42), rng.uniform(178, 182) - 360 * (k % 2))
    points = [(*place(k), rng.choice(["a", "b", None]), rng.randrange(-50, 50) if k % 7 else None) for k in range(500)] + [(None, 1.0, "a", 1), (float("nan"), 1.0, "a", 1)]
    if circle:
        queries = [(k, *place(k)[:2], rng.choice([0.0, 30.0, 400.0, 3000.0, 11000.0])) for k in range(120)] + [(500, 40.0, -120.0, -1.0), (501, 90.0, 0.0, 2000.0), (502, None, 0.0, 9.0)]
        names = "id long, lat double, lon double, km double"
        inside = lambda q, p: km_between(q[1], q[2], p[0], p[1]) <= q[3]
    else:
        queries = [(k, lon - w, lat - w, lon + w, lat + w) for k in range(120) for lat, lon in [place(k)] for w in [rng.choice([0.0, 0.5, 9.0, 70.0])]] + [(500, 5.0, 5.0, 4.0, 6.0), (501, -120.0, 40.0, -120.0, 40.0)]
        names = "id long, west double, south double, east double, north double"
        inside = lambda q, p: q[1] <= p[1] <= q[3] and q[2] <= p[0] <= q[4]
    df = spark.createDataFrame(points, "lat double, lon double, t string, v int")
    got = {(r["id"], r["t"]): (r["n"], int(r["v"]), r["m"]) for r in totals(spark.createDataFrame(queries, names), df.selectExpr("*", "v AS m"), "id", by="t", sums=("v",), largest=("m",), circle=circle).collect()}
    want = {}
    for q in queries:
        for p in points:
            if None not in (*q, p[0]) and not math.isnan(p[0]) and inside(q, p):
                want.setdefault((q[0], p[2]), []).append(p[3])
    known = lambda v: [x for x in v if x is not None]
    assert got == {k: (len(v), sum(known(v)), max(known(v), default=None)) for k, v in want.items()}
    assert len(got) > 150
    some = totals(spark.createDataFrame(queries, names), df.limit(0).drop("v"), "id", circle=circle)
    assert some.count() == 0
