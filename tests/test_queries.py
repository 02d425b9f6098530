"""Every registered query with SQL against DuckDB on the same tables; the others against a second way of their own."""

import duckdb
import pytest

from terrafold import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(df):
    return sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    got, want = plans.QUERIES[name](spark, sf_dir).toPandas(), con.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_other_queries_run(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_location_context_by_brute_force(spark, sf_dir):
    import math

    from terrafold.functions import models
    from terrafold.plans.views import view

    places, days, soil = (view(spark, sf_dir, t).collect() for t in ("watched_locations", "weather_days", "soil_points"))
    got = {r["id"]: r for r in plans.QUERIES["d39_location_context"](spark, sf_dir).collect()}
    assert set(got) == {p["id"] for p in places}
    latest = {}
    for d in sorted(days, key=lambda d: d["day"]):
        latest[d["station_id"]] = d
    for p in places:
        d, r = latest.get(p["id"] % 20), got[p["id"]]
        near = min(((math.hypot(p["lat"] - s["lat"], p["lon"] - s["lon"]), s["id"]) for s in soil), default=(9, None))
        assert r["soil_id"] == (near[1] if near[0] <= 0.5 else None)
        if d is None:
            assert r["fire_risk"] is None
            continue
        raw = models.FUEL_WEIGHTS["shrubland"] * 30 + 10 / 45 * 20 + 10 + max(0, 100 - d["rh"]) * 0.25 + min(100, d["wind_kmh"] / 3.6 / 30 * 100) * 0.15
        assert abs(r["fire_risk"] - min(100, raw)) <= 0.51 and r["weather_day"] == d["day"]
    assert len({r["fire_risk"] for r in got.values()}) > 1


def test_diverse_top_by_brute_force(spark, sf_dir):
    import numpy as np

    got = {}
    for r in plans.QUERIES["x3_diverse_top"](spark, sf_dir).collect():
        got.setdefault(r["id"], {})[r["place"]] = r["other"]
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    rows = {k: v / np.linalg.norm(v) for k, v in rows.items()}
    assert set(got) == {k for k in rows if k % 20 == 0}
    for q, places in got.items():
        left = sorted((k for k in rows if k != q), key=lambda k: (-round(rows[q] @ rows[k], 9), k))[:10]
        taken = []
        while len(taken) < 5:
            gain = {k: round(0.7 * (rows[q] @ rows[k]) - 0.3 * max((rows[k] @ rows[t] for t in taken), default=0), 9) for k in left if k not in taken}
            taken.append(min(gain, key=lambda k: (-gain[k], k)))
        assert [places[p] for p in sorted(places)] == taken
