"""Streams over landed files, run to their end, against the batch answer."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from terrafold.operators import tracks
from terrafold.plans.views import view
from terrafold.streaming import flows
from terrafold.streaming.decisions import Cooldown, MinuteQuota, TrailingQuota, decided, decisions, packed, with_timers
from terrafold.streaming.settle import settled


@pytest.fixture(scope="module")
def positions(spark, sf_dir, tmp_path_factory):
    """Positions landed as files in time order, streamed file by file."""
    path = str(tmp_path_factory.mktemp("positions"))
    rows = view(spark, sf_dir, "positions").withColumn("asset_id", F.col("asset_id").cast("string"))
    rows.repartitionByRange(4, "time").sortWithinPartitions("time").write.mode("overwrite").parquet(path)
    for k, file in enumerate(sorted(Path(path).glob("part-*"))):  # the stream takes files by age
        os.utime(file, (1_700_000_000 + 60 * k,) * 2)
    return rows, lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def finished(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_tumbling_windows(positions):
    rows, stream = positions
    got = {r["bucket"]: r["n"] for r in finished(flows.tumbling(stream(), "time", "speed", "1 day"), "tumbling").collect()}
    want = {r["w"]["start"]: r["n"] for r in rows.groupBy(F.window("time", "1 day").alias("w")).agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) >= len(want) - 2


def test_latest_in_update_mode_ends_as_batch(positions):
    rows, stream = positions
    out = finished(flows.latest(stream(), "asset_id", "time"), "latest_rows", "update")
    last = out.groupBy("asset_id").agg(F.max("time").alias("time"))
    want = tracks.last_per_key(rows, "asset_id", "time", "id").select("asset_id", "time")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_geofence_events_equal_batch(spark, positions):
    rows, stream = positions
    fences = [(k, -122 + 0.8 * (k % 5), 37 + 0.8 * (k // 5), -121.2 + 0.8 * (k % 5), 37.8 + 0.8 * (k // 5), k % 2 == 0, k % 3 == 0) for k in range(25)]
    got = sorted(map(tuple, finished(flows.geofence_events(stream(), fences), "fence_events").collect()))
    table = spark.createDataFrame(fences, "fence_id long, w double, s double, e double, n double, alert_on_enter boolean, alert_on_exit boolean")
    inside = rows.crossJoin(table).withColumn("inside", (F.col("lon") >= F.col("w")) & (F.col("lon") < F.col("e")) & (F.col("lat") >= F.col("s")) & (F.col("lat") < F.col("n")))
    want = sorted((r["asset_id"], r["fence_id"], r["time"], r["event"]) for r in tracks.transitions(inside).collect())
    assert got == want


def test_sensor_ingest(spark, tmp_path):
    rows = [{"sensor_id": "a", "lat": 1, "lon": 2, "timestamp": "2024-01-01T00:00:00Z", "readings": {"t": "1"}}] * 2 + [{"sensor_id": "b", "lat": 99, "lon": 2, "timestamp": "2024-01-01T00:00:00Z", "readings": {}}]
    (tmp_path / "s.json").write_text("\n".join(map(json.dumps, rows)))
    got = finished(flows.ingest_sensors(flows.sensor_stream(spark, str(tmp_path))), "sensors").collect()
    assert [(r["sensor_id"], r["channel"]) for r in got] == [("a", "layer:sensors")]
    (tmp_path / "p").mkdir()
    (tmp_path / "p/p.json").write_text(json.dumps({"assetId": "x", "lat": 1, "lon": 2, "timestamp": "2024-01-01T00:00:00Z"}) + "\n" + json.dumps({"assetId": None, "lat": 1, "lon": 2}))
    assert finished(flows.position_stream(spark, str(tmp_path / "p")), "updates").count() == 1


def test_suppression_quota_trips_metrics(spark, sf_dir):
    alerts = view(spark, sf_dir, "environmental_alerts")
    once = flows.on_channel(flows.alert_queue(alerts), "alerts:3")
    assert once.count() == alerts.where("user_id = 3").count() and not once.where("email and severity = 'info'").count()
    pos = view(spark, sf_dir, "positions")
    assert flows.trips(pos).agg(F.sum("n")).first()[0] == pos.count()
    assert flows.over_quota(pos, "asset_id", "time", 0).agg(F.sum("n")).first()[0] == pos.count()
    rows = spark.createDataFrame([("k", 1, 5.0, None), ("k", 2, None, 7.0), ("k", 3, 6.0, None)], "k string, t int, a double, b double")
    assert flows.last_metrics(rows, "k", "t", ["a", "b"]).first()[1:] == (6.0, 7.0)


def test_suppression_in_a_stream(spark, sf_dir, tmp_path):
    alerts = view(spark, sf_dir, "environmental_alerts")
    alerts.coalesce(1).write.parquet(f"{tmp_path}/a")
    stream = spark.readStream.schema(alerts.schema).parquet(f"{tmp_path}/a")
    got = finished(flows.suppressed(stream), "let_through")
    assert got.count() == alerts.dropDuplicates(["user_id", "alert_type", "watched_location_id"]).count()


def test_append_new_is_idempotent(spark, tmp_path):
    sink = flows.append_new(f"{tmp_path}/store", ["id"])
    sink(spark.range(5), 0)
    sink(spark.range(3, 8), 1)
    sink(spark.range(3, 8), 1)
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/store").collect()) == list(range(8))


def test_gauge_refresh_keeps_a_table_current(spark, tmp_path):
    schema = "site_no long, site_name string, flow_cfs double, percentile int, trend string, condition string, updated_at timestamp"
    frame = lambda *rows: spark.createDataFrame([(k, n, f, 1, "stable", "low", None) for k, n, f in rows], schema)
    path, source = str(tmp_path / "table"), str(tmp_path / "in")
    sink = flows.refresh(path, ["site_no"], ["flow_cfs", "percentile", "trend", "condition", "updated_at"])
    state = lambda: {r["site_no"]: (r["site_name"], r["flow_cfs"]) for r in flows.current(spark, path).collect()}
    sink(frame((1, "a", 1.0), (2, "b", 2.0)), 0)
    sink(frame((2, "renamed", 5.0), (3, "c", 3.0), (3, "c", 4.0)), 1)
    assert state() == {1: ("a", 1.0), 2: ("b", 5.0), 3: ("c", 4.0)}
    sink(frame((2, "renamed", 5.0), (3, "c", 3.0), (3, "c", 4.0)), 1)  # again, after a failure
    assert state() == {1: ("a", 1.0), 2: ("b", 5.0), 3: ("c", 4.0)}
    sink(frame(), 2)
    assert len(state()) == 3 and flows.versions(spark, path) == [1, 2]
    frame((1, "x", 9.0)).write.parquet(source)
    table = str(tmp_path / "streamed")
    q = flows.gauge_refresh(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    assert flows.current(spark, table).first()["flow_cfs"] == 9.0


def test_requests_wait_many_to_an_entry():
    requests = [(k, f"r{k}") for k in range(5000)]
    entries = packed(requests)
    assert len(entries) == 2 and [x for e in entries for x in zip(*e, strict=True)] == requests and packed([]) == []


RULES = {"quota": TrailingQuota(2, 43_200), "cooldown": Cooldown(), "minute": MinuteQuota(1)}


@pytest.mark.parametrize("rule", sorted(RULES))
def test_decisions_in_a_stream_equal_the_batch(spark, sf_dir, tmp_path, rule):
    """Rows come in files of shuffled time, up to two days late; the query is stopped after half of them."""
    with_timers(spark)
    rows = view(spark, sf_dir, "positions").withColumn("asset_id", (F.col("asset_id") % 7).cast("string")).where("time is not null").select("asset_id", "id", "time")
    day = F.dayofmonth("time")
    files = rows.withColumn("part", F.floor((day + F.pmod(F.xxhash64("id"), F.lit(2))) / 6).cast("int"))
    end = spark.createDataFrame([("end", -1, "2030-01-01 00:00:00")], "asset_id string, id long, time string").withColumn("time", F.to_timestamp("time"))
    source, want = f"{tmp_path}/in", decided(rows, RULES[rule], keys=["asset_id"]).collect()

    def land(part, df):
        df.coalesce(1).write.mode("append").parquet(source)
        for f in Path(source).glob("part-*"):
            if f.stat().st_mtime > 1_600_000_000:
                os.utime(f, (1_500_000_000 + 60 * part,) * 2)

    parts = sorted(r["part"] for r in files.select("part").distinct().collect())
    stream = lambda: decisions(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source), RULES[rule], keys=["asset_id"], late="3 days")
    for p in parts[:3]:
        land(p, files.where(F.col("part") == p).select(rows.columns))
    first = settled(stream(), path=f"{tmp_path}/out").count()
    for p in parts[3:]:
        land(p, files.where(F.col("part") == p).select(rows.columns))
    land(99, end)
    got = settled(stream(), path=f"{tmp_path}/out").where("asset_id <> 'end'").collect()
    assert 0 < first < len(got)
    order = lambda found: sorted((r["asset_id"], r["id"], r["time"], r["allowed"], r["retry_after"]) for r in found)
    assert order(got) == order(want) and {r["allowed"] for r in want} == {True, False}
    for state in ("pending", "held"):  # all but the closing row is forgotten
        left = spark.read.format("statestore").option("stateVarName", state).load(f"{tmp_path}/out/checkpoint")
        assert {r["key"]["asset_id"] for r in left.select("key").collect()} <= {"end"}
