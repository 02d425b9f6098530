"""Bucketed stores: what they open, what they leave alone, and what a failure leaves behind."""

import hashlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import buckets
from terrafold.operators.buckets import BucketTable, KeyedStore


def test_filter_never_misses_and_seldom_lies():
    rng = np.random.default_rng(1)
    own, other = rng.integers(-(2**63), 2**63 - 1, (2, 5000))
    data = buckets.key_filter(own)
    assert all(buckets.may_hold(data, own[k : k + 1]) for k in range(0, 5000, 7))
    assert sum(buckets.may_hold(data, other[k : k + 1]) for k in range(5000)) < 10
    assert not buckets.may_hold(buckets.key_filter(np.zeros(0, np.int64)), own[:5])


def test_append_opens_only_files_that_can_hold_a_key(spark, tmp_path):
    store = KeyedStore(f"{tmp_path}/s", ("id",), buckets=8)
    rows = lambda lo, hi: spark.range(lo, hi).withColumn("v", F.lit(lo))
    for n in range(6):
        store.append(rows(1000 * n, 1000 * n + 1000), n)
    files = len(list(Path(f"{tmp_path}/s").glob("batch=*/bucket=*/*.parquet")))
    assert files == 48
    assert store.opened(rows(50_000, 50_100), 9) is None or len(store.opened(rows(50_000, 50_100), 9).inputFiles()) <= 4
    late = rows(2500, 2503)
    opened = store.opened(late, 9).inputFiles()
    assert len(opened) <= 4 and {f.split("batch=")[1][0] for f in opened} >= {"2"}
    store.append(late.unionByName(rows(7000, 7002)).unionByName(rows(7000, 7002)), 9)
    store.append(late.unionByName(rows(7000, 7002)), 9)  # again
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == 6002 == back.select("id").distinct().count() and back.where("v = 2500").count() == 0
    store.append(rows(0, 0), 10)
    assert spark.read.parquet(f"{tmp_path}/s").count() == 6002


def files_of(path):
    return {str(f.relative_to(path)): hashlib.md5(f.read_bytes()).hexdigest() for f in Path(path).glob("version=*/bucket=*/*.parquet")}


def state(table, spark):
    df = table.read(spark)
    return {} if df is None else {r["id"]: (r["name"], r["v"]) for r in df.collect()}


def test_changes_leave_other_buckets_alone(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    table = BucketTable(path, ("id",), buckets=16)
    frame = lambda *rows: spark.createDataFrame(list(rows), "id long, name string, v double")
    table.upsert(frame(*((k, f"n{k}", 0.0) for k in range(200))), 0, ["v"])
    before = files_of(path)
    table.upsert(frame((5, "x", 1.0), (5, "x", 2.0), (1000, "new", 3.0)), 1, ["v"])
    want = {k: (f"n{k}", 0.0) for k in range(200)} | {5: ("n5", 2.0), 1000: ("new", 3.0)}
    assert state(table, spark) == want
    after = files_of(path)
    assert all(after[f] == h for f, h in before.items())
    live = table.live(spark)
    assert 1 <= sum(v == 1 for v in live.values()) <= 2 and sum(v == 0 for v in live.values()) >= 14
    table.upsert(frame((5, "x", 9.0)), 1, ["v"])  # a finished number isn't made again
    assert state(table, spark) == want

    def broken(old, new):
        return buckets.upsert(old, new, ["id"], ["v"]).withColumn("v", F.raise_error(F.lit("broken")).cast("double"))

    with pytest.raises(Exception, match="broken"):
        table.change(frame((6, "x", 1.0)), 2, broken)
    assert state(table, spark) == want and table.versions(spark) == [0, 1]
    table.upsert(frame((6, "x", 1.0)), 2, ["v"])
    assert state(table, spark) == want | {6: ("n6", 1.0)}
    log = spark.createDataFrame([(5, "gone", 0.0, 1, "update"), (5, "gone", 0.0, 2, "delete"), (7, "seven", 7.0, 5, "update"), (7, "old", 1.0, 4, "delete"), (2000, "made", 1.0, 1, "create")], "id long, name string, v double, seq int, op string")
    table.replay(log, 3, seq="seq", op="op")
    want = {k: v for k, v in (want | {6: ("n6", 1.0), 7: ("seven", 7.0), 2000: ("made", 1.0)}).items() if k != 5}
    assert state(table, spark) == want and table.versions(spark) == [2, 3]
    assert {r["id"]: (r["name"], r["v"]) for r in table.read(spark, version=2).collect()}[5] == ("n5", 2.0)
    one = BucketTable(f"{tmp_path}/u", ("id",), buckets=1)
    one.upsert(frame((1, "a", 1.0)), 0, ["v"])
    one.replay(spark.createDataFrame([(1, "a", 1.0, 1, "delete")], log.schema), 1, seq="seq", op="op")
    assert state(one, spark) == {} and one.live(spark) == {}


def test_scratch_of_another_thread_keeps_its_hands_off(spark):
    """A query that materialises while another thread has a scratch open keeps its table."""
    import threading

    from terrafold.operators.storage import materialize, scratch

    kept, opened, written = [], threading.Event(), threading.Event()

    def other():
        with scratch(spark):
            materialize(spark.range(3))
            opened.set()
            written.wait(60)

    thread = threading.Thread(target=other)
    thread.start()
    assert opened.wait(60)
    kept.append(materialize(spark.range(5)))
    written.set()
    thread.join(60)
    assert kept[0].count() == 5
    with scratch(spark):
        inner = materialize(spark.range(4))
        with scratch(spark):
            outer = materialize(spark.range(6), keep=True)
        assert inner.count() == 4
    assert outer.count() == 6
    with pytest.raises(Exception):
        inner.count()
