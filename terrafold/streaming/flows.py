"""Event flows with Structured Streaming (R1 to R15). Every function takes and returns streaming (or batch) DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrafold.operators.buckets import BucketTable, KeyedStore
from terrafold.sources.landed import POSITION, SENSOR


def sensor_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Sensor readings from landed JSON files."""
    return spark.readStream.schema(SENSOR).option("maxFilesPerTrigger", files).json(path)


def position_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Position updates; those without id, place or time are left out."""
    rows = spark.readStream.schema(POSITION).option("maxFilesPerTrigger", files).json(path)
    return rows.where("assetId is not null and lat is not null and lon is not null and timestamp is not null").select(F.col("assetId").alias("asset_id"), F.col("timestamp").alias("time"), "lat", "lon", "speed", "heading", "altitude")


def ingest_sensors(readings: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Valid readings, each once by sensor and time, with the channel that they go to."""
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & F.col("sensor_id").isNotNull() & F.col("timestamp").isNotNull()
    named = readings.where(ok).withColumn("feature_id", F.concat_ws(":", "sensor_id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS")))
    return named.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["feature_id"]).withColumn("channel", F.lit("layer:sensors"))


def on_channel(rows: DataFrame, channel: str) -> DataFrame:
    """The rows of one channel."""
    return rows.where(F.col("channel") == channel)


def tumbling(rows: DataFrame, time: str, value: str, width: str, late: str = "10 minutes", start: str = "0 seconds") -> DataFrame:
    """Average, largest value and count by window."""
    grouped = rows.withWatermark(time, late).groupBy(F.window(time, width, startTime=start).alias("w"))
    return grouped.agg(F.avg(value).alias("mean"), F.max(value).alias("most"), F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), "mean", "most", "n")


def latest(rows: DataFrame, key: str, time: str) -> DataFrame:
    """The newest row of each key, for update mode."""
    return rows.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*rows.columns), time).alias("r")).select("r.*")


def last_metrics(rows: DataFrame, key: str, time: str, metrics: list[str]) -> DataFrame:
    """Per key the newest non-null value of each metric."""
    return rows.groupBy(key).agg(*(F.max_by(m, F.when(F.col(m).isNotNull(), F.col(time))).alias(m) for m in metrics))


def suppressed(alerts: DataFrame, time: str = "created_at") -> DataFrame:
    """An alert of a user, kind and place is let through once in 24 hours."""
    return alerts.withWatermark(time, "24 hours").dropDuplicatesWithinWatermark(["user_id", "alert_type", "watched_location_id"])


def over_quota(requests: DataFrame, key: str, time: str, limit: int, late: str = "10 minutes") -> DataFrame:
    """Keys with more than ``limit`` requests in a minute."""
    counted = requests.withWatermark(time, late).groupBy(key, F.window(time, "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > limit).select(key, F.col("w.start").alias("minute"), "n")


def trips(positions: DataFrame, late: str = "10 minutes", gap: str = "5 minutes") -> DataFrame:
    """Sessions of positions; the gaps between them are stops."""
    rows = positions.withWatermark("time", late).groupBy("asset_id", F.session_window("time", gap).alias("w"))
    return rows.agg(F.count("*").alias("n")).select("asset_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def alert_queue(alerts: DataFrame) -> DataFrame:
    """The user's channel, and whether a mail is due."""
    return alerts.withColumn("channel", F.concat(F.lit("alerts:"), F.col("user_id").cast("string"))).withColumn("email", F.col("severity").isin("critical", "warning"))


FENCE_EVENT = "asset_id string, fence_id long, time timestamp, event string"


def geofence_events(positions: DataFrame, fences: list[tuple[int, float, float, float, float, bool, bool]]) -> DataFrame:
    """Enter and exit events; the state of an asset is the set of fences around its last position.

    ``fences``: id, west, south, east, north, alert on enter, alert on exit; a small fixed table. The first position of
    an asset gives no event; positions older than the state's are left out.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, (at, inside) = state.exists, state.get if state.exists else (None, "")
        now = {int(x) for x in inside.split(",") if x}
        out = []
        for r in pd.concat(list(frames)).sort_values("time").itertuples():
            if known and r.time.value < at:
                continue
            around = {f[0] for f in fences if f[1] <= r.lon < f[3] and f[2] <= r.lat < f[4]}
            if known:
                out += [(key[0], f[0], r.time, "enter") for f in fences if f[0] in around - now and f[5]]
                out += [(key[0], f[0], r.time, "exit") for f in fences if f[0] in now - around and f[6]]
            known, now, at = True, around, r.time.value
        state.update((at, ",".join(map(str, sorted(now)))))
        yield pd.DataFrame(out, columns=["asset_id", "fence_id", "time", "event"])

    keyed = positions.select(F.col("asset_id").cast("string").alias("asset_id"), "time", "lat", "lon")
    return keyed.groupBy("asset_id").applyInPandasWithState(step, FENCE_EVENT, "at long, inside string", "append", GroupStateTimeout.NoTimeout)


def append_new(path: str, keys: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends rows whose key is not stored yet (``KeyedStore``).

    A batch opens only the files whose key filters may hold one of its keys. A batch that runs again after a failure
    writes its own folder anew, so nothing is stored twice.
    """
    return KeyedStore(path, tuple(keys), buckets).append


def refresh(path: str, keys: list[str], columns: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps a table (gauges) current; known keys take ``columns``, new keys are added (``BucketTable``).

    Batch n is applied to the newest earlier version, so a batch that runs again gives the same table. The version before
    is kept for readers. Read the table with ``current``.
    """
    table = BucketTable(path, tuple(keys), buckets)
    return lambda batch, number: table.upsert(batch, number, columns)


def versions(spark: SparkSession, path: str) -> list[int]:
    return BucketTable(path, ()).versions(spark)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of a table that ``refresh`` keeps."""
    return BucketTable(path, ()).read(spark)


def gauge_refresh(rows: DataFrame, path: str, checkpoint: str, every: str = "15 minutes") -> DataStreamWriter:
    """The writer that applies landed gauges to the table every quarter of an hour."""
    sink = refresh(path, ["site_no"], ["flow_cfs", "percentile", "trend", "condition", "updated_at"])
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every)
