"""Windows over tracks: last positions, stops, segments, transitions, simplification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STOP_GAP_MS = 300_000


def last_per_key(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The newest row of each key (partial aggregate, no sort); equal times go to the larger ``tie``."""
    return df.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*df.columns), F.struct(time, tie)).alias("row")).select("row.*")


def in_order(key: str, *order: str):
    return W.partitionBy(key).orderBy(*order)


def stops(positions: DataFrame, gap_ms: int = STOP_GAP_MS) -> DataFrame:
    """A gap above ``gap_ms`` to the next position is a stop at the earlier one."""
    w = in_order("asset_id", "time", "id")
    rows = positions.withColumn("end", F.lead("time").over(w))
    ms = F.expr("(unix_micros(end) - unix_micros(time)) div 1000")
    return rows.where(ms > gap_ms).select("asset_id", "lat", "lon", F.col("time").alias("start"), "end", ms.alias("duration_ms"))


def speed_class(speed: Column) -> Column:
    return F.when(speed.isNull() | (speed < 5), "stopped").when(speed < 30, "slow").otherwise("fast")


def segments(positions: DataFrame) -> DataFrame:
    """Lines between neighbouring positions, classed by the first one's speed."""
    w = in_order("asset_id", "time", "id")
    rows = positions.select("asset_id", "time", "lat", "lon", speed_class(F.col("speed")).alias("speed_class"), F.lead("lat").over(w).alias("to_lat"), F.lead("lon").over(w).alias("to_lon"))
    return rows.where("to_lat is not null")


def transitions(inside: DataFrame, *, key: str = "asset_id", fence: str = "fence_id") -> DataFrame:
    """Enter and exit events from rows (key, fence, time, id, inside, flags); a key's first row gives none."""
    w = W.partitionBy(key, fence).orderBy("time", "id")
    rows = inside.withColumn("was", F.lag("inside").over(w))
    event = F.when(~F.col("was") & F.col("inside") & F.col("alert_on_enter"), "enter").when(F.col("was") & ~F.col("inside") & F.col("alert_on_exit"), "exit")
    return rows.withColumn("event", event).where("event is not null").select(key, fence, "time", "id", "event")


def kept_points(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Douglas-Peucker: which points stay, by distance to the segment."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        length = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / length, 0, 1) if length else np.zeros(len(px))
        far = np.hypot(px - t * dx, py - t * dy)
        k = int(far.argmax())
        if far[k] > eps:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplify(positions: DataFrame, eps: float = 1e-4) -> DataFrame:
    """Tracks without the points that lie within ``eps`` degrees of the line, per asset and day (so a task's track is bounded).

    A task reads its tracks one after the other from sorted batches; only a batch's last track waits for the next batch.
    """
    rows = positions.select("asset_id", F.to_date("time").alias("day"), "id", "time", "lat", "lon")

    def kept(tracks: pa.Table) -> pa.Table:
        asset, day, x, y = (tracks.column(c).combine_chunks() for c in ("asset_id", "day", "lon", "lat"))
        starts = np.r_[_changes(asset, day), len(asset)]
        x, y = (v.to_numpy(zero_copy_only=False) for v in (x, y))
        keep = np.ones(len(x), bool)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a > 2:
                keep[a:b] = kept_points(x[a:b], y[a:b], eps)
        return tracks.filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        open_track = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c) for c in ("asset_id", "day")]
            last = int(_changes(*keys)[-1])
            first, end = (tuple(k[j].as_py() for k in keys) for j in (0, batch.num_rows - 1))
            if last == 0 and first == open_track:
                waiting.append(batch)
                continue
            yield from kept(pa.Table.from_batches([*waiting, batch.slice(0, last)])).to_batches()
            waiting, open_track = [batch.slice(last)], end
        if waiting:
            yield from kept(pa.Table.from_batches(waiting)).to_batches()

    by = ["asset_id", "day"]
    return rows.repartition(*by).sortWithinPartitions(*by, "time", "id").mapInArrow(run, rows.schema)


def _changes(*keys: pa.Array) -> np.ndarray:
    """Where a row's keys differ from the row before; the first row counts."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        codes = k.dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.nonzero(new)[0]
