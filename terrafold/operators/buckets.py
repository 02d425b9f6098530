"""Tables in hash buckets of their key: appends that open only files that can hold a key (R2, J16, K18), and changes that
write only the buckets they touch (K3, K16, R8).

Every write goes to a folder of its own number, and a small index or manifest written after it makes it count. A write
that fails before that leaves the table as it was, and the same number can run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators.maintenance import upsert
from terrafold.operators.storage import remove, subfolders

#: Bits of a file's filter for each key, and bits that a key sets: one key in 7,000 is taken for a held one.
BITS, HASHES = 20, 8


def numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the finished folders ``prefix=n`` below ``path``."""
    return sorted(int(x.removeprefix(f"{prefix}=")) for x in subfolders(spark, path) if x.startswith(f"{prefix}="))


def filter_places(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits (a row for each key) that 64-bit hashes set in a filter of ``size`` bits."""
    h = hashes.astype(np.int64).view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64) * high[:, None]) % np.uint64(size)).astype(np.int64)


def key_filter(hashes: np.ndarray) -> bytes:
    """A Bloom filter of the keys."""
    size = max(64, -(-len(hashes) * BITS // 8) * 8)
    bits = np.zeros(size, np.uint8)
    bits[filter_places(hashes, size).ravel()] = 1
    return np.packbits(bits).tobytes()


def may_hold(data: bytes, hashes: np.ndarray) -> bool:
    """Whether a filter has any of the keys."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    return bool(bits[filter_places(hashes, len(bits))].all(axis=1).any())


@dataclass(frozen=True)
class KeyedStore:
    """Rows with distinct ``keys``, appended in numbered batches: folders ``batch=n/bucket=b``, and a filter of each one's keys.

    Read it as a Parquet table; ``bucket`` and ``batch`` are columns. Keys must not be null.
    """

    path: str
    keys: tuple[str, ...]
    buckets: int = 64

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_hash", F.xxhash64(*self.keys)).withColumn("bucket", F.pmod("_hash", F.lit(self.buckets)).cast("int"))

    def holders(self, rows: DataFrame, number: int) -> list[tuple[int, int]]:
        """(batch, bucket) of the folders that may hold a key of ``rows``, by the filters; there are at most as many as folders."""
        spark = rows.sparkSession
        stored = [n for n in numbers(spark, f"{self.path}/_index", "batch") if n != number]
        if not stored:
            return []
        index = spark.read.schema("bucket int, number int, low long, high long, keys binary").parquet(*(f"{self.path}/_index/batch={n}" for n in stored))
        kinds = pa.schema([("number", pa.int32()), ("bucket", pa.int32())])

        def probe(mine: pa.Table, held: pa.Table) -> pa.Table:
            h = np.sort(mine.column("_hash").to_numpy())
            out = []
            for r in held.to_pylist():
                span = h[np.searchsorted(h, r["low"]) : np.searchsorted(h, r["high"], "right")]
                if len(span) and may_hold(r["keys"], span):
                    out.append((r["number"], r["bucket"]))
            return pa.Table.from_arrays([pa.array([x[k] for x in out], pa.int32()) for k in (0, 1)], schema=kinds)

        mine = self._keyed(rows).select("bucket", "_hash").distinct()
        found = mine.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(probe, "number int, bucket int")
        return sorted(map(tuple, found.collect()))

    def opened(self, rows: DataFrame, number: int) -> DataFrame | None:
        """What the store holds in those folders."""
        paths = [f"{self.path}/batch={n}/bucket={b}" for n, b in self.holders(rows, number)]
        return rows.sparkSession.read.schema(rows.schema).parquet(*paths) if paths else None

    def append(self, batch: DataFrame, number: int) -> None:
        """Add the rows whose key isn't stored yet, one for each key, as batch ``number``. The same number again replaces it."""
        new = batch.dropDuplicates(list(self.keys))
        old = self.opened(new, number)
        kept = new if old is None else new.join(old.select(*self.keys), list(self.keys), "left_anti")
        self._keyed(kept).drop("_hash").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={number}")
        kinds = pa.schema([("bucket", pa.int32()), ("number", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("keys", pa.binary())])

        def summary(key: tuple, rows: pa.Table) -> pa.Table:
            h = rows.column("_hash").to_numpy()
            return pa.Table.from_arrays([pa.array([v], t) for v, t in zip((key[0].as_py(), number, int(h.min()), int(h.max()), key_filter(h)), kinds.types, strict=True)], schema=kinds)

        written = batch.sparkSession.read.schema(batch.schema).parquet(f"{self.path}/batch={number}")
        self._keyed(written).select("bucket", "_hash").groupBy("bucket").applyInArrow(summary, "bucket int, number int, low long, high long, keys binary").write.mode("overwrite").parquet(f"{self.path}/_index/batch={number}")


@dataclass(frozen=True)
class BucketTable:
    """A table that changes by numbered batches: ``version=n/bucket=b`` has what batch n made of a bucket, and
    ``_manifest/version=n`` names the live version of every bucket. A bucket that a batch doesn't touch keeps its files.
    """

    path: str
    keys: tuple[str, ...]
    buckets: int = 64

    def versions(self, spark: SparkSession) -> list[int]:
        """Versions that can be read: of these the newest is current, the others are kept for readers."""
        return numbers(spark, f"{self.path}/_manifest", "version")

    def live(self, spark: SparkSession, version: int | None = None) -> dict[int, int]:
        """The version of each bucket; a row for each bucket comes to the driver."""
        known = self.versions(spark)
        if not known:
            return {}
        rows = spark.read.schema("bucket int, version int").parquet(f"{self.path}/_manifest/version={known[-1] if version is None else version}")
        return {r["bucket"]: r["version"] for r in rows.select("bucket", "version").collect()}

    def read(self, spark: SparkSession, only: Iterable[int] | None = None, version: int | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None if nothing is there."""
        live = self.live(spark, version)
        paths = [f"{self.path}/version={v}/bucket={b}" for b, v in sorted(live.items()) if only is None or b in only]
        return spark.read.parquet(*paths) if paths else None

    def change(self, batch: DataFrame, number: int, apply: Callable[[DataFrame, DataFrame], DataFrame], like: DataFrame | None = None) -> None:
        """Make version ``number``: ``apply(old, batch)`` of the touched buckets. It must not move rows to other keys.

        ``like`` has the table's columns, if the batch has others. A number that is finished isn't made again; one that
        broke off before its manifest starts from the version before.
        """
        spark = batch.sparkSession
        if number in self.versions(spark):
            return
        older = [v for v in self.versions(spark) if v < number]
        live = self.live(spark, older[-1]) if older else {}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = sorted(r["bucket"] for r in batch.select(bucket.alias("bucket")).distinct().collect())  # as many as buckets at most
        if touched:
            shape = (batch if like is None else like).schema
            old = self.read(spark, touched, older[-1]) if older else None
            old = spark.createDataFrame([], shape) if old is None else old.select(*shape.names)
            made = apply(old, batch).withColumn("bucket", bucket).repartition("bucket")  # keys are distinct, so buckets are even
            made.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={number}")
            filled = {r["bucket"] for r in spark.read.schema(made.schema).parquet(f"{self.path}/version={number}").select("bucket").distinct().collect()}
            live = {b: v for b, v in live.items() if b not in touched} | {b: number for b in filled}
        spark.createDataFrame(sorted(live.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_manifest/version={number}")
        self._forget(spark, number)

    def _forget(self, spark: SparkSession, number: int) -> None:
        """Drop manifests before the last two, and versions that none of these name."""
        known = self.versions(spark)
        kept = set(known[-2:]) | {number}
        named = {v for k in kept for v in self.live(spark, k).values()}
        for v in known:
            if v not in kept:
                remove(spark, f"{self.path}/_manifest/version={v}")
        for v in numbers(spark, self.path, "version"):
            if v not in named and v < number:
                remove(spark, f"{self.path}/version={v}")

    def upsert(self, batch: DataFrame, number: int, columns: list[str]) -> None:
        """K3: known keys take ``columns`` from the batch and keep the rest, unknown keys are added. Of a key that a batch holds twice, the row whose ``columns`` are largest counts."""

        def apply(old: DataFrame, new: DataFrame) -> DataFrame:
            one = new.groupBy(*self.keys).agg(F.max_by(F.struct(*new.columns), F.struct(*columns)).alias("r")).select("r.*")
            return upsert(old, one.select(*old.columns), list(self.keys), columns)

        self.change(batch, number, apply)

    def replay(self, log: DataFrame, number: int, *, seq: str, op: str) -> None:
        """Ordered changes; the last one of each key counts, and ``delete`` takes the row away. Other columns of the log are the table's."""
        kept = [c for c in log.columns if c not in (seq, op)]

        def apply(old: DataFrame, changes: DataFrame) -> DataFrame:
            last = changes.groupBy(*(F.col(k).alias(f"_{k}") for k in self.keys)).agg(F.max_by(F.struct(*changes.columns), seq).alias("r")).select("r.*")
            return old.join(last.select(*self.keys), list(self.keys), "left_anti").select(*kept).unionByName(last.where(F.col(op) != "delete").select(*kept))

        self.change(log, number, apply, like=log.select(*kept))
