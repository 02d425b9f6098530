"""Dashboard aggregates by time bucket, kept as partials that merge (A5, A6, A7 kept current).

A micro-batch adds one small row for each bucket it has rows of: sum, number, least and largest. Late rows, however late,
just add another row for their bucket, and nothing stored is rewritten. Reading merges the rows of a bucket. A batch that
runs again replaces its own rows, so nothing counts twice. ``compact`` merges old batches into one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators.buckets import numbers
from terrafold.operators.storage import remove

PARTIAL = "bucket timestamp, total decimal(38,6), n long, least double, most double"


@dataclass(frozen=True)
class PartialStore:
    """Partials of ``value`` by a bucket of time, below ``path``: ``batch=n`` of each batch, ``merged=n`` of all batches up to n."""

    path: str

    def add(self, rows: DataFrame, number: int, bucket: Column, value: str) -> None:
        """Add a batch; the foreachBatch sink of ``keep``. A number that is merged already isn't added again."""
        merged = numbers(rows.sparkSession, self.path, "merged")
        if merged and number <= merged[-1]:
            return
        exact = F.col(value).cast("decimal(18,6)")
        partial = rows.groupBy(bucket.alias("bucket")).agg(F.sum(exact).cast("decimal(38,6)").alias("total"), F.count(value).alias("n"), F.min(value).cast("double").alias("least"), F.max(value).cast("double").alias("most"))
        partial.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def keep(self, stream: DataFrame, bucket: Column, value: str):
        """The writer that keeps the store current with a stream; its checkpoint lies beside the store."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.add(batch, number, bucket, value)).option("checkpointLocation", f"{self.path}/_checkpoint")

    def _parts(self, spark: SparkSession) -> list[str]:
        merged = numbers(spark, self.path, "merged")
        newest = merged[-1:] or [-1]
        return [f"{self.path}/merged={n}" for n in merged[-1:]] + [f"{self.path}/batch={n}" for n in numbers(spark, self.path, "batch") if n > newest[0]]

    def partials(self, spark: SparkSession) -> DataFrame:
        """One row for each bucket."""
        parts = self._parts(spark)
        rows = spark.read.schema(PARTIAL).parquet(*parts) if parts else spark.createDataFrame([], PARTIAL)
        return rows.groupBy("bucket").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))

    def read(self, spark: SparkSession) -> DataFrame:
        """``bucket``, ``mean``, ``least``, ``most``, ``n``."""
        return self.partials(spark).select("bucket", F.try_divide(F.col("total").cast("double"), F.col("n").cast("double")).alias("mean"), "least", "most", "n")

    def compact(self, spark: SparkSession) -> None:
        """Merge all that is stored; the old parts go once the merged one is written."""
        batches, merged = numbers(spark, self.path, "batch"), numbers(spark, self.path, "merged")
        if batches and batches[-1] > max(merged, default=-1):
            self.partials(spark).select("bucket", F.col("total").cast("decimal(38,6)").alias("total"), "n", "least", "most").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/merged={batches[-1]}")
            for old in [f"merged={n}" for n in merged] + [f"batch={n}" for n in batches]:
                remove(spark, f"{self.path}/{old}")
