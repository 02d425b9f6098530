"""Run a stream to the end of what has landed, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from terrafold.operators.storage import shared_dir


def settled(stream: DataFrame, *, mode: str = "append", path: str | None = None) -> DataFrame:
    """Everything that the stream has given so far, written to a folder that the cluster shares.

    With the ``path`` of an earlier run the query goes on from its checkpoint there, and its rows are added to the table.
    """
    spark = stream.sparkSession
    path = path or shared_dir(spark)
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
