"""As-of join: the last observation at or before a moment, for every row of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], *, days: int = 30) -> DataFrame:
    """``left`` with ``values`` of the last right row of its ``keys`` at or before ``left_time``, and ``seen``, that row's time; nulls without one.

    Both tables are put in one order by key and time, so no row meets all rows of its key. Spans of ``days`` are ordered
    apart from each other, and what a span begins with comes from a table of one row for each key and span, so the rows
    of one key can be shared by many tasks. Of right rows with the same key and time the one with the largest values
    counts. Rows with a null time or key see nothing.
    """
    kept = F.struct(*(F.col(f"_l.{c}").alias(c) for c in left.columns))
    span = F.floor(F.unix_seconds(F.col("_t").cast("timestamp")) / (86_400 * days)).alias("_span")
    held = right.where(F.col(right_time).isNotNull()).na.drop(subset=keys).groupBy(*keys, F.col(right_time).alias("_t")).agg(F.max(F.struct(*values)).alias("_v"))
    mine = left.select(*keys, F.col(left_time).alias("_t"), F.struct(*left.columns).alias("_l"))
    theirs = held.select(*keys, "_t", F.struct(F.col("_t").alias("seen"), *(F.col(f"_v.{v}").alias(v) for v in values)).alias("_seen"))
    both = mine.unionByName(theirs, allowMissingColumns=True).select("*", span)
    before = F.last("_seen", ignorenulls=True)
    # a left row stands behind right rows of its own time
    inside = both.withColumn("_own", before.over(W.partitionBy(*keys, "_span").orderBy("_t", F.col("_l").isNotNull()).rowsBetween(W.unboundedPreceding, 0))).where("_l is not null")
    ends = both.groupBy(*keys, "_span").agg(F.max_by("_seen", F.when(F.col("_seen").isNotNull(), F.col("_t"))).alias("_seen"))
    carried = ends.select(*keys, "_span", before.over(W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    met = inside.join(carried, [*keys, "_span"], "left")
    last = F.when(reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in ("_t", *keys))), F.coalesce("_own", "_carried"))
    return met.select(kept.alias("_l"), last.alias("_seen")).select("_l.*", *(F.col(f"_seen.{c}").alias(c) for c in ("seen", *values)))
