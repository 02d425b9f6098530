"""Table maintenance (of K3 to K19; README lists those not built) as joins that give the table's next state; write it to a new place, then switch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.streaming.decisions import TrailingQuota, decided


def upsert(base: DataFrame, batch: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Known keys take ``columns`` from the batch and keep the rest, unknown keys are added. Batch keys must be unique."""
    b = batch.select(*keys, *(F.col(c).alias(f"_b_{c}") for c in base.columns if c not in keys), F.lit(True).alias("_in_batch"))
    joined = base.withColumn("_in_base", F.lit(True)).join(b, keys, "full")
    new = F.col("_in_base").isNull()
    taken = lambda c: F.when(new | (F.col("_in_batch") if c in columns else F.lit(False)), F.col(f"_b_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*(F.col(c) if c in keys else taken(c) for c in base.columns))


def insert_absent(base: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch with a new key are added, one for each key."""
    return base.unionByName(batch.dropDuplicates(keys).join(base, keys, "left_anti"))


def retain(parents: DataFrame, time: str, as_of: str, interval: str, key: str, children: DataFrame, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Parents not older than the interval, and their children."""
    kept = parents.where(F.col(time) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {interval}"))
    return kept, children.join(kept.select(F.col(key).alias(child_key)), child_key, "left_semi")


def cascade(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """K7: children without those of deleted parents."""
    return children.join(gone, key, "left_anti")


def set_flag(df: DataFrame, flag: str, where: Column) -> DataFrame:
    """The flag becomes true where the condition holds."""
    return df.withColumn(flag, F.when(where, F.lit(True)).otherwise(F.col(flag)))


def reorder(df: DataFrame, ids: list, key: str = "id", column: str = "sort_order") -> DataFrame:
    """Place in the list as the order; others keep theirs."""
    order = F.create_map(*[x for k, i in enumerate(ids) for x in (F.lit(i), F.lit(k))]) if ids else F.create_map()
    return df.withColumn(column, F.coalesce(F.try_element_at(order, F.col(key)), F.col(column)))


def apply_changes(log: DataFrame, key: str, seq: str, op: str) -> DataFrame:
    """The last change of each key, without deleted ones."""
    last = log.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*log.columns), seq).alias("r")).select("r.*")
    return last.where(F.col(op) != "delete")


def allowed_requests(requests: DataFrame, *, key: str = "asset_id", limit: int = 20, seconds: int = 3600) -> DataFrame:
    """At most ``limit`` allowed requests of a key in the trailing window; only allowed ones count."""
    return decided(requests, TrailingQuota(limit, seconds), keys=[key])
