"""Operator 12: sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A tree has regions, racks in them and shards in those, each with a weight among its siblings. A key descends it: at each
level every child draws -ln(u) / weight, with u a hash of the key and the child's own path, and the least draw wins, so a
child wins with a probability in proportion to its weight. The draw of a child depends on nothing but key, path and its
own weight. So where a weight rises, keys move only into that subtree, where it falls only out of it, and keys of all
other subtrees keep their place among themselves.

Rules for odd input: a null key is placed as the text 'null'. Children of weight 0 get nothing; a tree without a child of
positive weight at some place is an error. Equal draws go to the smaller name. A null text counts no bytes and has the
checksum 0. Rows that are equal in key, size and checksum are told apart by their slots only. An empty table gives an
empty table. Columns of other names are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hexadecimal digits of a draw: 52 bits, which a double holds.
DIGITS = 13
#: Rows of a numbering task, and copies of one row that are made at a time.
BUCKET_ROWS = 1 << 16


class Leaf(NamedTuple):
    """A shard, the rack and the region that hold it, and the weights that each has among its siblings."""

    region: int
    rack: int
    shard: int
    region_weight: float = 1.0
    rack_weight: float = 1.0
    shard_weight: float = 1.0


def by_capacity(shards: Sequence[tuple[int, int, int, float]]) -> list[Leaf]:
    """A tree of (region, rack, shard, capacity): a rack weighs what its shards hold, a region what its racks do."""
    rack: dict[tuple[int, int], float] = {}
    region: dict[int, float] = {}
    for r, k, _, size in shards:
        rack[r, k] = rack.get((r, k), 0.0) + size
        region[r] = region.get(r, 0.0) + size
    return [Leaf(r, k, s, region[r], rack[r, k], size) for r, k, s, size in shards]


def draw(key: Column, path: Column, weight: Column) -> Column:
    """The child's draw for a key; the least of the siblings wins."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit("/"), path).cast("binary")), 1, DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << (4 * DIGITS))
    return -F.ln(u) / weight


def _winner(key: Column, children: Column) -> Column:
    """Name of the child (struct of name, path and weight) with the least draw."""
    return F.array_min(F.transform(children, lambda c: F.struct(draw(key, c["path"], c["weight"]).alias("draw"), c["name"].alias("name"))))["name"]


def _children(found: dict[str, tuple[int, float]], where: str) -> Column:
    alive = [(name, path, w) for path, (name, w) in sorted(found.items()) if w > 0]
    if not alive:
        raise ValueError(f"no child of positive weight in {where}")
    return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("path"), F.lit(float(w)).alias("weight")) for n, p, w in alive))


def place(key: Column, tree: Sequence[Leaf]) -> Column:
    """Struct of ``region``, ``rack`` and ``shard`` of a key. The tree is a parameter of a few thousand shards at most."""
    regions: dict[str, tuple[int, float]] = {}
    racks: dict[str, dict[str, tuple[int, float]]] = {}
    shards: dict[str, dict[str, tuple[int, float]]] = {}
    for x in tree:
        r, k, s = f"{x.region}", f"{x.region}.{x.rack}", f"{x.region}.{x.rack}.{x.shard}"
        same = regions.setdefault(r, (x.region, x.region_weight)) == (x.region, x.region_weight)
        same &= racks.setdefault(r, {}).setdefault(k, (x.rack, x.rack_weight)) == (x.rack, x.rack_weight)
        if not same or s in shards.setdefault(k, {}):
            raise ValueError(f"shard {s} is named twice, or its region or rack has two weights")
        shards[k][s] = (x.shard, x.shard_weight)
    live = {r for r, (_, w) in regions.items() if w > 0}
    below = {r: k for r, k in racks.items() if r in live}
    inner = {k: s for r in below for k, (_, w) in below[r].items() if w > 0 for s in [shards[k]]}
    table = lambda level: F.create_map(*(x for at in sorted(level) for x in (F.lit(at), _children(level[at], at))))
    region = _winner(key, _children(regions, "the tree"))
    found = F.struct(region.alias("region"))
    rack = F.transform(F.array(found), lambda x: F.struct(x["region"].alias("region"), _winner(key, table(below)[x["region"].cast("string")]).alias("rack")))
    last = F.transform(rack, lambda x: F.struct(x["region"].alias("region"), x["rack"].alias("rack"), _winner(key, table(inner)[F.concat_ws(".", x["region"].cast("string"), x["rack"].cast("string"))]).alias("shard")))
    return last[0]


def numbered(rows: DataFrame, group: str, *fields: str, slot: str = "slot", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``fields``, ``group`` and a gapless number from 0 in each group, by a hash of all these values and then the values.

    Equal rows are merged and counted first, so a group of copies is one row. The hash's leading bits cut each group into
    buckets of about ``bucket_rows`` rows; a task numbers a bucket, and the buckets' totals, a table smaller by that
    factor, give where each begins. Copies are made at the end, ``bucket_rows`` at a time.
    """
    merged = rows.select(group, *fields).groupBy(group, *fields).agg(F.count("*").alias("_copies"))
    text = F.concat_ws(":", *(F.coalesce(F.col(f).cast("string"), F.lit("null")) for f in fields))
    hashed = merged.withColumn("_order", F.md5(text.cast("binary")))
    wanted = max(1, rows.count() // bucket_rows)
    digits = max(1, -(-(wanted - 1).bit_length() // 4))
    cut = hashed.withColumn("_bucket", F.substring("_order", 1, digits))
    totals = cut.groupBy(group, "_bucket").agg(F.sum("_copies").alias("_n"))
    before = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    begins = totals.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    inside = W.partitionBy(group, "_bucket").orderBy("_order", *fields).rowsBetween(W.unboundedPreceding, -1)
    within = cut.withColumn("_within", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
    same = F.col(f"w.{group}").eqNullSafe(F.col(f"b.{group}")) & (F.col("w._bucket") == F.col("b._bucket"))
    placed = within.alias("w").join(begins.alias("b"), same).select(*(F.col(f"w.{c}").alias(c) for c in (group, *fields)), "_copies", (F.col("_begin") + F.col("_within")).alias("_first"))
    runs = placed.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / bucket_rows))))
    last = F.least(F.col("_copies") - 1, (F.col("_run") + 1) * bucket_rows - 1)
    return runs.withColumn("_at", F.explode(F.sequence(F.col("_run") * bucket_rows, last))).select(group, *fields, (F.col("_first") + F.col("_at")).alias(slot))


def shards(docs: DataFrame, tree: Sequence[Leaf], grown: Sequence[Leaf] | None = None, *, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id``, ``size`` (bytes of the text plus 1), ``text_crc32``, ``region``, ``rack``, ``shard``, ``slot``, and
    ``grown_shard`` by the tree ``grown`` (null without one).
    """
    key, body = F.col(doc_id), F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(key.alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), place(key, tree)["shard"].alias("shard"))
    slots = numbered(rows, "shard", "doc_id", "size", "text_crc32", bucket_rows=bucket_rows)
    at = slots.withColumn("_at", place(F.col("doc_id"), tree))
    later = place(F.col("doc_id"), grown)["shard"] if grown else F.lit(None)
    return at.select("doc_id", "size", "text_crc32", F.col("_at.region").alias("region"), F.col("_at.rack").alias("rack"), "shard", "slot", later.cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, tree: Sequence[Leaf], path: str, *, doc_id: str = "doc_id", pieces: int = 16) -> None:
    """Write all columns of ``docs`` to ``path`` as Parquet, a folder ``_region=/_rack=/_shard=`` for each shard, each by up to ``pieces`` tasks."""
    at = place(F.col(doc_id), tree)
    rows = docs.select("*", *(at[c].alias(f"_{c}") for c in ("region", "rack", "shard")))
    dealt = rows.repartition("_region", "_rack", "_shard", F.pmod(F.xxhash64(F.col(doc_id), F.spark_partition_id()), F.lit(pieces)))
    dealt.write.partitionBy("_region", "_rack", "_shard").parquet(path)
