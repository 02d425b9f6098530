"""Registered queries that run a stream over a whole landed table to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions.models import half_up
from terrafold.operators.buckets import BucketTable, KeyedStore
from terrafold.operators.storage import shared_dir
from terrafold.plans.views import ORACLES, QUERIES, VIEWS, query, view
from terrafold.streaming.decisions import Cooldown, MinuteQuota, TrailingQuota, decided, decisions, with_timers
from terrafold.streaming.partials import PartialStore
from terrafold.streaming.settle import settled

#: A request may come so much later than a newer one.
LATE_MINUTES = 10
HALF_DAY = 43_200


def landed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table as a stream of its files. The path is a pattern, since a table can be a single file or a folder."""
    table, columns = VIEWS[name]
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]").selectExpr(*columns)


def greedy(rows: str, rule: str, keep: str) -> str:
    """DuckDB: decisions one after the other; ``rule`` says whether a request is allowed, ``keep`` what is held if it is."""
    return f"""
WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, id) AS n FROM ({rows})),
r AS (
  SELECT key, n, id, us, true AS allowed, [us] AS held FROM q WHERE n = 1
  UNION ALL
  SELECT q.key, q.n, q.id, q.us, {rule} AS allowed, CASE WHEN {rule} THEN {keep} ELSE r.held END AS held FROM r JOIN q ON q.key = r.key AND q.n = r.n + 1)
"""


#: DuckDB: requests whose time the stream's last watermark has passed.
PASSED = f"us <= (SELECT (max(us) // 1000 - {LATE_MINUTES * 60_000}) * 1000 FROM q)"
RECENT = f"list_filter(r.held, lambda x: x + {HALF_DAY * 1_000_000} > q.us)"
QUOTA_SQL = greedy("SELECT asset_id AS key, id, epoch_us(time) AS us FROM positions", f"len({RECENT}) < 2", f"list_append({RECENT}, q.us)")
QUOTA_SQL += "SELECT key AS asset_id, id, allowed FROM r"


@query("w11_trailing_quota", "positions")
def trailing_quota(requests: DataFrame) -> DataFrame:
    """Two allowed requests of a key in any twelve hours."""
    return decided(requests, TrailingQuota(2, HALF_DAY), keys=["asset_id"]).select("asset_id", "id", "allowed")


def positions_sql(sql: str, view: str) -> str:
    table, columns = VIEWS[view]
    return sql.replace("WITH RECURSIVE ", f"WITH RECURSIVE {view} AS (SELECT {', '.join(columns)} FROM {table}), ", 1)


ORACLES["w11_trailing_quota"] = positions_sql(QUOTA_SQL, "positions")


def quota_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11 as a stream, ordered by event-time timers."""
    with_timers(spark)
    out = decisions(landed(spark, sf_dir, "positions"), TrailingQuota(2, HALF_DAY), keys=["asset_id"], late=f"{LATE_MINUTES} minutes")
    return settled(out).select("asset_id", "id", "allowed")


QUERIES["w11_quota_stream"] = quota_stream
ORACLES["w11_quota_stream"] = ORACLES["w11_trailing_quota"] + f" WHERE {PASSED}"


def alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert of a user and kind goes out if the last one that went out is over 24 hours old."""
    with_timers(spark)
    out = decisions(landed(spark, sf_dir, "environmental_alerts"), Cooldown(), keys=["user_id", "alert_type"], time="created_at", late=f"{LATE_MINUTES} minutes")
    return settled(out).select("id", "user_id", "alert_type", F.col("allowed").alias("sent"))


QUERIES["r10_suppression_stream"] = alert_stream
ALERT_SQL = greedy("SELECT user_id || ':' || alert_type AS key, id, epoch_us(created_at) AS us FROM environmental_alerts", "q.us - r.held[1] > 86400000000", "[q.us]")
ALERT_SQL += f"SELECT r.id, a.user_id, a.alert_type, allowed AS sent FROM r JOIN environmental_alerts a ON a.id = r.id WHERE {PASSED}"
ORACLES["r10_suppression_stream"] = positions_sql(ALERT_SQL, "environmental_alerts")


def minute_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second request of a key in a minute waits for the next one."""
    with_timers(spark)
    out = decisions(landed(spark, sf_dir, "positions"), MinuteQuota(1), keys=["asset_id"], late=f"{LATE_MINUTES} minutes")
    return settled(out).select("id", "asset_id", "allowed", "retry_after")


QUERIES["r11_minute_stream"] = minute_stream
ORACLES["r11_minute_stream"] = positions_sql(
    "WITH RECURSIVE q AS (SELECT *, epoch_us(time) AS us, row_number() OVER (PARTITION BY asset_id, date_trunc('minute', time) ORDER BY time, id) AS n FROM positions) "
    f"SELECT id, asset_id, n = 1 AS allowed, CASE WHEN n = 1 THEN 0 ELSE 60 - extract(second FROM time) END::bigint AS retry_after FROM q WHERE {PASSED}",
    "positions",
)


def kept_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly fire risk from partials that a stream keeps current."""
    store = PartialStore(shared_dir(spark))
    rows = landed(spark, sf_dir, "features").where("kind = 'fire_detection'")
    query = store.keep(rows, F.date_trunc("hour", "created_at"), "risk_score").trigger(availableNow=True).start()
    query.awaitTermination()
    merged = store.partials(spark)
    return merged.select("bucket", half_up(F.col("total").cast("double") / F.col("n"), 4).alias("avg_risk"), F.col("most").alias("max_risk"), "n")


QUERIES["r9_hourly_fire_kept"] = kept_hourly
ORACLES["r9_hourly_fire_kept"] = ORACLES["a5_hourly_fire_risk"]


def bucket_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3, R8 through a bucketed table: the batch rewrites only the buckets of its keys."""
    gauges = view(spark, sf_dir, "water_gauges").select("site_no", "site_name", "flow_cfs", "condition")
    known = gauges.where("site_no % 3 = 0").select("site_no", F.lit("changed").alias("site_name"), (F.col("flow_cfs") + 1).alias("flow_cfs"), F.lit("normal").alias("condition"))
    new = gauges.where("site_no % 10 = 0").select((F.col("site_no") + 1_000_000).alias("site_no"), F.lit("new").alias("site_name"), "flow_cfs", F.lit("low").alias("condition"))
    table = BucketTable(shared_dir(spark), ("site_no",))
    table.upsert(gauges, 0, ["flow_cfs", "condition"])
    table.upsert(known.unionByName(new), 1, ["flow_cfs", "condition"])
    return table.read(spark)


QUERIES["k3_bucket_upsert"] = bucket_upsert
ORACLES["k3_bucket_upsert"] = ORACLES["k3_gauge_upsert"]


def new_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that arrive in two batches, of which the second repeats rows of the first; each is stored once."""
    rows = view(spark, sf_dir, "positions").select("id", "asset_id", "time", F.lit(1).alias("batch_no"))
    store = KeyedStore(shared_dir(spark), ("id",))
    store.append(rows.where("id % 5 < 3"), 0)
    store.append(rows.where("id % 5 > 1").withColumn("batch_no", F.lit(2)), 1)
    return spark.read.parquet(store.path).groupBy("asset_id").agg(F.count("*").alias("n"), F.count_if(F.col("batch_no") == 2).alias("late"), F.sum("id").alias("ids"))


QUERIES["k18_append_new"] = new_positions
ORACLES["k18_append_new"] = positions_sql("WITH RECURSIVE q AS (SELECT * FROM positions) SELECT asset_id, count(*) AS n, count(*) FILTER (id % 5 > 2) AS late, sum(id)::bigint AS ids FROM q GROUP BY 1", "positions")
