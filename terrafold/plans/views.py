"""Logical tables (layers, fires, positions, requests, gauges, ...) derived from the driver's tables by integer arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def spread(key: str, a: int, b: int, m: int, base: int) -> str:
    """SQL of a coordinate: a quadratic hash of the key in thousandths of a degree above ``base``."""
    k = f"CAST({key} AS BIGINT)"
    return f"{base} + (({k} * {k} * {a} + {k} * {b}) % {m}) / CAST(1000.0 AS DOUBLE)"


FIRE_LAT, FIRE_LON = (31, 7919, 16001, 32), (17, 104729, 23981, -124)
AREA_LAT, AREA_LON = (31, 7919, 4001, 37), (17, 104729, 3989, -122)

#: Extent of a basin in degrees: some as large as states, most small.
BASIN = "CAST(CASE WHEN s_suppkey % 7 = 0 THEN 6.5 WHEN s_suppkey % 3 = 0 THEN 0.9 ELSE 0.15 END AS DOUBLE)"
#: Zoom of an asked tile, and its column and row by the Web-Mercator formulas.
ASKED_ZOOM = "CAST(3 + c_custkey % 8 AS INT)"
STRATEGIES = ("keyline", "silvopasture", "reforestation", "biochar", "water_harvesting", "cover_cropping")


def pick(key: str, names: tuple[str, ...]) -> str:
    return f"CASE {key} % {len(names)} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(names)) + " END"


def condition(p: str) -> str:
    return f"CASE WHEN {p} IS NULL THEN 'unknown' WHEN {p} > 75 THEN 'above_normal' WHEN {p} >= 25 THEN 'normal' WHEN {p} >= 10 THEN 'below_normal' WHEN {p} >= 5 THEN 'low' ELSE 'critically_low' END"


PERCENTILE = "CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST((CAST(s_suppkey AS BIGINT) * 37) % 101 AS INT) END"
TS = "CAST(ts AS TIMESTAMP)"
#: View: (driver table, column expressions that Spark and DuckDB read alike).
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "fire_detections": ("events", ("event_id AS id", f"{TS} AS detected_at", f"{pick('event_id', ('low', 'nominal', 'high'))} AS confidence", "300 + event_id % 200 AS brightness", "value AS frp", f"{spread('event_id', *FIRE_LAT)} AS lat", f"{spread('event_id', *FIRE_LON)} AS lon")),
    "positions": ("events", ("event_id AS id", "user_id AS asset_id", f"{TS} AS time", f"{spread('event_id', *AREA_LAT)} AS lat", f"{spread('event_id', *AREA_LON)} AS lon", "value AS speed")),
    "features": ("events", ("event_id AS id", "event_type AS layer_id", f"{spread('event_id', *FIRE_LAT)} AS lat", f"{spread('event_id', *FIRE_LON)} AS lon", f"{pick('event_id', ('fire_detection', 'ndvi_observation'))} AS kind", "value AS risk_score", "props AS properties", f"{pick('event_id', ('published', 'draft', 'pending_review', 'published'))} AS status", f"{TS} AS created_at")),
    "strategy_requests": ("orders", ("o_orderkey AS id", "o_custkey AS user_id", f"{pick('o_orderkey', STRATEGIES)} AS strategy_type", f"{spread('o_orderkey', *AREA_LAT)} AS lat", f"{spread('o_orderkey', *AREA_LON)} AS lon", "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' WHEN 'F' THEN 'completed' END AS status", "CAST((o_orderkey * 31) % 60 AS INT) AS vote_count", "CAST(o_orderdate AS TIMESTAMP) AS created_at")),
    "request_votes": ("lineitem", ("l_orderkey AS request_id", "l_suppkey AS user_id")),
    "water_gauges": ("supplier", ("s_suppkey AS site_no", "s_name AS site_name", f"{spread('s_suppkey', *FIRE_LAT)} AS lat", f"{spread('s_suppkey', *FIRE_LON)} AS lon", "s_acctbal AS flow_cfs", f"{PERCENTILE} AS percentile", f"{condition('(' + PERCENTILE + ')')} AS condition")),
    "watched_locations": ("customer", ("c_custkey AS id", "c_custkey AS user_id", "c_name AS name", f"{spread('c_custkey', *FIRE_LAT)} AS lat", f"{spread('c_custkey', *FIRE_LON)} AS lon", "CAST(10 + c_custkey % 190 AS INT) AS radius_km")),
    "alert_subscriptions": ("customer", ("c_custkey AS user_id", "c_custkey AS watched_location_id", f"{pick('c_custkey', ('fire_proximity', 'drought_escalation', 'streamflow_critical', 'priority_zone_created'))} AS alert_type", "c_custkey % 5 <> 0 AS in_app_enabled")),
    "basins": ("supplier", ("s_suppkey AS id", f"{spread('s_suppkey', *FIRE_LON)} AS x1", f"{spread('s_suppkey', *FIRE_LAT)} AS y1", f"{spread('s_suppkey', *FIRE_LON)} + {BASIN} AS x2", f"{spread('s_suppkey', *FIRE_LAT)} + {BASIN} / 4 AS y2", f"{spread('s_suppkey', *FIRE_LON)} + {BASIN} / 3 AS x3", f"{spread('s_suppkey', *FIRE_LAT)} + {BASIN} AS y3", "1984 + s_suppkey % 41 AS burned")),
    "trails": ("customer", ("c_custkey AS id", f"{spread('c_custkey', *FIRE_LON)} AS x1", f"{spread('c_custkey', *FIRE_LAT)} AS y1", f"{spread('c_custkey', *FIRE_LON)} + (c_custkey % 9) / CAST(8.0 AS DOUBLE) AS x2", f"{spread('c_custkey', *FIRE_LAT)} - (c_custkey % 5) / CAST(16.0 AS DOUBLE) AS y2", f"{spread('c_custkey', *FIRE_LON)} + (c_custkey % 4) / CAST(4.0 AS DOUBLE) AS x3", f"{spread('c_custkey', *FIRE_LAT)} + (c_custkey % 11) / CAST(16.0 AS DOUBLE) AS y3")),
    "asked_tiles": ("customer", (f"{ASKED_ZOOM} AS z", f"CAST(floor(({spread('c_custkey', *FIRE_LON)} + 180) / 360 * pow(2, {ASKED_ZOOM})) AS BIGINT) AS x", f"CAST(floor((1 - ln(tan(radians({spread('c_custkey', *FIRE_LAT)})) + 1 / cos(radians({spread('c_custkey', *FIRE_LAT)}))) / pi()) / 2 * pow(2, {ASKED_ZOOM})) AS BIGINT) AS y")),
    "environmental_alerts": ("events", ("event_id AS id", "user_id", f"{pick('event_id', ('critical', 'warning', 'info'))} AS severity", "event_id % 2 = 0 AS is_read", "event_id % 50 AS watched_location_id", f"{pick('event_id', ('fire_proximity', 'drought_escalation', 'streamflow_critical', 'priority_zone_created'))} AS alert_type", f"{TS} AS created_at")),
    "geofences": ("nation", ("n_nationkey AS id", "n_name AS name", "-122 + (n_nationkey % 5) * CAST(0.8 AS DOUBLE) AS west", "37 + CAST(floor(n_nationkey / 5) AS INT) * CAST(0.8 AS DOUBLE) AS south", "n_nationkey % 2 = 0 AS alert_on_enter", "n_nationkey % 3 = 0 AS alert_on_exit")),
    "drought_areas": ("region", ("r_regionkey AS ordinal", "r_regionkey AS dm", "-124 + r_regionkey * CAST(2.5 AS DOUBLE) AS west", "32 + r_regionkey * CAST(1.5 AS DOUBLE) AS south", "-124 + r_regionkey * CAST(2.5 AS DOUBLE) + 12 AS east", "32 + r_regionkey * CAST(1.5 AS DOUBLE) + 8 AS north")),
    "teams": ("nation", ("n_nationkey AS id", "n_name AS name", f"{pick('n_nationkey', STRATEGIES)} AS specialty_a", f"{pick('(n_nationkey + 2)', STRATEGIES)} AS specialty_b")),
    "team_members": ("supplier", ("s_nationkey AS team_id", "s_suppkey AS user_id", f"{pick('s_suppkey', ('owner', 'member', 'viewer'))} AS team_role")),
    "soil_points": ("part", ("p_partkey AS id", f"{spread('p_partkey', *FIRE_LAT)} AS lat", f"{spread('p_partkey', *FIRE_LON)} AS lon", "CAST(4.5 AS DOUBLE) + (p_size % 50) / CAST(10.0 AS DOUBLE) AS ph", "CAST(p_partkey % 60 AS DOUBLE) AS organic_carbon", "(p_partkey % 30) / CAST(10.0 AS DOUBLE) AS nitrogen", "CAST(0.7 AS DOUBLE) + (p_partkey % 11) / CAST(10.0 AS DOUBLE) AS bulk_density", "CAST(p_partkey % 25 AS DOUBLE) AS cec")),
}

#: One row per station and day, aggregated from events.
WEATHER_DAYS = (
    "SELECT user_id % 20 AS station_id, CAST({ts} AS DATE) AS day, floor(avg(CAST(event_id % 35 AS DOUBLE)) * 10 + 0.5) / 10 AS temp, "
    "floor(avg(CAST(20 + event_id % 70 AS DOUBLE)) + 0.5) AS rh, floor(avg(CAST(event_id % 40 AS DOUBLE)) + 0.5) AS wind_kmh, "
    "CAST(max(event_id % 7) * 2 - 8 AS DOUBLE) AS rain FROM events GROUP BY user_id % 20, CAST({ts} AS DATE)"
).replace("{ts}", TS)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table as a DataFrame."""
    if name in VIEWS:
        table, columns = VIEWS[name]
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)
    if name == "weather_days":
        return spark.sql(WEATHER_DAYS.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ctes(*names: str) -> str:
    """The same tables as SQL common table expressions."""
    parts = [f"{n} AS ({WEATHER_DAYS})" if n == "weather_days" else f"{n} AS (SELECT {', '.join(VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in names]
    return "WITH " + ", ".join(parts) + " "


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Register ``f(view frames...)`` as query ``name`` over the named tables; ``sql`` is its oracle on the same names."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, t) for t in tables))
        if sql is not None:
            own = [t for t in tables if t in VIEWS or t == "weather_days"]
            text = sql.strip()
            first, _, rest = text.partition(" ")
            if own and first.lower() == "with":
                recursive, _, tail = rest.partition(" ")
                rest, start = (tail, "WITH RECURSIVE ") if recursive.lower() == "recursive" else (rest, "WITH ")
                text = start + ctes(*own)[5:].rstrip() + ", " + rest
            elif own:
                text = ctes(*own) + text
            ORACLES[name] = text
        return f

    return add
