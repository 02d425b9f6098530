"""Registered queries: dashboard aggregates, lookups, projections, orders, bands and feed maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.functions.models import half_up
from terrafold.operators import spatial
from terrafold.plans.core import AREA_BOX, AS_OF, BOX, exact_avg, in_box, since, sql_avg
from terrafold.plans.views import TS, VIEWS, query

VIEWS |= {
    "water_readings": ("events", ("event_id AS id", "user_id AS site_no", f"{TS} AS read_at", "value AS level", "CAST((event_id * 37) % 101 AS INT) AS percentile")),
    "drought_reports": ("events", ("event_id AS id", f"{TS} AS fetched_at", "CASE WHEN event_id % 6 = 5 THEN NULL ELSE CAST(event_id % 6 AS INT) END AS dm")),
    "map_layers": ("nation", ("n_nationkey AS id", "n_name AS name", "CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey END AS team_id", "n_nationkey % 3 <> 0 AS is_public", "n_regionkey AS position")),
    "team_areas": ("nation", ("n_nationkey AS id", "n_name AS name", "CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE -124 + (n_nationkey % 5) * CAST(0.8 AS DOUBLE) END AS west", "37 + CAST(floor(n_nationkey / 5) AS INT) * CAST(0.4 AS DOUBLE) AS south")),
    "vegetation_points": ("part", ("p_partkey AS id", "CAST(85 + p_partkey % 125 AS INT) AS code")),
    "soil_raw": ("part", ("p_partkey AS id", "CASE p_size % 10 WHEN 0 THEN -9999 WHEN 1 THEN -999 WHEN 2 THEN 9999 ELSE p_size END AS clay", "CASE WHEN p_partkey % 7 = 0 THEN 9999 ELSE p_partkey % 100 END AS sand", "CASE WHEN p_partkey % 5 = 0 THEN -999 ELSE CAST(p_size AS INT) * 3 END AS carbon")),
    "soil_horizons": ("lineitem", ("l_partkey AS site_id", "CASE WHEN l_suppkey % 2 = 0 THEN 'survey' ELSE 'global' END AS source", "CAST((l_linenumber - 1) * 10 AS INT) AS top", "CAST((l_linenumber - 1) * 10 + 15 AS INT) AS bottom", "CAST(l_quantity AS INT) AS value")),
}


@query("a6_hourly_water", "water_readings", sql=f"select date_trunc('hour', read_at) as bucket, {sql_avg('level')} as avg_level, min(percentile) as min_percentile, count(*) as n from water_readings group by 1")
def hourly_water(readings: DataFrame) -> DataFrame:
    rows = readings.groupBy(F.window("read_at", "1 hour").alias("w")).agg(exact_avg("level").alias("avg_level"), F.min("percentile").alias("min_percentile"), F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("bucket"), "avg_level", "min_percentile", "n")


@query("a10_drought_trend", "drought_reports", sql="select date_trunc('week', fetched_at)::timestamp as week, floor(sum(coalesce(dm, 0)) * 10.0::double / count(*) + 0.5::double) / 10.0::double as mean_dm from drought_reports group by 1")
def drought_trend(reports: DataFrame) -> DataFrame:
    """A10: mean class of each week, a missing class as 0, one decimal."""
    rows = reports.groupBy(F.date_trunc("week", "fetched_at").alias("week"))
    return rows.agg(half_up(F.sum(F.coalesce("dm", F.lit(0))).cast("double") / F.count("*"), 1).alias("mean_dm"))


@query("a13_demand_density", "strategy_requests", sql=f"select id, lon, lat, coalesce(vote_count, 0)::int as weight from strategy_requests where {BOX(AREA_BOX)}")
def demand_density(requests: DataFrame) -> DataFrame:
    return requests.where(in_box(AREA_BOX)).select("id", "lon", "lat", F.coalesce("vote_count", F.lit(0)).cast("int").alias("weight"))


@query("a30_batch_messages", "features", sql="select date_trunc('day', created_at)::timestamp as batch, count(*) as n, count(*) || ' new features' as message from features group by 1")
def batch_messages(features: DataFrame) -> DataFrame:
    counts = features.groupBy(F.date_trunc("day", "created_at").alias("batch")).agg(F.count("*").alias("n"))
    return counts.withColumn("message", F.concat(F.col("n").cast("string"), F.lit(" new features")))


@query("j1_features_of_layer", "features", sql="with l as (select distinct layer_id, 'Layer ' || layer_id as name from features) select f.id, l.name from features f join l on l.layer_id = f.layer_id where l.name = 'Layer error' and f.status = 'published'")
def features_of_layer(features: DataFrame) -> DataFrame:
    """Features of a layer that is chosen by its name."""
    layers = features.select("layer_id", F.concat(F.lit("Layer "), "layer_id").alias("name")).distinct().where("name = 'Layer error'")
    return features.where("status = 'published'").join(layers, "layer_id").select("id", "name")


@query("j3_unread_with_user", "environmental_alerts", "customer", sql=f"select a.id, a.user_id, c.c_name as user_name, a.severity from environmental_alerts a join customer c on c.c_custkey = a.user_id where not a.is_read and a.created_at >= timestamp '{AS_OF}' - interval 24 hours")
def unread_with_user(alerts: DataFrame, users: DataFrame) -> DataFrame:
    recent = alerts.where(~F.col("is_read") & since("created_at", AS_OF, "'24' HOUR"))
    return recent.join(users, F.col("user_id") == F.col("c_custkey")).select("id", "user_id", F.col("c_name").alias("user_name"), "severity")


@query("j4_team_roster", "team_members", "teams", "customer", sql="select t.id as team_id, t.name as team, m.user_id, c.c_name as user_name, m.team_role from team_members m join teams t on t.id = m.team_id join customer c on c.c_custkey = m.user_id")
def team_roster(people: DataFrame, teams: DataFrame, users: DataFrame) -> DataFrame:
    joined = people.join(teams, F.col("team_id") == F.col("id")).join(users, F.col("user_id") == F.col("c_custkey"))
    return joined.select("team_id", F.col("name").alias("team"), "user_id", F.col("c_name").alias("user_name"), "team_role")


@query("j14_zones_near_place", "watched_locations", "geofences", sql="""
with z as (select id as zone_id, west + 0.4::double as clon, south + 0.4::double as clat from geofences),
m as (select w.id, z.zone_id, row_number() over (partition by w.id order by z.zone_id) as place from watched_locations w join z on w.lat between clat - 0.5::double and clat + 0.5::double and w.lon between clon - 0.5::double and clon + 0.5::double)
select id, zone_id, place::int as place from m where place <= 10""")  # fmt: skip
def zones_near_place(places: DataFrame, zones: DataFrame) -> DataFrame:
    """At most ten zones whose centroid is within half a degree both ways."""
    centre = zones.select(F.col("id").alias("zone_id"), (F.col("west") + 0.4).alias("clon"), (F.col("south") + 0.4).alias("clat"))
    boxes = centre.select("zone_id", (F.col("clon") - 0.5).alias("west"), (F.col("clat") - 0.5).alias("south"), (F.col("clon") + 0.5).alias("east"), (F.col("clat") + 0.5).alias("north"))
    place = F.row_number().over(W.partitionBy("id").orderBy("zone_id"))
    return spatial.box_join(places.select("id", "lat", "lon"), boxes).select("id", "zone_id", place.alias("place")).where("place <= 10")


# Ranges of vegetation codes (first, last) with rate of spread, flame length in feet, heat by area, load factor; then the default.
FUEL_RANGES = (
    (91, 99, 0.0, 0.0, 0.0, 0.05), (101, 109, 60.0, 2.5, 2000.0, 0.8), (121, 124, 45.0, 3.5, 3500.0, 0.82), (141, 149, 35.0, 5.0, 5500.0, 0.85),
    (161, 165, 20.0, 3.0, 4000.0, 0.72), (181, 189, 15.0, 2.0, 3000.0, 0.75), (201, 204, 10.0, 6.0, 8000.0, 0.9),
)
FUEL_DEFAULT = (20.0, 3.0, 3500.0, 0.5)
FUEL_NAMES = ("spread_rate", "flame_length", "heat", "load_factor")


def fuel_parameters(code: Column) -> list[Column]:
    """The four parameters of a vegetation code; seven ranges are one expression, no join."""

    def pick(k: int) -> Column:
        found = reduce(lambda c, r: c.when(code.between(r[0], r[1]), r[2 + k]), FUEL_RANGES[1:], F.when(code.between(*FUEL_RANGES[0][:2]), FUEL_RANGES[0][2 + k]))
        return found.otherwise(FUEL_DEFAULT[k]).alias(FUEL_NAMES[k])

    return [pick(k) for k in range(4)]


FUEL_ROWS = ", ".join(str(tuple(r)) for r in FUEL_RANGES)


@query("j19_fuel_parameters", "vegetation_points", sql=f"""
with r(lo, hi, a, b, c, d) as (values {FUEL_ROWS})
select v.id, v.code, coalesce(a, 20)::double as spread_rate, coalesce(b, 3)::double as flame_length, coalesce(c, 3500)::double as heat, coalesce(d, 0.5)::double as load_factor from vegetation_points v left join r on v.code between lo and hi""")  # fmt: skip
def fuels(points: DataFrame) -> DataFrame:
    return points.select("id", "code", *fuel_parameters(F.col("code")))


@query("j24_latest_drought_everywhere", "watched_locations", "drought_reports", sql="with d as (select arg_max(dm, (fetched_at, id)) as dm, max(fetched_at) as fetched_at from drought_reports where dm is not null) select w.id, d.dm, d.fetched_at from watched_locations w, d")
def latest_drought(places: DataFrame, reports: DataFrame) -> DataFrame:
    """The latest report beside every place; the joined side is one row."""
    latest = reports.where("dm is not null").agg(F.max_by("dm", F.struct("fetched_at", "id")).alias("dm"), F.max("fetched_at").alias("fetched_at"))
    return places.select("id").crossJoin(F.broadcast(latest))


@query("w9_latest_reading", "water_readings", sql="select site_no, arg_max(id, (read_at, id)) as id, max(read_at) as read_at from water_readings group by 1")
def latest_reading(readings: DataFrame) -> DataFrame:
    return readings.groupBy("site_no").agg(F.max_by("id", F.struct("read_at", "id")).alias("id"), F.max("read_at").alias("read_at"))


@query("p8_visible_layers", "map_layers", sql="select id, name from map_layers where (team_id = 2 or team_id is null) and is_public")
def visible_layers(layers: DataFrame) -> DataFrame:
    return layers.where(((F.col("team_id") == 2) | F.col("team_id").isNull()) & F.col("is_public")).select("id", "name")


@query("p10_by_id", "strategy_requests", sql="select id, strategy_type, status from strategy_requests where id = 7")
def by_id(requests: DataFrame) -> DataFrame:
    return requests.where("id = 7").select("id", "strategy_type", "status").limit(1)


@query("p11_conditions_in", "water_gauges", sql="select site_no, condition from water_gauges where condition in ('low', 'critically_low')")
def conditions_in(gauges: DataFrame) -> DataFrame:
    return gauges.where(F.col("condition").isin("low", "critically_low")).select("site_no", "condition")


def json_text(*paths: str) -> list[Column]:
    return [F.get_json_object("properties", f"$.{p}") for p in paths]


@query("p14_point_projection", "features", sql="select id, lon, lat, coalesce(try_cast(properties->>'size' as double), try_cast(properties->>'value' as double), 1.0)::double as size, coalesce(properties->>'category', properties->>'type', 'default') as category from features where status = 'published'")
def point_projection(features: DataFrame) -> DataFrame:
    size = F.coalesce(*(x.try_cast("double") for x in json_text("size", "value")), F.lit(1.0))
    return features.where("status = 'published'").select("id", "lon", "lat", size.alias("size"), F.coalesce(*json_text("category", "type"), F.lit("default")).alias("category"))


@query("p15_flow_projection", "features", sql="select id, coalesce(try_cast(json_extract_string(properties, '$.source.lon') as double), lon) as from_lon, coalesce(try_cast(json_extract_string(properties, '$.target.lon') as double), lon) as to_lon, coalesce(try_cast(properties->>'value' as double), try_cast(properties->>'volume' as double), 1.0)::double as value from features where status = 'published'")
def flow_projection(features: DataFrame) -> DataFrame:
    """Nested coordinates, with the feature's own place where there are none."""
    source, target, value, volume = (x.try_cast("double") for x in json_text("source.lon", "target.lon", "value", "volume"))
    return features.where("status = 'published'").select("id", F.coalesce(source, "lon").alias("from_lon"), F.coalesce(target, "lon").alias("to_lon"), F.coalesce(value, volume, F.lit(1.0)).alias("value"))


@query("p17_teams_serving_point", "team_areas", sql="select id, name from team_areas where west is null or (-120.5 between west and west + 2 and 38.2 between south and south + 1)")
def teams_serving(areas: DataFrame) -> DataFrame:
    inside = F.lit(-120.5).between(F.col("west"), F.col("west") + 2) & F.lit(38.2).between(F.col("south"), F.col("south") + 1)
    return areas.where(F.col("west").isNull() | inside).select("id", "name")


@query("p20_merged_properties", "features", sql="select id, id::varchar as merged_id, properties->>'k' as k, (len(json_keys(properties)) + 1)::int as n_keys from features")
def merged_properties(features: DataFrame) -> DataFrame:
    """P20: the id put into the properties, which stay text by key."""
    merged = F.map_concat(F.map_filter(F.from_json("properties", "map<string,string>"), lambda k, _: k != "id"), F.create_map(F.lit("id"), F.col("id").cast("string")))
    return features.select("id", merged.alias("m")).select("id", F.element_at("m", "id").alias("merged_id"), F.element_at("m", "k").alias("k"), F.size("m").alias("n_keys"))


@query("p21_selected_alerts", "environmental_alerts", sql="select id, watched_location_id from environmental_alerts where watched_location_id in (3, 14, 15) and not is_read and severity = 'critical'")
def selected_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("watched_location_id").isin(3, 14, 15) & ~F.col("is_read") & (F.col("severity") == "critical")).select("id", "watched_location_id")


@query("t3_newest_alerts", "environmental_alerts", sql="select id, created_at from environmental_alerts order by created_at desc, id desc limit 100")
def newest_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.desc("created_at"), F.desc("id")).limit(100).select("id", "created_at")


@query("t5_by_name", "geofences", sql="select id, name from geofences order by name, id")
def by_name(fences: DataFrame) -> DataFrame:
    return fences.select("id", "name").orderBy("name", "id")


@query("t7_ascending_series", "water_readings", sql="select site_no, read_at, level, row_number() over (partition by site_no order by read_at, id)::int as step from water_readings")
def ascending_series(readings: DataFrame) -> DataFrame:
    """Every site's readings by time; ordered within the site, so no task holds all of them."""
    step = F.row_number().over(W.partitionBy("site_no").orderBy("read_at", "id"))
    return readings.select("site_no", "read_at", "level", step.alias("step"))


@query("t8_capped", "watched_locations", sql="select id, name from watched_locations order by id limit 50")
def capped(places: DataFrame) -> DataFrame:
    return places.select("id", "name").orderBy("id").limit(50)


def band(value: Column, *steps: tuple[float, str], rest: str) -> Column:
    """The name of the first step that the value is not above."""
    return reduce(lambda c, s: c.when(value <= s[0], s[1]), steps[1:], F.when(value <= steps[0][0], steps[0][1])).otherwise(rest)


@query("d29_status_bands", "fire_detections", "environmental_alerts", "positions", sql=f"""
with f as (select count(*) as fires from fire_detections where detected_at >= timestamp '{AS_OF}' - interval 24 hours),
a as (select count(*) as alerts from environmental_alerts where not is_read and created_at >= timestamp '{AS_OF}' - interval 24 hours), p as (select count(distinct asset_id) as fleet from positions)
select fires, alerts, fleet, case when fires = 0 then 'green' when fires < 10 then 'yellow' else 'red' end as fire_status, case when alerts = 0 then 'green' when alerts < 5 then 'yellow' else 'red' end as alert_status,
       case when fleet > 20 then 'green' when fleet > 5 then 'yellow' else 'red' end as fleet_status from f, a, p""")  # fmt: skip
def status_bands(fires: DataFrame, alerts: DataFrame, positions: DataFrame) -> DataFrame:
    f = fires.where(since("detected_at", AS_OF, "'24' HOUR")).agg(F.count("*").alias("fires"))
    a = alerts.where(~F.col("is_read") & since("created_at", AS_OF, "'24' HOUR")).agg(F.count("*").alias("alerts"))
    p = positions.agg(F.count_distinct("asset_id").alias("fleet"))
    fire, alert = band(F.col("fires"), (0, "green"), (9, "yellow"), rest="red"), band(F.col("alerts"), (0, "green"), (4, "yellow"), rest="red")
    return f.crossJoin(a).crossJoin(p).select("*", fire.alias("fire_status"), alert.alias("alert_status"), band(F.col("fleet"), (5, "red"), (20, "yellow"), rest="green").alias("fleet_status"))


@query("k5_replace_all", "drought_reports", "water_readings", sql="select id, 'drought' as kind from drought_reports where dm is not null union all select id, 'water' as kind from water_readings where percentile > 90")
def replaced(reports: DataFrame, readings: DataFrame) -> DataFrame:
    """K5: all rows of one kind are replaced by a new batch; the other kind stays."""
    stored = reports.where("dm is not null").select("id", F.lit("drought").alias("kind")).unionByName(readings.where("percentile <= 10").select("id", F.lit("water").alias("kind")))
    batch = readings.where("percentile > 90").select("id", F.lit("water").alias("kind"))
    return stored.join(F.broadcast(batch.select("kind").distinct()), "kind", "left_anti").unionByName(batch)


@query("k17_find_or_create_layer", "features", "map_layers", sql="""
with n as (select distinct layer_id as name from features), m as (select max(id) as top from map_layers),
l as (select id, name from map_layers union all select (m.top + row_number() over (order by n.name))::bigint, n.name from n, m where n.name not in (select name from map_layers))
select f.id, l.id as layer_number from features f join l on l.name = f.layer_id""")  # fmt: skip
def find_or_create(features: DataFrame, layers: DataFrame) -> DataFrame:
    """Features go to the layer of their name, which is made if it is missing; names are few, so they are numbered in one window."""
    names = features.select(F.col("layer_id").alias("name")).distinct().join(layers.select("name"), "name", "left_anti")
    top = layers.agg(F.max("id").alias("top"))
    made = names.crossJoin(F.broadcast(top)).select((F.col("top") + F.row_number().over(W.orderBy("name"))).cast("long").alias("number"), "name")
    every = layers.select(F.col("id").cast("long").alias("number"), "name").unionByName(made)
    return features.join(every, F.col("layer_id") == F.col("name")).select("id", F.col("number").alias("layer_number"))


@query("k19_batch_add", "features", sql="select layer_id, id, row_number() over (partition by layer_id order by created_at, id)::int as position from features where status = 'published'")
def batch_add(features: DataFrame) -> DataFrame:
    """Published features get the next positions of their layer."""
    position = F.row_number().over(W.partitionBy("layer_id").orderBy("created_at", "id"))
    return features.where("status = 'published'").select("layer_id", "id", position.alias("position"))


@query("x7_quality_pass", "soil_raw", sql="""
with c as (select id, case when clay in (-9999, -999, 9999) then null else clay / 100.0::double end as clay, case when sand in (-9999, -999, 9999) then null else sand / 100.0::double end as sand, case when carbon in (-9999, -999, 9999) then null else carbon / 10.0::double end as carbon from soil_raw)
select id, clay, sand, carbon, coalesce(carbon > 12, false) as carbon_outlier, floor(((clay is not null)::int + (sand is not null)::int + (carbon is not null)::int) / 3.0::double * 100 + 0.5::double) / 100.0::double as confidence from c""")  # fmt: skip
def quality_pass(raw: DataFrame) -> DataFrame:
    """Units, sentinels to null, an outlier flag, and the share of values that are there."""
    clean = lambda c, unit: F.when(~F.col(c).isin(-9999, -999, 9999), F.col(c) / unit).alias(c)
    rows = raw.select("id", clean("clay", 100.0), clean("sand", 100.0), clean("carbon", 10.0))
    there = sum((F.col(c).isNotNull().cast("int") for c in ("clay", "sand", "carbon")), F.lit(0))
    return rows.select("*", F.coalesce(F.col("carbon") > 12, F.lit(False)).alias("carbon_outlier"), half_up(there / 3.0, 2).alias("confidence"))


@query("x8_preferred_soil", "soil_horizons", sql="""
with h as (select site_id, source, greatest(least(bottom, 30) - top, 0) as thick, value from soil_horizons),
m as (select site_id, source, floor(sum(value * thick) * 100.0::double / sum(thick) + 0.5::double) / 100.0::double as value from h where thick > 0 group by 1, 2)
select site_id, arg_min(source, case source when 'survey' then 0 else 1 end) as source, arg_min(value, case source when 'survey' then 0 else 1 end) as value from m group by 1""")  # fmt: skip
def preferred_soil(horizons: DataFrame) -> DataFrame:
    """The mean of the upper 30 cm weighted by thickness, from the survey where it has the site."""
    thick = F.greatest(F.least("bottom", F.lit(30)) - F.col("top"), F.lit(0))
    means = horizons.withColumn("thick", thick).where("thick > 0").groupBy("site_id", "source").agg(half_up(F.sum(F.col("value") * F.col("thick")).cast("double") / F.sum("thick"), 2).alias("value"))
    rank = F.when(F.col("source") == "survey", 0).otherwise(1)
    best = means.groupBy("site_id").agg(F.min_by(F.struct("source", "value"), rank).alias("b"))
    return best.select("site_id", "b.source", "b.value")


@query("x9_same_period", "orders", sql="""
with m as (select date_trunc('month', o_orderdate)::date as month, sum(o_totalprice::decimal(18,2)) as total from orders group by 1)
select a.month::timestamp as month, a.total::double as total, b.total::double as year_before, c.total::double as three_before, d.total::double as five_before,
       (select sum(x.total) from m x where x.month > a.month - interval 12 months and x.month <= a.month)::double as rolling_year
from m a left join m b on b.month = a.month - interval 1 year left join m c on c.month = a.month - interval 3 years left join m d on d.month = a.month - interval 5 years""")  # fmt: skip
def same_period(orders: DataFrame) -> DataFrame:
    """Each month beside the same month 1, 3 and 5 years before, and the total of twelve months up to it. A month without a predecessor stays, with null."""
    months = orders.groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    number = F.year("month") * 12 + F.month("month")
    rolling = F.sum("total").over(W.orderBy(number).rangeBetween(-11, 0))  # a row for each month, so one task is enough
    out = months.select("month", F.col("total").cast("double").alias("total"), rolling.cast("double").alias("rolling_year"))
    for years, name in ((1, "year_before"), (3, "three_before"), (5, "five_before")):
        before = months.select(F.add_months("month", 12 * years).alias("month"), F.col("total").cast("double").alias(name))
        out = out.join(before, "month", "left")
    return out.withColumn("month", F.col("month").cast("timestamp"))
