"""Registered queries: filters, joins, aggregates, windows, ranking and set operations on the logical tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.functions.models import half_up, risk_trend
from terrafold.operators import tracks
from terrafold.plans.views import query

#: The fixed clock of the queries over events, and of those over orders.
AS_OF, ORDERS_AS_OF = "2024-01-31 00:00:00", "2001-08-02 00:00:00"
#: West, south, east, north.
FIRE_BOX, AREA_BOX = (-122.0, 34.0, -110.0, 44.0), (-121.0, 38.0, -119.0, 40.0)


def in_box(box: tuple[float, float, float, float], lat: str = "lat", lon: str = "lon") -> Column:
    """Borders included; plain ranges, so they reach the scan."""
    return F.col(lon).between(box[0], box[2]) & F.col(lat).between(box[1], box[3])


def parse_box(text: Column) -> Column:
    """Four numbers or null."""
    parts = F.transform(F.split(text, ","), lambda x: x.try_cast("double"))
    ok = (F.size(parts) == 4) & ~F.exists(parts, lambda x: x.isNull())
    return F.when(ok, F.struct(*(F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(("west", "south", "east", "north")))))


def since(column: str, as_of: str, interval: str) -> Column:
    """At or after ``as_of`` less the interval."""
    return F.col(column) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {interval}")


def rule_filter(rules: list[dict], properties: str = "properties") -> Column:
    """Rules {property, op, value} over a JSON column, all must hold; numbers compare as numbers."""

    def one(rule: dict) -> Column:
        text = F.get_json_object(properties, f"$.{rule['property']}")
        value, op = rule["value"], rule["op"]
        if op == "contains":
            return F.lower(text).contains(str(value).lower())
        left = text.try_cast("double") if isinstance(value, (int, float)) else text
        return {"=": left == value, "!=": left != value, ">": left > value, "<": left < value}[op]

    return reduce(lambda a, b: a & b, [one(r) for r in rules], F.lit(True))


def given(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters for the arguments that are given."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]) if kv[1] is not None else d, wanted.items(), df)


def money(c: str) -> Column:
    """A double as a decimal, so that sums don't depend on the order."""
    return F.col(c).cast("decimal(18,6)")


def exact_avg(c: str) -> Column:
    """Mean by a decimal sum, to four digits."""
    return half_up(F.sum(money(c)).cast("double") / F.count(c), 4)


def sql_avg(c: str) -> str:
    return f"floor(sum({c}::decimal(18,6))::double / count({c}) * 10000.0::double + 0.5) / 10000.0::double"


BOX = lambda b: f"lon BETWEEN {b[0]} AND {b[2]} AND lat BETWEEN {b[1]} AND {b[3]}"


@query("a12_priority_subregions", "strategy_requests", sql=f"""
with g as (select round(lat::decimal(12,6), 1)::decimal(9,1) as la, round(lon::decimal(12,6), 1)::decimal(9,1) as lo, strategy_type, count(*)::bigint as request_count, sum(vote_count)::bigint as total_votes
           from strategy_requests where {BOX(AREA_BOX)} and status <> 'completed' group by 1, 2, 3),
t as (select *, row_number() over (order by total_votes desc, request_count desc, la, lo, strategy_type) as i from g)
select i::int as position, 'Area ' || i || ' (' || la || ', ' || lo || ')' as name, strategy_type, request_count, total_votes, la::double as lat, lo::double as lon,
       least(100.0::double, floor(total_votes * 0.6::double + request_count * 4 + 0.5::double)) as score from t where i <= 5""")  # fmt: skip
def priority_subregions(requests: DataFrame) -> DataFrame:
    """Grid cells with most votes; ties by count, place and type."""
    cell = lambda c: F.round(F.col(c).cast("decimal(12,6)"), 1).cast("decimal(9,1)")
    grouped = requests.where(in_box(AREA_BOX) & (F.col("status") != "completed")).groupBy(cell("lat").alias("la"), cell("lon").alias("lo"), "strategy_type").agg(F.count("*").alias("request_count"), F.sum("vote_count").alias("total_votes"))
    order = [F.desc("total_votes"), F.desc("request_count"), "la", "lo", "strategy_type"]
    top = grouped.orderBy(*order).limit(5).withColumn("position", F.row_number().over(W.orderBy(*order)))
    score = F.least(F.lit(100.0), F.floor(F.col("total_votes") * 0.6 + F.col("request_count") * 4 + 0.5).cast("double"))
    return top.select("position", F.format_string("Area %d (%s, %s)", "position", F.col("la").cast("string"), F.col("lo").cast("string")).alias("name"), "strategy_type", "request_count", "total_votes", F.col("la").cast("double").alias("lat"), F.col("lo").cast("double").alias("lon"), score.alias("score"))


@query("p1_bbox_filter", "fire_detections", sql=f"select id, lat, lon from fire_detections where {BOX(FIRE_BOX)}")
def bbox_filter(fires: DataFrame) -> DataFrame:
    return fires.where(in_box(FIRE_BOX)).select("id", "lat", "lon")


@query("p3_recent_fires", "fire_detections", sql=f"select id, detected_at from fire_detections where detected_at >= timestamp '{AS_OF}' - interval 7 days")
def recent_fires(fires: DataFrame) -> DataFrame:
    return fires.where(since("detected_at", AS_OF, "'7' DAY")).select("id", "detected_at")


@query("p4_json_path", "features", sql="select id, try_cast(properties->>'k' as double) as k from features where kind = 'fire_detection' and try_cast(properties->>'k' as double) between 20 and 60")
def json_path(features: DataFrame) -> DataFrame:
    k = F.get_json_object("properties", "$.k").try_cast("double")
    return features.where((F.col("kind") == "fire_detection") & k.between(20, 60)).select("id", k.alias("k"))


@query("p5_array_contains", "teams", sql="select id, name from teams where list_contains([specialty_a, specialty_b], 'biochar')")
def team_specialty(teams: DataFrame) -> DataFrame:
    return teams.where(F.array_contains(F.array("specialty_a", "specialty_b"), "biochar")).select("id", "name")


@query("p6_text_search", "watched_locations", sql="select id, name from watched_locations where name ilike '%00012%' order by id limit 50")
def text_search(places: DataFrame) -> DataFrame:
    return places.where(F.col("name").ilike("%00012%")).select("id", "name").orderBy("id").limit(50)


@query("p7_rule_filter", "features", sql="select id from features where try_cast(properties->>'k' as double) > 30 and try_cast(properties->>'k' as double) < 70 and contains(lower(properties->>'k'), '4')")
def ruled(features: DataFrame) -> DataFrame:
    rules = [{"property": "k", "op": ">", "value": 30}, {"property": "k", "op": "<", "value": 70}, {"property": "k", "op": "contains", "value": "4"}]
    return features.where(rule_filter(rules)).select("id")


@query("p9_optional_filter", "strategy_requests", sql=f"select id, strategy_type, vote_count from strategy_requests where strategy_type = 'biochar' and {BOX(AREA_BOX)} order by vote_count desc, id limit 200")
def optional_filter(requests: DataFrame) -> DataFrame:
    found = given(requests, strategy_type="biochar", status=None).where(in_box(AREA_BOX))
    return found.orderBy(F.desc_nulls_first("vote_count"), "id").limit(200).select("id", "strategy_type", "vote_count")


@query("p12_status_filter", "features", sql="select layer_id, count(*) as n from features where status = 'pending_review' group by 1")
def pending(features: DataFrame) -> DataFrame:
    return features.where("status = 'pending_review'").groupBy("layer_id").agg(F.count("*").alias("n"))


@query("p13_heat_projection", "features", sql="select id, lon, lat, coalesce(try_cast(properties->>'weight' as double), try_cast(properties->>'intensity' as double), try_cast(properties->>'k' as double), 1.0) as weight from features where status = 'published'")
def heat(features: DataFrame) -> DataFrame:
    number = lambda k: F.get_json_object("properties", f"$.{k}").try_cast("double")
    return features.where("status = 'published'").select("id", "lon", "lat", F.coalesce(number("weight"), number("intensity"), number("k"), F.lit(1.0)).alias("weight"))


@query("p19_validation_split", "features", sql="select case when lat < 33 then 'lat' when lon > -101 then 'lon' when risk_score < 1 then 'risk' else 'ok' end as reason, count(*) as n from features group by 1")
def validation(features: DataFrame) -> DataFrame:
    """One pass that names the first broken rule."""
    reason = F.when(F.col("lat") < 33, "lat").when(F.col("lon") > -101, "lon").when(F.col("risk_score") < 1, "risk").otherwise("ok")
    return features.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("a1_count_by_layer", "features", sql="select layer_id, count(*) as n from features group by 1")
def count_by_layer(features: DataFrame) -> DataFrame:
    return features.groupBy("layer_id").agg(F.count("*").alias("n"))


@query("a2_recent_by_layer", "features", sql=f"select layer_id, count(*) as n from features where created_at >= timestamp '{AS_OF}' - interval 48 hours group by 1")
def recent_by_layer(features: DataFrame) -> DataFrame:
    return features.where(since("created_at", AS_OF, "'48' HOUR")).groupBy("layer_id").agg(F.count("*").alias("n"))


@query("a3_system_stats", "features", sql="select count(distinct layer_id) as layers, count(*) as features from features")
def system_stats(features: DataFrame) -> DataFrame:
    return features.agg(F.count_distinct("layer_id").alias("layers"), F.count("*").alias("features"))


@query("a4_density", "features", sql=f"select count(*) as n from features where {BOX(FIRE_BOX)}")
def density(features: DataFrame) -> DataFrame:
    return features.where(in_box(FIRE_BOX)).agg(F.count("*").alias("n"))


@query("a5_hourly_fire_risk", "features", sql=f"select date_trunc('hour', created_at) as bucket, {sql_avg('risk_score')} as avg_risk, max(risk_score) as max_risk, count(*) as n from features where kind = 'fire_detection' group by 1")
def hourly_fire(features: DataFrame) -> DataFrame:
    rows = features.where("kind = 'fire_detection'").groupBy(F.window("created_at", "1 hour").alias("w"))
    return rows.agg(exact_avg("risk_score").alias("avg_risk"), F.max("risk_score").alias("max_risk"), F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), "avg_risk", "max_risk", "n")


@query("a7_weekly_ndvi", "features", sql=f"select date_trunc('week', created_at)::timestamp as bucket, {sql_avg('risk_score')} as avg_ndvi, min(risk_score) as min_ndvi, count(*) as n from features where kind = 'ndvi_observation' group by 1")
def weekly_ndvi(features: DataFrame) -> DataFrame:
    rows = features.where("kind = 'ndvi_observation'").groupBy(F.window("created_at", "7 days", startTime="4 days").alias("w"))
    return rows.agg(exact_avg("risk_score").alias("avg_ndvi"), F.min("risk_score").alias("min_ndvi"), F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), "avg_ndvi", "min_ndvi", "n")


@query("a8_daily_fire_trend", "fire_detections", sql=f"select date_trunc('day', detected_at)::timestamp as day, count(*) as n from fire_detections where detected_at >= timestamp '{AS_OF}' - interval 14 days and {BOX(FIRE_BOX)} group by 1")
def daily_trend(fires: DataFrame) -> DataFrame:
    return fires.where(since("detected_at", AS_OF, "'14' DAY") & in_box(FIRE_BOX)).groupBy(F.date_trunc("day", "detected_at").alias("day")).agg(F.count("*").alias("n"))


@query("a9_water_trend", "water_gauges", sql=f"select coalesce(floor(avg(percentile) + 0.5::double), 50.0::double) as percentile from water_gauges where {BOX(FIRE_BOX)}")
def water_trend(gauges: DataFrame) -> DataFrame:
    return gauges.where(in_box(FIRE_BOX)).agg(F.coalesce(half_up(F.avg("percentile")), F.lit(50.0)).alias("percentile"))


@query("a11_regional_risk", "features", "drought_areas", "water_gauges", "fire_detections", sql=f"""
with f as (select {sql_avg('risk_score')} as risk from features where kind = 'fire_detection' and {BOX(FIRE_BOX)}),
d as (select avg(dm) as dm from drought_areas), w as (select avg(percentile) as p from water_gauges where {BOX(FIRE_BOX)}),
n as (select count(*) as fires from fire_detections where {BOX(FIRE_BOX)} and detected_at >= timestamp '{AS_OF}' - interval 7 days)
select coalesce(risk, 0.0::double) as fire_risk, coalesce(dm, 0.0::double) as drought, floor(coalesce(p, 50.0::double) * 100 + 0.5::double) / 100.0::double as percentile, fires,
       case when coalesce(risk, 0) > 50 or coalesce(dm, 0) >= 3 then 'worsening' when coalesce(risk, 0) < 20 and coalesce(dm, 0) <= 1 then 'improving' else 'stable' end as trend from f, d, w, n""")  # fmt: skip
def regional_risk(features: DataFrame, drought: DataFrame, gauges: DataFrame, fires: DataFrame) -> DataFrame:
    """Four one-row aggregates side by side."""
    f = features.where((F.col("kind") == "fire_detection") & in_box(FIRE_BOX)).agg(F.coalesce(exact_avg("risk_score"), F.lit(0.0)).alias("fire_risk"))
    d = drought.agg(F.coalesce(F.avg("dm"), F.lit(0.0)).alias("drought"))
    w = gauges.where(in_box(FIRE_BOX)).agg(half_up(F.coalesce(F.avg("percentile"), F.lit(50.0)), 2).alias("percentile"))
    n = fires.where(in_box(FIRE_BOX) & since("detected_at", AS_OF, "'7' DAY")).agg(F.count("*").alias("fires"))
    return f.crossJoin(d).crossJoin(w).crossJoin(n).withColumn("trend", risk_trend(F.col("fire_risk"), F.col("drought")))


@query("a14_demand_by_strategy", "strategy_requests", sql="select strategy_type, count(*) as n, sum(vote_count)::bigint as votes from strategy_requests group by 1")
def demand(requests: DataFrame) -> DataFrame:
    return requests.groupBy("strategy_type").agg(F.count("*").alias("n"), F.sum("vote_count").alias("votes"))


@query("a15_condition_counts", "water_gauges", sql="select condition, count(*) as n from water_gauges group by 1")
def conditions(gauges: DataFrame) -> DataFrame:
    return gauges.groupBy("condition").agg(F.count("*").alias("n"))


@query("a16_dominant_class", "fire_detections", sql="select arg_min(confidence, (-n, confidence)) as confidence, max(n) as n from (select confidence, count(*) as n from fire_detections group by 1)")
def dominant(fires: DataFrame) -> DataFrame:
    """The most frequent class; ties to the smallest."""
    counts = fires.groupBy("confidence").agg(F.count("*").alias("n"))
    return counts.agg(F.min_by("confidence", F.struct(-F.col("n"), "confidence")).alias("confidence"), F.max("n").alias("n"))


@query("a18_fleet_status", "positions", sql=f"""
with last as (select asset_id, max(time) as t from positions group by 1)
select count(*) as total, count(*) filter (t >= timestamp '{AS_OF}' - interval 24 hours) as active, count(*) filter (t < timestamp '{AS_OF}' - interval 24 hours and t >= timestamp '{AS_OF}' - interval 72 hours) as idle, count(*) filter (t < timestamp '{AS_OF}' - interval 72 hours) as offline from last""")  # fmt: skip
def fleet(positions: DataFrame) -> DataFrame:
    last = positions.groupBy("asset_id").agg(F.max("time").alias("time"))
    day, three = since("time", AS_OF, "'24' HOUR"), since("time", AS_OF, "'72' HOUR")
    return last.agg(F.count("*").alias("total"), F.count_if(day).alias("active"), F.count_if(~day & three).alias("idle"), F.count_if(~three).alias("offline"))


@query("a19_share_of_total", "features", sql="select layer_id, count(*) as n, floor(count(*) / sum(count(*)) over ()::double * 10000 + 0.5::double) / 10000.0::double as share from features group by 1")
def shares(features: DataFrame) -> DataFrame:
    counts = features.groupBy("layer_id").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("layer_id", "n", half_up(F.try_divide("n", "total"), 4).alias("share"))


@query("a24_distinct_text", "strategy_requests", sql="select user_id, string_agg(distinct strategy_type, ', ' order by strategy_type) as types from strategy_requests group by 1")
def distinct_text(requests: DataFrame) -> DataFrame:
    return requests.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("strategy_type")), ", ").alias("types"))


@query("a25_unread", "environmental_alerts", sql="select user_id, count(*) as unread from environmental_alerts where not is_read group by 1")
def unread(alerts: DataFrame) -> DataFrame:
    return alerts.where("not is_read").groupBy("user_id").agg(F.count("*").alias("unread"))


@query("a26_member_count", "teams", "team_members", sql="select t.id, t.name, coalesce(m.n, 0) as members from teams t left join (select team_id, count(*) as n from team_members group by 1) m on m.team_id = t.id")
def members(teams: DataFrame, people: DataFrame) -> DataFrame:
    """Counts first, so the join meets one row for each team."""
    counts = people.groupBy("team_id").agg(F.count("*").alias("n"))
    return teams.join(counts, F.col("id") == F.col("team_id"), "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("members"))


@query("a27_series_extent", "fire_detections", sql="select date_trunc('day', detected_at)::timestamp as day, count(*) as n, floor(count(*) / max(count(*)) over ()::double * 10000 + 0.5::double) / 10000.0::double as scaled from fire_detections group by 1")
def scaled(fires: DataFrame) -> DataFrame:
    days = fires.groupBy(F.date_trunc("day", "detected_at").alias("day")).agg(F.count("*").alias("n"))
    return days.crossJoin(F.broadcast(days.agg(F.max("n").alias("top")))).select("day", "n", half_up(F.try_divide("n", "top"), 4).alias("scaled"))


@query("u1_table_counts", "features", "positions", "strategy_requests", "water_gauges", sql="select 'features' as name, count(*) as n from features union all select 'positions', count(*) from positions union all select 'strategy_requests', count(*) from strategy_requests union all select 'water_gauges', count(*) from water_gauges")
def table_counts(features: DataFrame, positions: DataFrame, requests: DataFrame, gauges: DataFrame) -> DataFrame:
    named = (("features", features), ("positions", positions), ("strategy_requests", requests), ("water_gauges", gauges))
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in named])


@query("j2_alert_driver", "alert_subscriptions", "watched_locations", "customer", sql="select s.user_id, s.alert_type, w.id as location_id, w.radius_km, c.c_mktsegment as segment from alert_subscriptions s join watched_locations w on w.id = s.watched_location_id join customer c on c.c_custkey = s.user_id where s.in_app_enabled")
def alert_driver(subs: DataFrame, places: DataFrame, users: DataFrame) -> DataFrame:
    joined = subs.where("in_app_enabled").join(places.select("id", "radius_km"), F.col("watched_location_id") == F.col("id")).join(users, F.col("user_id") == F.col("c_custkey"))
    return joined.select("user_id", "alert_type", F.col("id").alias("location_id"), "radius_km", F.col("c_mktsegment").alias("segment"))


@query("j5_unknown_layer", "features", sql="with l as (select distinct layer_id, 'Layer ' || layer_id as name from features where layer_id <> 'error') select coalesce(l.name, 'Unknown') as name, count(*) as n from features f left join l on l.layer_id = f.layer_id group by 1")
def unknown_layer(features: DataFrame) -> DataFrame:
    layers = features.where("layer_id <> 'error'").select("layer_id", F.concat(F.lit("Layer "), "layer_id").alias("name")).distinct()
    counts = features.groupBy("layer_id").agg(F.count("*").alias("n"))
    return counts.join(layers, "layer_id", "left").select(F.coalesce("name", F.lit("Unknown")).alias("name"), "n")


@query("j15_alert_suppression", "alert_subscriptions", "environmental_alerts", sql=f"select s.user_id, s.alert_type from alert_subscriptions s where not exists (select 1 from environmental_alerts a where a.user_id = s.user_id and a.alert_type = s.alert_type and a.created_at >= timestamp '{AS_OF}' - interval 24 hours)")
def suppression(subs: DataFrame, alerts: DataFrame) -> DataFrame:
    recent = alerts.where(since("created_at", AS_OF, "'24' HOUR"))
    return subs.join(recent, ["user_id", "alert_type"], "left_anti").select("user_id", "alert_type")


@query("j20_ordered_messages", "conversations", sql="select conv_id, count(*) as turns, string_agg(role, '>' order by turn, role) as roles from conversations group by 1")
def ordered_messages(messages: DataFrame) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return messages.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(listed, lambda x: x["role"]), ">").alias("roles"))


@query("j22_membership_guard", "strategy_requests", "team_members", sql="select id from strategy_requests r where exists (select 1 from team_members m where m.user_id = r.user_id and m.team_role in ('owner', 'member'))")
def guard(requests: DataFrame, people: DataFrame) -> DataFrame:
    return requests.join(people.where(F.col("team_role").isin("owner", "member")), "user_id", "left_semi").select("id")


@query("k11_vote_apply", "strategy_requests", "request_votes", sql="select r.id, (r.vote_count + coalesce(v.n, 0))::bigint as votes from strategy_requests r left join (select request_id, count(distinct user_id) as n from request_votes group by 1) v on v.request_id = r.id")
def vote_apply(requests: DataFrame, votes: DataFrame) -> DataFrame:
    """A user's votes for a request count once."""
    counts = votes.dropDuplicates(["request_id", "user_id"]).groupBy("request_id").agg(F.count("*").alias("n"))
    return requests.join(counts, F.col("id") == F.col("request_id"), "left").select("id", (F.col("vote_count") + F.coalesce("n", F.lit(0))).cast("long").alias("votes"))


@query("t1_severity_order", "environmental_alerts", sql="select id, severity, created_at from environmental_alerts order by case severity when 'critical' then 0 when 'warning' then 1 else 2 end, created_at desc, id limit 100")
def severity_order(alerts: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return alerts.orderBy(rank, F.desc("created_at"), "id").limit(100).select("id", "severity", "created_at")


@query("t2_by_votes", "strategy_requests", sql="select id, vote_count from strategy_requests order by vote_count desc nulls first, id limit 200")
def by_votes(requests: DataFrame) -> DataFrame:
    return requests.orderBy(F.desc_nulls_first("vote_count"), "id").limit(200).select("id", "vote_count")


@query("t4_page", "features", sql="select id, layer_id from features order by id limit 50 offset 100")
def page(features: DataFrame) -> DataFrame:
    return features.orderBy("id").offset(100).limit(50).select("id", "layer_id")


@query("t9_top_per_group", "strategy_requests", sql="select strategy_type, id, vote_count from (select *, row_number() over (partition by strategy_type order by vote_count desc, id) as rn from strategy_requests) where rn <= 10")
def top_per_group(requests: DataFrame) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("strategy_type").orderBy(F.desc("vote_count"), "id"))
    return requests.withColumn("rn", rn).where("rn <= 10").select("strategy_type", "id", "vote_count")


@query("w1_last_position", "positions", sql="select asset_id, arg_max(id, (time, id)) as id, max(time) as time from positions group by 1")
def last_position(positions: DataFrame) -> DataFrame:
    return tracks.last_per_key(positions, "asset_id", "time", "id").select("asset_id", "id", "time")


@query("w2_stops", "positions", sql="""
with p as (select *, lead(time) over (partition by asset_id order by time, id) as nxt from positions)
select asset_id, lat, lon, time as start, nxt as "end", ((epoch_us(nxt) - epoch_us(time)) // 1000)::bigint as duration_ms from p where (epoch_us(nxt) - epoch_us(time)) // 1000 > 300000""")  # fmt: skip
def stop_detection(positions: DataFrame) -> DataFrame:
    return tracks.stops(positions)


@query("w3_segments", "positions", sql="""
with p as (select *, lead(lat) over w as to_lat, lead(lon) over w as to_lon from positions window w as (partition by asset_id order by time, id))
select asset_id, time, lat, lon, case when speed is null or speed < 5 then 'stopped' when speed < 30 then 'slow' else 'fast' end as speed_class, to_lat, to_lon from p where to_lat is not null""")  # fmt: skip
def route_segments(positions: DataFrame) -> DataFrame:
    return tracks.segments(positions)


@query("w12_minute_quota", "positions", sql="""
with r as (select id, asset_id, time, row_number() over (partition by asset_id, date_trunc('minute', time) order by time, id) as n from positions)
select id, asset_id, n > 1 as denied, (60 - extract(second from time))::int as retry_after from r""")  # fmt: skip
def minute_quota(requests: DataFrame) -> DataFrame:
    """More than one request of a key in a minute is denied."""
    n = F.row_number().over(W.partitionBy("asset_id", F.date_trunc("minute", "time")).orderBy("time", "id"))
    return requests.select("id", "asset_id", (n > 1).alias("denied"), (60 - F.second("time")).cast("int").alias("retry_after"))


@query("w14_last_turns", "conversations", sql="select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc, role desc) as rn from conversations) where rn <= 4")
def last_turns(messages: DataFrame) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role")))
    return messages.withColumn("rn", rn).where("rn <= 4").select("conv_id", "turn", "role")


@query("a23_digest", "environmental_alerts", sql=f"select user_id, count(*) as n, string_agg(id::varchar, ',' order by created_at desc, id desc) as ids from environmental_alerts where not is_read and created_at >= timestamp '{AS_OF}' - interval 72 hours group by 1")
def digest(alerts: DataFrame) -> DataFrame:
    recent = alerts.where(~F.col("is_read") & since("created_at", AS_OF, "'72' HOUR"))
    listed = F.sort_array(F.collect_list(F.struct("created_at", "id")), asc=False)
    return recent.groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.transform(listed, lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("u3_keyed_accumulate", "features", sql="select layer_id || ':' || (id % 100) as feature, arg_max(risk_score, (created_at, id)) as risk_score from features group by 1")
def accumulate(features: DataFrame) -> DataFrame:
    key = F.concat_ws(":", "layer_id", (F.col("id") % 100).cast("string"))
    return features.groupBy(key.alias("feature")).agg(F.max_by("risk_score", F.struct("created_at", "id")).alias("risk_score"))
