"""Registered queries: geometry, spatial joins, models, alerts, clusters and maintenance jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.functions import geo, models
from terrafold.functions.models import half_up
from terrafold.operators import maintenance, spatial, tracks
from terrafold.operators.totals import totals
from terrafold.plans.core import AS_OF, AREA_BOX, ORDERS_AS_OF, since
from terrafold.plans.views import query


def box_ring(west: str = "west", south: str = "south", size: float = 0.8) -> Column:
    box = F.struct(F.col(west).alias("west"), F.col(south).alias("south"), (F.col(west) + size).alias("east"), (F.col(south) + size).alias("north"))
    return geo.box_ring(box)


def km_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(12742.0::double * atan2(sqrt({a}), sqrt(greatest(1 - {a}, 0.0::double))))"


def up(x: str, digits: int = 0) -> str:
    m = f"{10.0**digits}::double"
    return f"(floor(({x}) * {m} + 0.5::double) / {m})"


@query("g1_haversine", "fire_detections", sql=f"select id, {up(km_sql('lat', 'lon', '37.0::double', '-120.0::double'), 3)} as km from fire_detections")
def haversine(fires: DataFrame) -> DataFrame:
    return fires.select("id", half_up(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(37.0), F.lit(-120.0)), 3).alias("km"))


BEARING_SQL = "(degrees(atan2(sin(radians(-120 - lon)) * cos(radians(39)), cos(radians(lat)) * sin(radians(39)) - sin(radians(lat)) * cos(radians(39)) * cos(radians(-120 - lon)))) + 360) % 360"


@query("g4_bearing", "positions", sql=f"select id, {up(BEARING_SQL, 3)} as bearing from positions")
def bearings(positions: DataFrame) -> DataFrame:
    return positions.select("id", half_up(geo.bearing(F.col("lon"), F.col("lat"), F.lit(-120.0), F.lit(39.0)), 3).alias("bearing"))


@query("g5_track_length", "positions", sql=f"""
with p as (select asset_id, lat, lon, lead(lat) over w as lat2, lead(lon) over w as lon2 from positions window w as (partition by asset_id order by time, id))
select asset_id, count(*) as segments, floor(sum({km_sql('lat', 'lon', 'lat2', 'lon2')}::decimal(18,6))::double * 100 + 0.5::double) / 100.0::double as km from p where lat2 is not null group by 1""")  # fmt: skip
def track_length(positions: DataFrame) -> DataFrame:
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon")).cast("decimal(18,6)")
    return tracks.segments(positions).groupBy("asset_id").agg(F.count("*").alias("segments"), half_up(F.sum(km).cast("double"), 2).alias("km"))


@query("g11_tiles", "features", sql="""
select id, 8 as z, floor((lon + 180) / 360 * 256)::bigint as x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 256)::bigint as y from features""")  # fmt: skip
def tiles(features: DataFrame) -> DataFrame:
    return spatial.tiles_of_points(features, 8).select("id", "z", "x", "y")


@query("g14_radius_box", "watched_locations", sql=f"select id, {up('lon - radius_km / (111 * cos(radians(lat)))', 6)} as west, {up('lat - radius_km / 111.0::double', 6)} as south, {up('lon + radius_km / (111 * cos(radians(lat)))', 6)} as east, {up('lat + radius_km / 111.0::double', 6)} as north from watched_locations")
def radius_box(places: DataFrame) -> DataFrame:
    boxed = places.withColumn("b", geo.box_of_radius(F.col("lat"), F.col("lon"), F.col("radius_km")))
    return boxed.select("id", *(half_up(F.col(f"b.{c}"), 6).alias(c) for c in ("west", "south", "east", "north")))


@query("g16_grid_key", "soil_points", sql="select printf('%.2f_%.2f', floor(lat * 100 + 0.5::double) / 100, floor(lon * 100 + 0.5::double) / 100) as cell, count(*) as n from soil_points group by 1")
def grid_counts(points: DataFrame) -> DataFrame:
    return points.groupBy(geo.grid_key(F.col("lat"), F.col("lon")).alias("cell")).agg(F.count("*").alias("n"))


@query("j6_tile_features", "features", sql="""
with t as (select floor((lon + 180) / 360 * 64)::bigint as x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 64)::bigint as y, id from features)
select x, y, count(*) as n, min(id) as first_id from t group by 1, 2""")  # fmt: skip
def tile_features(features: DataFrame) -> DataFrame:
    return spatial.tiles_of_points(features, 6).groupBy("x", "y").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))




@query("j7_point_in_polygon", "positions", "geofences", sql="select p.id, g.id as fence_id from positions p join geofences g on p.lon >= g.west and p.lon < g.west + 0.8::double and p.lat >= g.south and p.lat < g.south + 0.8::double")
def point_in_polygon(positions: DataFrame, fences: DataFrame) -> DataFrame:
    polygons = fences.select(F.col("id").alias("fence_id"), F.array(box_ring()).alias("rings"))
    return spatial.polygon_join(positions, polygons, cell=0.5).select("id", "fence_id")


@query("j8_nearest_fire", "watched_locations", "fire_detections", sql=f"""
with p as (select w.id, f.id as fire_id, w.radius_km, {km_sql('w.lat', 'w.lon', 'f.lat', 'f.lon')} as km from watched_locations w, fire_detections f where f.detected_at >= timestamp '{AS_OF}' - interval 10 days and abs(w.lat - f.lat) < 2),
m as (select id, arg_min(fire_id, (km, fire_id)) as fire_id, min(km) as km from p where km <= radius_km group by 1)
select id, fire_id, {up('km', 3)} as km, case when km < 10 then 'critical' when km < 30 then 'warning' else 'info' end as severity from m""")  # fmt: skip
def nearest_fire(places: DataFrame, fires: DataFrame) -> DataFrame:
    """Nearest fire inside each location's own radius."""
    right = fires.where(since("detected_at", AS_OF, "'10' DAY")).select(F.col("id").alias("fire_id"), F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"))
    near = spatial.nearest_join(places.select("id", "lat", "lon", "radius_km"), right, "id", "fire_id", F.col("radius_km").cast("double"), right_at=("f_lat", "f_lon"))
    return near.select("id", "fire_id", half_up(F.col("distance_km"), 3).alias("km"), models.distance_severity(F.col("distance_km")).alias("severity"))


@query("j9_critical_gauge", "watched_locations", "water_gauges", sql=f"""
with p as (select w.id, g.site_no, {km_sql('w.lat', 'w.lon', 'g.lat', 'g.lon')} as km from watched_locations w, water_gauges g where g.condition = 'critically_low')
select id, arg_min(site_no, (km, site_no)) as site_no, {up('min(km)', 3)} as km from p where km <= 200 group by 1""")  # fmt: skip
def critical_gauge(places: DataFrame, gauges: DataFrame) -> DataFrame:
    right = gauges.where("condition = 'critically_low'").select("site_no", F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"))
    near = spatial.nearest_join(places.select("id", "lat", "lon"), right, "id", "site_no", F.lit(200.0), right_at=("g_lat", "g_lon"))
    return near.select("id", "site_no", half_up(F.col("distance_km"), 3).alias("km"))


@query("j10_nearest_gauge_degrees", "watched_locations", "water_gauges", sql=f"""
with p as (select w.id, g.site_no, g.percentile, g.condition, sqrt((w.lat - g.lat) * (w.lat - g.lat) + (w.lon - g.lon) * (w.lon - g.lon)) as d from watched_locations w, water_gauges g),
m as (select id, arg_min(site_no, (d, site_no)) as site_no, arg_min(coalesce(100 - percentile, 50), (d, site_no))::double as stress, min(d) as d from p where d <= 2 group by 1)
select id, site_no, stress, {up('d', 4)} as degrees from m""")  # fmt: skip
def nearest_gauge(places: DataFrame, gauges: DataFrame) -> DataFrame:
    """Nearest gauge within two degrees and its stress."""
    right = gauges.select("site_no", "percentile", "condition", F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"))
    near = spatial.nearest_planar(places.select("id", "lat", "lon"), right, "id", "site_no", 2.0, right_at=("g_lat", "g_lon"))
    return near.select("id", "site_no", models.gauge_stress(F.col("percentile"), F.col("condition")).alias("stress"), half_up(F.col("distance_deg"), 4).alias("degrees"))


@query("j11_within_distance", "watched_locations", "strategy_requests", sql=f"""
with p as (select w.id, r.strategy_type, {km_sql('w.lat', 'w.lon', 'r.lat', 'r.lon')} as km, w.radius_km from watched_locations w join strategy_requests r on abs(w.lat - r.lat) < 2 where r.status = 'open')
select id, count(*) as requests, string_agg(distinct strategy_type, ', ' order by strategy_type) as types from p where km <= radius_km group by 1""")  # fmt: skip
def within_distance(places: DataFrame, requests: DataFrame) -> DataFrame:
    """Open requests around each location and their types."""
    open_ = requests.where("status = 'open'").select("strategy_type", "lat", "lon")
    near = totals(places.select("id", "lat", "lon", F.col("radius_km").alias("km")), open_, "id", by="strategy_type", circle=True)
    return near.groupBy("id").agg(F.sum("n").alias("requests"), F.array_join(F.array_sort(F.collect_set("strategy_type")), ", ").alias("types"))


@query("j12_max_drought", "watched_locations", "drought_areas", sql="select w.id, max(d.dm)::int as dm, (40 + 15 * max(d.dm))::double as stress from watched_locations w join drought_areas d on w.lon between d.west and d.east and w.lat between d.south and d.north group by 1")
def max_drought(places: DataFrame, areas: DataFrame) -> DataFrame:
    """The highest class whose bounds hold the point."""
    met = spatial.box_join(places.select("id", "lat", "lon"), areas.select("dm", "west", "south", "east", "north"), cell=2.0)
    return met.groupBy("id").agg(F.max("dm").cast("int").alias("dm")).select("id", "dm", models.drought_stress(F.col("dm")).alias("stress"))


@query("j13_first_area", "watched_locations", "drought_areas", sql="select w.id, coalesce('D' || min(d.ordinal), 'None') as label from watched_locations w left join drought_areas d on w.lon between d.west and d.east and w.lat between d.south and d.north group by 1")
def first_area(places: DataFrame, areas: DataFrame) -> DataFrame:
    met = spatial.box_join(places.select("id", "lat", "lon"), areas.select("ordinal", "west", "south", "east", "north"), cell=2.0)
    first = met.groupBy("id").agg(F.min("ordinal").alias("ordinal"))
    return places.select("id").join(first, "id", "left").select("id", F.coalesce(F.concat(F.lit("D"), F.col("ordinal").cast("string")), F.lit("None")).alias("label"))


@query("j21_team_zones", "geofences", "drought_areas", sql="select g.id, d.ordinal from geofences g join drought_areas d on g.west <= d.east and g.west + 0.8::double >= d.west and g.south <= d.north and g.south + 0.8::double >= d.south")
def team_zones(fences: DataFrame, areas: DataFrame) -> DataFrame:
    left = fences.select("id", "west", "south", (F.col("west") + 0.8).alias("east"), (F.col("south") + 0.8).alias("north"))
    right = areas.select("ordinal", *(F.col(c).alias(f"r_{c}") for c in ("west", "south", "east", "north")))
    return spatial.boxes_overlap(left, right, cell=2.0).select("id", "ordinal")


@query("j25_nearby_points", "water_gauges", "soil_points", sql=f"""
with p as (select g.site_no, s.id, {km_sql('g.lat', 'g.lon', 's.lat', 's.lon')} as km from water_gauges g join soil_points s on abs(g.lat - s.lat) < 1),
r as (select *, row_number() over (partition by site_no order by km, id) as rn from p where km <= 60)
select site_no, id, {up('km', 3)} as km from r where rn <= 5""")  # fmt: skip
def nearby_points(gauges: DataFrame, soil: DataFrame) -> DataFrame:
    """The nearest five points within 60 km of every gauge."""
    right = soil.select("id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    near = spatial.nearest_k(gauges.select("site_no", "lat", "lon"), right, "site_no", "id", F.lit(60.0), k=5, right_at=("s_lat", "s_lon"))
    return near.select("site_no", "id", half_up(F.col("distance_km"), 3).alias("km"))


@query("w4_density_clusters", "strategy_requests", sql="""
with recursive p as (select id, strategy_type as t, lat, lon from strategy_requests where status <> 'completed'),
near as (select a.t, a.id as a, b.id as b from p a join p b on a.t = b.t and b.lat between a.lat - 0.051 and a.lat + 0.051 and sqrt((a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon)) <= 0.05::double),
core as (select a from near group by a having count(*) >= 3),
link as (select a, b from near where a in (select a from core) and b in (select a from core)),
r as (select a as node, a as root from core union select l.b, r.root from r join link l on l.a = r.node),
lab as (select node, min(root) as cluster from r group by 1),
fin as (select p.t, p.id, p.lat, p.lon, coalesce(l.cluster, (select min(l2.cluster) from near n join lab l2 on l2.node = n.b where n.a = p.id)) as cluster from p left join lab l on l.node = p.id)
select t as strategy_type, count(*) as points, count(distinct cluster) as clusters, sum(cluster)::bigint as checksum from fin where cluster is not null group by 1""")  # fmt: skip
def density_clusters(requests: DataFrame) -> DataFrame:
    """DBSCAN of 0.05 degrees and three points for each strategy, summed up by strategy."""
    found = spatial.dbscan(requests.where("status <> 'completed'").select("id", "strategy_type", "lat", "lon"), part="strategy_type", eps=0.05, min_points=3)
    return found.groupBy("strategy_type").agg(F.count("*").alias("points"), F.count_distinct("cluster").alias("clusters"), F.sum("cluster").alias("checksum"))


@query("a22_cluster_rollup", "strategy_requests")
def cluster_rollup(requests: DataFrame) -> DataFrame:
    """Counts, votes, centroid and hull of every cluster."""
    rows = requests.where("status <> 'completed'").select("id", "strategy_type", "lat", "lon", "vote_count")
    found = spatial.dbscan(rows, part="strategy_type", eps=0.05, min_points=3)
    sums = found.groupBy("strategy_type", "cluster").agg(F.count("*").alias("requests"), F.sum("vote_count").alias("votes"), half_up(F.avg("lat"), 4).alias("lat"), half_up(F.avg("lon"), 4).alias("lon"))
    hulls = spatial.convex_hulls(found, "strategy_type", "cluster")
    return sums.join(hulls, ["strategy_type", "cluster"]).select("strategy_type", "cluster", "requests", "votes", "lat", "lon", "kind", F.to_json("ring").alias("ring"))


@query("w5_geofence_transitions", "positions", "geofences", sql="""
with s as (select p.asset_id, g.id as fence_id, p.time, p.id, g.alert_on_enter, g.alert_on_exit, p.lon >= g.west and p.lon < g.west + 0.8::double and p.lat >= g.south and p.lat < g.south + 0.8::double as inside from positions p, geofences g),
w as (select *, lag(inside) over (partition by asset_id, fence_id order by time, id) as was from s)
select asset_id, fence_id, time, id, case when not was and inside then 'enter' else 'exit' end as event from w where (not was and inside and alert_on_enter) or (was and not inside and alert_on_exit)""")  # fmt: skip
def geofence_transitions(positions: DataFrame, fences: DataFrame) -> DataFrame:
    """W5 without a row for each point and fence: a change only happens at an inside row or just after one."""
    flags = fences.select(F.col("id").alias("fence_id"), "alert_on_enter", "alert_on_exit", F.array(box_ring()).alias("rings"))
    order = W.partitionBy("asset_id").orderBy("time", "id")
    rows = positions.withColumn("n", F.row_number().over(order)).withColumn("next", F.lead(F.struct("time", "id")).over(order))
    inside = spatial.polygon_join(rows, flags, cell=0.5)
    by_fence = W.partitionBy("asset_id", "fence_id").orderBy("n")
    entered = inside.withColumn("before", F.lag("n").over(by_fence)).where((F.col("n") > 1) & (F.col("before").isNull() | (F.col("before") < F.col("n") - 1)) & F.col("alert_on_enter"))
    left = inside.withColumn("after", F.lead("n").over(by_fence)).where(F.col("next").isNotNull() & (F.col("after").isNull() | (F.col("after") > F.col("n") + 1)) & F.col("alert_on_exit"))
    return entered.select("asset_id", "fence_id", "time", "id", F.lit("enter").alias("event")).unionByName(left.select("asset_id", "fence_id", F.col("next.time").alias("time"), F.col("next.id").alias("id"), F.lit("exit").alias("event")))


@query("w8_strategy_ranking", "soil_points", "drought_areas")
def strategy_ranking(soil: DataFrame, areas: DataFrame) -> DataFrame:
    """Six ranked strategies for every soil point."""
    met = spatial.box_join(soil.select("id", "lat", "lon"), areas.select("dm", "west", "south", "east", "north"), cell=2.0).groupBy("id").agg(F.max("dm").alias("dm"))
    rows = soil.join(met, "id", "left").withColumn("f", models.factors(F.col("lat"), F.col("lon"), models.soil_score(F.col("organic_carbon")), models.drought_stress(F.col("dm")), F.lit(None).cast("double")))
    ranked = F.array_sort(models.strategy_scores(F.col("f")), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["ordinal"] - b["ordinal"]))
    each = rows.select("id", "f", F.posexplode(ranked).alias("place", "s"))
    return each.select("id", (F.col("place") + 1).alias("place"), F.col("s.strategy").alias("strategy"), F.col("s.score").alias("score"), F.array_join(models.top_reasons(F.col("f"), F.col("s.strategy")), ",").alias("reasons"))


@query("d12_erosion", "soil_points", sql=f"""
with k as (select id, least(0.69::double, greatest(0.02::double, 0.1::double + greatest(0.0::double, 1 - organic_carbon / 20) * 0.4::double + least(1.0::double, bulk_density / 1.5::double) * 0.15::double)) as k,
  least(50.0::double, pow(5 / 22.13::double, 0.6::double) * pow(sin(radians(5)) / 0.0896::double, 1.3::double)) as ls from soil_points),
s as (select id, {up('least(100.0::double, greatest(0.0::double, k * ls * 0.2::double / 0.01::double * 10))')} as score from k)
select id, score, case when score < 10 then 'very_low' when score < 30 then 'low' when score < 55 then 'moderate' when score < 75 then 'high' else 'very_high' end as class from s""")  # fmt: skip
def erosion(soil: DataFrame) -> DataFrame:
    score = models.erosion_score(F.col("organic_carbon"), F.col("bulk_density"), F.lit(5.0), F.lit("cropland"))
    return soil.select("id", score.alias("score"), models.erosion_class(score).alias("class"))


@query("d13_carbon", "soil_points", sql=f"""
with g as (select id, greatest(0.0::double, 6.5::double - organic_carbon / 10) as deficit from soil_points),
h as (select id, deficit, deficit * 0.3::double * 1.5::double * (0.4::double + (600 - 400) / 400.0::double * 0.6::double) as gain from g)
select id, {up('gain', 2)} as gain, case when gain > 0 then least({up('deficit / (gain / 10)')}, 100.0::double) else 100.0::double end as years from h""")  # fmt: skip
def carbon(soil: DataFrame) -> DataFrame:
    c = models.carbon_potential(F.col("organic_carbon"), F.col("bulk_density"), F.lit("reforestation"), F.lit(600.0))
    return soil.withColumn("c", c).select("id", "c.gain", "c.years")


@query("d14_suitability", "soil_points", sql="""
select id, 'biochar' as intervention, least(100, 30 + case when organic_carbon / 10 < 1 then 40 when organic_carbon / 10 < 2 then 20 else 5 end + case when cec < 10 then 20 else 5 end)::int as score from soil_points
union all select id, 'cover_cropping', least(100, 55 + case when organic_carbon / 10 < 1.5 then 20 else 5 end + case when nitrogen < 1 then 15 else 0 end)::int from soil_points
union all select id, 'keyline', least(100, 40 + case when bulk_density > 0.8 and bulk_density < 1.4 then 30 else 10 end + case when ph > 5.5 then 15 else 0 end)::int from soil_points
union all select id, 'reforestation', least(100, 40 + case when organic_carbon / 10 < 2 then 30 else 10 end + case when ph > 5.5 and ph < 7.5 then 20 else 0 end)::int from soil_points
union all select id, 'silvopasture', least(100, 30 + case when organic_carbon / 10 > 1.5 then 25 else 10 end + case when ph > 5.5 and ph < 7.0 then 25 else 10 end + case when cec > 10 then 10 else 0 end)::int from soil_points""")  # fmt: skip
def intervention_suitability(soil: DataFrame) -> DataFrame:
    kinds = F.explode(F.array(*map(F.lit, ("biochar", "cover_cropping", "keyline", "reforestation", "silvopasture"))))
    rows = soil.withColumn("intervention", kinds)
    return rows.select("id", "intervention", models.suitability(*(F.col(c) for c in ("intervention", "ph", "organic_carbon", "nitrogen", "bulk_density", "cec"))).cast("int").alias("score"))


@query("d21_condition", "water_gauges", sql="select site_no, condition from water_gauges")
def condition(gauges: DataFrame) -> DataFrame:
    return gauges.select("site_no", models.streamflow_condition(F.col("percentile")).alias("condition"))


@query("d1_fire_risk", "soil_points", sql=f"select id, {up('least(100.0::double, greatest(0.0::double, 0.85::double * 100 * 0.3::double + least(100.0::double, 10 / 45.0::double * 100) * 0.2::double + (cos(radians(180) - pi()) + 1) / 2 * 100 * 0.1::double + greatest(0.0::double, 100 - organic_carbon) * 0.25::double + least(100.0::double, cec / 30 * 100) * 0.15::double))')} as risk from soil_points")
def fire_risk(soil: DataFrame) -> DataFrame:
    risk = models.fire_risk(F.lit("shrubland"), F.lit(10.0), F.lit(180.0), F.col("organic_carbon"), F.col("cec"))
    return soil.select("id", risk.alias("risk"))


@query("g10_simplified_tracks", "positions")
def simplified(positions: DataFrame) -> DataFrame:
    return tracks.simplify(positions, 0.05)


@query("u2_alerts", "alert_subscriptions", "watched_locations", "fire_detections", "drought_areas", "water_gauges", "strategy_requests", "environmental_alerts", sql=f"""
with s as (select s.user_id, s.alert_type, w.id as loc, w.lat, w.lon, w.radius_km from alert_subscriptions s join watched_locations w on w.id = s.watched_location_id where s.in_app_enabled),
open_s as (select * from s where not exists (select 1 from environmental_alerts a where a.user_id = s.user_id and a.alert_type = s.alert_type and a.created_at >= timestamp '{AS_OF}' - interval 24 hours)),
fire as (select o.user_id, o.loc, min({km_sql('o.lat', 'o.lon', 'f.lat', 'f.lon')}) as km, max(o.radius_km) as r from open_s o, fire_detections f where o.alert_type = 'fire_proximity' and f.detected_at >= timestamp '{AS_OF}' - interval 10 days group by 1, 2),
dry as (select o.user_id, o.loc, max(d.dm) as dm from open_s o join drought_areas d on o.lon between d.west and d.east and o.lat between d.south and d.north where o.alert_type = 'drought_escalation' group by 1, 2),
low as (select o.user_id, o.loc, min({km_sql('o.lat', 'o.lon', 'g.lat', 'g.lon')}) as km from open_s o, water_gauges g where o.alert_type = 'streamflow_critical' and g.condition = 'critically_low' group by 1, 2),
zone as (select o.user_id, o.loc, count(*) as n from open_s o join strategy_requests r on r.status = 'open' and r.vote_count >= 55 and abs(o.lat - r.lat) < 2 where o.alert_type = 'priority_zone_created' and {km_sql('o.lat', 'o.lon', 'r.lat', 'r.lon')} <= o.radius_km group by 1, 2)
select user_id, loc as location_id, 'fire_proximity' as alert_type, case when km < 10 then 'critical' when km < 30 then 'warning' else 'info' end as severity, 'Active fire detected ' || floor(km + 0.5)::int || ' km away' as title from fire where km <= r
union all select user_id, loc, 'drought_escalation', 'critical', case when dm = 4 then 'D4' else 'D3' end || ' drought near watched location' from dry where dm >= 3
union all select user_id, loc, 'streamflow_critical', 'warning', 'Critically low streamflow ' || floor(km + 0.5)::int || ' km away' from low where km <= 200
union all select user_id, loc, 'priority_zone_created', 'info', n || ' new priority zone' || case when n > 1 then 's' else '' end || ' near your location' from zone""")  # fmt: skip
def alerts(subs: DataFrame, places: DataFrame, fires: DataFrame, areas: DataFrame, gauges: DataFrame, requests: DataFrame, old: DataFrame) -> DataFrame:
    """The four checks as joins over all subscriptions, less those alerted within 24 hours."""
    recent = old.where(since("created_at", AS_OF, "'24' HOUR")).select("user_id", "alert_type")
    joined = subs.where("in_app_enabled").join(places.drop("user_id"), F.col("watched_location_id") == F.col("id")).select("user_id", "alert_type", F.col("id").alias("location_id"), "lat", "lon", F.col("radius_km").cast("double").alias("radius_km"))
    due = joined.join(recent, ["user_id", "alert_type"], "left_anti")
    of = lambda kind: due.where(F.col("alert_type") == kind).drop("alert_type")
    other = lambda df, key: df.select(F.col(key).alias("key"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))

    def made(df: DataFrame, kind: str, severity: Column, title: Column) -> DataFrame:
        return df.select("user_id", "location_id", F.lit(kind).alias("alert_type"), severity.alias("severity"), title.alias("title"))

    km = F.floor(F.col("distance_km") + 0.5).cast("int")
    burning = spatial.nearest_join(of("fire_proximity"), other(fires.where(since("detected_at", AS_OF, "'10' DAY")), "id"), "location_id", "key", F.col("radius_km"), right_at=("o_lat", "o_lon"))
    dry = spatial.box_join(of("drought_escalation"), areas.where("dm >= 3").select("dm", "west", "south", "east", "north"), cell=2.0).groupBy("user_id", "location_id").agg(F.max("dm").alias("dm"))
    low = spatial.nearest_join(of("streamflow_critical"), other(gauges.where("condition = 'critically_low'"), "site_no"), "location_id", "key", F.lit(200.0), right_at=("o_lat", "o_lon"))
    watched = of("priority_zone_created")
    around = totals(watched.select("location_id", "lat", "lon", F.col("radius_km").alias("km")).distinct(), requests.where("status = 'open' and vote_count >= 55").select("lat", "lon"), "location_id", circle=True)
    zones = watched.select("user_id", "location_id").distinct().join(around, "location_id")
    parts = (
        made(burning, "fire_proximity", models.distance_severity(F.col("distance_km")), F.format_string("Active fire detected %d km away", km)),
        made(dry, "drought_escalation", F.lit("critical"), F.format_string("D%d drought near watched location", "dm")),
        made(low, "streamflow_critical", F.lit("warning"), F.format_string("Critically low streamflow %d km away", km)),
        made(zones, "priority_zone_created", F.lit("info"), F.concat(F.col("n").cast("string"), F.lit(" new priority zone"), F.when(F.col("n") > 1, "s").otherwise(""), F.lit(" near your location"))),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("k3_gauge_upsert", "water_gauges", sql="select site_no, site_name, case when site_no % 3 = 0 then flow_cfs + 1 else flow_cfs end as flow_cfs, case when site_no % 3 = 0 then 'normal' else condition end as condition from water_gauges union all select site_no + 1000000, 'new', flow_cfs, 'low' from water_gauges where site_no % 10 = 0")
def gauge_upsert(gauges: DataFrame) -> DataFrame:
    """K3: a batch updates flow and condition of known gauges (the name stays) and adds unknown ones."""
    base = gauges.select("site_no", "site_name", "flow_cfs", "condition")
    known = gauges.where("site_no % 3 = 0").select("site_no", F.lit("changed").alias("site_name"), (F.col("flow_cfs") + 1).alias("flow_cfs"), F.lit("normal").alias("condition"))
    new = gauges.where("site_no % 10 = 0").select((F.col("site_no") + 1000000).alias("site_no"), F.lit("new").alias("site_name"), "flow_cfs", F.lit("low").alias("condition"))
    return maintenance.upsert(base, known.unionByName(new), ["site_no"], ["flow_cfs", "condition"])


@query("k4_insert_absent", "fire_detections", sql="select id, brightness::bigint as brightness from fire_detections where id % 2 = 0 union all select id, 0::bigint from fire_detections where id % 2 = 1 and id % 3 = 0")
def insert_absent(fires: DataFrame) -> DataFrame:
    base = fires.where("id % 2 = 0").select("id", F.col("brightness").cast("long").alias("brightness"))
    return maintenance.insert_absent(base, fires.where("id % 3 = 0").select("id", F.lit(0).cast("long").alias("brightness")), ["id"])


@query("k6_retention", "strategy_requests", "request_votes", sql=f"with p as (select id from strategy_requests where created_at >= timestamp '{ORDERS_AS_OF}' - interval 400 days) select p.id, count(v.user_id) as votes from p left join request_votes v on v.request_id = p.id group by 1")
def retention(requests: DataFrame, votes: DataFrame) -> DataFrame:
    """K6: rows past the limit go, and with them their children."""
    parents, children = maintenance.retain(requests, "created_at", ORDERS_AS_OF, "'400' DAY", "id", votes, "request_id")
    counts = children.groupBy("request_id").agg(F.count("*").alias("votes"))
    return parents.join(counts, F.col("id") == F.col("request_id"), "left").select("id", F.coalesce("votes", F.lit(0)).alias("votes"))


@query("k7_cascade", "features", sql="select layer_id, count(*) as n from features where layer_id not in ('error', 'click') group by 1")
def cascade(features: DataFrame) -> DataFrame:
    layers = features.select("layer_id").distinct().where(F.col("layer_id").isin("error", "click"))
    return maintenance.cascade(features, layers, "layer_id").groupBy("layer_id").agg(F.count("*").alias("n"))


@query("k12_review_workflow", "features", sql="""
with log as (select id % 500 as feature_id, created_at as stamp, id, case id % 3 when 0 then 'pending_review' when 1 then 'published' else 'rejected' end as status from features)
select feature_id, arg_max(status, (stamp, id)) as status from log group by 1""")  # fmt: skip
def review(features: DataFrame) -> DataFrame:
    """The last entry of a change log decides."""
    status = F.element_at(F.array(F.lit("pending_review"), F.lit("published"), F.lit("rejected")), (F.col("id") % 3 + 1).cast("int"))
    log = features.select((F.col("id") % 500).alias("feature_id"), F.col("created_at").alias("at"), "id", status.alias("status"))
    return tracks.last_per_key(log, "feature_id", "at", "id").select("feature_id", "status")


@query("k13_bulk_flag", "environmental_alerts", sql="select id, is_read or user_id = 7 as is_read from environmental_alerts")
def bulk_flag(alerts_: DataFrame) -> DataFrame:
    return maintenance.set_flag(alerts_, "is_read", F.col("user_id") == 7).select("id", "is_read")


@query("k14_reorder", "teams", sql="select id, case id when 5 then 0 when 3 then 1 when 9 then 2 else id + 100 end::int as sort_order from teams")
def reorder(teams: DataFrame) -> DataFrame:
    return maintenance.reorder(teams.select("id", (F.col("id") + 100).alias("sort_order")), [5, 3, 9])


@query("k16_change_log", "features", sql="""
with log as (select id % 300 as key, id as seq, case id % 7 when 0 then 'delete' when 1 then 'create' else 'update' end as op, risk_score from features), l as (select key, arg_max(op, seq) as op, arg_max(risk_score, seq) as risk_score from log group by 1)
select key, risk_score from l where op <> 'delete'""")  # fmt: skip
def change_log(features: DataFrame) -> DataFrame:
    op = F.when(F.col("id") % 7 == 0, "delete").when(F.col("id") % 7 == 1, "create").otherwise("update")
    log = features.select((F.col("id") % 300).alias("key"), F.col("id").alias("seq"), op.alias("op"), "risk_score")
    return maintenance.apply_changes(log, "key", "seq", "op").select("key", "risk_score")


@query("a20_water_scarcity", "water_gauges", "drought_areas", sql=f"""
with g as (select {up('avg(case condition when $$above_normal$$ then 0 when $$normal$$ then 10 when $$below_normal$$ then 20 when $$low$$ then 30 when $$critically_low$$ then 40 else 15 end)', 4)} as s from water_gauges),
d as (select avg(dm / 4.0::double * 40) as s from drought_areas)
select {up('least(100.0::double, coalesce(d.s, 15.0::double) + coalesce(g.s, 15.0::double) + 6)', 2)} as score from g, d""".replace("$$", "'"))  # fmt: skip
def water_scarcity(gauges: DataFrame, areas: DataFrame) -> DataFrame:
    """Drought and gauge parts of at most 40 each; wells have no table here, so their default 6 stands."""
    weights = {"above_normal": 0, "normal": 10, "below_normal": 20, "low": 30, "critically_low": 40}
    g = gauges.agg(half_up(F.avg(models.lookup(F.col("condition"), weights, 15)), 4).alias("g"))
    d = areas.agg(F.avg(F.col("dm") / 4 * 40).alias("d"))
    score = F.least(F.lit(100.0), F.coalesce("d", F.lit(15.0)) + F.coalesce("g", F.lit(15.0)) + 6)
    return g.crossJoin(d).select(half_up(score, 2).alias("score"))


@query("p16_area_requests", "geofences", "strategy_requests", sql="select g.id, count(*) as n, max(r.vote_count) as top_votes from geofences g join strategy_requests r on r.lon between g.west and g.west + 0.8::double and r.lat between g.south and g.south + 0.8::double group by 1")
def area_requests(fences: DataFrame, requests: DataFrame) -> DataFrame:
    boxes = fences.select(F.col("id").alias("fence_id"), "west", "south", (F.col("west") + 0.8).alias("east"), (F.col("south") + 0.8).alias("north"))
    met = spatial.box_join(requests.select("lat", "lon", "vote_count"), boxes, cell=0.5)
    return met.groupBy(F.col("fence_id").alias("id")).agg(F.count("*").alias("n"), F.max("vote_count").alias("top_votes"))
