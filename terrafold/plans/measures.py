"""Registered queries: geometry and models as Column functions, one measure a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geo, models
from terrafold.functions.models import half_up
from terrafold.plans.core import parse_box
from terrafold.plans.places import up
from terrafold.plans.views import VIEWS, query
from terrafold.sources.landed import series_trend

VIEWS |= {
    "boxes": ("nation", ("n_nationkey AS id", "-122 + (n_nationkey % 5) * CAST(0.8 AS DOUBLE) AS west", "37 + CAST(floor(n_nationkey / 5) AS INT) * CAST(0.8 AS DOUBLE) AS south", "-121 + (n_nationkey % 5) * CAST(0.8 AS DOUBLE) AS east", "37.5 + CAST(floor(n_nationkey / 5) AS INT) * CAST(0.8 AS DOUBLE) AS north")),
    "box_texts": ("supplier", ("s_suppkey AS id", "CASE s_suppkey % 4 WHEN 0 THEN concat(s_nationkey, ',1.5,', s_nationkey + 2, ',9') WHEN 1 THEN '1,2,3' WHEN 2 THEN 'a,1,2,3' ELSE concat('-', s_nationkey, ',-4,7,8.25') END AS bbox")),
    "probes": ("part", ("p_partkey AS id", "CAST(p_size AS DOUBLE) AS size", "CAST(p_partkey % 360 AS DOUBLE) AS degrees", "CAST((p_partkey * 7) % 101 AS DOUBLE) / 100 AS share", "CAST(CAST(p_partkey AS BIGINT) * p_partkey % 4000000 AS DOUBLE) AS metres", "CASE p_partkey % 5 WHEN 0 THEN 'Excessively drained' WHEN 1 THEN 'Moderately well drained' WHEN 2 THEN 'Very poorly drained' WHEN 3 THEN NULL ELSE 'Well drained' END AS drainage")),
}


def ring_of_box() -> Column:
    return geo.box_ring(F.struct("west", "south", "east", "north"))


@query("g2_haversine_m", "fire_detections", sql=f"select id, {up('12742000.0::double * asin(least(1.0::double, sqrt(pow(sin(radians(38 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(38)) * pow(sin(radians(-119 - lon) / 2), 2))))', 1)} as metres from fire_detections")
def metres(fires: DataFrame) -> DataFrame:
    return fires.select("id", half_up(geo.haversine_m(F.col("lon"), F.col("lat"), F.lit(-119.0), F.lit(38.0)), 1).alias("metres"))


@query("g3_box_area", "boxes", sql=f"select id, {up('abs(radians(east - west) * (2 + 2 * sin(radians(south))) + radians(west - east) * (2 + 2 * sin(radians(north)))) * 6371000.0::double * 6371000.0::double / 2 / 1e6::double', 3)} as km2 from boxes")
def box_area(boxes: DataFrame) -> DataFrame:
    return boxes.select("id", half_up(geo.ring_area_m2(ring_of_box()) / 1e6, 3).alias("km2"))


def text_sql(x: str, digits: int, unit: str) -> str:
    return f"printf('%.{digits}f {unit}', {up(x, digits)})"


@query("g6_formats", "probes", sql=f"""
select id, case when m < 1000 then {text_sql("m", 0, "m")} else {text_sql("m / 1000", 2, "km")} end as metric, case when feet < 5280 then {text_sql("feet", 0, "ft")} else {text_sql("feet / 5280", 2, "mi")} end as imperial
from (select id, metres / 7 as m, metres / 7 * 3.28084::double as feet from probes)""")  # fmt: skip
def formats(probes: DataFrame) -> DataFrame:
    """G6 in both units, over sevenths of a metre."""
    return probes.select("id", *(geo.format_distance(F.col("metres") / 7, unit).alias(unit) for unit in ("metric", "imperial")))


@query("g7_area_formats", "probes", sql=f"""
select id, case when a >= 10000 then {text_sql("a / 10000", 2, "ha")} else {text_sql("a", 0, "m²")} end as metric, case when a / 4046.86::double >= 1 then {text_sql("a / 4046.86::double", 2, "ac")} else {text_sql("a * 10.7639::double", 0, "ft²")} end as imperial
from (select id, metres / 7 as a from probes)""")  # fmt: skip
def area_formats(probes: DataFrame) -> DataFrame:
    """G7 in both units, over sevenths of a square metre."""
    return probes.select("id", *(geo.format_area(F.col("metres") / 7, unit).alias(unit) for unit in ("metric", "imperial")))


@query("g12_ring_bounds", "boxes", sql="select id, west, south, east, north, (west * 2 + east * 2 + west) / 5 as lon, (south * 3 + north * 2) / 5 as lat from boxes")
def ring_bounds(boxes: DataFrame) -> DataFrame:
    """Bounds and mean vertex of a box's closed ring."""
    made = boxes.select("id", ring_of_box().alias("r")).select("id", geo.rings_bbox(F.array("r")).alias("b"), geo.ring_centroid(F.col("r")).alias("c"))
    return made.select("id", "b.*", "c.*")


@query("g15_degree_box", "watched_locations", sql="select id, lon - 0.25::double as west, lat - 0.25::double as south, lon + 0.25::double as east, lat + 0.25::double as north, ((lon - 0.25::double) + (lon + 0.25::double)) / 2 as mid_lon from watched_locations")
def degree_box(places: DataFrame) -> DataFrame:
    boxed = places.select("id", geo.box_of_degrees(F.col("lat"), F.col("lon"), 0.25).alias("b"))
    return boxed.select("id", "b.*", geo.box_centre(F.col("b"))["lon"].alias("mid_lon"))


@query("g17_circle_vertices", "watched_locations", sql=f"with v as (select id, lat, lon, unnest(range(0, 9)) as i from watched_locations) select id, i::int as i, {up('lon + 0.5::double * cos(i * 2 * pi() / 8)', 6)} as x, {up('lat + 0.5::double * sin(i * 2 * pi() / 8)', 6)} as y from v")
def circle_vertices(places: DataFrame) -> DataFrame:
    each = places.select("id", F.posexplode(geo.circle_ring(F.col("lat"), F.col("lon"), F.lit(0.5), 8)).alias("i", "p"))
    return each.select("id", "i", half_up(F.col("p.lon"), 6).alias("x"), half_up(F.col("p.lat"), 6).alias("y"))


@query("g18_closed_rings", "boxes", sql="select id, 5 as n, 5 as again, east as mid_lon from boxes")
def closed_rings(boxes: DataFrame) -> DataFrame:
    """An open ring is closed once; the second edge of a box is its east side."""
    made = boxes.select("id", geo.closed(F.slice(ring_of_box(), 1, 4)).alias("r"))
    return made.select("id", F.size("r").alias("n"), F.size(geo.closed(F.col("r"))).alias("again"), F.get(geo.edge_midpoints(F.col("r")), F.lit(1))["lon"].alias("mid_lon"))


@query("g19_wind_sectors", "probes", sql="select id, (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[(floor(((degrees + 180) % 360) / 45 + 0.5::double)::int % 8) + 1] as sector from probes")
def sectors(probes: DataFrame) -> DataFrame:
    return probes.select("id", geo.wind_sector(F.col("degrees")).alias("sector"))


@query("d9_composite_risk", "probes", sql=f"select id, {up('0.6::double * (share * 100) + 0.4::double * least(100.0::double, size / 50 * 100)')} as risk from probes")
def composite(probes: DataFrame) -> DataFrame:
    return probes.select("id", models.composite_risk(F.col("share") * 100, F.col("size")).alias("risk"))


@query("d22_qualifier_trend", "probes", sql="select id, case when id % 3 = 0 then 'declining' else 'stable' end as trend from probes")
def qualifiers(probes: DataFrame) -> DataFrame:
    codes = F.array(F.lit("P"), F.when(F.col("id") % 3 == 0, F.when(F.col("id") % 2 == 0, "e").otherwise("E")).otherwise("A"))
    return probes.select("id", models.qualifier_trend(codes).alias("trend"))


@query("d24_drainage", "probes", sql="select id, case id % 5 when 0 then 'excessive' when 1 then 'moderately_well' when 2 then 'very_poorly' when 3 then 'unknown' else 'well' end as drainage from probes")
def drainage(probes: DataFrame) -> DataFrame:
    return probes.select("id", models.drainage_class(F.col("drainage")).alias("drainage"))


@query("d27_growing_system", "probes", sql="select id, case when share > 0.7 then 'Hydroponics' when share > 0.5 and id % 2 = 0 then 'Aquaponics' when size / 50 > 0.6 then 'Silvopasture' else 'Agroforestry' end as system from probes")
def systems(probes: DataFrame) -> DataFrame:
    return probes.select("id", models.growing_system(F.col("share"), F.col("id") % 2, F.col("size") / 50).alias("system"))


STOPS = ((0, 0.0), (10, 0.5), (40, 1.0))


@query("d36_scaled_size", "probes", sql=f"select id, {up('case when size < 10 then size * 0.05::double when size < 40 then 0.5::double + (size - 10) / 60 else 1 end', 6)} as scaled, size < 5 as calm, size * 3.6::double > 50 as alert, case when size * 1000 - 4000 >= -1000 then {up('(size * 1000 - 4000) / 10000', 4)} end as ndvi from probes")
def scaled(probes: DataFrame) -> DataFrame:
    """D36, D37, S20."""
    size = F.col("size")
    return probes.select("id", half_up(models.piecewise(size, STOPS), 6).alias("scaled"), (models.wind_class(size) == "calm").alias("calm"), models.wind_alert(size).alias("alert"), half_up(models.ndvi_value(size * 1000 - 4000), 4).alias("ndvi"))


@query("p2_parsed_boxes", "box_texts", sql="with p as (select id, string_split(bbox, ',') as x from box_texts), n as (select id, [try_cast(v as double) for v in x] as x from p where len(x) = 4) select id, x[1] as west, x[2] as south, x[3] as east, x[4] as north from n where x[1] is not null and x[2] is not null and x[3] is not null and x[4] is not null")
def parsed_boxes(texts: DataFrame) -> DataFrame:
    return texts.select("id", parse_box(F.col("bbox")).alias("b")).where("b is not null").select("id", "b.*")


@query("w6_series_trend", "water_gauges", "events", sql="""
with s as (select user_id as site_no, list(value order by ts, event_id) as v from events group by 1)
select g.site_no, case when s.v is null or len(s.v) < 2 then 'stable' when s.v[-1] - s.v[1] > 10 then 'critical' when s.v[-1] - s.v[1] > 5 then 'declining' when s.v[-1] - s.v[1] < -2 then 'rising' else 'stable' end as trend from water_gauges g left join s on s.site_no = g.site_no""")  # fmt: skip
def gauge_trends(gauges: DataFrame, readings: DataFrame) -> DataFrame:
    """Only the first and last value of a series are kept, so a busy site needs no long row."""
    at = F.struct("ts", "event_id")
    ends = readings.groupBy(F.col("user_id").alias("site_no")).agg(F.min_by("value", at).alias("first"), F.max_by("value", at).alias("last"), F.count("*").alias("n"))
    values = F.when(F.col("n") > 1, F.array("first", "last")).otherwise(F.array().cast("array<double>"))
    return gauges.select("site_no").join(ends, "site_no", "left").select("site_no", series_trend(values).alias("trend"))
