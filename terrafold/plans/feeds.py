"""Registered queries that pass given tables through landed text and back: CSV and GeoJSON feeds (S1, S2, S3, K1, K2), perimeters (S12, D25), map objects (S18, D35), and seed and subscription upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import terrafold.plans.measures  # noqa: F401  its logical tables
from terrafold.operators import maintenance
from terrafold.operators.storage import shared_dir
from terrafold.plans.shapes import features_of
from terrafold.plans.views import ORACLES, QUERIES, ctes, query, view
from terrafold.sources import landed

#: Features of a collection file.
FILE_FEATURES = 2000
BOX = (-121.5, 33.0, -112.25, 41.5)


def fire_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections as the feed's CSV (K1), read by its reader."""
    rows = view(spark, sf_dir, "fire_detections")
    text = rows.select(F.col("lat").alias("Latitude"), F.col("lon").alias("longitude"), "brightness", "confidence", "frp", F.lit(None).cast("string").alias("satellite"), F.date_format("detected_at", "yyyy-MM-dd").alias("acq_date"), F.col("id").alias("acq_time"))
    path = shared_dir(spark)
    landed.write_csv(text, path)
    return landed.fires_csv(spark, path)


QUERIES["s1_fires_csv"] = fire_feed
ORACLES["s1_fires_csv"] = ctes("fire_detections") + "SELECT lat, lon, brightness::double AS brightness, confidence, coalesce(frp, 0)::double AS frp, 'VIIRS' AS satellite, strftime(detected_at, '%Y-%m-%d') AS acq_date, id::varchar AS acq_time FROM fire_detections WHERE lat IS NOT NULL AND lon IS NOT NULL"

QUERIES["s2_fires_in_box"] = lambda spark, sf_dir: landed.fires_in(fire_feed(spark, sf_dir), BOX, 7, "2024-01-20").select("acq_time", "acq_date", "frp")
ORACLES["s2_fires_in_box"] = ctes("fire_detections") + f"SELECT id::varchar AS acq_time, strftime(detected_at, '%Y-%m-%d') AS acq_date, coalesce(frp, 0)::double AS frp FROM fire_detections WHERE lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]} AND detected_at::date >= date '2024-01-13'"


def geojson_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as GeoJSON (K2), in collection files of some thousands, read by the feed's reader (S3)."""
    rows = view(spark, sf_dir, "features").select("id", "lat", "lon", "kind", "status")
    files = max(1, -(-rows.count() // FILE_FEATURES))
    lines = landed.as_features(rows).withColumn("file", F.pmod(F.xxhash64("value"), F.lit(files)))
    whole = lines.groupBy("file").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value"))
    path = shared_dir(spark)
    whole.write.partitionBy("file").text(path)
    good, _ = landed.collection(spark, path)
    prop = lambda n: F.get_json_object("properties", f"$.{n}").alias(n)
    return landed.points(good).select(F.get_json_object("properties", "$.id").cast("long").alias("id"), "lon", "lat", prop("kind"), prop("status"))


QUERIES["s3_geojson_points"] = geojson_feed
ORACLES["s3_geojson_points"] = ctes("features") + "SELECT id, lon, lat, kind, status FROM features"


@query("d25_perimeters", "basins", sql="""
select id::varchar as fire_id, 'Unknown' as name, (id * 10)::double as acres, case id % 5 + 1 when 1 then 'unburned' when 2 then 'low' when 3 then 'moderate' when 4 then 'high' else 'increased_greenness' end as severity, burned::int as year from basins""")  # fmt: skip
def perimeters(basins: DataFrame) -> DataFrame:
    """Names, acres, severity labels and years of all perimeters."""
    return landed.burn_perimeters(features_of(basins)).select("fire_id", "name", "acres", "severity", F.col("year").cast("int").alias("year"))


#: Tags of a map object by its number modulo 7.
TAGS = (("amenity", "cafe"), ("building", "yes"), ("highway", "primary"), ("waterway", "river"), ("landuse", "forest"), ("highway", "proposed"), ("natural", "wood"))


@query("s18_osm_tables", "probes", sql="""
with o as (select id, case id % 3 when 0 then 'node' when 1 then 'way' else 'relation' end as kind, id % 2 = 0 as closed, id % 7 as tag, size from probes)
select 'pois' as "table", id, 'cafe' as class, null::double as number from o where kind = 'node' and tag = 0
union all select 'buildings', id, null, size from o where kind in ('way', 'relation') and tag = 1
union all select 'roads', id, 'primary', size from o where kind = 'way' and tag = 2
union all select 'waterways', id, 'river', null from o where kind = 'way' and tag = 3
union all select 'landuse', id, case tag when 4 then 'forest' else 'wood' end, null from o where ((kind = 'way' and closed) or kind = 'relation') and tag in (4, 6)""")  # fmt: skip
def osm_tables(probes: DataFrame) -> DataFrame:
    """Objects routed by their tags, with heights and speeds read from text."""
    key, value = (F.element_at(F.array(*(F.lit(t[k]) for t in TAGS)), (F.col("id") % 7 + 1).cast("int")) for k in (0, 1))
    kind = F.element_at(F.array(*map(F.lit, ("node", "way", "relation"))), (F.col("id") % 3 + 1).cast("int"))
    more = F.create_map(F.lit("name:en"), F.lit("x"), F.lit("height"), F.format_string("%.1f m", "size"), F.lit("maxspeed"), F.format_string("%.0f mph", "size"))
    objects = probes.select(kind.alias("kind"), "id", (F.col("id") % 2 == 0).alias("is_closed"), F.map_concat(F.create_map(key, value), more).alias("tags"), F.lit(None).cast("array<struct<lon:double,lat:double>>").alias("coords"))
    out = None
    for name, rows in landed.route_osm(objects).items():
        number = F.col("height") if "height" in rows.columns else F.col("maxspeed") if "maxspeed" in rows.columns else F.lit(None)
        part = rows.select(F.lit(name).alias("table"), "id", (F.col("class") if "class" in rows.columns else F.lit(None).cast("string")).alias("class"), number.cast("double").alias("number"))
        out = part if out is None else out.unionByName(part)
    return out


@query("k8_seed_upsert", "teams", sql="""
select lower(name) as slug, id, case when id % 2 = 0 then upper(specialty_a) else specialty_a end as specialty from teams union all select 'seed-' || id, id + 1000, specialty_b from teams where id % 3 = 0""")  # fmt: skip
def seed_upsert(teams: DataFrame) -> DataFrame:
    """K8: seeds overwrite the specialty of known slugs and add unknown ones; ids of known slugs stay."""
    base = teams.select(F.lower("name").alias("slug"), "id", F.col("specialty_a").alias("specialty"))
    known = base.where("id % 2 = 0").select("slug", (F.col("id") + 500).alias("id"), F.upper("specialty").alias("specialty"))
    new = teams.where("id % 3 = 0").select(F.concat(F.lit("seed-"), "id").alias("slug"), (F.col("id") + 1000).alias("id"), F.col("specialty_b").alias("specialty"))
    return maintenance.upsert(base, known.unionByName(new), ["slug"], ["specialty"]).select("slug", F.col("id").cast("long").alias("id"), "specialty")


@query("k15_subscription_upsert", "alert_subscriptions", sql="""
select user_id, watched_location_id, alert_type, case when user_id % 4 = 1 then not in_app_enabled else in_app_enabled end as in_app_enabled from alert_subscriptions
union all select user_id, watched_location_id + 1, 'fire_proximity', true from alert_subscriptions where user_id % 6 = 0""")  # fmt: skip
def subscription_upsert(subscriptions: DataFrame) -> DataFrame:
    """One row for each user, place and kind; a repeated subscription changes its switch."""
    keys = ["user_id", "watched_location_id", "alert_type"]
    again = subscriptions.where("user_id % 4 = 1").withColumn("in_app_enabled", ~F.col("in_app_enabled"))
    new = subscriptions.where("user_id % 6 = 0").select("user_id", (F.col("watched_location_id") + 1).alias("watched_location_id"), F.lit("fire_proximity").alias("alert_type"), F.lit(True).alias("in_app_enabled"))
    return maintenance.upsert(subscriptions, again.unionByName(new), keys, ["in_app_enabled"])
