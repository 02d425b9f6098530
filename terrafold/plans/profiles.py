"""Registered queries: seasonal water tables and site profiles (X11), chunks with metadata (X1), zone payloads (K9), suited species by grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions.models import half_up
from terrafold.operators.buckets import KeyedStore
from terrafold.operators.density import dbscan
from terrafold.operators.storage import shared_dir
from terrafold.plans.places import up
from terrafold.plans.views import ORACLES, QUERIES, VIEWS, pick, query, view

VIEWS |= {
    "well_readings": ("lineitem", ("l_suppkey AS well_id", "CAST(l_shipdate AS DATE) AS read_on", "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(5 + (CAST(l_orderkey AS BIGINT) * 13 + l_linenumber * 7) % 160 / CAST(4.0 AS DOUBLE) AS DOUBLE) END AS depth")),
    "site_places": ("customer", ("c_custkey AS id", "1 + c_custkey % 120 AS well_id")),
    "soil_profiles": ("part", ("p_partkey AS location_id", "CAST(45 + p_size % 45 AS DOUBLE) / 10 AS ph", "p_size % 3 = 0 AS from_survey")),
    "climate_profiles": ("orders", ("o_custkey AS location_id", "CAST(o_orderdate AS DATE) AS fetched_on", "CAST(200 + o_orderkey % 1500 AS DOUBLE) AS precip", "CAST(o_orderkey % 35 AS DOUBLE) AS temp")),
    "topography_profiles": ("customer", ("c_custkey * 2 AS location_id", "CAST(c_custkey % 45 AS DOUBLE) AS slope")),
    "land_use": ("orders", ("o_custkey AS location_id", "CAST(year(o_orderdate) AS INT) AS year", f"{pick('o_orderkey', ('cropland', 'pasture', 'forest', 'fallow'))} AS cover")),
}


def seasonal_depth(readings: DataFrame) -> DataFrame:
    """X11: ``well_id``, ``month``, ``depth`` and ``n``: mean depth by month of the year, over the month and its two neighbours; December is beside January.

    A well has twelve sums, each of which goes to three months, so readings are shuffled as partial sums only. A month whose
    three months have no reading has no row.
    """
    sums = readings.where("depth is not null").groupBy("well_id", F.month("read_on").alias("m")).agg(F.sum(F.col("depth").cast("decimal(18,6)")).alias("total"), F.count("*").alias("n"))
    around = sums.withColumn("month", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: (F.pmod(F.col("m") - 1 + d, F.lit(12)) + 1).cast("int"))))
    smooth = around.groupBy("well_id", "month").agg(F.sum("total").cast("double").alias("total"), F.sum("n").alias("n"))
    return smooth.select("well_id", "month", half_up(F.col("total") / F.col("n"), 4).alias("depth"), "n")


SEASONAL = f"""
sums as (select well_id, month(read_on) as m, sum(depth::decimal(18,6)) as total, count(*) as n from well_readings where depth is not null group by 1, 2),
seasonal as (select well_id, ((m - 1 + d + 12) % 12 + 1)::int as month, {up("sum(total)::double / sum(n)", 4)} as depth, sum(n)::bigint as n from sums, (select unnest([-1, 0, 1]) as d) group by 1, 2)"""


@query("x11_water_table", "well_readings", sql=f"with {SEASONAL} select well_id, month, depth, n from seasonal")
def water_table(readings: DataFrame) -> DataFrame:
    return seasonal_depth(readings)


@query("x11_site_profile", "site_places", "soil_profiles", "climate_profiles", "topography_profiles", "well_readings", "land_use", sql=f"""
with {SEASONAL},
climate as (select location_id, arg_max(precip, (fetched_on, precip, temp)) as precip, arg_max(temp, (fetched_on, precip, temp)) as temp from climate_profiles group by 1),
cover as (select location_id, arg_max(cover, (year, cover)) as cover, max(year) as year from land_use group by 1),
wells as (select well_id, max(depth) filter (month = 3) as march, arg_max(month, (depth, -month)) as deepest from seasonal group by 1)
select p.id, s.ph, c.precip, c.temp, t.slope, w.march as water_depth, w.deepest::double as deepest_month, l.cover, l.year::double as cover_year,
  ((s.ph is not null)::int + (c.precip is not null)::int + (t.slope is not null)::int + (w.well_id is not null)::int + (l.cover is not null)::int)::int as parts
from site_places p left join soil_profiles s on s.location_id = p.id left join climate c on c.location_id = p.id left join topography_profiles t on t.location_id = p.id left join wells w on w.well_id = p.well_id left join cover l on l.location_id = p.id""")  # fmt: skip
def site_profile(places: DataFrame, soil: DataFrame, climate: DataFrame, topography: DataFrame, readings: DataFrame, cover: DataFrame) -> DataFrame:
    """X11: soil, newest climate, topography, water table in March and newest land use of every place; missing parts are null."""
    newest = climate.groupBy("location_id").agg(F.max(F.struct("fetched_on", "precip", "temp")).alias("c"))
    last = cover.groupBy("location_id").agg(F.max(F.struct("year", "cover")).alias("l"))
    wells = seasonal_depth(readings).groupBy("well_id").agg(F.max(F.when(F.col("month") == 3, F.col("depth"))).alias("water_depth"), F.max(F.struct("depth", (-F.col("month")).alias("m"))).alias("d"))
    joined = places.join(soil.withColumnRenamed("location_id", "id"), "id", "left").join(newest.withColumnRenamed("location_id", "id"), "id", "left").join(topography.withColumnRenamed("location_id", "id"), "id", "left").join(wells, "well_id", "left").join(last.withColumnRenamed("location_id", "id"), "id", "left")
    known = sum((F.col(c).isNotNull().cast("int") for c in ("ph", "c", "slope", "d", "l")), F.lit(0))
    return joined.select("id", "ph", "c.precip", "c.temp", "slope", "water_depth", (-F.col("d.m")).cast("double").alias("deepest_month"), "l.cover", F.col("l.year").cast("double").alias("cover_year"), known.cast("int").alias("parts"))


def chunk_rows(documents: DataFrame, *, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Windows of ``size`` characters that overlap, each with a hash of its content and its document's metadata."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length("text") - overlap) / float(step)), F.lit(1)) - 1
    each = documents.where("text is not null").select("doc_id", "lang", "source", "text", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("chunk"))
    part = F.substring("text", F.col("chunk") * step + 1, F.lit(size))
    return each.select("doc_id", "chunk", part.alias("content"), F.sha2(part, 256).alias("hash"), F.struct("lang", "source", (F.col("chunk") * step).alias("start"), F.length(part).alias("length")).alias("metadata"))


def store_chunks(documents: DataFrame, store: KeyedStore, number: int) -> None:
    """Append the chunks whose content isn't stored; of equal ones the first of the smallest document. The store's key is ``hash``."""
    first = chunk_rows(documents).groupBy("hash").agg(F.min(F.struct("doc_id", "chunk", "content", "metadata")).alias("c")).select("hash", "c.*")
    store.append(first, number)


def chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older half of the documents is stored, then all of them; every content is there once, from the oldest document."""
    documents = view(spark, sf_dir, "documents")
    store = KeyedStore(shared_dir(spark), ("hash",))
    older = documents.crossJoin(F.broadcast(documents.agg((F.max("doc_id") / 2).alias("half")))).where("doc_id <= half").drop("half")
    store_chunks(older, store, 0)
    store_chunks(documents, store, 1)
    return spark.read.parquet(store.path).select("hash", "doc_id", "chunk", "metadata.lang", "metadata.source", "metadata.start", F.col("metadata.length").cast("long").alias("length"), F.sha2("content", 256).alias("content_hash"))


QUERIES["x1_chunk_store"] = chunk_store
ORACLES["x1_chunk_store"] = """
with c as (select doc_id, lang, source, text, unnest(range(0, greatest(ceil((length(text) - 200) / 800.0)::bigint, 1))) as chunk from documents where text is not null),
h as (select *, sha256(substring(text, chunk * 800 + 1, 1000)) as hash, length(substring(text, chunk * 800 + 1, 1000)) as length from c),
r as (select *, row_number() over (partition by hash order by doc_id, chunk) as rn from h)
select hash, doc_id, chunk, lang, source, chunk * 800 as start, length, hash as content_hash from r where rn = 1"""


@query("k9_zone_payload", "strategy_requests", sql=f"""
with recursive p as (select id, strategy_type as t, lat, lon, vote_count from strategy_requests where status <> 'completed'),
near as (select a.t, a.id as a, b.id as b from p a join p b on a.t = b.t and b.lat between a.lat - 0.051 and a.lat + 0.051 and sqrt((a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon)) <= 0.05::double),
core as (select a from near group by a having count(*) >= 3),
link as (select a, b from near where a in (select a from core) and b in (select a from core)),
r as (select a as node, a as root from core union select l.b, r.root from r join link l on l.a = r.node),
lab as (select node, min(root) as cluster from r group by 1),
fin as (select p.t, p.id, p.lat, p.lon, p.vote_count, coalesce(l.cluster, (select min(l2.cluster) from near n join lab l2 on l2.node = n.b where n.a = p.id)) as cluster from p left join lab l on l.node = p.id)
select cluster as zone_id, t as strategy_type, count(*) as requests, sum(vote_count)::bigint as votes, min(lon) as west, min(lat) as south, max(lon) as east, max(lat) as north, {up("sum(lat::decimal(18,6))::double / count(*)", 4)} as lat, {up("sum(lon::decimal(18,6))::double / count(*)", 4)} as lon from fin where cluster is not null group by 1, 2""")  # fmt: skip
def zone_payload(requests: DataFrame) -> DataFrame:
    """K9: what the export says of every zone: counts, votes, bounds and centroid."""
    rows = requests.where("status <> 'completed'").select("id", "strategy_type", "lat", "lon", "vote_count")
    mean = lambda c: half_up(F.sum(F.col(c).cast("decimal(18,6)")).cast("double") / F.count("*"), 4).alias(c)
    found = dbscan(rows, part="strategy_type", eps=0.05, min_points=3)
    return found.groupBy(F.col("cluster").alias("zone_id"), "strategy_type").agg(F.count("*").alias("requests"), F.sum("vote_count").alias("votes"), F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"), mean("lat"), mean("lon"))


def zone_messages(zones: DataFrame, at: str) -> DataFrame:
    """One JSON message on the zones' channel for each zone, for any sink of text."""
    body = F.struct(F.lit("priority_zones_updated").alias("event"), "zone_id", "strategy_type", "requests", "votes", F.array("west", "south", "east", "north").alias("bbox"), "lat", "lon", F.lit(at).alias("timestamp"))
    return zones.select(F.lit("zones").alias("channel"), F.to_json(body).alias("value"))
