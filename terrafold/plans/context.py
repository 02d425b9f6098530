"""Registered queries: land cover, context records, chunks, retrieval and period comparisons."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.functions import models
from terrafold.functions.models import half_up
from terrafold.operators import spatial
from terrafold.operators.totals import totals
from terrafold.operators.vectors import VectorIndex, top_similar
from terrafold.plans.core import exact_avg, money, sql_avg
from terrafold.plans.views import query

# Lower bounds and labels of the vegetation index, land-cover codes with name and category.
NDVI_BANDS = ((0.0, "Water / Bare soil"), (0.1, "Very sparse"), (0.2, "Sparse"), (0.3, "Low density"), (0.4, "Moderate"), (0.5, "Moderate-high"), (0.7, "High density"), (1.0, "Very dense"))
LAND_COVER = {
    11: ("Open Water", "Other"), 21: ("Developed, Open Space", "Developed"), 22: ("Developed, Low Intensity", "Developed"), 23: ("Developed, Medium Intensity", "Developed"),
    24: ("Developed, High Intensity", "Developed"), 31: ("Barren Land", "Other"), 41: ("Deciduous Forest", "Forest"), 42: ("Evergreen Forest", "Forest"), 43: ("Mixed Forest", "Forest"),
    52: ("Shrub/Scrub", "Shrubland"), 71: ("Herbaceous/Grassland", "Grassland"), 81: ("Hay/Pasture", "Cropland"), 82: ("Cultivated Crops", "Cropland"), 90: ("Woody Wetlands", "Wetland"), 95: ("Emergent Herbaceous Wetlands", "Wetland"),
}
DEGRADED = (52, 71, 81)


def ndvi_label(value: Column) -> Column:
    """Band of a vegetation index."""
    return models.banded(value, NDVI_BANDS, "Maximum greenness")


def cover_code(key: Column) -> Column:
    """A land-cover code for a key, as the sample tables have none."""
    return F.element_at(F.array(*map(F.lit, LAND_COVER)), (key % len(LAND_COVER) + 1).cast("int"))


CODES = "[" + ", ".join(map(str, LAND_COVER)) + "]"
CASE = lambda k: "case code " + " ".join(f"when {c} then '{x[k]}'" for c, x in LAND_COVER.items()) + " end"


@query("d23_ndvi_bands", "features", sql="""
with v as (select risk_score / 400 - 0.2::double as v from features where kind = 'ndvi_observation')
select case when v < 0 then 'Water / Bare soil' when v < 0.1 then 'Very sparse' when v < 0.2 then 'Sparse' when v < 0.3 then 'Low density' when v < 0.4 then 'Moderate' when v < 0.5 then 'Moderate-high' when v < 0.7 then 'High density' when v < 1 then 'Very dense' else 'Maximum greenness' end as band, count(*) as n from v group by 1""")  # fmt: skip
def ndvi_bands(features: DataFrame) -> DataFrame:
    rows = features.where("kind = 'ndvi_observation'").select(ndvi_label(F.col("risk_score") / 400 - 0.2).alias("band"))
    return rows.groupBy("band").agg(F.count("*").alias("n"))


@query("d32_land_cover", "soil_points", sql=f"""
with c as (select {CODES}[id % {len(LAND_COVER)} + 1] as code from soil_points)
select {CASE(0)} as name, {CASE(1)} as category, code in (52, 71, 81) as degraded, count(*) as n from c group by 1, 2, 3""")  # fmt: skip
def land_cover(points: DataFrame) -> DataFrame:
    counts = points.groupBy(cover_code(F.col("id")).alias("code")).agg(F.count("*").alias("n"))
    pick = lambda k: models.lookup(F.col("code"), {c: x[k] for c, x in LAND_COVER.items()}, "Unknown")
    return counts.select(pick(0).alias("name"), pick(1).alias("category"), F.col("code").isin(*DEGRADED).alias("degraded"), "n")


@query("d33_reforestation", "soil_points", sql=f"""
with c as (select floor(lat * 2)::bigint as y, floor(lon * 2)::bigint as x, {CODES}[id % {len(LAND_COVER)} + 1] as code, organic_carbon, 200 + (id * 37) % 900 as rain from soil_points),
g as (select y, x, count(*) as cells, {sql_avg('organic_carbon')} as carbon from c where code in (52, 71, 81) and rain >= 400 group by 1, 2)
select y, x, cells, carbon, case when carbon < 15 then 'High' when carbon < 30 then 'Medium' else 'Low' end as suitability from g""")  # fmt: skip
def reforestation(points: DataFrame) -> DataFrame:
    """Half-degree cells of degraded, wet enough land, classed by how much carbon the soil lacks."""
    wet = cover_code(F.col("id")).isin(*DEGRADED) & (200 + (F.col("id") * 37) % 900 >= 400)
    cells = points.where(wet).groupBy(F.floor(F.col("lat") * 2).alias("y"), F.floor(F.col("lon") * 2).alias("x")).agg(F.count("*").alias("cells"), exact_avg("organic_carbon").alias("carbon"))
    return cells.withColumn("suitability", F.when(F.col("carbon") < 15, "High").when(F.col("carbon") < 30, "Medium").otherwise("Low"))


def mean_in(boxes: DataFrame, points: DataFrame, value: str) -> DataFrame:
    """``id``, ``n`` points in each box, and the ``mean`` of a value by a decimal sum, as ``exact_avg``; the sum is carried in two whole numbers."""
    units = (money(value) * 1_000_000).cast("decimal(18,0)").cast("long")
    rows = points.select("lat", "lon", units.alias("_u")).select("lat", "lon", F.expr("_u div 1000000000").alias("high"), (F.col("_u") % 1_000_000_000).alias("low"), F.col("_u").isNotNull().cast("long").alias("known"))
    found = totals(boxes, rows, "id", sums=("high", "low", "known"))
    whole = F.col("high").cast("decimal(24,0)") * F.lit(1000).cast("decimal(4,0)") + F.col("low").cast("decimal(24,0)") * F.lit(Decimal("0.000001")).cast("decimal(6,6)")
    return found.select("id", "n", half_up(F.try_divide(whole.cast("double"), F.col("known")), 4).alias("mean"))


@query("a21_context", "watched_locations", "fire_detections", "soil_points", sql=f"""
with f as (select w.id, {sql_avg('frp')} as fire, count(*) as fires from watched_locations w join fire_detections f on f.lat between w.lat - 0.45::double and w.lat + 0.45::double and f.lon between w.lon - 0.45::double and w.lon + 0.45::double group by 1),
s as (select w.id, {sql_avg('organic_carbon')} as carbon from watched_locations w join soil_points p on p.lat between w.lat - 0.45::double and w.lat + 0.45::double and p.lon between w.lon - 0.45::double and w.lon + 0.45::double group by 1)
select w.id, coalesce(f.fire, 0.0::double) as fire, coalesce(f.fires, 0) as fires, coalesce(s.carbon, 0.5::double) as carbon from watched_locations w left join f on f.id = w.id left join s on s.id = w.id""")  # fmt: skip
def context(places: DataFrame, fires: DataFrame, soil: DataFrame) -> DataFrame:
    """Averages around every location, with defaults where there is nothing."""
    boxes = places.select("id", *((F.col(c) + d).alias(n) for n, c, d in (("west", "lon", -0.45), ("south", "lat", -0.45), ("east", "lon", 0.45), ("north", "lat", 0.45))))
    f = mean_in(boxes, fires, "frp").select("id", F.col("mean").alias("fire"), F.col("n").alias("fires"))
    s = mean_in(boxes, soil, "organic_carbon").select("id", F.col("mean").alias("carbon"))
    return places.select("id").join(f, "id", "left").join(s, "id", "left").select("id", F.coalesce("fire", F.lit(0.0)).alias("fire"), F.coalesce("fires", F.lit(0)).alias("fires"), F.coalesce("carbon", F.lit(0.5)).alias("carbon"))


@query("d39_location_context", "watched_locations", "drought_areas", "strategy_requests", "water_gauges", "weather_days", "soil_points")
def location_context(places: DataFrame, areas: DataFrame, requests: DataFrame, gauges: DataFrame, days: DataFrame, soil: DataFrame) -> DataFrame:
    """A record for every location; missing parts are null.

    Stations have no place here, so a location reads station id modulo 20: the humidity and wind of its latest day.
    """
    at = places.select("id", "lat", "lon", "radius_km")
    dry = spatial.box_join(at, areas.select("dm", "west", "south", "east", "north"), cell=2.0).groupBy("id").agg(F.max("dm").alias("dm"))
    zones = totals(at.select("id", "lat", "lon", F.col("radius_km").alias("km")), requests.where("status = 'open'").select("lat", "lon", "vote_count"), "id", largest=("vote_count",), circle=True)
    zones = zones.select("id", F.col("n").alias("requests"), F.col("vote_count").cast("int").alias("top_votes"))
    near = spatial.nearest_planar(at, gauges.select("site_no", "percentile", "condition", F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon")), "id", "site_no", 2.0, right_at=("g_lat", "g_lon")).select("id", "site_no", models.gauge_stress(F.col("percentile"), F.col("condition")).alias("gauge_stress"))
    latest = days.groupBy("station_id").agg(F.max_by(F.struct("rh", "wind_kmh"), "day").alias("w"), F.max("day").alias("weather_day"))
    weather = at.select("id", (F.col("id") % 20).alias("station_id")).join(latest, "station_id").select("id", "w.rh", "w.wind_kmh", "weather_day")
    ground = spatial.nearest_planar(at, soil.select(F.col("id").alias("soil_id"), "ph", "organic_carbon", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")), "id", "soil_id", 0.5, right_at=("s_lat", "s_lon")).select("id", "soil_id", "ph", "organic_carbon")
    risk = F.when(F.col("rh").isNotNull(), models.fire_risk(F.lit("shrubland"), F.lit(10.0), F.lit(180.0), F.col("rh"), F.col("wind_kmh") / 3.6))
    joined = at.join(dry, "id", "left").join(zones, "id", "left").join(near, "id", "left").join(weather, "id", "left").join(ground, "id", "left")
    return joined.select("id", risk.alias("fire_risk"), models.drought_label(F.col("dm")).alias("drought"), models.drought_stress(F.col("dm")).alias("drought_stress"), "site_no", "gauge_stress", "requests", "top_votes", models.data_confidence(F.col("gauge_stress").isNotNull(), F.col("dm").isNotNull()).alias("confidence"), "weather_day", "soil_id", "ph", "organic_carbon")


@query("x1_chunks", "documents", sql="""
with c as (select doc_id, text, unnest(range(0, greatest(ceil((length(text) - 200) / 800.0)::bigint, 1))) as chunk from documents)
select doc_id, chunk, length(substring(text, chunk * 800 + 1, 1000)) as n, sha256(substring(text, chunk * 800 + 1, 1000)) as hash from c""")  # fmt: skip
def chunks(documents: DataFrame) -> DataFrame:
    """Windows of 1,000 characters that overlap by 200, with a hash of their content."""
    last = F.greatest(F.ceil((F.length("text") - 200) / 800.0), F.lit(1)) - 1
    each = documents.select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("chunk"))
    part = F.substring("text", F.col("chunk") * 800 + 1, F.lit(1000))
    return each.select("doc_id", "chunk", F.length(part).cast("long").alias("n"), F.sha2(part, 256).alias("hash"))


X2_SQL = """
with s as (select q.vec_id as id, v.vec_id as other, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as sim from embeddings q join embeddings v on q.vec_id % 20 = 0 and q.vec_id <> v.vec_id),
r as (select *, row_number() over (partition by id order by round(sim, 9) desc, other) as place from s)
select id, place::int as place, other, floor(sim * 10000 + 0.5::double) / 10000.0::double as similarity from r where place <= 10"""


@query("x2_cosine_top_k", "embeddings", sql=X2_SQL)
def cosine_top(embeddings: DataFrame) -> DataFrame:
    """Queries are the rows whose id is divisible by 20, against all rows."""
    rows = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return top_similar(rows.where("id % 20 = 0"), rows).select("id", "place", "other", half_up(F.col("similarity"), 4).alias("similarity"))


@query("x2_index_exact", "embeddings", sql=X2_SQL)
def indexed_exact(embeddings: DataFrame) -> DataFrame:
    """X2 through the index: the same rows, by the cells that can hold them."""
    rows = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = VectorIndex.fit(rows).search(rows.where("id % 20 = 0"), exact=True)
    return found.select("id", "place", "other", half_up(F.col("similarity"), 4).alias("similarity"))


@query("x2_index_recall", "embeddings")
def index_recall(embeddings: DataFrame) -> DataFrame:
    """Of each query, how many of its ten nearest the nearest cells hold, and the share of cells that were looked into."""
    rows = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    index, queries = VectorIndex.fit(rows), rows.where("id % 20 = 0")
    truth = top_similar(queries, rows).select("id", "other")
    hit = truth.join(index.search(queries).select("id", "other", F.lit(1).alias("hit")), ["id", "other"], "left")
    return hit.groupBy("id").agg(F.count("hit").alias("found"), F.count("*").alias("wanted"), F.lit(index.probes / len(index.centres)).alias("looked_into"))


def diverse(found: DataFrame, vectors: DataFrame, keep: int = 5, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over each query's top rows (``id``, ``other``, ``similarity``).

    Each step takes the row with the largest ``weight`` * similarity - (1 - ``weight``) * its largest cosine to a row taken
    before; ties go to the smaller ``other``. A group is a query's top-k, so it has a bounded size. Null or zero vectors
    are unlike everything.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("other").reset_index(drop=True)
        v = np.array([np.asarray(x, float) for x in pdf["v"]])
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        gain, near, taken = pdf["similarity"].to_numpy(), np.zeros(len(pdf)), []
        for _ in range(min(keep, len(pdf))):
            score = np.round(weight * gain - (1 - weight) * near, 9)
            score[taken] = -np.inf
            taken.append(int(score.argmax()))
            near = (v @ v[taken].T).max(axis=1)
        return pdf.loc[taken, ["id", "other"]].assign(place=range(1, len(taken) + 1))

    rows = found.select("id", "other", "similarity").join(vectors.where("v is not null").select(F.col("id").alias("other"), "v"), "other")
    return rows.groupBy("id").applyInPandas(run, "id long, other long, place int")


@query("x3_diverse_top", "embeddings")
def diverse_top(embeddings: DataFrame) -> DataFrame:
    """Five of the ten nearest, re-ranked; queries as in X2."""
    rows = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return diverse(top_similar(rows.where("id % 20 = 0"), rows), rows)


@query("x9_week_over_week", "fire_detections", sql="""
with d as (select date_trunc('day', detected_at)::timestamp as day, count(*) as n from fire_detections group by 1)
select a.day, a.n, b.n as week_before, (a.n - b.n) as change from d a join d b on b.day = a.day - interval 7 days""")  # fmt: skip
def week_over_week(fires: DataFrame) -> DataFrame:
    """Every day beside the same day of the week before."""
    days = fires.groupBy(F.date_trunc("day", "detected_at").alias("day")).agg(F.count("*").alias("n"))
    before = days.select((F.col("day") + F.expr("INTERVAL '7' DAY")).alias("day"), F.col("n").alias("week_before"))
    return days.join(before, "day").select("day", "n", "week_before", (F.col("n") - F.col("week_before")).alias("change"))


@query("x11_seasonal_water", "strategy_requests", sql="select extract(month from created_at)::int as month, count(*) as n, sum(vote_count)::bigint as votes from strategy_requests group by 1")
def seasonal(requests: DataFrame) -> DataFrame:
    """X11: a table by month of the year."""
    return requests.groupBy(F.month("created_at").alias("month")).agg(F.count("*").alias("n"), F.sum("vote_count").alias("votes"))
