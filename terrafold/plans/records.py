"""Registered queries: the regional record of every location at its own date (D39, D40), and the strategies' ranking in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import models
from terrafold.functions.models import half_up
from terrafold.operators import spatial
from terrafold.operators.asof import as_of
from terrafold.operators.meeting import polygons_met
from terrafold.plans.places import up
from terrafold.plans.shapes import CROSSES, MEETS, corners
from terrafold.plans.views import ORACLES, VIEWS, ctes, query

VIEWS |= {
    "gauge_readings": ("lineitem", ("l_suppkey AS site_no", "CAST(DATE '2024-01-01' + CAST((CAST(l_orderkey AS BIGINT) * 7 + l_linenumber * 3) % 40 AS INT) AS DATE) AS read_on", "CAST(l_quantity AS DOUBLE) AS flow")),
    "dated_locations": ("customer", ("c_custkey AS id", *VIEWS["watched_locations"][1][3:5], "CAST(DATE '2023-12-28' + CAST(c_custkey % 40 AS INT) AS DATE) AS as_of")),
}
FACTORS = ("water_stress", "soil_health", "fire_risk", "vegetation", "demand")


def factors_sql(source: str, keep: str) -> str:
    """SQL of the five factors from ``lat, lon, soil, drought, gauge``; the columns of ``keep`` go along."""
    clamp = lambda x: f"least(100.0::double, greatest(0.0::double, {x}))"
    soil = "coalesce(soil, least(90.0::double, 40 + abs(lat - 37) / 20 * 20 + abs(lon + 115) / 30 * 15))"
    water = f"case when drought is not null and gauge is not null then {up('drought * 0.6::double + gauge * 0.4::double')} else coalesce(drought, gauge, {up('30 + least(1.0::double, greatest(0.0::double, (-lon - 100) / 25)) * 50 + (sin(lat * 0.3::double) + 1) * 10')}) end"
    fire = up("25 + greatest(0.0::double, (36 - lat) * 1.5::double) + greatest(0.0::double, (-lon - 117) * 2) + (cos(lon * 0.15::double) + 1) * 8")
    plants, demand = up(f"20 + {soil} * 0.4::double + (sin(lat * 0.2::double + lon * 0.1::double) + 1) * 10"), up("30 + (cos(lat * 0.5::double) + 1) * 20")
    return f"select {keep}, " + ", ".join(f"{clamp(x)} as {n}" for n, x in zip(FACTORS, (water, soil, fire, plants, demand), strict=True)) + f" from {source}"


def score_sql(weights: tuple[float, ...]) -> str:
    return up("least(100.0::double, greatest(0.0::double, " + " + ".join(f"{n} * {w}::double" for n, w in zip(FACTORS, weights, strict=True)) + "))")


def soil_sql(carbon: str) -> str:
    return f"case when {carbon} <= 0 then 90.0::double when {carbon} >= 30 then 10.0::double else {up(f'100 - {carbon} / 30 * 90')} end"


STRATEGY_ROWS = " union all ".join(f"select id, {k} as ordinal, '{s}' as strategy, {score_sql(w)} as score, " + ", ".join(f"{n} * {x}::double as w_{n}, {n}" for n, x in zip(FACTORS, w, strict=True)) + " from f" for k, (s, w) in enumerate(models.STRATEGY_WEIGHTS.items()))
LIMITS = {"water_stress": 60, "soil_health": 50, "fire_risk": 55, "vegetation": 55, "demand": 40}
REASON_ROWS = " union all ".join(f"select id, strategy, '{n}' as name, {k} as k, w_{n} as share from each where {n} > {LIMITS[n]}" for k, n in enumerate(FACTORS))

#: W8 in SQL: soil score and drought of every soil point, six scores, the three largest triggered shares.
ORACLES["w8_strategy_ranking"] = f"""
{ctes("soil_points", "drought_areas").rstrip()},
s as (
  select id, lat, lon, {soil_sql("organic_carbon")} as soil, (select (40 + 15 * max(dm))::double from drought_areas a where lon between a.west and a.east and lat between a.south and a.north) as drought, null::double as gauge from soil_points),
f as ({factors_sql("s", "id")}),
each as ({STRATEGY_ROWS}),
why as (select id, strategy, string_agg(name, ',' order by share desc, k) as reasons from (select *, row_number() over (partition by id, strategy order by share desc, k) as rn from ({REASON_ROWS})) where rn <= 3 group by 1, 2)
select e.id, row_number() over (partition by e.id order by score desc, ordinal)::int as place, e.strategy, score, coalesce(reasons, 'applicable') as reasons from each e left join why on why.id = e.id and why.strategy = e.strategy
"""


def risk_sql(rh: str, wind: str) -> str:
    return up(f"least(100.0::double, greatest(0.0::double, 0.85::double * 100 * 0.3::double + least(100.0::double, 10 / 45.0::double * 100) * 0.2::double + (cos(radians(180) - pi()) + 1) / 2 * 100 * 0.1::double + greatest(0.0::double, 100 - {rh}) * 0.25::double + least(100.0::double, {wind} / 30 * 100) * 0.15::double))")


RECORD_SQL = f"""
with w as (select * from (select l.id, d.rh, d.wind_kmh, l.as_of - d.day as age, row_number() over (partition by l.id order by d.day desc) as rn from dated_locations l join weather_days d on d.station_id = l.id % 20 and d.day <= l.as_of) where rn = 1),
dry as (select l.id, max(a.dm) as dm from dated_locations l join drought_areas a on l.lon between a.west and a.east and l.lat between a.south and a.north group by 1),
g as (select id, arg_min(site_no, (d, site_no)) as site_no, arg_min(coalesce(100 - percentile, 50), (d, site_no))::double as gauge from (select l.id, g.site_no, g.percentile, sqrt((l.lat - g.lat) * (l.lat - g.lat) + (l.lon - g.lon) * (l.lon - g.lon)) as d from dated_locations l, water_gauges g) where d <= 2 group by 1),
read as (select * from (select l.id, r.flow, l.as_of - r.read_on as age, row_number() over (partition by l.id order by r.read_on desc, r.flow desc) as rn from dated_locations l join g on g.id = l.id join gauge_readings r on r.site_no = g.site_no and r.read_on <= l.as_of) where rn = 1),
boxes as (select id as loc, as_of, lon - 0.25::double as w, lat - 0.25::double as s, lon + 0.25::double as e, lat + 0.25::double as n from dated_locations),
edges as (select id, burned, unnest([x1, x2, x3]) as ax, unnest([y1, y2, y3]) as ay, unnest([x2, x3, x1]) as bx, unnest([y2, y3, y1]) as b_y from basins),
burned as (select loc, count(*) as fires, max(burned) as last_burn from (select loc, id, any_value(burned) as burned from boxes, edges where burned between year(as_of) - 30 and year(as_of) group by 1, 2 having bool_or({MEETS}) or count(*) filter ({CROSSES}) % 2 = 1) group by 1),
soil as (select l.id, arg_min(s.id, (sqrt((l.lat - s.lat) * (l.lat - s.lat) + (l.lon - s.lon) * (l.lon - s.lon)), s.id)) as soil_id from dated_locations l join soil_points s on sqrt((l.lat - s.lat) * (l.lat - s.lat) + (l.lon - s.lon) * (l.lon - s.lon)) <= 0.5 group by 1),
zones as (select l.id, count(*) as zones from dated_locations l join geofences z on l.lat between z.south + 0.4::double - 0.5::double and z.south + 0.4::double + 0.5::double and l.lon between z.west + 0.4::double - 0.5::double and z.west + 0.4::double + 0.5::double group by 1),
r as (
  select l.id, l.lat, l.lon, l.as_of, {risk_sql("w.rh", "(w.wind_kmh / 3.6::double)")} as risk, w.age as weather_age, dm, (40 + 15 * dm)::double as drought, g.site_no, g.gauge, read.flow, read.age as flow_age, fires, last_burn, zones, p.id as soil_id, p.ph, p.organic_carbon, {soil_sql("p.organic_carbon")} as soil,
    greatest(0.0::double, 6.5::double - p.organic_carbon / 10) * 0.3::double * 1.5::double * (0.4::double + (600 - 400) / 400.0::double * 0.6::double) as gain, w.rh
  from dated_locations l left join w on w.id = l.id left join dry on dry.id = l.id left join g on g.id = l.id left join read on read.id = l.id left join burned on burned.loc = l.id left join soil on soil.id = l.id left join soil_points p on p.id = soil.soil_id left join zones on zones.id = l.id),
f as ({factors_sql("r", "id")}),
each as ({STRATEGY_ROWS}),
best as (select id, arg_min(strategy, (-score, ordinal)) as strategy, max(score) as score from each group by 1)
select r.id, as_of::timestamp as as_of, case when rh is not null then risk end as fire_risk, weather_age::double as weather_age,
  case dm when 0 then 'D0 (Abnormally Dry)' when 1 then 'D1 (Moderate Drought)' when 2 then 'D2 (Severe Drought)' when 3 then 'D3 (Extreme Drought)' when 4 then 'D4 (Exceptional Drought)' end as drought,
  site_no::double as site_no, gauge as gauge_stress, flow, flow_age::double as flow_age, coalesce(fires, 0) as perimeters, last_burn::double as last_burn, coalesce(zones, 0) as zones, soil_id::double as soil_id, ph, case when soil_id is not null then {up("gain", 2)} end as carbon_gain, strategy, score,
  concat_ws(',', case when rh is null then 'weather' end, case when dm is null then 'drought' end, case when site_no is null then 'gauge' end, case when flow is null then 'reading' end, case when soil_id is null then 'soil' end) as missing
from r join best on best.id = r.id"""


def box_around(degrees: float) -> Column:
    """Bounds of a square around a place."""
    lat, lon = F.col("lat"), F.col("lon")
    return F.struct((lon - degrees).alias("west"), (lat - degrees).alias("south"), (lon + degrees).alias("east"), (lat + degrees).alias("north"))


def burned_near(places: DataFrame, perimeters: DataFrame, degrees: float = 0.25, years: int = 30) -> DataFrame:
    """``id``, ``perimeters`` and ``last_burn``: polygons (``fire, burned, rings``) of the last years that share a point with the square around a place."""
    boxed = places.select("id", box_around(degrees).alias("box"), F.year("as_of").alias("high")).select("id", "box.*", "high", (F.col("high") - years).alias("low"))
    return polygons_met(boxed, perimeters.select("rings", F.col("burned").alias("value")), "id").select("id", F.col("n").alias("perimeters"), F.col("largest").alias("last_burn"))


@query("d40_regional_record", "dated_locations", "weather_days", "drought_areas", "water_gauges", "gauge_readings", "basins", "soil_points", "geofences", sql=RECORD_SQL)
def regional_record(places: DataFrame, days: DataFrame, areas: DataFrame, gauges: DataFrame, readings: DataFrame, basins: DataFrame, soil: DataFrame, fences: DataFrame) -> DataFrame:
    """What is known of every location at its date, how many days old each observation is, and which parts are missing. Numbers that can be missing are doubles."""
    at = places.select("id", "lat", "lon", "as_of")
    age = lambda c: F.datediff("as_of", "seen").cast("int").alias(c)
    weather = as_of(at.select("id", "as_of", (F.col("id") % 20).alias("station_id")), days, ["station_id"], "as_of", "day", ["rh", "wind_kmh"]).select("id", "rh", "wind_kmh", age("weather_age"))
    dry = spatial.box_join(at, areas.select("dm", "west", "south", "east", "north"), cell=2.0).groupBy("id").agg(F.max("dm").alias("dm"))
    near = spatial.nearest_planar(at, gauges.select("site_no", "percentile", "condition", F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon")), "id", "site_no", 2.0, right_at=("g_lat", "g_lon"))
    near = near.select("id", "as_of", "site_no", models.gauge_stress(F.col("percentile"), F.col("condition")).alias("gauge"))
    read = as_of(near, readings, ["site_no"], "as_of", "read_on", ["flow"]).select("id", "site_no", "gauge", "flow", age("flow_age"))
    burned = burned_near(at, basins.select(F.col("id").alias("fire"), "burned", F.array(corners(1, 2, 3, 1)).alias("rings")))
    ground = spatial.nearest_planar(at, soil.select(F.col("id").alias("soil_id"), "ph", "organic_carbon", "bulk_density", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")), "id", "soil_id", 0.5, right_at=("s_lat", "s_lon")).select("id", "soil_id", "ph", "organic_carbon", "bulk_density")
    centre = fences.select((F.col("west") + 0.4).alias("x"), (F.col("south") + 0.4).alias("y"))
    zones = spatial.box_join(at, centre.select((F.col("x") - 0.5).alias("west"), (F.col("y") - 0.5).alias("south"), (F.col("x") + 0.5).alias("east"), (F.col("y") + 0.5).alias("north"))).groupBy("id").agg(F.count("*").alias("zones"))
    whole = at
    for part in (weather, dry, read, burned, ground, zones):
        whole = whole.join(part, "id", "left")
    f = models.factors(F.col("lat"), F.col("lon"), models.soil_score(F.col("organic_carbon")), models.drought_stress(F.col("dm")), F.col("gauge"))
    scores = whole.withColumn("s", F.array_min(F.transform(models.strategy_scores(f), lambda s: F.struct((-s["score"]).alias("rank"), s["ordinal"].alias("ordinal"), s["strategy"].alias("strategy")))))
    risk = models.fire_risk(F.lit("shrubland"), F.lit(10.0), F.lit(180.0), F.col("rh"), F.col("wind_kmh") / 3.6)
    gain = models.carbon_potential(F.col("organic_carbon"), F.col("bulk_density"), F.lit("reforestation"), F.lit(600.0))["gain"]
    absent = F.concat_ws(",", *(F.when(F.col(c).isNull(), n) for n, c in (("weather", "rh"), ("drought", "dm"), ("gauge", "site_no"), ("reading", "flow"), ("soil", "soil_id"))))
    number = lambda c: F.col(c).cast("double").alias(c)
    return scores.select(
        "id", F.col("as_of").cast("timestamp").alias("as_of"), F.when(F.col("rh").isNotNull(), risk).alias("fire_risk"), number("weather_age"), models.drought_label(F.col("dm"), "record").alias("drought"), number("site_no"), F.col("gauge").alias("gauge_stress"), "flow", number("flow_age"),
        F.coalesce("perimeters", F.lit(0)).alias("perimeters"), number("last_burn"), F.coalesce("zones", F.lit(0)).alias("zones"), number("soil_id"), "ph", F.when(F.col("soil_id").isNotNull(), gain).alias("carbon_gain"), F.col("s.strategy").alias("strategy"), (-F.col("s.rank")).alias("score"), absent.alias("missing"),
    )


#: The four wordings of a drought class, by class.
WORDS_SQL = " union all ".join(f"select {k} as dm, '{w}' as wording, '{text}' as label" for w, texts in models.DROUGHT_WORDINGS.items() if w != "export" for k, text in enumerate(texts))
EXPORT_SQL = " union all ".join(f"select {k} as dm, 'export' as wording, '{text}' as label" for k, text in enumerate(models.DROUGHT_WORDINGS["export"][:5]))


@query("d26_drought_wordings", "drought_areas", sql=f"select ordinal, wording, label from drought_areas a join ({WORDS_SQL} union all {EXPORT_SQL}) w on w.dm = a.dm")
def drought_wordings(areas: DataFrame) -> DataFrame:
    """Every area's class in each wording."""
    each = F.array(*(F.struct(F.lit(w).alias("wording"), models.drought_label(F.col("dm"), w).alias("label")) for w in models.DROUGHT_WORDINGS))
    return areas.select("ordinal", F.inline(each))


@query("d23_ndwi_bands", "features", sql="""
with v as (select risk_score / 400 - 0.6::double as v from features where kind = 'ndvi_observation')
select case when v < -0.2 then 'Severe water stress' when v < 0 then 'High water stress' when v < 0.2 then 'Moderate stress' when v < 0.4 then 'Adequate moisture' when v < 0.6 then 'High moisture' else 'Water body' end as band, count(*) as n from v group by 1""")  # fmt: skip
def water_bands(features: DataFrame) -> DataFrame:
    rows = features.where("kind = 'ndvi_observation'").select(models.water_label(F.col("risk_score") / 400 - 0.6).alias("band"))
    return rows.groupBy("band").agg(F.count("*").alias("n"))


@query("d9_point_risk", "soil_points", sql=f"""
select id, {up("0.6::double * cec * 4 + 0.4::double * least(100.0::double, organic_carbon / 50 * 100)")} as score, case when id % 4 > 0 then case when organic_carbon > 30 then 'high' else 'medium' end else 'low' end as confidence from soil_points""")  # fmt: skip
def point_risk(soil: DataFrame) -> DataFrame:
    """D9 with its confidence; risk, index and code are made of the soil points' columns."""
    return soil.select("id", models.point_risk(F.col("cec") * 4, F.col("organic_carbon"), F.col("id") % 4).alias("p")).select("id", "p.*")


REGION_SQL = """
with r as (select id, west, south, west + 0.8::double as east, south + 0.8::double as north from geofences),
f as (select r.id, avg(risk_score::decimal(18,6))::double as risk from r join features x on x.kind = 'fire_detection' and x.lon between west and east and x.lat between south and north group by 1),
d as (select r.id, max(dm) as dm from r join drought_areas a on r.west <= a.east and r.east >= a.west and r.south <= a.north and r.north >= a.south group by 1),
w as (select r.id, avg(percentile::decimal(18,6))::double as p from r join water_gauges g on g.lon between r.west and r.east and g.lat between r.south and r.north group by 1),
n as (select r.id, count(*) as fires from r join fire_detections x on x.lon between west and east and x.lat between south and north where detected_at >= timestamp '2024-01-31' - interval 7 days group by 1),
s as (select r.id, floor(coalesce(risk, 0.0::double) * 100 + 0.5::double) / 100.0::double as risk, dm, floor(coalesce(p, 50.0::double) * 100 + 0.5::double) / 100.0::double as p, coalesce(fires, 0) as fires from r left join f on f.id = r.id left join d on d.id = r.id left join w on w.id = r.id left join n on n.id = r.id)
select id, risk as fire_risk, dm, p as percentile, fires, case when risk > 50 or coalesce(dm, 0) >= 3 then 'worsening' when risk < 20 and coalesce(dm, 0) <= 1 then 'improving' else 'stable' end as trend,
  case when risk >= 60 then 'High/red' when risk >= 30 then 'Moderate/yellow' else 'Low/green' end as risk_badge, case when dm >= 3 then 'Severe/red' when dm >= 2 then 'Moderate/yellow' else 'Normal/green' end as drought_badge,
  case when p <= 20 then 'Critically Low/red' when p <= 40 then 'Below Normal/yellow' else 'Normal/green' end as streamflow_badge, case when fires > 20 then 'High/red' when fires > 5 then 'Elevated/yellow' else 'Normal/green' end as fires_badge from s"""


@query("a11_all_regions", "geofences", "features", "drought_areas", "water_gauges", "fire_detections", sql=REGION_SQL)
def all_regions(fences: DataFrame, features: DataFrame, areas: DataFrame, gauges: DataFrame, fires: DataFrame) -> DataFrame:
    """The risk summary and badges of every region in one job; the drought class is the highest that meets it."""
    boxes = fences.select("id", "west", "south", (F.col("west") + 0.8).alias("east"), (F.col("south") + 0.8).alias("north"))
    within = lambda df, *cs: spatial.box_join(df.select("lat", "lon", *cs), boxes, cell=0.5).groupBy("id")
    mean = lambda c: F.avg(F.col(c).cast("decimal(18,6)")).cast("double")
    risk = within(features.where("kind = 'fire_detection'"), "risk_score").agg(mean("risk_score").alias("risk"))
    dry = spatial.boxes_overlap(boxes, areas.select("dm", *(F.col(c).alias(f"r_{c}") for c in ("west", "south", "east", "north"))), cell=2.0).groupBy("id").agg(F.max("dm").alias("dm"))
    flow = within(gauges, "percentile").agg(mean("percentile").alias("p"))
    recent = within(fires.where("detected_at >= TIMESTAMP '2024-01-31' - INTERVAL '7' DAY")).agg(F.count("*").alias("fires"))
    whole = fences.select("id")
    for part in (risk, dry, flow, recent):
        whole = whole.join(part, "id", "left")
    s = whole.select("id", half_up(F.coalesce("risk", F.lit(0.0)), 2).alias("fire_risk"), "dm", half_up(F.coalesce("p", F.lit(50.0)), 2).alias("percentile"), F.coalesce("fires", F.lit(0)).alias("fires"))
    b = s.withColumn("b", models.badges(F.col("fire_risk"), F.col("dm"), F.col("percentile"), F.col("fires")))
    trend = models.risk_trend(F.col("fire_risk"), F.coalesce("dm", F.lit(0)))
    return b.select("id", "fire_risk", "dm", "percentile", "fires", trend.alias("trend"), *(F.col(f"b.{c}").alias(f"{c}_badge") for c in ("risk", "drought", "streamflow", "fires")))
