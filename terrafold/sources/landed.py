"""Readers of landed feed files (S1 to S23). Each reads with a fixed schema and gives one row per observation or feature."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLLECTION = "type string, features array<struct<type string, id string, geometry struct<type string, coordinates string>, properties string>>, _corrupt string"
#: A line end that no JSON text can hold, so that a file is one line. Spark cuts values that stay text (coordinates,
#: properties) out of a line's bytes; with ``multiLine`` it reads each of them from the file again.
NO_LINE_END = "\0\0\0"
SENSOR = "sensor_id string, lat double, lon double, timestamp timestamp, readings map<string,string>"
POSITION = "assetId string, lat double, lon double, heading double, speed double, altitude double, timestamp timestamp"
NWIS = (
    "value struct<timeSeries array<struct<sourceInfo struct<siteName string, siteCode array<struct<value string>>, geoLocation struct<geogLocation struct<latitude double, longitude double>>>, "
    "values array<struct<value array<struct<value string, dateTime string>>, qualifier array<struct<qualifierCode string>>>>>>>"
)
SOIL_GRIDS = "lat double, lon double, properties struct<layers array<struct<name string, depths array<struct<label string, values struct<mean double>>>>>>"
WEATHER = "lat double, lon double, current struct<temperature_2m double, relative_humidity_2m double, wind_speed_10m double, wind_direction_10m double, precipitation double>, hourly struct<time array<string>, temperature_2m array<double>, wind_speed_10m array<double>>"
#: Divisors of the soil layers' stored units, in the order of the output columns.
SOIL_FACTORS = {"phh2o": ("ph", 10), "soc": ("organic_carbon", 10), "nitrogen": ("nitrogen", 100), "bdod": ("bulk_density", 100), "cec": ("cec", 10), "clay": ("clay", 10)}
ROAD_CLASSES = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "service", "unclassified", "track", "path", "footway", "cycleway")


def number(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def lower_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all text, columns by lower-cased name."""
    df = spark.read.option("header", True).csv(path)
    return df.toDF(*(c.strip().lower() for c in df.columns))


def fires_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows without numeric coordinates go; missing values take their defaults."""
    df = lower_csv(spark, path)
    have = lambda c, default: F.coalesce(F.col(c) if c in df.columns else F.lit(None), F.lit(default))
    rows = df.select(number("latitude").alias("lat"), number("longitude").alias("lon"), F.coalesce(number(have("brightness", "0")), F.lit(0.0)).alias("brightness"), have("confidence", "nominal").alias("confidence"), F.coalesce(number(have("frp", "0")), F.lit(0.0)).alias("frp"), have("satellite", "VIIRS").alias("satellite"), have("acq_date", "").alias("acq_date"), have("acq_time", "").alias("acq_time"))
    return rows.where("lat is not null and lon is not null")


def fires_in(fires: DataFrame, box: tuple[float, float, float, float] = (-180, -90, 180, 90), days: int = 1, as_of: str = "2024-01-31") -> DataFrame:
    """A box, and the last 1 to 10 days."""
    days = max(1, min(10, days))
    return fires.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]) & (F.col("acq_date").try_cast("date") >= F.date_sub(F.lit(as_of).cast("date"), days)))


def collection(spark: SparkSession, path: str, *, need_geometry: bool = True) -> tuple[DataFrame, DataFrame]:
    """S3: features of GeoJSON collections, and the documents or features that are not valid."""
    docs = spark.read.schema(COLLECTION).option("lineSep", NO_LINE_END).option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("file", F.input_file_name())
    ok = F.col("_corrupt").isNull() & (F.col("type") == "FeatureCollection") & F.col("features").isNotNull()
    each = docs.where(ok).select("file", F.explode("features").alias("f")).select("file", "f.id", F.col("f.type").alias("type"), F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))
    fine = (F.col("type") == "Feature") & (F.col("geometry_type").isNotNull() if need_geometry else F.lit(True))
    bad = docs.where(~F.coalesce(ok, F.lit(False))).select("file", F.lit("document").alias("reason")).unionByName(each.where(~F.coalesce(fine, F.lit(False))).select("file", F.lit("feature").alias("reason")))
    return each.where(fine).drop("type", "file"), bad


def points(features: DataFrame) -> DataFrame:
    """Point features with lon and lat; properties stay JSON."""
    pair = F.from_json("coordinates", "array<double>")
    return features.where("geometry_type = 'Point'").select("id", F.get(pair, F.lit(0)).alias("lon"), F.get(pair, F.lit(1)).alias("lat"), "properties")


def polygons(features: DataFrame) -> DataFrame:
    """Polygon and multipolygon features with ``rings``."""
    one = F.from_json("coordinates", "array<array<array<double>>>")
    many = F.flatten(F.from_json("coordinates", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("geometry_type") == "Polygon", one).when(F.col("geometry_type") == "MultiPolygon", many)
    shaped = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))))
    return features.where(F.col("geometry_type").isin("Polygon", "MultiPolygon")).select("id", "properties", shaped.alias("rings"))


def _named(names: tuple[str, ...], columns: list[str]) -> Column | None:
    return next((F.col(f"`{c}`") for n in names for c in columns if c == n), None)


def layer_csv(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded table with coordinate columns by any of their names; all columns become properties."""
    df = lower_csv(spark, path)
    lat, lon = _named(("lat", "latitude"), df.columns), _named(("lon", "longitude", "lng"), df.columns)
    if lat is None or lon is None:
        raise ValueError("no coordinate columns")
    return df.select(number(lon).alias("lon"), number(lat).alias("lat"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("properties")).where("lat is not null and lon is not null")


def layer_kml(spark: SparkSession, path: str) -> DataFrame:
    """A point for each placemark, at its first coordinates."""
    df = spark.read.format("xml").option("rowTag", "Placemark").schema("name string, Point struct<coordinates string>, LineString struct<coordinates string>").load(path)
    first = F.split(F.split(F.trim(F.coalesce("Point.coordinates", "LineString.coordinates")), r"\s+")[0], ",")
    return df.select(number(F.get(first, F.lit(0))).alias("lon"), number(F.get(first, F.lit(1))).alias("lat"), F.to_json(F.struct("name")).alias("properties")).where("lat is not null and lon is not null")


def load_layer(spark: SparkSession, path: str) -> DataFrame:
    """By extension; anything but CSV and KML is GeoJSON."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return layer_csv(spark, path)
    return layer_kml(spark, path) if kind == "kml" else points(collection(spark, path)[0]).drop("id")


def series_trend(values: Column) -> Column:
    """By the last less the first value; fewer than two are stable."""
    change = F.element_at(values, -1) - F.element_at(values, 1)
    return F.when(F.size(values) < 2, "stable").when(change > 10, "critical").when(change > 5, "declining").when(change < -2, "rising").otherwise("stable")


def gauges(spark: SparkSession, path: str) -> DataFrame:
    """Sites with the last value of the first series, its trend and qualifiers; unreadable values are null."""
    each = spark.read.schema(NWIS).option("multiLine", True).json(path).select(F.explode("value.timeSeries").alias("s"))
    readings = F.transform(F.get("s.values", F.lit(0))["value"], lambda v: v["value"].try_cast("double"))
    real = F.filter(readings, lambda v: v.isNotNull() & ~F.isnan(v))
    last = F.try_element_at(readings, F.lit(-1))
    place = F.col("s.sourceInfo.geoLocation.geogLocation")
    return each.select(F.get("s.sourceInfo.siteCode", F.lit(0))["value"].alias("site_no"), F.col("s.sourceInfo.siteName").alias("site_name"), place["latitude"].alias("lat"), place["longitude"].alias("lon"), F.when(~F.isnan(last), last).alias("flow"), series_trend(real).alias("trend"), F.transform(F.get("s.values", F.lit(0))["qualifier"], lambda q: q["qualifierCode"]).alias("qualifiers"))


def drought(spark: SparkSession, path: str, week: str | None = None) -> DataFrame:
    """Drought polygons of files kept by ``week_date``; without a week the newest one."""
    docs = spark.read.schema("type string, features array<struct<type string, id string, geometry struct<type string, coordinates string>, properties string>>").option("lineSep", NO_LINE_END).json(path)
    parts = docs.select("week_date", F.posexplode("features").alias("ordinal", "f"))
    newest = parts.agg(F.max("week_date").alias("newest"))
    rows = parts.where(F.col("week_date") == F.lit(week).cast("date")) if week else parts.join(F.broadcast(newest), F.col("week_date") == F.col("newest")).drop("newest")
    shaped = polygons(rows.select(F.to_json(F.struct("week_date", "ordinal", F.get_json_object("f.properties", "$.DM").alias("dm"))).alias("id"), F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates")))
    head = F.from_json("id", "week_date date, ordinal int, dm string")
    return shaped.select(head["week_date"].alias("week_date"), head["ordinal"].alias("ordinal"), head["dm"].try_cast("int").alias("dm"), "rings")


def soil_survey(features: DataFrame) -> DataFrame:
    """Property names in either case, with defaults."""
    prop = lambda n, default=None: F.coalesce(F.get_json_object("properties", f"$.{n}"), F.get_json_object("properties", f"$.{n.upper()}"), F.lit(default))
    return features.select(prop("mukey", "").alias("mukey"), prop("muname", "Unknown").alias("muname"), prop("compname", "Unknown").alias("compname"), prop("drainagecl", "").alias("drainage"), (F.lower(prop("hydricrating", "")) == "yes").alias("hydric"), prop("nirrcapcl", "").alias("capability"))


def soil_grids(spark: SparkSession, path: str) -> DataFrame:
    """Per layer the mean of 0-5cm, else of the first depth, else 0, in customary units."""
    df = spark.read.schema(SOIL_GRIDS).option("multiLine", True).json(path)

    def value(layer: str, divisor: int) -> Column:
        depths = F.get(F.filter("properties.layers", lambda x: x["name"] == layer), F.lit(0))["depths"]
        top = F.get(F.filter(depths, lambda d: d["label"] == "0-5cm"), F.lit(0))
        return F.coalesce(top["values"]["mean"], F.get(depths, F.lit(0))["values"]["mean"], F.lit(0.0)) / divisor

    return df.select("lat", "lon", *(value(layer, d).alias(name) for layer, (name, d) in SOIL_FACTORS.items()))


def incident_pages(spark: SparkSession, path: str) -> DataFrame:
    """A folder of page files; active wildfires, each once."""
    docs = spark.read.schema("features array<struct<attributes struct<UniqueFireIdentifier string, IncidentName string, IncidentTypeCategory string, ActiveFireCandidate int, IncidentSize double>, geometry struct<x double, y double>>>").option("multiLine", True).json(path)
    each = docs.select(F.explode("features").alias("f")).select("f.attributes.*", F.col("f.geometry.x").alias("lon"), F.col("f.geometry.y").alias("lat"))
    return each.where("IncidentTypeCategory = 'WF' and ActiveFireCandidate = 1").dropDuplicates(["UniqueFireIdentifier"])


def weather_current(spark: SparkSession, path: str) -> DataFrame:
    """Current conditions; wind in km/h as the fire-weather model takes it."""
    df = spark.read.schema(WEATHER).option("multiLine", True).json(path)
    return df.select("lat", "lon", F.col("current.temperature_2m").alias("temp"), F.col("current.relative_humidity_2m").alias("rh"), (F.col("current.wind_speed_10m") * 3.6).alias("wind_kmh"), F.col("current.wind_direction_10m").alias("wind_deg"), F.col("current.precipitation").alias("rain"))


def weather_hourly(spark: SparkSession, path: str) -> DataFrame:
    """One row for each hour of the parallel arrays."""
    df = spark.read.schema(WEATHER).option("multiLine", True).json(path)
    zipped = F.arrays_zip(F.col("hourly.time").alias("time"), F.col("hourly.temperature_2m").alias("temp"), F.col("hourly.wind_speed_10m").alias("wind"))
    return df.select("lat", "lon", F.explode(zipped).alias("h")).select("lat", "lon", F.to_timestamp("h.time").alias("time"), "h.temp", "h.wind")


def burn_perimeters(features: DataFrame, year_from: int | None = None, year_to: int | None = None, box: tuple[float, float, float, float] | None = None, limit: int = 500) -> DataFrame:
    """Renamed and typed properties, by year; with a box those whose polygon meets it, at most ``limit`` by id as the feed itself caps them."""
    from terrafold.functions.models import burn_severity
    from terrafold.operators.shapes import in_bounds

    prop = lambda n: F.get_json_object("properties", f"$.{n}")
    rows = polygons(features).select(prop("Fire_ID").alias("fire_id"), F.coalesce(prop("Fire_Name"), F.lit("Unknown")).alias("name"), prop("Ig_Date").try_cast("date").alias("ignited"), F.coalesce(number(prop("BurnBndAc")), F.lit(0.0)).alias("acres"), burn_severity(number(prop("Severity"))).alias("severity"), "rings")
    year = F.year("ignited")
    kept = rows.where((year >= year_from if year_from else F.lit(True)) & (year <= year_to if year_to else F.lit(True))).withColumn("year", year)
    return in_bounds(kept, box).orderBy("fire_id").limit(limit) if box else kept


def watersheds(features: DataFrame, box: tuple[float, float, float, float], limit: int = 500) -> DataFrame:
    """Basin polygons that share a point with the box, at most ``limit`` by id as the feed itself caps them."""
    from terrafold.operators.shapes import in_bounds

    return in_bounds(polygons(features), box).orderBy("id").limit(limit)


IMAGES = "data array<struct<id string, geometry struct<coordinates array<double>>, thumb_1024_url string, thumb_2048_url string, compass_angle double, sequence_id string, sequence string>>"


def street_images(spark: SparkSession, path: str, *, box: tuple[float, float, float, float] | None = None, sequence: str | None = None, large: bool = False, limit: int | None = None) -> DataFrame:
    """Images in a box (100 at most) or of a sequence (200 at most), by id; ``large`` prefers the larger thumbnail.

    Missing thumbnails and sequences are empty text, a missing angle is 0; an image without coordinates is in no box.
    """
    raw = spark.read.schema(IMAGES).option("multiLine", True).json(path).select(F.explode("data").alias("i")).select("i.*")
    thumbs = ("thumb_2048_url", "thumb_1024_url") if large else ("thumb_1024_url", "thumb_2048_url")
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    point = F.col("geometry.coordinates")
    rows = raw.select(
        "id", F.get(point, F.lit(0)).alias("lon"), F.get(point, F.lit(1)).alias("lat"), F.coalesce(*map(filled, thumbs), F.lit("")).alias("thumb_url"),
        F.coalesce("compass_angle", F.lit(0.0)).alias("compass_angle"), F.coalesce("sequence_id", "sequence", F.lit("")).alias("sequence_id"),
    )
    if box is not None:
        rows = rows.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    if sequence is not None:
        rows = rows.where(F.col("sequence_id") == sequence)
    return rows.orderBy("id").limit(limit or (100 if sequence is None else 200))


def route_osm(objects: DataFrame) -> dict[str, DataFrame]:
    """Map objects (kind, id, is_closed, tags, coords) into five tables by their tags."""
    from terrafold.functions.models import osm_height

    tag = lambda k: F.try_element_at("tags", F.lit(k))
    has = lambda *ks: reduce(lambda a, b: a | b, [tag(k).isNotNull() for k in ks])
    own = F.map_filter("tags", lambda k, _: ~k.startswith("name") & (k != "source"))
    way, area = F.col("kind") == "way", ((F.col("kind") == "way") & F.col("is_closed")) | (F.col("kind") == "relation")
    named = ["id", tag("name").alias("name")]
    return {
        "pois": objects.where((F.col("kind") == "node") & has("amenity", "shop", "tourism")).select(*named, F.coalesce(tag("amenity"), tag("shop"), tag("tourism")).alias("class"), own.alias("tags"), "coords"),
        "buildings": objects.where((way | (F.col("kind") == "relation")) & has("building")).select(*named, osm_height(F.col("tags")).alias("height"), "coords"),
        "roads": objects.where(way & tag("highway").isin(*ROAD_CLASSES)).select(*named, tag("highway").alias("class"), F.regexp_extract(tag("maxspeed"), r"(\d+)", 1).try_cast("int").alias("maxspeed"), (F.coalesce(tag("oneway"), F.lit("no")) == "yes").alias("oneway"), "coords"),
        "waterways": objects.where(way & has("waterway")).select(*named, tag("waterway").alias("class"), "coords"),
        "landuse": objects.where(area & has("landuse", "leisure", "natural")).select(*named, F.coalesce(tag("landuse"), tag("leisure"), tag("natural")).alias("class"), "coords"),
    }


def with_fallback(real: DataFrame, demo: DataFrame) -> DataFrame:
    """The real rows, or the demo rows if there are none, with ``is_demo``."""
    none = real.agg((F.count("*") == 0).alias("_none"))
    return real.withColumn("is_demo", F.lit(False)).unionByName(demo.crossJoin(F.broadcast(none)).where("_none").drop("_none").withColumn("is_demo", F.lit(True)))


def write_csv(df: DataFrame, path: str) -> None:
    """K1: header, quotes doubled inside quotes, null as empty."""
    df.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def as_features(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """K2: a GeoJSON feature, as text, for each row; the other columns are its properties."""
    rest = [c for c in df.columns if c not in (lon, lat)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))
