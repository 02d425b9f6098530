"""Readers of landed files, and sinks, on small files."""

import gzip
import json

from pyspark.sql import functions as F

from terrafold.sources import landed


def put(path, text):
    path.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(path)


def feature(kind, coordinates, **properties):
    return {"type": "Feature", "id": properties.get("id"), "geometry": {"type": kind, "coordinates": coordinates} if kind else None, "properties": properties}


def test_fires_csv(spark, tmp_path):
    path = put(tmp_path / "f.csv", "Latitude,LONGITUDE,brightness,acq_date\n34.5,-120.1,300,2024-01-30\nx,-120,1,2024-01-30\n35,-121\n36,-122,bad,2024-01-01\n")
    rows = landed.fires_csv(spark, path).orderBy("lat").collect()
    assert [(r["lat"], r["brightness"], r["confidence"], r["frp"], r["satellite"]) for r in rows] == [(34.5, 300, "nominal", 0, "VIIRS"), (35, 0, "nominal", 0, "VIIRS"), (36, 0, "nominal", 0, "VIIRS")]
    assert landed.fires_in(landed.fires_csv(spark, path), days=50).count() == 1


def test_collection(spark, tmp_path):
    put(tmp_path / "a.json", {"type": "FeatureCollection", "features": [feature("Point", [1, 2], id="p"), feature("Polygon", [[[0, 0], [1, 0], [1, 1]]], id="q"), feature("MultiPolygon", [[[[0, 0], [1, 0], [1, 1]]], [[[5, 5], [6, 5], [6, 6]]]], id="m"), feature(None, None, id="n")]})
    put(tmp_path / "b.json", {"type": "Other"})
    put(tmp_path / "c.json", "{ not json")
    good, bad = landed.collection(spark, str(tmp_path))
    assert sorted(r["id"] for r in good.collect()) == ["m", "p", "q"]
    assert sorted(r["reason"] for r in bad.collect()) == ["document", "document", "feature"]
    assert [(r["lon"], r["lat"]) for r in landed.points(good).collect()] == [(1, 2)]
    assert {r["id"]: len(r["rings"]) for r in landed.polygons(good).collect()} == {"q": 1, "m": 2}
    assert landed.collection(spark, str(tmp_path), need_geometry=False)[0].count() == 4


def test_collection_keeps_text_as_written(spark, tmp_path):
    """Values that stay text come from the file's bytes, also of a packed file and one over many lines."""
    text = '{"type": "FeatureCollection",\n "features": [\n  {"type": "Feature", "geometry": {"type": "Point",\n   "coordinates": [1.50, 2]}, "properties": {"a": 1.10}}\n ]\n}\n'
    put(tmp_path / "a.json", text)
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(text.encode()))
    rows = landed.collection(spark, str(tmp_path))[0].collect()
    assert [(r["coordinates"], r["properties"]) for r in rows] == [("[1.50, 2]", '{"a": 1.10}')] * 2


def test_layers(spark, tmp_path):
    csv = put(tmp_path / "l.csv", "name,Lat,lng\na,1.5,2.5\nb,,3\n")
    kml = put(tmp_path / "l.kml", "<kml><Document><Placemark><name>n</name><Point><coordinates> 7,8,0 </coordinates></Point></Placemark><Placemark><name>e</name></Placemark></Document></kml>")
    geo = put(tmp_path / "l.geojson", {"type": "FeatureCollection", "features": [feature("Point", [3, 4])]})
    for path, at in ((csv, (2.5, 1.5)), (kml, (7, 8)), (geo, (3, 4))):
        assert [(r["lon"], r["lat"]) for r in landed.load_layer(spark, path).collect()] == [at]


def test_gauges(spark, tmp_path):
    def series(site, values, code):
        return {"sourceInfo": {"siteName": "n", "siteCode": [{"value": site}], "geoLocation": {"geogLocation": {"latitude": 1.0, "longitude": 2.0}}}, "values": [{"value": [{"value": v, "dateTime": ""} for v in values], "qualifier": [{"qualifierCode": code}]}]}

    path = put(tmp_path / "g.json", {"value": {"timeSeries": [series("1", ["1", "12.5"], "P"), series("2", ["3", "bad"], "e"), series("3", [], "P"), series("4", ["9", "6"], "E"), series("5", ["1", "7", "NaN"], "P")]}})
    got = {r["site_no"]: (r["flow"], r["trend"]) for r in landed.gauges(spark, path).collect()}
    assert got == {"1": (12.5, "critical"), "2": (None, "stable"), "3": (None, "stable"), "4": (6.0, "rising"), "5": (None, "declining")}


def test_soil_and_weather(spark, tmp_path):
    soil = put(tmp_path / "s.json", {"lat": 1, "lon": 2, "properties": {"layers": [{"name": "phh2o", "depths": [{"label": "5-15cm", "values": {"mean": 50}}, {"label": "0-5cm", "values": {"mean": 60}}]}, {"name": "soc", "depths": [{"label": "5-15cm", "values": {"mean": 70}}]}]}})
    r = landed.soil_grids(spark, soil).first()
    assert (r["ph"], r["organic_carbon"], r["nitrogen"]) == (6, 7, 0)
    weather = put(tmp_path / "w.json", {"lat": 1, "lon": 2, "current": {"temperature_2m": 20, "relative_humidity_2m": 30, "wind_speed_10m": 10, "precipitation": 0}, "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1, 2], "wind_speed_10m": [3, 4]}})
    assert landed.weather_current(spark, weather).first()["wind_kmh"] == 36
    assert [r["temp"] for r in landed.weather_hourly(spark, weather).orderBy("time").collect()] == [1, 2]


def test_drought_survey_perimeters(spark, tmp_path):
    for week, dm in (("2024-01-02", 1), ("2024-01-09", 3)):
        (tmp_path / f"d/week_date={week}").mkdir(parents=True)
        put(tmp_path / f"d/week_date={week}/a.json", {"type": "FeatureCollection", "features": [feature("Polygon", [[[0, 0], [1, 0], [1, 1]]], DM=dm)]})
    assert [r["dm"] for r in landed.drought(spark, str(tmp_path / "d")).collect()] == [3]
    assert [r["dm"] for r in landed.drought(spark, str(tmp_path / "d"), "2024-01-02").collect()] == [1]
    path = put(tmp_path / "x.json", {"type": "FeatureCollection", "features": [feature("Polygon", [[[0, 0], [1, 0], [1, 1]]], MUKEY="7", hydricrating="Yes", Fire_ID="f", Ig_Date="2015-05-01", Severity=4)]})
    good, _ = landed.collection(spark, path)
    s = landed.soil_survey(good).first()
    assert (s["mukey"], s["muname"], s["hydric"]) == ("7", "Unknown", True)
    assert landed.burn_perimeters(good, 2010, 2020).first()["severity"] == "high" and landed.burn_perimeters(good, 2016).count() == 0


def test_incidents_are_read_once(spark, tmp_path):
    (tmp_path / "p").mkdir()
    one = lambda i, c="WF", a=1: {"attributes": {"UniqueFireIdentifier": i, "IncidentTypeCategory": c, "ActiveFireCandidate": a}, "geometry": {"x": 1.0, "y": 2.0}}
    put(tmp_path / "p/1.json", {"features": [one("a"), one("b"), one("c", "RX")]})
    put(tmp_path / "p/2.json", {"features": [one("b"), one("d", a=0)]})
    assert sorted(r["UniqueFireIdentifier"] for r in landed.incident_pages(spark, str(tmp_path / "p")).collect()) == ["a", "b"]


def test_osm_routing(spark):
    rows = [("node", 1, False, {"amenity": "cafe", "name:en": "x", "source": "s", "k": "v"}), ("way", 2, True, {"building": "yes", "height": "12.5 m"}), ("way", 3, False, {"highway": "primary", "maxspeed": "50 mph", "oneway": "yes"}), ("way", 4, False, {"highway": "proposed"}), ("way", 5, False, {"waterway": "river"}), ("way", 6, True, {"natural": "wood"}), ("way", 7, False, {"natural": "coastline"}), ("relation", 8, False, {"landuse": "forest"})]
    df = spark.createDataFrame([(*r, None) for r in rows], "kind string, id long, is_closed boolean, tags map<string,string>, coords array<struct<lon:double,lat:double>>")
    out = landed.route_osm(df)
    assert {k: sorted(r["id"] for r in v.collect()) for k, v in out.items()} == {"pois": [1], "buildings": [2], "roads": [3], "waterways": [5], "landuse": [6, 8]}
    assert out["pois"].first()["tags"] == {"amenity": "cafe", "k": "v"} and out["buildings"].first()["height"] == 12.5
    road = out["roads"].first()
    assert road["maxspeed"] == 50 and road["oneway"]


def test_fallback_and_sinks(spark, tmp_path):
    real, demo = spark.range(2), spark.range(5)
    assert landed.with_fallback(real, demo).where("is_demo").count() == 0
    assert landed.with_fallback(real.limit(0), demo).where("is_demo").count() == 5
    rows = spark.createDataFrame([('say "hi", all', None, 1.0, 2.0)], "a string, b string, lon double, lat double")
    landed.write_csv(rows.coalesce(1), f"{tmp_path}/out")
    assert next(tmp_path.glob("out/part*")).read_text() == 'a,b,lon,lat\n"say ""hi"", all",,1.0,2.0\n'
    assert json.loads(landed.as_features(rows).first()["value"])["geometry"]["coordinates"] == [1.0, 2.0]
    assert spark.range(1).select(landed.series_trend(F.array(F.lit(1.0), F.lit(12.0))).alias("t")).first()["t"] == "critical"


def test_watersheds_and_street_images(spark, tmp_path):
    square = lambda x: [[[x, 0], [x + 1, 0], [x + 1, 1], [x, 0]]]
    path = put(tmp_path / "w.json", {"type": "FeatureCollection", "features": [feature("Polygon", square(x)) | {"id": str(x)} for x in (0, 2, 4, 6)] + [feature("Point", [0, 0]) | {"id": "p"}]})
    good, _ = landed.collection(spark, path)
    assert [r["id"] for r in landed.watersheds(good, (1, 0.5, 4.5, 2)).collect()] == ["0", "2", "4"]
    assert [r["id"] for r in landed.watersheds(good, (-9, -9, 9, 9), limit=2).collect()] == ["0", "2"]
    assert landed.watersheds(good.limit(0), (-9, -9, 9, 9)).count() == 0
    image = lambda i, x, **more: {"id": i, "geometry": {"coordinates": [x, 1.0]}} | more
    path = put(tmp_path / "i.json", {"data": [image("a", 1.0, thumb_1024_url="s", thumb_2048_url="l", sequence="q"), image("b", 5.0, sequence_id="q", sequence="r", compass_angle=9.0), {"id": "c", "thumb_2048_url": "l", "thumb_1024_url": ""}]})
    got = landed.street_images(spark, path).collect()
    assert [(r["id"], r["thumb_url"], r["compass_angle"], r["sequence_id"]) for r in got] == [("a", "s", 0, "q"), ("b", "", 9, "q"), ("c", "l", 0, "")]
    assert [r["id"] for r in landed.street_images(spark, path, box=(0, 0, 2, 2)).collect()] == ["a"]
    assert [r["thumb_url"] for r in landed.street_images(spark, path, sequence="q", large=True).collect()] == ["l", ""]
