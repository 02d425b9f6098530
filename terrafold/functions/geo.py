"""Geometry as Column functions (G1 to G20). Points are lon and lat in degrees; rings are arrays of (lon, lat) structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
EARTH_M = 6371000.0


def _half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    return F.pow(F.sin(dlat), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2.0)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """G1: great-circle kilometres, atan2 form."""
    a = _half_chord(lat1, lon1, lat2, lon2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres, asin form."""
    half = F.sqrt(_half_chord(lat1, lon1, lat2, lon2))
    return 2 * EARTH_M * F.asin(F.when(half > 1, F.lit(1.0)).otherwise(half))


def ring_area_m2(ring: Column) -> Column:
    """Area by the spherical-excess approximation; 0 for fewer than three points. The ring may be open."""
    n = F.size(ring)
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    parts = F.zip_with(ring, after, lambda p, q: F.radians(q["lon"] - p["lon"]) * (2 + F.sin(F.radians(p["lat"])) + F.sin(F.radians(q["lat"]))))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.when(n >= 3, F.abs(total * EARTH_M * EARTH_M / 2)).otherwise(F.lit(0.0))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))
    return F.pmod(F.degrees(angle) + 360, F.lit(360.0))


def line_length_m(points: Column) -> Column:
    """Sum of the segments' great-circle metres."""
    after = F.slice(points, F.lit(2), F.greatest(F.size(points), F.lit(1)))
    parts = F.zip_with(points, after, lambda p, q: F.coalesce(haversine_m(p["lon"], p["lat"], q["lon"], q["lat"]), F.lit(0.0)))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def _text(x: Column, digits: int, unit: str) -> Column:
    """A number with so many decimals, halves rounded upward, and its unit."""
    scale = 10.0**digits
    return F.format_string(f"%.{digits}f {unit}", F.floor(x * scale + 0.5) / scale)


def format_distance(m: Column, unit: str = "metric") -> Column:
    """Text of a distance; metres below a kilometre, feet below a mile."""
    if unit == "imperial":
        feet = m * 3.28084
        return F.when(feet < 5280, _text(feet, 0, "ft")).otherwise(_text(feet / 5280, 2, "mi"))
    return F.when(m < 1000, _text(m, 0, "m")).otherwise(_text(m / 1000, 2, "km"))


def format_area(m2: Column, unit: str = "metric") -> Column:
    """Text of an area; m² below a hectare, ft² below an acre."""
    if unit == "imperial":
        acres = m2 / 4046.86
        return F.when(acres >= 1, _text(acres, 2, "ac")).otherwise(_text(m2 * 10.7639, 0, "ft²"))
    return F.when(m2 >= 10000, _text(m2 / 10000, 2, "ha")).otherwise(_text(m2, 0, "m²"))


def in_rings(lat: Column, lon: Column, rings: Column) -> Column:
    """Even-odd rule over all rings (with one ring: the outer-ring test)."""

    def crossings(ring: Column) -> Column:
        n = F.size(ring)
        before = F.concat(F.slice(ring, n, F.lit(1)), F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))))
        edges = F.zip_with(ring, before, lambda p, q: F.coalesce(((p["lat"] > lat) != (q["lat"] > lat)) & (lon < F.try_divide((q["lon"] - p["lon"]) * (lat - p["lat"]), q["lat"] - p["lat"]) + p["lon"]), F.lit(False)).cast("int"))
        return F.when(n > 0, F.aggregate(edges, F.lit(0), lambda s, x: s + x)).otherwise(F.lit(0))

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda s, x: s + x) % 2 == 1


def tile_x(lon: Column, zoom: Column) -> Column:
    """Web-Mercator tile column."""
    n = F.pow(F.lit(2.0), zoom)
    return F.least(F.greatest(F.floor((lon + 180) / 360 * n), F.lit(0)), (n - 1).cast("long"))


def tile_y(lat: Column, zoom: Column) -> Column:
    """Web-Mercator tile row; latitudes beyond the projection fall into the border rows."""
    n = F.pow(F.lit(2.0), zoom)
    phi = F.radians(F.least(F.greatest(lat, F.lit(-85.0511287798)), F.lit(85.0511287798)))
    return F.least(F.greatest(F.floor((1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / F.lit(3.141592653589793)) / 2 * n), F.lit(0)), (n - 1).cast("long"))


def tile_bounds(x: Column, y: Column, zoom: Column) -> Column:
    """West, south, east and north of a tile."""
    n = F.pow(F.lit(2.0), zoom)
    lat = lambda row: F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1 - 2 * row / n))))
    return F.struct((x / n * 360 - 180).alias("west"), lat(y + 1).alias("south"), ((x + 1) / n * 360 - 180).alias("east"), lat(y).alias("north"))


def rings_bbox(rings: Column) -> Column:
    """Bounds of all rings."""
    lons, lats = F.transform(F.flatten(rings), lambda p: p["lon"]), F.transform(F.flatten(rings), lambda p: p["lat"])
    return F.struct(F.array_min(lons).alias("west"), F.array_min(lats).alias("south"), F.array_max(lons).alias("east"), F.array_max(lats).alias("north"))


def ring_centroid(ring: Column) -> Column:
    """Mean of the vertices."""
    mean = lambda axis: F.try_divide(F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[axis]), F.size(ring))
    return F.struct(mean("lon").alias("lon"), mean("lat").alias("lat"))


def box_of_radius(lat: Column, lon: Column, km: Column) -> Column:
    """Box around a point, in kilometres."""
    dlat, dlon = km / 111.0, km / (111.0 * F.cos(F.radians(lat)))
    return F.struct((lon - dlon).alias("west"), (lat - dlat).alias("south"), (lon + dlon).alias("east"), (lat + dlat).alias("north"))


def box_of_degrees(lat: Column, lon: Column, degrees: float) -> Column:
    """Box around a point, in degrees."""
    return F.struct((lon - degrees).alias("west"), (lat - degrees).alias("south"), (lon + degrees).alias("east"), (lat + degrees).alias("north"))


def box_centre(box: Column) -> Column:
    """Middle of a box."""
    return F.struct(((box["west"] + box["east"]) / 2).alias("lon"), ((box["south"] + box["north"]) / 2).alias("lat"))


def grid_key(lat: Column, lon: Column, decimals: int = 2) -> Column:
    """Text key of a grid cell, halves rounded upward."""
    number, scale = f"%.{decimals}f", 10.0**decimals
    return F.format_string(f"{number}_{number}", F.floor(lat * scale + 0.5) / scale, F.floor(lon * scale + 0.5) / scale)


def circle_ring(lat: Column, lon: Column, degrees: Column, vertices: int = 64) -> Column:
    """Closed ring of a circle in degrees."""
    turn = lambda i: i * F.lit(2 * 3.141592653589793 / vertices)
    return F.transform(F.sequence(F.lit(0), F.lit(vertices)), lambda i: F.struct((lon + degrees * F.cos(turn(i))).alias("lon"), (lat + degrees * F.sin(turn(i))).alias("lat")))


def box_ring(box: Column) -> Column:
    """Closed ring of a box."""
    corner = lambda x, y: F.struct(box[x].alias("lon"), box[y].alias("lat"))
    return F.array(corner("west", "south"), corner("east", "south"), corner("east", "north"), corner("west", "north"), corner("west", "south"))


def closed(ring: Column) -> Column:
    """The ring with its first vertex again at the end, if it isn't there."""
    open_ = (F.size(ring) > 0) & (F.get(ring, F.lit(0)) != F.get(ring, F.size(ring) - 1))
    return F.when(open_, F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


#: G19, fixed values: eight sectors, the first one for wind from the south.
SECTORS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def wind_sector(degrees: Column) -> Column:
    """The sector that wind from ``degrees`` blows to."""
    to = F.pmod(F.floor(F.pmod(degrees + 180, F.lit(360.0)) / 45 + 0.5), F.lit(8)).cast("int")
    return F.element_at(F.array(*map(F.lit, SECTORS)), to + 1)


def edge_midpoints(ring: Column) -> Column:
    """Middles of neighbouring vertices."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda p, q: F.struct(((p["lon"] + q["lon"]) / 2).alias("lon"), ((p["lat"] + q["lat"]) / 2).alias("lat")))
