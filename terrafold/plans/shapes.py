"""Registered queries on lines and polygons: tiles (J6), cut lengths, basins (S17) and perimeters (S12) of a box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.clip import clip_line, planar_length, point
from terrafold.functions.models import half_up
from terrafold.operators.shapes import shapes_in_tiles
from terrafold.plans.places import up
from terrafold.plans.views import query
from terrafold.sources.landed import burn_perimeters, watersheds

BOX = (-117.3, 35.2, -111.7, 40.9)


def corners(*order: int) -> Column:
    return F.array(*(point(F.col(f"x{k}"), F.col(f"y{k}")) for k in order))


def shapes_of(basins: DataFrame, trails: DataFrame) -> DataFrame:
    """Triangles and lines of three points in one table."""
    area = basins.select(F.concat(F.lit("b"), "id").alias("shape"), F.lit(True).alias("is_area"), F.array(corners(1, 2, 3, 1)).alias("paths"))
    return area.unionByName(trails.select(F.concat(F.lit("t"), "id").alias("shape"), F.lit(False).alias("is_area"), F.array(corners(1, 2, 3)).alias("paths")))


#: DuckDB: bounds of the asked tiles.
TILES_SQL = """tiles as (
  select z, x, y, x / pow(2.0, z) * 360 - 180 as w, (x + 1) / pow(2.0, z) * 360 - 180 as e, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2.0, z))))) as s, degrees(atan(sinh(pi() * (1 - 2 * y / pow(2.0, z))))) as n
  from (select distinct z, x, y from asked_tiles))"""


def side(x: str, y: str) -> str:
    return f"((bx - ax) * ({y} - ay) - (b_y - ay) * ({x} - ax))"


SIDES = ", ".join(side(x, y) for x in ("w", "e") for y in ("s", "n"))
#: DuckDB: a segment (ax, ay) to (bx, b_y) has a point in the box; and the even-odd count of a box's corner.
MEETS = f"least(ax, bx) <= e and greatest(ax, bx) >= w and least(ay, b_y) <= n and greatest(ay, b_y) >= s and least({SIDES}) <= 0 and greatest({SIDES}) >= 0"
CROSSES = "((ay > s) <> (b_y > s)) and w < (bx - ax) * (s - ay) / (b_y - ay) + ax"
EDGES_SQL = """edges as (
  select 'b' || id as shape, unnest([x1, x2, x3]) as ax, unnest([y1, y2, y3]) as ay, unnest([x2, x3, x1]) as bx, unnest([y2, y3, y1]) as b_y from basins
  union all select 't' || id, unnest([x1, x2]), unnest([y1, y2]), unnest([x2, x3]), unnest([y2, y3]) from trails)"""


@query("j6_shapes_in_tiles", "basins", "trails", "asked_tiles", sql=f"""
with {TILES_SQL}, {EDGES_SQL},
near as (
  select t.z, t.x, t.y, shape, bool_or({MEETS}) as border, count(*) filter ({CROSSES}) % 2 = 1 as inside
  from tiles t, edges group by 1, 2, 3, 4)
select z, x, y, count(*) as n, min(shape) as first_shape, count(*) filter (not border) as around from near where border or (inside and shape like 'b%') group by 1, 2, 3""")  # fmt: skip
def tiles_of_shapes(basins: DataFrame, trails: DataFrame, asked: DataFrame) -> DataFrame:
    """Shapes of each asked tile; ``around`` counts polygons that hold the whole tile."""
    from terrafold.functions.clip import line_meets_box

    met = shapes_in_tiles(shapes_of(basins, trails), asked.distinct(), "shape", areas=F.col("is_area"))
    border = F.when(F.col("held") | ~F.col("is_area"), True).otherwise(F.exists("paths", lambda p: line_meets_box(p, F.col("bounds"))))
    return met.groupBy("z", "x", "y").agg(F.count("*").alias("n"), F.min("shape").alias("first_shape"), F.count_if(~border).alias("around"))


def wall(speed: str, room: str) -> tuple[str, str, str]:
    return f"case when {speed} < 0 then {room} / {speed} end", f"case when {speed} > 0 then {room} / {speed} end", f"({speed} = 0 and {room} < 0)"


WALLS = [wall("-(bx - ax)", "(ax - w)"), wall("(bx - ax)", "(e - ax)"), wall("-(b_y - ay)", "(ay - s)"), wall("(b_y - ay)", "(n - ay)")]


@query("j6_trail_length_in_tiles", "basins", "trails", "asked_tiles", sql=f"""
with {TILES_SQL}, {EDGES_SQL},
cut as (
  select z, x, y, sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) as len, greatest(0.0::double, {", ".join(x[0] for x in WALLS)}) as t0, least(1.0::double, {", ".join(x[1] for x in WALLS)}) as t1, {" or ".join(x[2] for x in WALLS)} as outside
  from tiles, edges where shape like 't%' and least(ax, bx) <= e and greatest(ax, bx) >= w and least(ay, b_y) <= n and greatest(ay, b_y) >= s)
select z, x, y, {up("sum(((t1 - t0) * len)::decimal(18,9))::double", 5)} as degrees from cut where not outside and t0 <= t1 group by 1, 2, 3 having sum(((t1 - t0) * len)::decimal(18,9)) > 0.0001""")  # fmt: skip
def trail_length(basins: DataFrame, trails: DataFrame, asked: DataFrame) -> DataFrame:
    """Length of the lines inside each asked tile, in degrees; lengths of a ten-thousandth and less are left out."""
    lines = shapes_of(basins, trails).where("not is_area")
    met = shapes_in_tiles(lines, asked.distinct(), "shape")
    inside = F.aggregate(F.flatten(F.transform("paths", lambda p: clip_line(p, F.col("bounds")))), F.lit(0.0), lambda s, part: s + planar_length(part))
    whole = F.aggregate("paths", F.lit(0.0), lambda s, p: s + planar_length(p))
    total = F.sum(F.when(F.col("held"), whole).otherwise(inside).cast("decimal(18,9)"))
    return met.groupBy("z", "x", "y").agg(total.alias("total")).where("total > 0.0001").select("z", "x", "y", half_up(F.col("total").cast("double"), 5).alias("degrees"))


def features_of(basins: DataFrame) -> DataFrame:
    """Basins as features of a collection: geometry and properties are JSON text."""
    pair = lambda k: F.array(f"x{k}", f"y{k}")
    named = F.struct(F.col("id").cast("string").alias("Fire_ID"), F.concat("burned", F.lit("-07-01")).alias("Ig_Date"), (F.col("id") * 10).alias("BurnBndAc"), (F.col("id") % 5 + 1).alias("Severity"))
    return basins.select(F.lpad(F.col("id").cast("string"), 12, "0").alias("id"), F.lit("Polygon").alias("geometry_type"), F.to_json(F.array(F.array(*map(pair, (1, 2, 3, 1))))).alias("coordinates"), F.to_json(named).alias("properties"))


BOX_SQL = f"""
edges as (select id, burned, unnest([x1, x2, x3]) as ax, unnest([y1, y2, y3]) as ay, unnest([x2, x3, x1]) as bx, unnest([y2, y3, y1]) as b_y from basins),
met as (select id, any_value(burned) as burned from edges, (select {BOX[0]}::double as w, {BOX[1]}::double as s, {BOX[2]}::double as e, {BOX[3]}::double as n) group by id having bool_or({MEETS}) or count(*) filter ({CROSSES}) % 2 = 1)"""


@query("s17_basins_in_box", "basins", sql=f"with {BOX_SQL} select lpad(id::varchar, 12, '0') as id from met order by 1 limit 500")
def basins_in_box(basins: DataFrame) -> DataFrame:
    """Basins that share a point with the box, by their border; 500 at most, as the feed gives."""
    return watersheds(features_of(basins), BOX).select("id")


@query("s12_perimeters_in_box", "basins", sql=f"with {BOX_SQL} select id::varchar as fire_id, burned::int as year, (id * 10)::double as acres from met where burned between 1990 and 2015 order by fire_id limit 500")
def perimeters_in_box(basins: DataFrame) -> DataFrame:
    """Perimeters of a span of years that share a point with the box; 500 at most, as the feed gives."""
    return burn_perimeters(features_of(basins), 1990, 2015, BOX).select("fire_id", F.col("year").cast("int").alias("year"), "acres")
