"""Lines and polygons against tiles and boxes (J6, S12, S17), by quadtree cells of several levels.

A shape is kept at the level whose cells are about as large as its bounds, so it has a handful of cells, be it a house
or a continent. A tile looks for shapes in its own cell and the cells above it; shapes of finer levels also stand in the
cells above theirs. So both sides have at most a few rows for each level, never one for each small tile of a large shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.functions.clip import line_meets_box, polygon_meets_box

#: The finest level of cells; smaller shapes stand in its cells.
FINEST = 20
#: Degrees by which bounds reach out, so that a shape stands in all cells whose border it touches.
TOUCH = 1e-9


def level_of(box: Column) -> Column:
    """The finest level at which bounds touch two cells along each axis, or three where they lie on a border."""
    unit = lambda lat: geo.tile_y(lat, F.lit(30)) / float(1 << 30)
    size = F.greatest((box["east"] - box["west"]) / 360, unit(box["south"]) - unit(box["north"]), F.lit(2.0**-FINEST))
    return F.least(F.greatest(F.floor(-F.log2(size)), F.lit(0)), F.lit(FINEST)).cast("int")


def own_cells(box: Column, level: Column) -> Column:
    """Array of (level, x, y) of the cells that bounds touch at ``level``."""
    xs = F.sequence(geo.tile_x(box["west"] - TOUCH, level), geo.tile_x(box["east"] + TOUCH, level))
    ys = F.sequence(geo.tile_y(box["north"] + TOUCH, level), geo.tile_y(box["south"] - TOUCH, level))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(level.alias("level"), x.alias("x"), y.alias("y")))))


def above(cell: Column) -> Column:
    """Array of a cell's ancestors, without itself."""
    up = lambda k: F.struct((cell["level"] - k).alias("level"), F.floor(cell["x"] / F.pow(F.lit(2.0), k)).cast("long").alias("x"), F.floor(cell["y"] / F.pow(F.lit(2.0), k)).cast("long").alias("y"))
    return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(cell["level"], F.lit(0))), F.lit(2), F.greatest(cell["level"], F.lit(0))), up)


def shape_cells(shapes: DataFrame, key: str, paths: str = "paths") -> DataFrame:
    """``key``, ``box`` and the cells of every shape: its own ones (``own``) and those above them, each once."""
    boxed = shapes.where(F.size(F.flatten(paths)) > 0).select(key, geo.rings_bbox(F.col(paths)).alias("box")).where("box.west is not null and box.south is not null")
    cells = boxed.withColumn("mine", own_cells(F.col("box"), level_of(F.col("box"))))
    higher = F.array_distinct(F.flatten(F.transform("mine", above)))
    flagged = F.concat(F.transform("mine", lambda c: F.struct(c["level"].alias("level"), c["x"].alias("x"), c["y"].alias("y"), F.lit(True).alias("own"))), F.transform(higher, lambda c: F.struct(c["level"].alias("level"), c["x"].alias("x"), c["y"].alias("y"), F.lit(False).alias("own"))))
    return cells.select(key, "box", F.inline(flagged))


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["west"] <= b["east"]) & (a["east"] >= b["west"]) & (a["south"] <= b["north"]) & (a["north"] >= b["south"])


def box_holds(a: Column, b: Column) -> Column:
    return (a["west"] <= b["west"]) & (a["east"] >= b["east"]) & (a["south"] <= b["south"]) & (a["north"] >= b["north"])


def tile_candidates(shapes: DataFrame, tiles: DataFrame, key: str, paths: str = "paths") -> DataFrame:
    """``z, x, y``, ``bounds``, ``key`` and ``held`` (the tile holds its bounds) of shapes whose bounds meet a tile's; each pair once. ``tiles`` has distinct ``z, x, y``."""
    own = F.struct(F.col("z").cast("int").alias("level"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    asked = tiles.select("z", "x", "y", geo.tile_bounds(F.col("x"), F.col("y"), F.col("z")).alias("bounds"), own.alias("cell"))
    asked = asked.select("z", F.col("x").alias("tx"), F.col("y").alias("ty"), "bounds", F.explode(F.concat(F.array("cell"), above(F.col("cell")))).alias("c")).select("z", "tx", "ty", "bounds", "c.*")
    met = shape_cells(shapes, key, paths).join(asked, ["level", "x", "y"]).where(F.col("own") | (F.col("level") == F.col("z")))
    return met.where(boxes_meet(F.col("box"), F.col("bounds"))).select("z", F.col("tx").alias("x"), F.col("ty").alias("y"), "bounds", box_holds(F.col("bounds"), F.col("box")).alias("held"), key)


def shapes_in_tiles(shapes: DataFrame, tiles: DataFrame, key: str, *, paths: str = "paths", areas: Column | None = None) -> DataFrame:
    """The shapes of each tile, by exact geometry. ``paths`` are lines, or rings where ``areas`` holds; all columns stay, and ``bounds`` of the tile and ``held``.

    Only keys and bounds travel with the cells; the geometry comes back by ``key`` (unique) for pairs whose bounds meet. A shape whose bounds the tile holds needs no test.
    """
    pairs = tile_candidates(shapes, tiles, key, paths)
    line = F.exists(F.col(paths), lambda p: line_meets_box(p, F.col("bounds")))
    test = line if areas is None else F.when(areas, polygon_meets_box(F.col(paths), F.col("bounds"))).otherwise(line)
    full = F.forall(F.flatten(paths), lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    return pairs.join(shapes, key).withColumn("held", F.col("held") & full).where(F.when(F.col("held"), True).otherwise(test))


def in_bounds(shapes: DataFrame, box: tuple[float, float, float, float], rings: str = "rings") -> DataFrame:
    """Polygons that share a point with one box (west, south, east, north)."""
    asked = F.struct(*(F.lit(float(v)).alias(n) for v, n in zip(box, ("west", "south", "east", "north"), strict=True)))
    return shapes.where(boxes_meet(geo.rings_bbox(F.col(rings)), asked)).where(polygon_meets_box(F.col(rings), asked))
