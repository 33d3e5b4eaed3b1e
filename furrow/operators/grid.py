"""The tile grid of a mosaic: facts, tiles, which pixel lies where, and world coordinates.

Tile (c, r) covers the pixels [(c-1)*p, c*p) by [(r-1)*p, r*p) of the mosaic; column 0 and row 0 are empty padding.
Project tables have one row a project and are small beside pixels; they are joined by project key and Spark
broadcasts them when their measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import names
from furrow.params import DEFAULTS


def grid_facts(projects: DataFrame, tile_m: float = DEFAULTS.tile_m) -> DataFrame:
    """prj, cm_per_px, area_cm2, area_m2, area_ha, pixel_tile, n_cols, n_rows, n_tiles and the extent and pixel size of each project."""
    w, h = F.get("image_dimensions", F.lit(0)), F.get("image_dimensions", F.lit(1))
    psx = F.get("pixel_size", F.lit(0))
    cm = psx * 100
    pixel_tile = tile_m * 100 / cm
    return projects.select(
        "prj",
        cm.alias("cm_per_px"),
        (w * cm * h * cm).alias("area_cm2"),
        (w * cm * h * cm / 1e4).alias("area_m2"),
        (w * cm * h * cm / 1e8).alias("area_ha"),
        pixel_tile.alias("pixel_tile"),
        (F.floor(w / pixel_tile) + 2).cast("int").alias("n_cols"),
        (F.floor(h / pixel_tile) + 2).cast("int").alias("n_rows"),
        ((F.floor(w / pixel_tile) + 2) * (F.floor(h / pixel_tile) + 2)).cast("int").alias("n_tiles"),
        psx.alias("psx"),
        F.get("pixel_size", F.lit(1)).alias("psy"),
        F.get("image_extents", F.lit(0)).alias("xmin"),
        F.get("image_extents", F.lit(3)).alias("ymax"),
    )


def tile_grid(facts: DataFrame) -> DataFrame:
    """A row for each col in [0, n_cols) and row in [0, n_rows)."""
    cols = facts.select("*", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col"))
    return cols.select("*", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row")).withColumn("colrow", names.colrow(F.col("col"), F.col("row")))


def assign_tile(pixels: DataFrame, facts: DataFrame) -> DataFrame:
    """Pixels with col, row and the place px, py in the tile."""
    col, row = (F.floor(F.col(a) / F.col("pixel_tile")).cast("int") + 1 for a in ("x", "y"))
    placed = pixels.join(facts.select("prj", "pixel_tile"), "prj").withColumn("col", col).withColumn("row", row)
    start = lambda k: F.ceil((F.col(k) - 1) * F.col("pixel_tile")).cast("int")
    return placed.withColumn("px", F.col("x") - start("col")).withColumn("py", F.col("y") - start("row")).drop("pixel_tile")


def tile_georef(grid: DataFrame, tile_m: float = DEFAULTS.tile_m) -> DataFrame:
    """Tiles with their top-left corner x0, y0 and a closed ring of five points."""
    placed = grid.withColumn("x0", F.col("xmin") + (F.col("col") - 1) * tile_m).withColumn("y0", F.col("ymax") - (F.col("row") - 1) * tile_m)
    x, y = F.col("x0"), F.col("y0")
    corners = [(x, y), (x + tile_m, y), (x + tile_m, y - tile_m), (x, y - tile_m), (x, y)]
    return placed.withColumn("ring", F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in corners]))


def pixel_to_world(px: Column, py: Column, tile_m: float = DEFAULTS.tile_m) -> tuple[Column, Column]:
    """World coordinates of a pixel of a tile; needs psx, psy, xmin, ymax, col, row."""
    x = px * F.col("psx") + F.col("xmin") + tile_m * (F.col("col") - 1)
    return x, py * F.col("psy") + F.col("ymax") - tile_m * (F.col("row") - 1)


def raster_facts(rasters: DataFrame) -> DataFrame:
    """Image origin (whole numbers) and pixel size (y negative) from extent and dimensions: xmin, ymin, xmax, ymax, w, h."""
    return rasters.select(
        "prj",
        F.array(F.round("xmin").cast("int"), F.round("ymin").cast("int")).alias("image_origin"),
        F.array((F.col("xmax") - F.col("xmin")) / F.col("w"), -(F.col("ymax") - F.col("ymin")) / F.col("h")).alias("pixel_size"),
    )


def world_files(tiles: DataFrame) -> DataFrame:
    """prj, col, row, body: the six lines of each tile's world file (steps, turns, then the first pixel's place)."""
    number = lambda c: F.format_string("%.6f", c)
    zero = F.lit(0.0)
    return tiles.select("prj", "col", "row", F.concat_ws("\n", *[number(c) for c in (F.col("psx"), zero, zero, F.col("psy"), F.col("x0"), F.col("y0"))]).alias("body"))


def pending_tiles(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Tiles of the grid that are not done yet."""
    return grid.join(done.select("prj", "col", "row").distinct(), ["prj", "col", "row"], "left_anti")


def tiles_with_contours(grid: DataFrame, contours: DataFrame) -> DataFrame:
    """Tiles for which there is a contour."""
    return grid.join(contours.select("prj", "col", "row").distinct(), ["prj", "col", "row"], "left_semi")


def locate_in_tiles(points: DataFrame, facts: DataFrame, tile_m: float = DEFAULTS.tile_m) -> DataFrame:
    """Points (prj, x, y in metres) with the col and row of the tile they lie in, by arithmetic instead of a range join."""
    met = points.join(facts.select("prj", "xmin", "ymax"), "prj")
    return (
        met.withColumn("col", F.floor((F.col("x") - F.col("xmin")) / tile_m).cast("int") + 1)
        .withColumn("row", F.floor((F.col("ymax") - F.col("y")) / tile_m).cast("int") + 1)
        .drop("xmin", "ymax")
    )


def bounds(tiles: DataFrame, *keys: str) -> DataFrame:
    """The extent of all rings of a key."""
    points = tiles.select(*keys, F.explode("ring").alias("p"))
    return points.groupBy(*keys).agg(F.min("p.x").alias("xmin"), F.min("p.y").alias("ymin"), F.max("p.x").alias("xmax"), F.max("p.y").alias("ymax"))
