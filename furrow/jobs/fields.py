"""The field jobs: mosaics to tiles, tiles to contours and angles, contours to lines, lines to rows.

Pixels move once, when they are grouped into tiles; from there on a row is a tile, a contour or a line.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import geometry, names
from furrow.operators import angles, contours, grid, kernels, lines, regions, rows, shapes
from furrow.params import DEFAULTS, Params
from furrow.sources import manifests, vectors
from furrow.sources.shared import checkpointed

TILE = ("prj", "col", "row")


def generate_tiles(projects: DataFrame, done: DataFrame | None = None, p: Params = DEFAULTS) -> DataFrame:
    """Tiles of many mosaics with corners and rings, without those already done."""
    tiles = grid.tile_georef(grid.tile_grid(grid.grid_facts(projects, p.tile_m)), p.tile_m)
    return tiles if done is None else grid.pending_tiles(tiles, done)


def segment_tiles(pixels: DataFrame, facts: DataFrame, p: Params = DEFAULTS, index: str = "exg", done: DataFrame | None = None) -> DataFrame:
    """Long pixels to tiles with mask, masked colours and a vegetation index, those with plants only; tiles of done (prj, col, row) are left
    out before their pixels move."""
    placed = grid.assign_tile(pixels, facts)
    if done is not None:
        placed = placed.join(done.select(*TILE).distinct(), list(TILE), "left_anti")
    images = kernels.tile_images(placed).join(facts.select("prj", F.col("psx").alias("pixel_m")), "prj")
    return kernels.tile_pipeline(images, p, index).where("plants > 0")


def set_pixels(tiles: DataFrame) -> DataFrame:
    """prj, col, row, px, py of the pixels set in tiles' masks (w, h, mask: bytes row by row)."""

    def run(batches):
        for batch in batches:
            for t in batch.itertuples():
                at = np.flatnonzero(np.frombuffer(t.mask, np.uint8))
                for first in range(0, len(at), 200_000):
                    py, px = np.divmod(at[first : first + 200_000].astype(np.int32), np.int32(t.w))
                    yield pd.DataFrame({"prj": t.prj, "col": t.col, "row": t.row, "px": px, "py": py})

    return tiles.select(*TILE, "w", "mask").mapInPandas(run, "prj string, col int, row int, px int, py int")


def tile_contours(tiles: DataFrame, p: Params = DEFAULTS, least_px: float | None = None) -> DataFrame:
    """Contours of tiles' masks: outer borders, large enough, smoothed, with their rectangle and ellipse angles (NaN where no ellipse fits); contour_id is the rank by area in
    the tile, from 0."""
    key = (*TILE, "contour_id")
    traced = checkpointed(regions.trace_contours(set_pixels(tiles), *TILE).where("not hole and size(pts) >= 3").drop("hole"))
    large = contours.filter_contours(shapes.min_rectangles(traced, *key), p.contour_min_px if least_px is None else least_px)
    smooth = checkpointed(contours.smooth_contours(traced.join(large.select(*key), list(key))))
    points = smooth.select(*key, F.explode("pts").alias("v")).select(*key, F.col("v.x").cast("double").alias("x"), F.col("v.y").cast("double").alias("y"))
    found = contours.contour_measures(smooth).select(*key, "pts", "area").join(shapes.min_rectangles(smooth, *key).drop("corners"), list(key)).join(shapes.ellipse_angles(points, *key), list(key))
    rank = F.row_number().over(Window.partitionBy(*TILE).orderBy(F.desc("area"), "contour_id")) - 1
    angle = F.coalesce("angle", F.lit(float("nan")))
    return found.select(*TILE, rank.alias("contour_id"), "pts", "area", "cx", "cy", "w", "h", "rect_angle", angle.alias("angle"), F.greatest("w", "h").alias("major_px"))


def generate_angles(found: DataFrame, projects: DataFrame, p: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(angles of tiles, angles of fields) from the largest contours of each tile and the projects' seeds. A field without an angle has null."""
    seeded = angles.filter_angles(found.where(F.col("contour_id") < p.top_contours).join(projects.select("prj", "seed"), "prj"), p.seed_tolerance)
    tiles = angles.tile_angles(seeded, *TILE, top=p.top_contours, deviation=p.max_angle_deviation)
    return tiles, angles.field_angle(tiles, "prj")


def without_angle(projects: DataFrame, field_angles: DataFrame) -> DataFrame:
    """prj, reason: the projects that no row angle was found for."""
    return projects.select("prj").join(field_angles.where("angle_mean is not null").select("prj"), "prj", "left_anti").withColumn("reason", F.lit("no tile has a row angle"))


def generate_lines(found: DataFrame, facts: DataFrame, field_angles: DataFrame, tiles: DataFrame | None = None) -> DataFrame:
    """Candidate lines in world coordinates from contours: prj, col, row, idx, lcount, d, the mid-point mid_x, mid_y, and the ends x1, y1, x2, y2.
    Tiles (prj, col, row) bound the job to theirs. Where a field's angle is -1, each tile's mean rectangle angle stands in; fields without an
    angle have no lines."""
    if tiles is not None:
        found = grid.tiles_with_contours(found, tiles)
    fallback = angles.fallback_angle(found, *TILE).withColumnRenamed("angle", "tile_angle")
    angled = field_angles.where("angle_mean is not null").select("prj", "angle_mean")
    met = found.join(facts.select("prj", "cm_per_px", "psx", "psy", "xmin", "ymax"), "prj").drop("angle").join(angled, "prj").join(fallback, list(TILE))
    met = met.withColumn("angle", F.when(F.col("angle_mean") == -1, F.col("tile_angle")).otherwise(F.col("angle_mean"))).drop("angle_mean", "tile_angle")
    placed = lines.candidate_lines(met.withColumn("len_cm", F.col("major_px") * F.col("cm_per_px")))
    counted = placed.withColumn("lcount", F.row_number().over(Window.partitionBy(*TILE).orderBy("contour_id")) - 1)
    spaced = lines.prev_center_distance(counted, *TILE)
    key = F.col("col").cast("long") * (1 << 40) + F.col("row").cast("long") * (1 << 20) + F.col("lcount")
    return spaced.select(*TILE, key.alias("idx"), "lcount", "d", "mid_x", "mid_y", F.col("ini_x").alias("x1"), F.col("ini_y").alias("y1"), F.col("end_x").alias("x2"), F.col("end_y").alias("y2"))


def candidate_points(candidates: DataFrame) -> DataFrame:
    """A row each for the mid, ini and end points of candidate lines."""
    ends = {"ini_x": F.col("x1"), "ini_y": F.col("y1"), "end_x": F.col("x2"), "end_y": F.col("y2")}
    return lines.line_points(candidates.withColumns(ends).drop("x1", "y1", "x2", "y2"))


def mask_boxes(masks: DataFrame) -> DataFrame:
    """prj, angle, u0, u1, v0, v1: the least oriented box of each field's mask."""
    points = masks.select("prj", F.explode("ring").alias("v")).select("prj", "v.x", "v.y")
    return contours.ombb(contours.convex_hulls(points, "prj"), "prj").drop("area")


def tile_bounds(tiles: DataFrame, projects: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Bounds and seed of each tile, and the oriented box of its field."""
    bounds = grid.bounds(tiles, *TILE).join(projects.select("prj", "seed"), "prj")
    return bounds if boxes is None else bounds.join(boxes, "prj")


def build_rows(tile_lines: DataFrame, masks: DataFrame, p: Params = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(geometric rows, statistical rows, counts) of fields from cleaned tile lines and field masks.

    Lines are extended, cut to the mask's least box with a margin, and measured mid-point to point from a point side_probe_m beyond the line
    closest to a far probe on the left of the first line, so that the outermost line is at that distance, not at 0; then they are cut to the mask.
    Groups of overlapping lines give the first rows, their distances alone the second. Distances count to a micrometre.
    """
    box = mask_boxes(masks)
    long = lines.clip_lines_to_oriented(lines.extend_lines(tile_lines.drop("d", "id").join(box, "prj"), p.extend_ratio), p.clip_margin_m).drop("angle", "u0", "u1", "v0", "v1")
    long = lines.number_lines(long, "prj", order=("col", "row", "idx"), name="line").drop("idx").withColumnRenamed("line", "idx")
    long = checkpointed(long)
    first = lines.first_line(long, "prj", order="idx")
    ends = (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2"))
    side = (geometry.azimuth(*ends) + 270).alias("side")
    px, py = geometry.project_point(geometry.midpoint(*ends), geometry.azimuth(*ends) + 270, p.far_probe_m)
    probes = first.select("prj", side, px.alias("x"), py.alias("y"))
    near = rows.closest_to_probe(long, probes, "prj").join(probes.select("prj", "side"), "prj").withColumnRenamed("idx", "base").drop("dist")
    base = long.join(near, "prj").where("idx = base")
    qx, qy = geometry.project_point(geometry.midpoint(*ends), F.col("side"), p.side_probe_m)
    away = geometry.distance((F.col("qx"), F.col("qy")), geometry.midpoint(*ends))
    measured = long.join(base.select("prj", qx.alias("qx"), qy.alias("qy")), "prj").withColumn("d", F.round(away, 6)).drop("qx", "qy")
    inside = checkpointed(lines.clip_to_polygon(measured.join(masks, "prj")).where(F.size("parts") > 0).drop("ring"))
    geometric = rows.geometric_rows(inside.select("prj", "idx", "x1", "y1", "x2", "y2"), "prj", width=2 * p.row_buffer_m, dissolved=True)
    with_parts = inside.select("prj", "idx", "parts", F.col("inside_length").alias("crlen"), "x1", "y1", "x2", "y2", F.col("d").alias("geo_dist"))
    statistical = rows.statistical_rows(inside.select("prj", "idx", "d"), "prj", p=p)
    return rows.select_lines(geometric, with_parts, "prj").join(geometric.select("prj", "idx", "grp", "idg"), ["prj", "idx"]), statistical.join(with_parts, ["prj", "idx"]), rows.result_counts(inside, "prj", p=p)


def run(pixels: DataFrame, projects: DataFrame, masks: DataFrame, p: Params = DEFAULTS, least_px: float | None = None, index: str = "exg", done: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole chain for a set of fields; each stage is checkpointed before the next reads it more than once. done: the contours of
    tiles that an earlier run got through, whose pixels are not worked on again. A field without a row angle is put aside in `errors`
    and holds up no other."""
    facts = grid.grid_facts(projects, p.tile_m)
    tiles = generate_tiles(projects, p=p)
    found = tile_contours(segment_tiles(pixels, facts, p, index, done), p, least_px)
    found = checkpointed(found if done is None else found.unionByName(done))
    tile_angles, field_angles = generate_angles(found, projects, p)
    field_angles = checkpointed(field_angles)
    candidates = checkpointed(generate_lines(found, facts, field_angles, tiles))
    cleaned = checkpointed(lines.clean_tile_lines(candidates, tile_bounds(tiles, projects, mask_boxes(masks)), ratio=p.extend_ratio, gap=p.min_row_gap_m, least=p.min_line_m))
    geometric, statistical, counts = build_rows(cleaned, masks, p)
    return {
        "contours": found,
        "tile_angles": tile_angles,
        "field_angles": field_angles,
        "errors": without_angle(projects, field_angles),
        "candidates": candidates,
        "points": candidate_points(candidates),
        "tile_lines": cleaned,
        "rows": geometric,
        "rows_stat": statistical,
        "counts": counts,
    }


def row_pieces(geometric: DataFrame, projects: DataFrame) -> DataFrame:
    """prj, id (a row's number), part, epsg and the ends x1, y1, x2, y2 of each piece of a row inside its field."""
    pieces = geometric.select("prj", F.col("idg").alias("id"), F.posexplode("parts").alias("part", "s")).select("prj", "id", "part", "s.*")
    return pieces.join(projects.select("prj", F.regexp_extract("epsg", r"(\d+)", 1).cast("int").alias("epsg")), "prj")


def write_products(out: dict[str, DataFrame], projects: DataFrame, path: str, p: Params = DEFAULTS) -> None:
    """The products of run() below a path: the tables as Parquet; the rows' pieces, their buffers, and KML in WGS 84 of them; an angle report
    of all tiles; result manifests. The contours table is what a later run takes as done."""
    for name in ("contours", "tile_angles", "field_angles", "errors", "candidates", "points", "tile_lines", "rows", "rows_stat", "counts"):
        vectors.write_table(out[name], path, name)
    spark = projects.sparkSession
    written = spark.read.schema(out["rows"].schema).parquet(f"{path}/rows")
    pieces = row_pieces(written, projects)
    vectors.write_table(pieces, path, "export")
    buffer = geometry.segment_buffer((F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")), p.row_buffer_m)
    vectors.write_table(pieces.select("prj", "id", "part", buffer.alias("ring")), path, "buffers")
    vectors.write_kml(pieces, f"{path}/kml")
    named = spark.read.schema(out["tile_angles"].schema).parquet(f"{path}/tile_angles").withColumn("colrow", names.colrow(F.col("col"), F.col("row")))
    vectors.write_angle_report(angles.angle_report(named.withColumn("colrow", F.concat_ws("/", "prj", "colrow"))), f"{path}/angles")
    manifests.write_results(manifests.result_manifest(out["counts"], projects), f"{path}/results")
