"""Candidate lines of tiles: from contours to world coordinates, extended, clipped, spaced and numbered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import geometry
from furrow.functions.names import colrow
from furrow.operators.grid import pixel_to_world
from furrow.params import DEFAULTS


def candidate_lines(contours: DataFrame, least: float = 1.0) -> DataFrame:
    """A line per contour (needs cx, cy, len_cm, angle and the tile's facts): mid, ini and end in world coordinates, where longer than least."""
    ini, end = geometry.contour_line((F.col("cx"), F.col("cy")), F.col("len_cm"), F.col("angle"))
    out = contours
    for name, (x, y) in {"mid": (F.col("cx"), F.col("cy")), "ini": ini, "end": end}.items():
        wx, wy = pixel_to_world(x, y)
        out = out.withColumn(f"{name}_x", wx).withColumn(f"{name}_y", wy)
    return out.where(F.col("len_cm") > least)


def prev_center_distance(contours: DataFrame, *tile: str) -> DataFrame:
    """contours with d: the distance from the previous contour's centre in the tile; 1 for the first."""
    w = Window.partitionBy(*tile).orderBy("lcount")
    d = geometry.distance((F.col("cx"), F.col("cy")), (F.lag("cx").over(w), F.lag("cy").over(w)))
    return contours.withColumn("d", F.coalesce(d, F.lit(1.0)))


def line_points(lines: DataFrame) -> DataFrame:
    """Candidate lines to a row each for their mid, ini and end points."""
    points = F.explode(F.array(*[F.struct(F.lit(n).alias("typepoint"), F.col(f"{n}_x").alias("x"), F.col(f"{n}_y").alias("y")) for n in ("mid", "ini", "end")]))
    return lines.select(*[c for c in lines.columns if c[:4] not in ("mid_", "ini_", "end_")], points.alias("p")).select("*", "p.*").drop("p")


def drop_empty_geom(df: DataFrame, coords: str = "coords") -> DataFrame:
    return df.where(F.coalesce(F.size(coords), F.lit(0)) > 0)


def with_project(df: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows with their project's facts (mask, angle, grid). Spark broadcasts the facts if their measured size allows."""
    return df.join(facts, "prj")


def catalog_filter(layers: DataFrame, *types: str, column: str = "geom_type") -> DataFrame:
    """Layers of the given geometry types."""
    return layers.where(F.col(column).isin(*types))


def merge_lines(*tables: DataFrame) -> DataFrame:
    """All tiles' lines in one table."""
    return reduce(DataFrame.unionByName, tables)


def merge_raw_points(*tables: DataFrame, coords: str = "coords") -> DataFrame:
    """All tiles' points, sets without geometry left out, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [drop_empty_geom(t, coords) for t in tables])


def line_vertices(lines: DataFrame, *attributes: str) -> DataFrame:
    """A row per vertex, attributes as text."""
    return lines.select(*[F.col(a).cast("string").alias(a) for a in attributes], F.posexplode("coords").alias("vertex", "p")).select(*attributes, "vertex", "p.x", "p.y")


def to_segments(lines: DataFrame, *keys: str) -> DataFrame:
    """A row per pair of consecutive vertices: x1, y1, x2, y2."""
    n = F.size("coords") - 1
    pairs = F.zip_with(F.slice("coords", F.lit(1), n), F.slice("coords", F.lit(2), n), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return lines.where(F.size("coords") > 1).select(*keys, F.posexplode(pairs).alias("part", "s")).select(*keys, "part", "s.*")


def lines_with_bounds(lines: DataFrame, tiles: DataFrame) -> DataFrame:
    """Lines with the bounds of their tile."""
    return lines.join(tiles, ["prj", "col", "row"])


def _ends() -> tuple[geometry.Point, geometry.Point]:
    return (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2"))


def extend_lines(lines: DataFrame, ratio: float = DEFAULTS.extend_ratio) -> DataFrame:
    """x1, y1, x2, y2 moved out to both sides."""
    (ax, ay), (bx, by) = geometry.extend_line(*_ends(), ratio)
    return lines.withColumns({"x1": ax, "y1": ay, "x2": bx, "y2": by})


def _cut(lines: DataFrame, first: Column, last: Column) -> DataFrame:
    # The row number keeps the filter above the projection: pushed below, it would spell out the whole clip twice.
    ranged = lines.withColumns({"_t0": first, "_t1": last, "_row": F.monotonically_increasing_id()}).where("_t0 < _t1 and _row >= 0")
    (ax, ay), (bx, by) = (geometry.along(*_ends(), F.col(t)) for t in ("_t0", "_t1"))
    return ranged.withColumns({"x1": ax, "y1": ay, "x2": bx, "y2": by}).drop("_t0", "_t1", "_row")


def clip_lines_to_box(lines: DataFrame) -> DataFrame:
    """Lines cut to their row's box xmin, ymin, xmax, ymax; those outside are dropped."""
    return _cut(lines, *geometry.clip_to_box(*_ends(), (F.col("xmin"), F.col("ymin")), (F.col("xmax"), F.col("ymax"))))


def clip_lines_to_oriented(lines: DataFrame, margin: float = 0.0) -> DataFrame:
    """Lines cut to their row's oriented box (angle, u0, u1, v0, v1), grown by a margin with square corners."""
    c, s = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
    turned = {}
    for i in "12":
        x, y = F.col(f"x{i}"), F.col(f"y{i}")
        turned |= {f"_u{i}": x * c + y * s, f"_v{i}": y * c - x * s}
    a, b = ((F.col(f"_u{i}"), F.col(f"_v{i}")) for i in "12")
    low, high = (F.col("u0") - margin, F.col("v0") - margin), (F.col("u1") + margin, F.col("v1") + margin)
    return _cut(lines.withColumns(turned), *geometry.clip_to_box(a, b, low, high)).drop(*turned)


def clip_to_polygon(lines: DataFrame, ring: str = "ring") -> DataFrame:
    """Lines with parts: the pieces (x1, y1, x2, y2) inside their row's ring, which may be concave, and their length in all.

    Where the line crosses edges cuts it; pieces whose middle lies inside stay. All within a row: rings are short.
    """
    a, b = _ends()
    n = F.size(ring) - 1
    dx, dy = b[0] - a[0], b[1] - a[1]

    def crossing(p: Column, q: Column) -> Column:
        ex, ey = q["x"] - p["x"], q["y"] - p["y"]
        den = dx * ey - dy * ex
        safe = F.when(den != 0, den).otherwise(F.lit(1.0))
        t = ((p["x"] - a[0]) * ey - (p["y"] - a[1]) * ex) / safe
        u = ((p["x"] - a[0]) * dy - (p["y"] - a[1]) * dx) / safe
        return F.when((den != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1), t)

    found = F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), crossing)
    stops = lines.withColumn("_t", F.concat(F.array(F.lit(0.0)), F.array_sort(F.filter(found, lambda t: t.isNotNull())), F.array(F.lit(1.0))))
    pairs = F.zip_with(F.slice("_t", F.lit(1), F.size("_t") - 1), F.slice("_t", F.lit(2), F.size("_t") - 1), lambda s, e: F.struct(s.alias("s"), e.alias("e")))

    def inside(t: Column) -> Column:
        middle = (t["s"] + t["e"]) / 2
        x, y = geometry.along(a, b, middle)
        return (t["e"] > t["s"]) & geometry.in_ring(x, y, F.col(ring))

    def part(t: Column) -> Column:
        (x1, y1), (x2, y2) = geometry.along(a, b, t["s"]), geometry.along(a, b, t["e"])
        return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    out = stops.withColumn("_in", F.filter(pairs, inside)).withColumn("parts", F.transform("_in", part))
    length = F.aggregate("_in", F.lit(0.0), lambda s, t: s + t["e"] - t["s"]) * geometry.distance(a, b)
    return out.withColumn("inside_length", length).drop("_t", "_in")


def valid_lines(lines: DataFrame, least: float = DEFAULTS.min_line_m) -> DataFrame:
    """Lines longer than least."""
    return lines.where(geometry.distance(*_ends()) > least)


def first_line(lines: DataFrame, *keys: str, order: str = "id") -> DataFrame:
    """The first line of each key."""
    return lines.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_i = 1").drop("_i")


def seed_point(seed: Column, first_azimuth: Column, probe: float = DEFAULTS.corner_probe_m, by: type[geometry.Functions] = geometry.Functions) -> geometry.Point:
    """The point of a tile (xmin, ymin, xmax, ymax) from which its lines are measured: seed 1 the middle of the top, 2 of the left side,
    3 and 4 the top-left and top-right corner pushed out square to the first line; (0, 0) without one. Other seeds are an error."""
    x0, x1, y0, y1 = F.col("xmin"), F.col("xmax"), F.col("ymin"), F.col("ymax")
    fault = F.raise_error(F.lit("seed has no reference point")).cast("double")
    left, right = (geometry.project_point((x, y1), first_azimuth + 270, probe, by) for x in (x0, x1))
    known = first_azimuth.isNotNull()

    def chosen(i: int) -> Column:
        one, two = ((x0 + x1) / 2, y1)[i], (x0, (y0 + y1) / 2)[i]
        pushed = F.when(known, F.when(seed == 3, left[i]).otherwise(right[i])).otherwise(F.lit(0.0))
        return F.when(seed == 1, one).when(seed == 2, two).when(seed.isin(3, 4), pushed).otherwise(fault)

    return chosen(0), chosen(1)


def distinct_sorted(lines: DataFrame, *keys: str, value: str = "d") -> DataFrame:
    """One row for each different value of a key."""
    return lines.select(*keys, value).distinct()


def gap_filter(values: DataFrame, *keys: str, value: str = "d", gap: float = DEFAULTS.min_row_gap_m) -> DataFrame:
    """Values at least a gap away from the one before them, kept or not; before the first comes 0. Sorted within a key."""
    w = Window.partitionBy(*keys).orderBy(value)
    before = F.coalesce(F.lag(value).over(w), F.lit(0.0))
    return values.withColumn("_b", before).where(F.abs(F.col(value) - F.col("_b")) >= gap).drop("_b")


def span_groups(values: DataFrame, *keys: str, value: str = "d", span: float = DEFAULTS.group_span) -> DataFrame:
    """keys, grp, d: sorted distinct values in groups that begin anew when a value is more than span above its group's first; d is the
    group's greatest. A fold over one key's values; the key is a project or a tile, never all rows."""
    start = F.lit(None).cast("double")
    state = F.struct(F.array().cast("array<double>").alias("out"), start.alias("first"), start.alias("last"))

    def step(s: Column, v: Column) -> Column:
        same = s["first"].isNotNull() & (v - s["first"] <= span)
        return F.struct(
            F.when(same | s["last"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["last"]))).alias("out"), F.when(same, s["first"]).otherwise(v).alias("first"), v.alias("last")
        )

    folded = values.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_set(value)), state, step, lambda s: F.concat(s["out"], F.array(s["last"]))).alias("_d"))
    return folded.select(*keys, F.posexplode("_d").alias("grp", value))


def first_index_of(values: DataFrame, lines: DataFrame, *keys: str, value: str = "d") -> DataFrame:
    """keys, d, idx: the least idx of the lines with exactly that value."""
    return values.join(lines.select(*keys, value, "idx"), [*keys, value]).groupBy(*keys, value).agg(F.min("idx").alias("idx"))


def number_lines(lines: DataFrame, *keys: str, order: tuple = ("d",), name: str = "id") -> DataFrame:
    """Lines numbered from 0 in an order within their key."""
    return lines.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def clean_tile_lines(lines: DataFrame, tiles: DataFrame, *, ratio: float = DEFAULTS.extend_ratio, gap: float = DEFAULTS.min_row_gap_m, least: float = DEFAULTS.min_line_m) -> DataFrame:
    """Tile lines (prj, col, row, idx, x1, y1, x2, y2) extended, cut to their tile and to the field's oriented box if there is one, measured
    from the tile's seed point and spaced; numbered from 0 in each tile. tiles: prj, col, row, seed, xmin, ymin, xmax, ymax, and angle, u0, u1,
    v0, v1 of the box (see contours.ombb)."""
    tile = ("prj", "col", "row")
    met = clip_lines_to_box(extend_lines(lines_with_bounds(lines, tiles), ratio))
    if "u0" in tiles.columns:
        met = clip_lines_to_oriented(met)
    first = Window.partitionBy(*tile).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Without a gap all different distances stay, and the last bit tells whether two differ.
    by = geometry.Functions if gap > 0 else geometry.CLibrary
    met = met.withColumn("first_azimuth", geometry.azimuth(*_ends(), by)).withColumn("first_azimuth", F.first("first_azimuth").over(first))
    px, py = seed_point(F.col("seed"), F.col("first_azimuth"), by=by)
    met = valid_lines(met, least).withColumn("d", geometry.distance((px, py), geometry.midpoint(*_ends()), by))
    if gap > 0:  # distances that differ in their last bits alone are one
        met = met.withColumn("d", F.round("d", 9))
    chosen = first_index_of(gap_filter(distinct_sorted(met, *tile), *tile, gap=gap), met, *tile)
    kept = met.join(chosen.select(*tile, "idx"), [*tile, "idx"])
    return number_lines(kept, *tile, order=("d", "idx")).select(*tile, "id", colrow(F.col("col"), F.col("row")).alias("colrow"), "idx", "d", "x1", "y1", "x2", "y2")
