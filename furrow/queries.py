"""A query for each operation of the row jobs over the given tables, and its DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import geometry, names, spectral
from furrow.operators import angles, blocks, buffers, contours, grid, lines, ordered, raster, regions, rows, shapes
from furrow.sources import manifests, vectors
from furrow.views import TILE_PX, Views, pt, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return add


def r6(c, name: str):
    """Rounded to six places, as on the SQL side."""
    return F.round(c, 6).alias(name)


PIX = ("prj", "x", "y")
TILE = ("prj", "col", "row")


def _rgb():
    return F.col("r"), F.col("g"), F.col("b")


# Projections over pixels

_CH = "r / (r + g + b)::DOUBLE AS cr, g / (r + g + b)::DOUBLE AS cg, b / (r + g + b)::DOUBLE AS cb"
_CHROMA = f"(SELECT prj, x, y, {_CH} FROM pixels WHERE r + g + b > 0 UNION ALL SELECT prj, x, y, NULL, NULL, NULL FROM pixels WHERE r + g + b = 0)"
for _name, _sql in {
    "exg": "2 * cg - cr - cb",
    "exr": "1.4 * cr - cg",
    "exgr": "(2 * cg - cr - cb) - (1.4 * cr - cg)",
}.items():
    query(f"veg_index_{_name}", f"SELECT prj, x, y, round({_sql}, 12) AS v FROM {_CHROMA}")(
        lambda v, n=_name: v.pixels.select(*PIX, F.round(spectral.veg_index(n, *_rgb()), 12).alias("v"))
    )


# A seventh: the index itself often ends in a 5, where two engines' last bits round apart.
@query("veg_index_cive", f"SELECT prj, x, y, round((0.441 * cr - 0.811 * cg + 0.385 * cb + 18.78745) / 7, 7) AS v_7th FROM {_CHROMA}")
def _(v):
    return v.pixels.select(*PIX, F.round(spectral.veg_index("cive", *_rgb()) / 7, 7).alias("v_7th"))


@query("veg_index_ndi", "SELECT prj, x, y, CASE WHEN g + r > 0 THEN round((g - r) / (g + r)::DOUBLE, 6) END AS v FROM pixels")
def _(v):
    return v.pixels.select(*PIX, r6(spectral.veg_index("ndi", *_rgb()), "v"))


_STRETCH = "quantile_cont({v}, 0.05) AS p5, quantile_cont({v}, 0.95) AS p95"


@query(
    "veg_index_ndvi",
    f"""WITH n AS (SELECT prj, x, y, (r - b) / CASE WHEN r + b = 0 THEN 0.01::DOUBLE ELSE (r + b)::DOUBLE END AS v FROM pixels),
    p AS (SELECT prj, {_STRETCH.format(v="v")} FROM n GROUP BY prj),
    s AS (SELECT prj, x, y, round((v - p5) * 255 / (p95 - p5) + p5, 6) AS s FROM n JOIN p USING (prj))
    SELECT prj, x, y, s AS stretched, ((trunc(s)::INT % 256) + 256) % 256 AS level FROM s""",
)
def _(v):
    raw = v.pixels.select(*PIX, spectral.veg_index("ndvi", *_rgb()).alias("v"))
    out = raster.contrast_stretch(raw, "v", ("prj",)).select(*PIX, r6(F.col("stretched"), "stretched"))
    return out.withColumn("level", F.pmod(F.col("stretched").cast("int"), F.lit(256)))


@query("veg_index_grb", "SELECT prj, x, y, CASE WHEN r + g + b > 0 THEN round((2 * r - g - b) / (r + g + b)::DOUBLE, 12) END AS v FROM pixels")
def _(v):
    return v.pixels.select(*PIX, F.round(spectral.veg_index("exg", *_rgb(), order="grb"), 12).alias("v"))


@query("adjust_gamma", "SELECT prj, x, y, floor(pow(r / 255.0::DOUBLE, 1.0 / 1.5::DOUBLE) * 255)::INT AS r, floor(pow(g / 255.0::DOUBLE, 1.0 / 1.5::DOUBLE) * 255)::INT AS g FROM pixels")
def _(v):
    return v.pixels.select(*PIX, *[spectral.adjust_gamma(F.col(c), 1.5).alias(c) for c in "rg"])


@query(
    "contrast_stretch",
    f"WITH p AS (SELECT prj, col, row, {_STRETCH.format(v='r')} FROM tpix GROUP BY ALL) SELECT prj, x, y, round((r - p5) * 255 / (p95 - p5), 6) AS stretched FROM tpix JOIN p USING (prj, col, row)",
)
def _(v):
    return raster.contrast_stretch(v.tpix, "r", TILE, add_low=False).select(*PIX, r6(F.col("stretched"), "stretched"))


@query("to_byte", "SELECT prj, x, y, v FROM bpix")
def _(v):
    return v.bpix.select(*PIX, "v")


_HSV = """(SELECT *, CASE WHEN hi = lo THEN 0 ELSE CASE WHEN deg < 0 THEN deg + 360 ELSE deg END END AS deg2 FROM (SELECT *, CASE WHEN hi = lo THEN 0::DOUBLE WHEN hi = r THEN 60 * (g - b) / (hi - lo)::DOUBLE
    WHEN hi = g THEN 120 + 60 * (b - r) / (hi - lo)::DOUBLE ELSE 240 + 60 * (r - g) / (hi - lo)::DOUBLE END AS deg FROM (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM pixels)))"""
_HUE = "(CASE WHEN floor(deg2 / 2 + 0.5) >= 180 THEN 0 ELSE floor(deg2 / 2 + 0.5) END)::INT AS h, floor(255 * (hi - lo) / greatest(hi, 1)::DOUBLE + 0.5)::INT AS s, hi AS v"


@query("hsv", f"SELECT prj, x, y, {_HUE} FROM {_HSV}")
def _(v):
    h, s, val = spectral.hsv(*_rgb())
    return v.pixels.select(*PIX, h.alias("h"), s.alias("s"), val.alias("v"))


@query("green_mask", f"SELECT prj, x, y, CASE WHEN h BETWEEN 45 AND 95 AND s >= 30 AND v >= 30 THEN 1 ELSE 0 END AS mask FROM (SELECT prj, x, y, {_HUE} FROM {_HSV})")
def _(v):
    return v.pixels.select(*PIX, spectral.green_mask(*_rgb()).alias("mask"))


@query(
    "combine_masks",
    "SELECT prj, x, y, least(mask + r % 2, 255) AS mask, least(least(mask + r % 2, 255), g) AS g, CASE WHEN mask > 0 THEN b ELSE 0 END AS b FROM bpix",
)
def _(v):
    both = spectral.combine_masks(F.col("mask"), F.col("r") % 2)
    return v.bpix.select(*PIX, both.alias("mask"), spectral.mask_rgb(both, F.col("g")).alias("g"), spectral.apply_mask(F.col("mask"), F.col("b")).alias("b"))


# Histograms, thresholds, statistics


@query("histogram", "SELECT prj, col, row, v, count(*) AS n FROM bpix GROUP BY ALL")
def _(v):
    return raster.histogram(v.bpix, "v")


_OTSU = """WITH h AS (SELECT prj, col, row, v, count(*) AS n FROM bpix GROUP BY ALL),
    c AS (SELECT prj, col, row, v, sum(n) OVER w AS n0, sum(n * v) OVER w AS s0, sum(n) OVER p AS n, sum(n * v) OVER p AS s FROM h WINDOW p AS (PARTITION BY prj, col, row), w AS (PARTITION BY prj, col, row ORDER BY v ROWS UNBOUNDED PRECEDING)),
    k AS (SELECT *, CASE WHEN n > n0 THEN round(n0::DOUBLE * (n - n0)::DOUBLE / (n::DOUBLE * n) * (s0 / n0::DOUBLE - (s - s0) / (n - n0)::DOUBLE) * (s0 / n0::DOUBLE - (s - s0) / (n - n0)::DOUBLE), 9) ELSE 0 END AS var FROM c),
    t AS (SELECT prj, col, row, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY prj, col, row ORDER BY var DESC, v) AS i FROM k) WHERE i = 1)"""


@query("otsu", f"{_OTSU} SELECT prj, x, y, threshold, CASE WHEN v > threshold THEN 255 ELSE 0 END AS mask FROM bpix JOIN t USING (prj, col, row)")
def _(v):
    t = raster.otsu_thresholds(v.bpix, "v")
    return raster.otsu(v.bpix, "v").join(t, list(TILE)).select(*PIX, "threshold", "mask")


@query(
    "foreground_share",
    f"{_OTSU} SELECT prj, col, row, round(avg(CASE WHEN v > threshold THEN 1.0 ELSE 0.0 END), 6) AS share FROM bpix JOIN t USING (prj, col, row) GROUP BY ALL HAVING max(v) > min(threshold)",
)
def _(v):
    return raster.non_empty_tiles(raster.otsu(v.bpix, "v")).select(*TILE, r6(F.col("share"), "share"))


@query("non_empty_tiles", "SELECT prj, col, row, round(avg(CASE WHEN mask > 0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM bpix GROUP BY ALL HAVING max(mask) > 0")
def _(v):
    return raster.non_empty_tiles(v.bpix).select(*TILE, r6(F.col("share"), "share"))


@query(
    "equalize",
    """WITH l AS (SELECT *, (299 * r + 587 * g + 114 * b + 500) // 1000 AS lum FROM tpix), h AS (SELECT prj, col, row, lum, count(*) AS n FROM l GROUP BY ALL),
    c AS (SELECT prj, col, row, lum, sum(n) OVER w AS cdf, sum(n) OVER p AS total, first(n) OVER w AS low FROM h WINDOW p AS (PARTITION BY prj, col, row), w AS (PARTITION BY prj, col, row ORDER BY lum ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT prj, col, row, lum, CASE WHEN total > low THEN floor((cdf - low) * 255 / (total - low)::DOUBLE + 0.5)::INT ELSE lum END AS level FROM c)
    SELECT prj, x, y, least(255, greatest(0, r + level - lum)) AS r_eq, least(255, greatest(0, g + level - lum)) AS g_eq, least(255, greatest(0, b + level - lum)) AS b_eq FROM l JOIN e USING (prj, col, row, lum)""",
)
def _(v):
    return raster.equalize(v.tpix).select(*PIX, "r_eq", "g_eq", "b_eq")


@query("band_stats", " UNION ALL ".join(f"SELECT prj, '{c}' AS band, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM pixels GROUP BY prj" for c in "rgb"))
def _(v):
    return raster.band_stats(v.pixels).select("prj", "band", "min", "max", r6(F.col("mean"), "mean"), r6(F.col("std"), "std"))


@query("auto_edge_bounds", "SELECT prj, median(r) AS median, floor(greatest(0, (1 - 0.33::DOUBLE) * median(r)))::INT AS low, floor(least(255, (1 + 0.33::DOUBLE) * median(r)))::INT AS high FROM pixels GROUP BY prj")
def _(v):
    return raster.auto_edge_bounds(v.pixels, "r", ("prj",))


# Neighbourhoods


def _morph_sql(source: str, k: int, n: int, f: str) -> str:
    before, after = raster._reach(k, n)
    w = f"ORDER BY {{}} RANGE BETWEEN {before} PRECEDING AND {after} FOLLOWING"
    inner = f"(SELECT prj, col, row, px, py, {f}(mask) OVER (PARTITION BY prj, col, row, py {w.format('px')}) AS mask FROM {source})"
    return f"(SELECT prj, col, row, px, py, {f}(mask) OVER (PARTITION BY prj, col, row, px {w.format('py')}) AS mask FROM {inner})"


_AT = ("prj", "col", "row", "px", "py")
for _n, _f, _q in (
    ("dilate", lambda d: raster.dilate(d, k=3, n=9), _morph_sql("bpix", 3, 9, "max")),
    ("erode", lambda d: raster.erode(d, k=4, n=2), _morph_sql("bpix", 4, 2, "min")),
    ("morph_open", lambda d: raster.morph_open(d, k=3), _morph_sql(_morph_sql("bpix", 3, 1, "min"), 3, 1, "max")),
    ("morph_close", lambda d: raster.morph_close(d, k=3), _morph_sql(_morph_sql("bpix", 3, 1, "max"), 3, 1, "min")),
):
    query(_n, f"SELECT prj, col, row, px, py, mask FROM {_q}")(lambda v, f=_f: f(v.bpix).select(*_AT, "mask"))


def _mirror(c: str, n: str) -> str:
    return f"CASE WHEN abs({c}) >= {n} THEN 2 * ({n} - 1) - abs({c}) ELSE abs({c}) END"


_W5 = raster.gaussian_weights(5)
_WEIGHTS = "(VALUES " + ", ".join(f"({i - 2}, {w!r}::DOUBLE)" for i, w in enumerate(_W5)) + ") w(d, k)"


@query(
    "gaussian_blur",
    f"""WITH s AS (SELECT prj, col, row, max(px) + 1 AS nx, max(py) + 1 AS ny FROM tpix GROUP BY ALL),
    a AS (SELECT t.prj, t.col, t.row, t.px, t.py, ny, sum(k * q.r) AS r FROM tpix t JOIN s USING (prj, col, row) CROSS JOIN {_WEIGHTS}
        JOIN tpix q ON q.prj = t.prj AND q.col = t.col AND q.row = t.row AND q.py = t.py AND q.px = {_mirror("(t.px + d)", "nx")} GROUP BY ALL)
    SELECT a.prj, a.col, a.row, a.px, a.py, floor(round(sum(k * q.r), 9) + 0.5)::INT AS r FROM a CROSS JOIN {_WEIGHTS}
        JOIN a q ON q.prj = a.prj AND q.col = a.col AND q.row = a.row AND q.px = a.px AND q.py = {_mirror("(a.py + d)", "a.ny")} GROUP BY ALL""",
)
def _(v):
    return raster.gaussian_blur(v.tpix, "r", 5).select(*_AT, "r")


@query(
    "median_binary",
    """WITH s AS (SELECT prj, col, row, max(px) AS mx, max(py) AS my FROM bpix GROUP BY ALL),
    a AS (SELECT t.prj, t.col, t.row, t.px, t.py, my, sum(CASE WHEN q.mask > 0 THEN 1 ELSE 0 END) AS n FROM bpix t JOIN s USING (prj, col, row) CROSS JOIN range(-7, 8) w(d)
        JOIN bpix q ON q.prj = t.prj AND q.col = t.col AND q.row = t.row AND q.py = t.py AND q.px = least(mx, greatest(0, t.px + d)) GROUP BY ALL)
    SELECT a.prj, a.col, a.row, a.px, a.py, CASE WHEN sum(q.n) > 112 THEN 255 ELSE 0 END AS mask FROM a CROSS JOIN range(-7, 8) w(d)
        JOIN a q ON q.prj = a.prj AND q.col = a.col AND q.row = a.row AND q.px = a.px AND q.py = least(a.my, greatest(0, a.py + d)) GROUP BY ALL""",
)
def _(v):
    return raster.median_binary(v.bpix).select(*_AT, "mask")


_INSIDE = "sum(CASE WHEN (e.y1 > {y}) <> (e.y2 > {y}) AND {x} < (e.x2 - e.x1) * ({y} - e.y1) / (e.y2 - e.y1) + e.x1 THEN 1 ELSE 0 END) % 2 = 1"


@query("clip_raster", f"SELECT p.prj, x, y, r FROM pixels p JOIN mask_edges e ON e.prj = p.prj GROUP BY ALL HAVING {_INSIDE.format(x='x', y='y')}")
def _(v):
    return raster.clip_raster(v.pixels, v.masks).select(*PIX, "r")


@query(
    "clip_raster_nodata",
    f"""SELECT p.prj, x, y, CASE WHEN {_INSIDE.format(x="x", y="y")} THEN r ELSE -9999 END AS r FROM pixels p JOIN mask_edges e ON e.prj = p.prj GROUP BY p.prj, x, y, r
    HAVING x BETWEEN min(least(e.x1, e.x2)) AND max(e.x1) AND y BETWEEN min(e.y1) AND max(e.y1)""",
)
def _(v):
    return raster.clip_raster(v.pixels, v.masks, nodata=-9999).select(*PIX, "r")


# The grid


@query("grid_facts", "SELECT prj, round(cm_per_px, 6) AS cm_per_px, round(w * cm_per_px * h * cm_per_px / 1e4, 4) AS area_m2, round(w * cm_per_px * h * cm_per_px / 1e8, 6) AS area_ha, round(pixel_tile, 6) AS pixel_tile, n_cols, n_rows, n_cols * n_rows AS n_tiles FROM facts")
def _(v):
    f = grid.grid_facts(v.projects)
    return f.select("prj", r6(F.col("cm_per_px"), "cm_per_px"), F.round("area_m2", 4).alias("area_m2"), r6(F.col("area_ha"), "area_ha"), r6(F.col("pixel_tile"), "pixel_tile"), "n_cols", "n_rows", "n_tiles")


@query("tile_grid", "SELECT prj, col, row, colrow FROM grid")
def _(v):
    return grid.tile_grid(grid.grid_facts(v.projects)).select(*TILE, "colrow")


@query("assign_tile", "SELECT prj, x, y, col, row, px, py FROM tpix")
def _(v):
    return v.tpix.select(*PIX, "col", "row", "px", "py")


@query("tile_georef", "SELECT prj, col, row, round(x0, 6) AS x0, round(y0, 6) AS y0, 5 AS n, round(x0 + 20, 6) AS x1, round(y0 - 20, 6) AS y1 FROM grid")
def _(v):
    t = grid.tile_georef(grid.tile_grid(grid.grid_facts(v.projects)))
    return t.select(*TILE, r6(F.col("x0"), "x0"), r6(F.col("y0"), "y0"), F.size("ring").alias("n"), r6(F.get("ring", F.lit(2))["x"], "x1"), r6(F.get("ring", F.lit(2))["y"], "y1"))


@query("pixel_to_world", "SELECT prj, col, row, round(17 * psx + xmin + 20 * (col - 1), 6) AS wx, round(31 * psy + ymax - 20 * (row - 1), 6) AS wy FROM grid")
def _(v):
    x, y = grid.pixel_to_world(F.lit(17), F.lit(31))
    return grid.tile_grid(grid.grid_facts(v.projects)).select(*TILE, r6(x, "wx"), r6(y, "wy"))


@query("raster_facts", "SELECT prj, round(xmin)::INT AS ox, round(ymin)::INT AS oy, round((xmax - xmin) / w, 6) AS psx, round(-(ymax - ymin) / h, 6) AS psy FROM projects")
def _(v):
    e, d = "image_extents", "image_dimensions"
    flat = v.projects.select("prj", *[F.get(e, F.lit(i)).alias(n) for i, n in enumerate(("xmin", "ymin", "xmax", "ymax"))], *[F.get(d, F.lit(i)).alias(n) for i, n in enumerate("wh")])
    f = grid.raster_facts(flat)
    return f.select("prj", *[F.get("image_origin", F.lit(i)).alias(n) for i, n in enumerate(("ox", "oy"))], *[r6(F.get("pixel_size", F.lit(i)), n) for i, n in enumerate(("psx", "psy"))])


@query("world_files", "SELECT prj, col, row, concat_ws(chr(10), printf('%.6f', psx), '0.000000', '0.000000', printf('%.6f', psy), printf('%.6f', x0), printf('%.6f', y0)) AS body FROM grid")
def _(v):
    return grid.world_files(grid.tile_georef(grid.tile_grid(grid.grid_facts(v.projects))))


@query("pending_tiles", "SELECT prj, col, row FROM grid WHERE (prj, col, row) NOT IN (SELECT prj, col, row FROM grid WHERE (col + row) % 3 = 0)")
def _(v):
    g = grid.tile_grid(grid.grid_facts(v.projects))
    return grid.pending_tiles(g, g.where("(col + row) % 3 = 0")).select(*TILE)


@query("tiles_with_contours", "SELECT DISTINCT t.prj, t.col, t.row FROM tiles t JOIN contours c ON c.col = t.col AND c.row = t.row AND c.prj = 'c' || (substr(t.prj, 2)::INT % 5)")
def _(v):
    renamed = v.tiles.select(F.concat(F.lit("c"), F.substring("prj", 2, 9).cast("int") % 5).alias("prj"), "col", "row", F.col("prj").alias("own"))
    return grid.tiles_with_contours(renamed, v.contours).select(F.col("own").alias("prj"), "col", "row")


@query("locate_in_tiles", "SELECT p.prj, point, floor(x / 40)::INT + 1 AS col, floor((120 - y) / 40)::INT + 1 AS row FROM points p")
def _(v):
    facts = v.points.select("prj").distinct().select("prj", F.lit(0.0).alias("xmin"), F.lit(120.0).alias("ymax"))
    return grid.locate_in_tiles(v.points, facts, 40.0).select("prj", "point", "col", "row")


@query("bounds", "SELECT prj, round(min(x0), 6) AS xmin, round(min(y0 - 20), 6) AS ymin, round(max(x0 + 20), 6) AS xmax, round(max(y0), 6) AS ymax FROM grid GROUP BY prj")
def _(v):
    b = grid.bounds(grid.tile_georef(grid.tile_grid(grid.grid_facts(v.projects))), "prj")
    return b.select("prj", *[r6(F.col(c), c) for c in ("xmin", "ymin", "xmax", "ymax")])


# Names and values


@query("tile_names", "SELECT prj, col, row, 'mosaic-cl_' || col || '-rw_' || row AS name, split_part(colrow, '_', 1) AS lead FROM grid")
def _(v):
    g = grid.tile_grid(grid.grid_facts(v.projects))
    return g.select(*TILE, names.tile_name(F.col("col"), F.col("row")).alias("name"), names.leading_token(F.col("colrow")).alias("lead"))


@query("parse_lists", "SELECT prj, w AS w, h AS h, round(psx, 6) AS psx, substr(epsg, 6)::INT AS code FROM projects")
def _(v):
    text = v.projects.select("prj", F.array_join("image_dimensions", ",").alias("d"), F.array_join("pixel_size", ",").alias("p"), "epsg")
    ints, doubles = names.parse_ints(F.col("d")), names.parse_doubles(F.col("p"))
    return text.select("prj", F.get(ints, F.lit(0)).alias("w"), F.get(ints, F.lit(1)).alias("h"), r6(F.get(doubles, F.lit(0)), "psx"), names.epsg_code(F.col("epsg")).alias("code"))


@query("relative_paths", "SELECT page_id, array_to_string(string_split(url, '/')[3:], '/') AS path FROM pages")
def _(v):
    return v.table("pages").select("page_id", names.relative_path(F.col("url")).alias("path"))


@query("project_stamp", "SELECT event_id, 'rows_' || strftime(ts, '%Y%m%d-%H%M%S') AS stamp FROM events")
def _(v):
    return v.table("events").select("event_id", names.project_stamp(F.col("ts")).alias("stamp"))


@query("seed_names", "SELECT prj, ['Horizontal', 'Vertical', 'Counterclockwise', 'Clockwise'][seed] AS name FROM projects")
def _(v):
    return v.projects.select("prj", names.seed_name(F.col("seed")).alias("name"))


@query("stepped_range", "SELECT prj, unnest(range(10, w // 100 + 1, 7)) AS v FROM projects")
def _(v):
    return v.projects.select("prj", F.explode(names.stepped(F.lit(10), F.floor(F.get("image_dimensions", F.lit(0)) / 100), F.lit(7))).alias("v"))


@query("tiles_geojson", "SELECT prj, col, row, '{\"type\":\"Feature\",\"properties\":{\"col\":' || col || ',\"row\":' || row || ',\"colrow\":\"' || colrow || '\"},\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || col || ',' || row || ']}}' AS feature FROM grid")
def _(v):
    g = grid.tile_grid(grid.grid_facts(v.projects))
    return g.select(*TILE, names.feature(names.point_geojson(F.col("col"), F.col("row")), col=F.col("col"), row=F.col("row"), colrow=F.col("colrow")).alias("feature"))


@query("lines_geojson", "SELECT idx, '{\"type\":\"Feature\",\"properties\":{\"lcount\":' || idx || '},\"geometry\":{\"type\":\"LineString\",\"coordinates\":[[' || floor(x1)::BIGINT || ',' || floor(y1)::BIGINT || '],[' || floor(x2)::BIGINT || ',' || floor(y2)::BIGINT || ']]}}' AS feature FROM lines")
def _(v):
    whole = F.array(*[F.struct(F.floor(a).alias("x"), F.floor(b).alias("y")) for a, b in (("x1", "y1"), ("x2", "y2"))])
    return v.lines.select("idx", names.feature(names.line_geojson(whole), lcount=F.col("idx")).alias("feature"))


# Geometry expressions



def _ab():
    return (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2"))


@query("azimuth", "SELECT idx, round(CASE WHEN a <= 0 THEN a + 360 ELSE a END, 6) AS azimuth FROM (SELECT idx, degrees(atan2(x2 - x1, y2 - y1)) AS a FROM (SELECT idx, x1, y1, CASE WHEN idx % 2 = 0 THEN x2 ELSE x1 - 2 END AS x2, CASE WHEN idx % 3 = 0 THEN y1 - 1 ELSE y2 END AS y2 FROM lines))")
def _(v):
    x2, y2 = F.when(F.col("idx") % 2 == 0, F.col("x2")).otherwise(F.col("x1") - 2), F.when(F.col("idx") % 3 == 0, F.col("y1") - 1).otherwise(F.col("y2"))
    return v.lines.select("idx", r6(geometry.azimuth((F.col("x1"), F.col("y1")), (x2, y2)), "azimuth"))


@query("angle_between", "SELECT idx, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 6) AS angle FROM (SELECT idx, degrees(atan2(y2 - y1, x2 - x1) - atan2(y1, x1)) AS a FROM lines)")
def _(v):
    (x1, y1), (x2, y2) = _ab()
    return v.lines.select("idx", r6(geometry.angle_between((x1, y1), (x2 - x1, y2 - y1)), "angle"))


@query("midpoint_distance", "SELECT idx, round((x1 + x2) / 2, 6) AS mx, round((y1 + y2) / 2, 6) AS my, round(sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)), 6) AS length FROM lines")
def _(v):
    a, b = _ab()
    mx, my = geometry.midpoint(a, b)
    return v.lines.select("idx", r6(mx, "mx"), r6(my, "my"), r6(geometry.distance(a, b), "length"))


@query("line_length", "SELECT contour_id, round(sum(sqrt((u - x) * (u - x) + (w - y) * (w - y))), 6) AS length FROM (SELECT contour_id, x, y, lead(x) OVER p AS u, lead(y) OVER p AS w FROM contours WINDOW p AS (PARTITION BY contour_id ORDER BY i)) GROUP BY contour_id")
def _(v):
    pts = F.transform("pts", lambda p: pt(p["x"], p["y"]))
    return v.contours.select("contour_id", r6(geometry.line_length(pts), "length"))


@query("extend_line", "SELECT idx, round(x1 - (x2 - x1) * 500, 6) AS ax, round(y1 - (y2 - y1) * 500, 6) AS ay, round(x1 + (x2 - x1) * 500, 6) AS bx, round(y1 + (y2 - y1) * 500, 6) AS by FROM lines")
def _(v):
    a, b = geometry.last_two(F.array(pt(F.lit(0), F.lit(0)), pt(F.col("x1"), F.col("y1")), pt(F.col("x2"), F.col("y2"))))
    (ax, ay), (bx, by) = geometry.extend_line(a, b)
    return v.lines.select("idx", r6(ax, "ax"), r6(ay, "ay"), r6(bx, "bx"), r6(by, "by"))


_TX = "CASE WHEN {d} <> 0 THEN least(({lo} - {p}) / {d}, ({hi} - {p}) / {d}) WHEN {p} BETWEEN {lo} AND {hi} THEN '-inf'::DOUBLE ELSE 1 END"
_TL = "CASE WHEN {d} <> 0 THEN greatest(({lo} - {p}) / {d}, ({hi} - {p}) / {d}) WHEN {p} BETWEEN {lo} AND {hi} THEN 'inf'::DOUBLE ELSE 0 END"


def _box_sql(source: str, x1: str, y1: str, x2: str, y2: str, x0: str, x9: str, y0: str, y9: str) -> str:
    """A clip of lines to boxes: the source's columns, t0, t1."""
    first = ", ".join(_TX.format(d=f"({b} - {a})", p=a, lo=lo, hi=hi) for a, b, lo, hi in ((x1, x2, x0, x9), (y1, y2, y0, y9)))
    last = ", ".join(_TL.format(d=f"({b} - {a})", p=a, lo=lo, hi=hi) for a, b, lo, hi in ((x1, x2, x0, x9), (y1, y2, y0, y9)))
    return f"(SELECT * FROM (SELECT *, greatest(0.0::DOUBLE, {first}) AS t0, least(1.0::DOUBLE, {last}) AS t1 FROM {source}) WHERE t0 < t1)"


_EXTENDED = "(SELECT prj, col, row, idx, d, x1 - (x2 - x1) * 500 AS x1, y1 - (y2 - y1) * 500 AS y1, x1 + (x2 - x1) * 500 AS x2, y1 + (y2 - y1) * 500 AS y2 FROM lines)"
_CUT = "x1 + (x2 - x1) * t0 AS x1, y1 + (y2 - y1) * t0 AS y1, x1 + (x2 - x1) * t1 AS x2, y1 + (y2 - y1) * t1 AS y2"
_TILE_CUT = f"(SELECT prj, col, row, idx, d, seed, xmin, ymin, xmax, ymax, {_CUT} FROM {_box_sql(f'{_EXTENDED} JOIN tiles USING (prj, col, row)', 'x1', 'y1', 'x2', 'y2', 'xmin', 'xmax', 'ymin', 'ymax')})"
_ROUND4 = "round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2"


def _round4():
    return [r6(F.col(c), c) for c in ("x1", "y1", "x2", "y2")]


@query("clip_to_box", f"SELECT idx, {_ROUND4} FROM {_TILE_CUT}")
def _(v):
    return lines.clip_lines_to_box(lines.extend_lines(lines.lines_with_bounds(v.lines, v.tiles))).select("idx", *_round4())


_C30, _S30 = math.cos(math.radians(30)), math.sin(math.radians(30))
_TURNED = f"(SELECT *, x1 * {_C30!r} + y1 * {_S30!r} AS u1, y1 * {_C30!r} - x1 * {_S30!r} AS v1, x2 * {_C30!r} + y2 * {_S30!r} AS u2, y2 * {_C30!r} - x2 * {_S30!r} AS v2 FROM {_EXTENDED})"


@query("clip_to_convex", f"SELECT idx, {_ROUND4} FROM (SELECT idx, {_CUT} FROM {_box_sql(_TURNED, 'u1', 'v1', 'u2', 'v2', '0', '150', '0', '80')})")
def _(v):
    boxed = lines.extend_lines(v.lines).withColumns({"angle": F.lit(30.0), "u0": F.lit(20.0), "u1": F.lit(130.0), "v0": F.lit(20.0), "v1": F.lit(60.0)})
    return lines.clip_lines_to_oriented(boxed, 20.0).select("idx", *_round4())


_PIECES = f"""WITH l AS (SELECT prj, idx, x1, y1, x2, y2 FROM {_box_sql("(SELECT prj, idx, x1, y1, x1 + (x2 - x1) * 20 AS x2, y1 + (y2 - y1) * 20 AS y2 FROM lines)", "x1", "y1", "x2", "y2", "-1000", "1000", "-1000", "1000")}),
    c AS (SELECT l.idx, ((e.x1 - l.x1) * (e.y2 - e.y1) - (e.y1 - l.y1) * (e.x2 - e.x1)) / ((l.x2 - l.x1) * (e.y2 - e.y1) - (l.y2 - l.y1) * (e.x2 - e.x1)) AS t,
        ((e.x1 - l.x1) * (l.y2 - l.y1) - (e.y1 - l.y1) * (l.x2 - l.x1)) / ((l.x2 - l.x1) * (e.y2 - e.y1) - (l.y2 - l.y1) * (e.x2 - e.x1)) AS u
        FROM l JOIN mask_edges e ON e.prj = l.prj WHERE (l.x2 - l.x1) * (e.y2 - e.y1) - (l.y2 - l.y1) * (e.x2 - e.x1) <> 0),
    s AS (SELECT idx, 0::DOUBLE AS t FROM l UNION ALL SELECT idx, 1 FROM l UNION ALL SELECT idx, t FROM c WHERE t > 0 AND t < 1 AND u BETWEEN 0 AND 1),
    p AS (SELECT idx, t AS a, lead(t) OVER (PARTITION BY idx ORDER BY t) AS b FROM s),
    i AS (SELECT l.idx, a, b, l.x1, l.y1, l.x2, l.y2 FROM p JOIN l ON l.idx = p.idx JOIN mask_edges e ON e.prj = l.prj WHERE b > a GROUP BY ALL
        HAVING {_INSIDE.format(x="(l.x1 + (l.x2 - l.x1) * ((a + b) / 2))", y="(l.y1 + (l.y2 - l.y1) * ((a + b) / 2))")})"""


@query("clip_to_polygon", f"{_PIECES} SELECT idx, count(*) AS parts, round(sum(b - a) * any_value(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 5) AS inside_length FROM i GROUP BY idx")
def _(v):
    (x1, y1), (x2, y2) = _ab()
    longer = v.lines.withColumns({"x2": x1 + (x2 - x1) * 20, "y2": y1 + (y2 - y1) * 20}).join(v.masks, "prj")
    out = lines.clip_to_polygon(longer).where(F.size("parts") > 0)
    return out.select("idx", F.size("parts").cast("long").alias("parts"), F.round("inside_length", 5).alias("inside_length"))


@query(
    "order_points",
    """WITH k AS (SELECT idx, x1 AS ax, y1 AS ay, x1 + 4 AS bx, y1 + 1 AS by, x1 + 3 AS cx, y1 + 5 AS cy, x1 - 1 AS dx, y1 + 4 AS dy FROM lines)
    SELECT idx, round(ax, 6) AS tlx, round(bx, 6) AS trx, round(cx, 6) AS brx, round(dx, 6) AS blx FROM k""",
)
def _(v):
    x, y = F.col("x1"), F.col("y1")
    corners = F.array(pt(x + 3, y + 5), pt(x, y), pt(x - 1, y + 4), pt(x + 4, y + 1))
    p = geometry.order_points(corners)
    return v.lines.select("idx", *[r6(F.get(p, F.lit(i))["x"], n) for i, n in enumerate(("tlx", "trx", "brx", "blx"))])


@query("major_axis", "SELECT idx, round(greatest(sqrt(2.0 * 2 + (w + 1) * (w + 1)), w) * 1.84, 6) AS len_cm FROM (SELECT idx, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) AS w FROM lines)")
def _(v):
    w = geometry.distance(*_ab())
    z = F.lit(0.0)
    corners = F.array(pt(z, z), pt(w, z), pt(w + 2, w + 1), pt(z + 2, w + 1))
    return v.lines.select("idx", r6(geometry.major_axis(corners, F.lit(1.84)), "len_cm"))


@query("contour_line", "SELECT idx, round(x1 - sin(radians(d)) * y1 / 4, 6) AS ax, round(y1 + cos(radians(d)) * y1 / 4, 6) AS ay, round(x1 + sin(radians(d)) * y1 / 4, 6) AS bx, round(y1 - cos(radians(d)) * y1 / 4, 6) AS by FROM lines")
def _(v):
    (ax, ay), (bx, by) = geometry.contour_line((F.col("x1"), F.col("y1")), F.col("y1"), F.col("d"))
    return v.lines.select("idx", r6(ax, "ax"), r6(ay, "ay"), r6(bx, "bx"), r6(by, "by"))


@query("project_point", "SELECT idx, round(x1 + sin(radians(d + 270)) * 100, 6) AS px, round(y1 + cos(radians(d + 270)) * 100, 6) AS py FROM lines")
def _(v):
    px, py = geometry.project_point((F.col("x1"), F.col("y1")), F.col("d") + 270, 100.0)
    return v.lines.select("idx", r6(px, "px"), r6(py, "py"))


def _utm_sql() -> str:
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    ep2 = e2 / (1 - e2)
    d = lambda x: f"({x!r}::DOUBLE)"
    return f"""WITH p AS (SELECT prj, xmin AS x, CASE WHEN substr(epsg, 6, 3) = '327' THEN ymin - 10000000 ELSE ymin END AS y, substr(epsg, 9)::INT AS zone FROM projects),
    m AS (SELECT *, y / {d(k0 * a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))} AS mu FROM p),
    q AS (SELECT *, mu + {d(3 * e1 / 2 - 27 * e1**3 / 32)} * sin(2 * mu) + {d(21 * e1**2 / 16 - 55 * e1**4 / 32)} * sin(4 * mu) + {d(151 * e1**3 / 96)} * sin(6 * mu) + {d(1097 * e1**4 / 512)} * sin(8 * mu) AS phi FROM m),
    s AS (SELECT *, {d(ep2)} * cos(phi) ** 2 AS c1, tan(phi) ** 2 AS t1, {d(a)} / sqrt(1 - {d(e2)} * sin(phi) ** 2) AS n1, {d(a * (1 - e2))} / (1 - {d(e2)} * sin(phi) ** 2) ** 1.5 AS r1 FROM q),
    u AS (SELECT *, (x - 500000) / (n1 * {d(k0)}) AS d FROM s)
    SELECT prj, round(degrees((d - (1 + 2 * t1 + c1) * d ** 3 / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 ** 2 + 8 * {d(ep2)} + 24 * t1 ** 2) * d ** 5 / 120) / cos(phi)) + zone * 6 - 183, 6) AS lon,
        round(degrees(phi - n1 * tan(phi) / r1 * (d ** 2 / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 ** 2 - 9 * {d(ep2)}) * d ** 4 / 24 + (61 + 90 * t1 + 298 * c1 + 45 * t1 ** 2 - 252 * {d(ep2)} - 3 * c1 ** 2) * d ** 6 / 720)), 6) AS lat FROM u"""


@query("utm_to_wgs84", _utm_sql())
def _(v):
    lon, lat = geometry.utm_to_wgs84(F.get("image_extents", F.lit(0)), F.get("image_extents", F.lit(1)), names.epsg_code(F.col("epsg")))
    return v.projects.select("prj", r6(lon, "lon"), r6(lat, "lat"))


# Contours

_EDGES = "(SELECT contour_id, prj, col, row, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS u, coalesce(lead(y) OVER w, first(y) OVER w) AS v FROM contours WINDOW w AS (PARTITION BY contour_id ORDER BY i))"


@query(
    "contour_measures",
    f"""SELECT contour_id, round(abs(sum(x * v - u * y) / 2.0), 6) AS area, round(sum((x + u) * (x * v - u * y)) / 6.0::DOUBLE * CASE WHEN sum(x * v - u * y) < 0 THEN -1 ELSE 1 END, 4) AS m10,
    round(sum((y + v) * (x * v - u * y)) / 6.0::DOUBLE * CASE WHEN sum(x * v - u * y) < 0 THEN -1 ELSE 1 END, 4) AS m01, min(x) AS bx, min(y) AS by, max(x) - min(x) AS bw, max(y) - min(y) AS bh FROM {_EDGES} GROUP BY contour_id""",
)
def _(v):
    m = contours.contour_measures(v.contours)
    return m.select("contour_id", r6(F.col("area"), "area"), F.round("m10", 4).alias("m10"), F.round("m01", 4).alias("m01"), "bx", "by", "bw", "bh")


_AREAS = f"(SELECT prj, col, row, contour_id, abs(sum(x * v - u * y) / 2.0) AS area, min(x) AS bx, min(y) AS by, max(x) - min(x) AS w, max(y) - min(y) AS h FROM {_EDGES} GROUP BY ALL)"


@query("filter_contours", f"SELECT contour_id FROM {_AREAS} WHERE w > 20 AND h > 20")
def _(v):
    boxes = contours.contour_measures(v.contours).select("contour_id", F.col("bw").alias("w"), F.col("bh").alias("h"))
    return contours.filter_contours(boxes).select("contour_id")


@query("top_contours", f"SELECT * FROM (SELECT prj, col, row, contour_id, row_number() OVER (PARTITION BY prj, col, row ORDER BY area DESC, contour_id) AS rank FROM {_AREAS}) WHERE rank <= 10")
def _(v):
    return contours.top_contours(contours.contour_measures(v.contours), *TILE).select(*TILE, "contour_id", "rank")


for _m, _o in (("left-to-right", "bx"), ("right-to-left", "bx DESC"), ("top-to-bottom", '"by"'), ("bottom-to-top", '"by" DESC')):
    query(f"sort_contours_{_m.replace('-', '_')}", f"SELECT prj, col, row, contour_id, row_number() OVER (PARTITION BY prj, col, row ORDER BY {_o}, contour_id) AS place FROM {_AREAS}")(
        lambda v, m=_m: contours.sort_contours(contours.contour_measures(v.contours), *TILE, method=m).select(*TILE, "contour_id", "place")
    )


@query(
    "close_contours",
    """SELECT DISTINCT a.prj, a.col, a.row, a.contour_id AS a, b.contour_id AS b FROM contours a JOIN contours b ON a.prj = b.prj AND a.col = b.col AND a.row = b.row AND a.contour_id < b.contour_id
    WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 1""",
)
def _(v):
    return blocks.pairs_of(contours.close_lists(v.contours, *TILE), *TILE)


@query(
    "ombb",
    """WITH e AS (SELECT DISTINCT prj, round(((degrees(atan2(y2 - y1, x2 - x1)) % 90) + 90) % 90, 9) AS angle FROM mask_edges),
    b AS (SELECT e.prj, angle, min(x1 * cos(radians(angle)) + y1 * sin(radians(angle))) AS u0, max(x1 * cos(radians(angle)) + y1 * sin(radians(angle))) AS u1,
        min(y1 * cos(radians(angle)) - x1 * sin(radians(angle))) AS v0, max(y1 * cos(radians(angle)) - x1 * sin(radians(angle))) AS v1 FROM e JOIN mask_edges m ON m.prj = e.prj GROUP BY ALL),
    k AS (SELECT *, round((u1 - u0) * (v1 - v0), 6) AS area FROM b)
    SELECT prj, angle, area, round(u0, 6) AS u0, round(u1, 6) AS u1, round(v0, 6) AS v0, round(v1, 6) AS v1 FROM (SELECT *, row_number() OVER (PARTITION BY prj ORDER BY area, angle) AS i FROM k) WHERE i = 1""",
)
def _(v):
    points = v.masks.select("prj", F.explode("ring").alias("p")).select("prj", "p.x", "p.y")
    o = contours.ombb(contours.convex_hulls(points, "prj"), "prj")
    return o.select("prj", "angle", "area", *[r6(F.col(c), c) for c in ("u0", "u1", "v0", "v1")])


# Shapes without an SQL form; tests hold them against invariants.


_CONTOUR_PTS = "p AS (SELECT DISTINCT contour_id, x::DOUBLE AS x, y::DOUBLE AS y FROM contours)"


@query(
    "contour_rectangles",
    f"""WITH {_CONTOUR_PTS},
    e AS (SELECT DISTINCT contour_id, round(((degrees(atan2(v - y, u - x)) % 90) + 90) % 90, 9) AS angle FROM (
        SELECT a.contour_id, a.x, a.y, b.x AS u, b.y AS v FROM p a JOIN p b ON a.contour_id = b.contour_id AND (a.x <> b.x OR a.y <> b.y) JOIN p r ON r.contour_id = a.contour_id GROUP BY a.contour_id, a.x, a.y, b.x, b.y
        HAVING bool_and((b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x) >= 0))),
    t AS (SELECT e.contour_id, angle, max(x * cos(radians(angle)) + y * sin(radians(angle))) - min(x * cos(radians(angle)) + y * sin(radians(angle))) AS h,
        max(y * cos(radians(angle)) - x * sin(radians(angle))) - min(y * cos(radians(angle)) - x * sin(radians(angle))) AS w FROM e JOIN p ON p.contour_id = e.contour_id GROUP BY e.contour_id, angle)
    SELECT contour_id, round(w, 5) AS w, round(h, 5) AS h, round(angle - 90, 5) AS rect_angle FROM t QUALIFY row_number() OVER (PARTITION BY contour_id ORDER BY round(w * h, 6), angle) = 1""",
)
def _(v):
    out = shapes.min_rectangles(v.contours, "contour_id")
    return out.select("contour_id", *[F.round(c, 5).alias(c) for c in ("w", "h", "rect_angle")])


@query(
    "contour_circles",
    f"""WITH {_CONTOUR_PTS},
    c AS (
        SELECT a.contour_id, (a.x + b.x) / 2 AS x, (a.y + b.y) / 2 AS y, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 2 AS r FROM p a JOIN p b ON a.contour_id = b.contour_id AND (a.x, a.y) <= (b.x, b.y)
        UNION ALL SELECT contour_id, ax + (cy * b2 - byy * c2) / d, ay + (bxx * c2 - cx * b2) / d, sqrt((cy * b2 - byy * c2) ** 2 + (bxx * c2 - cx * b2) ** 2) / abs(d) FROM (
            SELECT a.contour_id, a.x AS ax, a.y AS ay, b.x - a.x AS bxx, b.y - a.y AS byy, k.x - a.x AS cx, k.y - a.y AS cy, 2 * ((b.x - a.x) * (k.y - a.y) - (b.y - a.y) * (k.x - a.x)) AS d,
                (b.x - a.x) ** 2 + (b.y - a.y) ** 2 AS b2, (k.x - a.x) ** 2 + (k.y - a.y) ** 2 AS c2
            FROM p a JOIN p b ON a.contour_id = b.contour_id AND (a.x, a.y) < (b.x, b.y) JOIN p k ON k.contour_id = a.contour_id AND (b.x, b.y) < (k.x, k.y)) WHERE d <> 0),
    ok AS (SELECT c.contour_id, c.x, c.y, c.r FROM c JOIN p ON p.contour_id = c.contour_id GROUP BY c.contour_id, c.x, c.y, c.r HAVING bool_and(sqrt((p.x - c.x) ** 2 + (p.y - c.y) ** 2) <= c.r + 1e-9))
    SELECT contour_id, round(arg_min(x, r), 5) AS x, round(arg_min(y, r), 5) AS y, round(min(r), 5) AS r FROM ok GROUP BY contour_id""",
)
def _(v):
    c = v.contours.select("contour_id", shapes.min_circle(F.col("pts")).alias("c"))
    return c.select("contour_id", *[F.round(f"c.{k}", 5).alias(k) for k in "xyr"])


def _ellipse_sql() -> str:
    """The five equations of the conic from sums of powers, solved row by row, then the long axis."""
    terms = [(2, 0), (1, 1), (0, 2), (1, 0), (0, 1), (0, 0)]
    power = lambda i, j: "1.0::DOUBLE" + " * u" * i + " * w" * j
    first = ", ".join(f"sum({power(p[0] + q[0], p[1] + q[1])}) AS m{i}{j}" for i, p in enumerate(terms[:5]) for j, q in enumerate(terms))
    steps = []
    for k in range(5):
        lead = lambda j, k=k: f"m{k}{j} / m{k}{k}"
        cells = ", ".join(f"{lead(j)} AS m{i}{j}" if i == k else f"m{i}{j} - m{i}{k} * ({lead(j)}) AS m{i}{j}" for i in range(5) for j in range(6))
        steps.append(f"e{k + 1} AS MATERIALIZED (SELECT contour_id, n, {cells} FROM e{k} WHERE abs(m{k}{k}) > 1e-9)")
    return f"""WITH p AS (SELECT contour_id, x::DOUBLE AS x, y::DOUBLE AS y FROM contours),
        f AS (SELECT contour_id, avg(x) AS mx, avg(y) AS my, greatest(max(x) - avg(x), avg(x) - min(x), max(y) - avg(y), avg(y) - min(y)) AS far FROM p GROUP BY contour_id),
        uw AS (SELECT contour_id, (x - mx) / CASE WHEN far > 0 THEN far ELSE 1 END AS u, (y - my) / CASE WHEN far > 0 THEN far ELSE 1 END AS w FROM p JOIN f USING (contour_id)),
        e0 AS MATERIALIZED (SELECT contour_id, count(*) AS n, {first} FROM uw GROUP BY contour_id), {", ".join(steps)}
        SELECT f.contour_id, round(CASE WHEN n >= 5 AND m15 * m15 - 4 * m05 * m25 < 0 THEN ((degrees(atan2(m15 * sign(m05), (m05 - m25) * sign(m05)) / 2) % 180) + 180) % 180 END, 3) AS angle FROM f LEFT JOIN e5 USING (contour_id)"""


@query("contour_ellipses", _ellipse_sql())
def _(v):
    return shapes.contour_ellipse_angles(v.contours, "contour_id").select("contour_id", F.round("angle", 3).alias("angle"))


@query("contour_shapes")
def _(v):
    return shapes.contour_shapes(v.contours, "contour_id")


@query("smooth_contours")
def _(v):
    return contours.smooth_contours(v.contours)


_AREAS = """WITH RECURSIVE s AS (SELECT prj, col, row, px, py, px - row_number() OVER (PARTITION BY prj, col, row, py ORDER BY px) AS g FROM bpix WHERE mask > 0),
    runs AS (SELECT prj, col, row, py, g, min(px) AS x0, max(px) AS x1, py * 2147483648 + min(px) AS id FROM s GROUP BY prj, col, row, py, g),
    e AS (SELECT a.prj, a.col, a.row, a.id AS a, b.id AS b FROM runs a JOIN runs b ON a.prj = b.prj AND a.col = b.col AND a.row = b.row AND abs(a.py - b.py) <= 1 AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1),
    lab(k, prj, col, row, id, l) AS (
        SELECT 0, prj, col, row, id, id FROM runs
        UNION ALL SELECT any_value(k) + 1, r.prj, r.col, r.row, e.b, min(r.l) FROM lab r JOIN e ON e.prj = r.prj AND e.col = r.col AND e.row = r.row AND e.a = r.id WHERE k < 400 GROUP BY r.prj, r.col, r.row, e.b),
    named AS (SELECT r.prj, r.col, r.row, r.py, r.g, l AS label, sum(x1 - x0 + 1) OVER (PARTITION BY r.prj, r.col, r.row, l) AS area FROM runs r JOIN lab ON lab.prj = r.prj AND lab.col = r.col AND lab.row = r.row AND lab.id = r.id AND k = 400)
    SELECT prj, col, row, px, py, label, CAST(area AS BIGINT) AS area FROM s JOIN named USING (prj, col, row, py, g) WHERE area >= 4"""


@query("components", _AREAS)
def _(v):
    found = regions.components(v.bpix.where("mask > 0"), *TILE, least_area=4)
    return found.select(*_AT, "label", "area")


_AWAY = """SELECT p.prj, p.col, p.row, p.px, p.py, coalesce(min((p.px - u.px) ** 2 + (p.py - u.py) ** 2), 0) AS d2
    FROM bpix p LEFT JOIN bpix u ON u.mask = 0 AND u.prj = p.prj AND u.col = p.col AND u.row = p.row GROUP BY ALL"""


@query("distance_transform", f"SELECT prj, col, row, px, py, round(sqrt(d2), 6) AS distance FROM ({_AWAY})")
def _(v):
    return regions.distances(v.bpix, *TILE).select(*_AT, r6(F.col("distance"), "distance"))


@query(
    "distance_mask",
    f"""WITH a AS (SELECT *, sqrt(d2) AS d FROM ({_AWAY})), m AS (SELECT prj, col, row, min(d) AS lo, max(d) AS hi FROM a GROUP BY ALL)
    SELECT prj, col, row, px, py, CASE WHEN hi > lo AND (d - lo) / (hi - lo) >= 0.4 THEN 255 ELSE 0 END AS core FROM a JOIN m USING (prj, col, row)""",
)
def _(v):
    return regions.distance_mask(v.bpix, *TILE).select(*_AT, "core")


def _edge_sql() -> str:
    """Each side of each set pixel between set and unset, with the side that follows, from the eight pixels around it."""
    around = ", ".join(f"coalesce(max(CASE WHEN n.px - p.px = {dx} AND n.py - p.py = {dy} THEN 1 END), 0) AS n{dx + 1}{dy + 1}" for dx in (-1, 0, 1) for dy in (-1, 0, 1))
    bit = lambda d: f"n{d[0] + 1}{d[1] + 1} = 1"
    # side, what lies outside it, ahead on the right, ahead on the left, the side after a right turn, the side after a left turn
    sides = [(0, (0, -1), (-1, -1), (-1, 0), 3, 1), (1, (-1, 0), (-1, 1), (0, 1), 0, 2), (2, (0, 1), (1, 1), (1, 0), 1, 3), (3, (1, 0), (1, -1), (0, -1), 2, 0)]
    pick = lambda r, l, a, b, c: f"CASE WHEN {bit(r)} THEN {a} WHEN {bit(l)} THEN {b} ELSE {c} END"
    each = [
        f"SELECT prj, col, row, px, py, {s} AS side, px + {pick(r, l, r[0], l[0], 0)} AS next_x, py + {pick(r, l, r[1], l[1], 0)} AS next_y, {pick(r, l, a, s, b)} AS next_side FROM n WHERE NOT {bit(o)}"
        for s, o, r, l, a, b in sides
    ]
    return f"""WITH n AS (SELECT p.prj, p.col, p.row, p.px, p.py, {around} FROM bpix p JOIN bpix n ON n.prj = p.prj AND n.col = p.col AND n.row = p.row AND n.mask > 0
        AND n.px BETWEEN p.px - 1 AND p.px + 1 AND n.py BETWEEN p.py - 1 AND p.py + 1 WHERE p.mask > 0 GROUP BY ALL) {" UNION ALL ".join(each)}"""


@query("border_edges", _edge_sql())
def _(v):
    return regions.border_edges(v.bpix.where("mask > 0"), *TILE)


@query("tile_pipeline")
def _(v):
    from furrow.operators.kernels import tile_images, tile_pipeline

    out = tile_pipeline(tile_images(v.tpix).withColumn("pixel_m", F.lit(20.0 / TILE_PX)))
    return out.select(*TILE, "w", "h", F.sha2("mask", 256).alias("mask_sha"), F.sha2("index", 256).alias("index_sha"))


# Angles


@query("filter_angles", "SELECT contour_id, round(angle, 6) AS angle, row FROM angles WHERE angle BETWEEN [-90, -45, 0, 90][seed] - 3 AND [90, 45, 90, 180][seed] + 3")
def _(v):
    return angles.filter_angles(v.angles).select("contour_id", r6(F.col("angle"), "angle"), "row")


_TOP = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prj, col, row ORDER BY area DESC, contour_id, angle) AS rank FROM angles WHERE angle BETWEEN [-90, -45, 0, 90][seed] - 3 AND [90, 45, 90, 180][seed] + 3) WHERE rank <= 10)"
_STATS = "(SELECT prj, col, row, count(*) AS n, stddev_pop(angle) AS std, max(angle) AS max, min(angle) AS min, avg(angle) AS avg, CASE WHEN count(*) > 7 AND round(stddev_pop(angle), 9) <= 3 THEN avg(angle) ELSE 'nan'::DOUBLE END AS angle FROM {} GROUP BY ALL)"


def _top_angles(v):
    from pyspark.sql import Window

    order = Window.partitionBy(*TILE).orderBy(F.desc("area"), "contour_id", "angle")
    return angles.filter_angles(v.angles).withColumn("rank", F.row_number().over(order)).where("rank <= 10")


@query("tile_angles", f"SELECT prj, col, row, n, round(std, 6) AS std, round(max, 6) AS max, round(min, 6) AS min, round(avg, 6) AS avg, CASE WHEN isnan(angle) THEN NULL ELSE round(angle, 6) END AS angle FROM {_STATS.format(_TOP)}")
def _(v):
    t = angles.tile_angles(_top_angles(v), *TILE)
    angle = F.when(~F.isnan("angle"), F.round("angle", 6)).alias("angle")
    return t.select(*TILE, "n", *[r6(F.col(c), c) for c in ("std", "max", "min", "avg")], angle)




@query(
    "rect_angles",
    f"""SELECT prj, col, row, n, CASE WHEN isnan(angle) THEN NULL ELSE round(angle, 6) END AS angle FROM
    {_STATS.format("(SELECT prj, col, row % 3 AS row, rect_angle / 10 AS angle FROM angles)")}""",
)
def _(v):
    near = v.angles.select("prj", "col", (F.col("row") % 3).alias("row"), (F.col("rect_angle") / 10).alias("rect_angle"))
    t = angles.rect_angles(near, *TILE)
    return t.select(*TILE, "n", F.when(~F.isnan("angle"), F.round("angle", 6)).alias("angle"))


@query(
    "field_angle",
    f"""WITH t AS {_STATS.format("(SELECT prj, seed AS col, row % 3 AS row, rect_angle / 10 AS angle FROM angles)")}
    SELECT prj, round(avg(angle) FILTER (NOT isnan(angle)), 6) AS angle_mean, round(stddev_pop(angle) FILTER (NOT isnan(angle)), 6) AS angle_std FROM t GROUP BY prj""",
)
def _(v):
    near = v.angles.select("prj", F.col("seed").alias("col"), (F.col("row") % 3).alias("row"), (F.col("rect_angle") / 10).alias("angle"))
    f = angles.field_angle(angles.tile_angles(near, *TILE), "prj")
    return f.select("prj", r6(F.col("angle_mean"), "angle_mean"), r6(F.col("angle_std"), "angle_std"))


@query("fallback_angle", "SELECT prj, col, row, round(avg(rect_angle), 6) AS angle FROM angles GROUP BY ALL")
def _(v):
    return angles.fallback_angle(v.angles, *TILE).select(*TILE, r6(F.col("angle"), "angle"))


@query("tile_filter_expr", """SELECT prj, '"colrow" in (' || array_to_string(list_sort(list(DISTINCT '''' || col || '_' || row || '''')), ',') || ')' AS expr FROM angles GROUP BY prj""")
def _(v):
    return angles.tile_filter_expr(v.angles.withColumn("colrow", names.colrow(F.col("col"), F.col("row"))), "prj")


@query("angle_report", f"SELECT col || '_' || row AS tile, round(angle, 6) AS angle FROM {_STATS.format(_TOP)} WHERE NOT isnan(angle)")
def _(v):
    t = angles.tile_angles(_top_angles(v), *TILE).withColumn("colrow", names.colrow(F.col("col"), F.col("row")))
    return angles.angle_report(t).select("tile", r6(F.col("angle"), "angle"))


# Lines


@query("candidate_lines", "SELECT idx, round(cx * 0.02 + 1000 + 20 * (col - 1), 6) AS mid_x, round((cx - sin(radians(d)) * len / 4) * 0.02 + 1000 + 20 * (col - 1), 6) AS ini_x, round((cy - cos(radians(d)) * len / 4) * -0.02 + 2000 - 20 * (row - 1), 6) AS end_y FROM (SELECT *, x1 AS cx, y1 AS cy, y2 - 2 AS len FROM lines) WHERE len > 1")
def _(v):
    c = v.lines.select("idx", "col", "row", F.col("x1").alias("cx"), F.col("y1").alias("cy"), (F.col("y2") - 2).alias("len_cm"), F.col("d").alias("angle"))
    facts = {"psx": F.lit(0.02), "psy": F.lit(-0.02), "xmin": F.lit(1000.0), "ymax": F.lit(2000.0)}
    return lines.candidate_lines(c.withColumns(facts)).select("idx", *[r6(F.col(c), c) for c in ("mid_x", "ini_x", "end_y")])


@query("prev_center_distance", "SELECT idx, round(coalesce(sqrt((x1 - lag(x1) OVER w) ** 2 + (y1 - lag(y1) OVER w) ** 2), 1), 6) AS d FROM lines WINDOW w AS (PARTITION BY prj, col, row ORDER BY idx)")
def _(v):
    c = v.lines.select(*TILE, F.col("idx").alias("lcount"), F.col("x1").alias("cx"), F.col("y1").alias("cy"))
    return lines.prev_center_distance(c, *TILE).select(F.col("lcount").alias("idx"), r6(F.col("d"), "d"))


@query("line_points", "SELECT idx, 'mid' AS typepoint, round((x1 + x2) / 2, 6) AS x FROM lines UNION ALL SELECT idx, 'ini', round(x1, 6) FROM lines UNION ALL SELECT idx, 'end', round(x2, 6) FROM lines")
def _(v):
    l = v.lines.select("idx", ((F.col("x1") + F.col("x2")) / 2).alias("mid_x"), F.lit(0.0).alias("mid_y"), F.col("x1").alias("ini_x"), F.col("y1").alias("ini_y"), F.col("x2").alias("end_x"), F.col("y2").alias("end_y"))
    return lines.line_points(l).select("idx", "typepoint", r6(F.col("x"), "x"))


@query("merge_lines", "SELECT idx, prj FROM lines")
def _(v):
    return lines.merge_lines(*[v.lines.where(F.col("col") == c).select("idx", "prj") for c in range(1, 5)])


@query("merge_raw_points", "SELECT contour_id, n AS size, NULL::VARCHAR AS col FROM contours WHERE i = 1 AND col < 5 UNION ALL SELECT contour_id, n, col::VARCHAR FROM contours WHERE i = 1 AND col >= 5 AND n > 3")
def _(v):
    low = v.contours.where("col < 5").select("contour_id", "pts")
    high = v.contours.where("col >= 5").select("contour_id", "col", F.when(F.size("pts") > 3, F.col("pts")).alias("pts"))
    return lines.merge_raw_points(low, high, coords="pts").select("contour_id", F.size("pts").cast("long").alias("size"), F.col("col").cast("string").alias("col"))


@query("line_vertices", "SELECT contour_id::VARCHAR AS contour_id, col::VARCHAR AS col, (i - 1)::INT AS vertex, x, y FROM contours")
def _(v):
    return lines.line_vertices(v.contours.withColumnRenamed("pts", "coords"), "contour_id", "col")


@query("to_segments", "SELECT * FROM (SELECT contour_id, (i - 1)::INT AS part, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM contours WINDOW w AS (PARTITION BY contour_id ORDER BY i)) WHERE x2 IS NOT NULL")
def _(v):
    return lines.to_segments(v.contours.withColumnRenamed("pts", "coords"), "contour_id")


@query("lines_with_bounds", "SELECT idx, seed, xmin, ymax FROM lines JOIN tiles USING (prj, col, row)")
def _(v):
    return lines.lines_with_bounds(v.lines, v.tiles).select("idx", "seed", "xmin", "ymax")


_AZ = "CASE WHEN degrees(atan2(x2 - x1, y2 - y1)) <= 0 THEN degrees(atan2(x2 - x1, y2 - y1)) + 360 ELSE degrees(atan2(x2 - x1, y2 - y1)) END"
def _seeded(cut: str) -> str:
    """The lines of a table with the point (sx, sy) that their tile's seed sets."""
    return f"""(SELECT *, CASE seed WHEN 1 THEN (xmin + xmax) / 2 WHEN 2 THEN xmin WHEN 3 THEN xmin + sin(radians(az + 270)) * 100 ELSE xmax + sin(radians(az + 270)) * 100 END AS sx,
    CASE seed WHEN 1 THEN ymax WHEN 2 THEN (ymin + ymax) / 2 ELSE ymax + cos(radians(az + 270)) * 100 END AS sy FROM (SELECT *, first({_AZ}) OVER (PARTITION BY prj, col, row ORDER BY idx) AS az FROM {cut}))"""


_SEEDED = _seeded(_TILE_CUT)


@query("seed_point", f"SELECT DISTINCT prj, col, row, round(sx, 5) AS sx, round(sy, 5) AS sy FROM {_SEEDED}")
def _(v):
    cut = lines.clip_lines_to_box(lines.extend_lines(lines.lines_with_bounds(v.lines, v.tiles)))
    first = lines.first_line(cut, *TILE, order="idx")
    px, py = lines.seed_point(F.col("seed"), geometry.azimuth(*_ab()))
    return first.select(*TILE, F.round(px, 5).alias("sx"), F.round(py, 5).alias("sy"))


@query("valid_lines", "SELECT idx FROM lines WHERE sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) > 3.18")
def _(v):
    return lines.valid_lines(v.lines, 3.18).select("idx")


@query("first_line", "SELECT prj, col, row, min(idx) AS idx FROM lines GROUP BY ALL")
def _(v):
    return lines.first_line(v.lines, *TILE, order="idx").select(*TILE, "idx")


@query("distinct_sorted", "SELECT DISTINCT prj, d FROM dists")
def _(v):
    return lines.distinct_sorted(v.dists, "prj")


_GAP = "(SELECT prj, d FROM (SELECT prj, d, coalesce(lag(d) OVER (PARTITION BY prj ORDER BY d), 0) AS b FROM {}) WHERE abs(d - b) >= {})"


@query("gap_filter", f"SELECT prj, d FROM {_GAP.format('(SELECT DISTINCT prj, d FROM dists)', 1.3)}")
def _(v):
    return lines.gap_filter(lines.distinct_sorted(v.dists, "prj"), "prj")


_SPANS = """o AS (SELECT prj, d, row_number() OVER (PARTITION BY prj ORDER BY d) AS i FROM (SELECT DISTINCT prj, d FROM {})),
    g(prj, i, d, first, grp) AS (SELECT prj, i, d, d, 0 FROM o WHERE i = 1 UNION ALL
        SELECT o.prj, o.i, o.d, CASE WHEN o.d - g.first <= 1.3 THEN g.first ELSE o.d END, CASE WHEN o.d - g.first <= 1.3 THEN g.grp ELSE g.grp + 1 END FROM g JOIN o ON o.prj = g.prj AND o.i = g.i + 1),
    spans AS (SELECT prj, grp, max(d) AS d FROM g GROUP BY prj, grp)"""


@query("span_groups", f"WITH RECURSIVE {_SPANS.format('dists')} SELECT prj, grp, d FROM spans")
def _(v):
    return lines.span_groups(v.dists, "prj")


@query("span_groups_in_ranges", f"WITH RECURSIVE {_SPANS.format('dists')} SELECT prj, grp, d FROM spans")
def _(v):
    return ordered.span_groups(ordered.order_values(lines.distinct_sorted(v.dists, "prj"), "prj"), "prj").drop("part")


@query("gap_filter_in_ranges", "SELECT prj, d, row_number() OVER (PARTITION BY prj ORDER BY d) - 1 AS id FROM (SELECT prj, d, coalesce(lag(d) OVER (PARTITION BY prj ORDER BY d), 0) AS b FROM (SELECT DISTINCT prj, d FROM dists)) WHERE abs(d - b) >= 1.3")
def _(v):
    kept = ordered.gap_filter(ordered.order_values(lines.distinct_sorted(v.dists, "prj"), "prj"), "prj")
    return ordered.numbered(kept, "prj").select("prj", "d", F.col("id").cast("long").alias("id"))


@query("first_index_of", "SELECT prj, d, min(idx) AS idx FROM dists GROUP BY ALL")
def _(v):
    return lines.first_index_of(lines.distinct_sorted(v.dists, "prj"), v.dists, "prj")


@query("number_lines", "SELECT prj, idx, row_number() OVER (PARTITION BY prj ORDER BY d, idx) - 1 AS id FROM dists")
def _(v):
    return lines.number_lines(v.dists, "prj", order=("d", "idx")).select("prj", "idx", F.col("id").cast("long").alias("id"))


@query(
    "clean_tile_lines",
    f"""WITH m AS (SELECT *, round(sqrt((sx - (x1 + x2) / 2) ** 2 + (sy - (y1 + y2) / 2) ** 2), 9) AS e FROM {_SEEDED} WHERE sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) > 0.4),
    u AS (SELECT DISTINCT prj, col, row, e FROM m), k AS (SELECT prj, col, row, e FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY prj, col, row ORDER BY e), 0) AS b FROM u) WHERE abs(e - b) >= 1.3),
    f AS (SELECT prj, col, row, e, min(idx) AS idx FROM k JOIN m USING (prj, col, row, e) GROUP BY ALL)
    SELECT prj, col, row, row_number() OVER (PARTITION BY prj, col, row ORDER BY e, idx) - 1 AS id, col || '_' || row AS colrow, idx, round(e, 5) AS d FROM f""",
)
def _(v):
    out = lines.clean_tile_lines(v.lines, v.tiles)
    return out.select(*TILE, F.col("id").cast("long").alias("id"), "colrow", "idx", F.round("d", 5).alias("d"))


_IN_BOX = f"(SELECT *, x1 * {_C30!r} + y1 * {_S30!r} AS u1, y1 * {_C30!r} - x1 * {_S30!r} AS v1, x2 * {_C30!r} + y2 * {_S30!r} AS u2, y2 * {_C30!r} - x2 * {_S30!r} AS v2 FROM {_TILE_CUT})"
_BOX_CUT = f"(SELECT prj, col, row, idx, seed, xmin, ymin, xmax, ymax, {_CUT} FROM {_box_sql(_IN_BOX, 'u1', 'v1', 'u2', 'v2', '20', '130', '20', '60')})"


@query(
    "tile_lines_in_box",
    f"""WITH m AS (SELECT *, sqrt((sx - (x1 + x2) / 2) ** 2 + (sy - (y1 + y2) / 2) ** 2) AS e, sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) AS n FROM {_seeded(_BOX_CUT)})
    SELECT prj, col, row, min(idx) AS idx, round(arg_min(n, idx), 6) AS length FROM m WHERE n > 0.4 GROUP BY prj, col, row, e""",
)
def _(v):
    boxed = v.tiles.withColumns({"angle": F.lit(30.0), "u0": F.lit(20.0), "u1": F.lit(130.0), "v0": F.lit(20.0), "v1": F.lit(60.0)})
    out = lines.clean_tile_lines(v.lines, boxed, gap=0.0)
    return out.select(*TILE, "idx", r6(geometry.distance(*_ab()), "length"))


# Rows


def _point_segment(px: str, py: str, x1: str, y1: str, x2: str, y2: str) -> str:
    t = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, (({px} - {x1}) * ({x2} - {x1}) + ({py} - {y1}) * ({y2} - {y1})) / (({x2} - {x1}) ** 2 + ({y2} - {y1}) ** 2)))"
    return f"sqrt(({px} - ({x1} + ({x2} - {x1}) * {t})) ** 2 + ({py} - ({y1} + ({y2} - {y1}) * {t})) ** 2)"


def _side(p: str, q: str, r: str) -> str:
    return f"sign(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"


def _pair(a: str, b: str) -> str:
    n = {"A": (f"{a}.x1", f"{a}.y1"), "B": (f"{a}.x2", f"{a}.y2"), "C": (f"{b}.x1", f"{b}.y1"), "D": (f"{b}.x2", f"{b}.y2")}
    side = lambda p, q, r: f"sign(({n[q][0]} - {n[p][0]}) * ({n[r][1]} - {n[p][1]}) - ({n[q][1]} - {n[p][1]}) * ({n[r][0]} - {n[p][0]}))"
    far = ", ".join(_point_segment(*n[p], *n[q], *n[r]) for p, q, r in (("A", "C", "D"), ("B", "C", "D"), ("C", "A", "B"), ("D", "A", "B")))
    return f"(CASE WHEN {side('A', 'B', 'C')} * {side('A', 'B', 'D')} < 0 AND {side('C', 'D', 'A')} * {side('C', 'D', 'B')} < 0 THEN 0 ELSE least({far}) END)"


_PAIRS = f"(SELECT a.prj, a.idx AS a, b.idx AS b FROM lines a JOIN lines b ON a.prj = b.prj AND a.idx < b.idx AND abs(a.x1 - b.x1) < 4 AND abs(a.y1 - b.y1) < 4 WHERE {_pair('a', 'b')} < 0.6)"


@query("overlap_pairs", f"SELECT prj, a, b FROM {_PAIRS}")
def _(v):
    return rows.overlap_pairs(v.lines, "prj")


_GROUPS = f"""p AS (SELECT prj, a, b FROM {_PAIRS} UNION ALL SELECT prj, b, a FROM {_PAIRS}), reach(a, b) AS (SELECT idx, idx FROM lines UNION SELECT r.a, p.b FROM reach r JOIN p ON p.a = r.b),
    grp AS (SELECT prj, idx, m AS grp FROM lines JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = idx)"""


@query("dissolve_groups", f"WITH RECURSIVE {_GROUPS} SELECT prj, idx, grp FROM grp")
def _(v):
    return rows.overlap_groups(v.lines, "prj")


@query(
    "group_centroids",
    f"""WITH RECURSIVE {_GROUPS}, w AS (SELECT g.prj, g.grp, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my, sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) AS w FROM grp g JOIN lines USING (idx))
    SELECT prj, grp, round(sum(mx * w) / sum(w), 6) AS x, round(sum(my * w) / sum(w), 6) AS y FROM w GROUP BY ALL""",
)
def _(v):
    groups = rows.overlap_groups(v.lines, "prj")
    return rows.group_centroids(v.lines, groups, "prj").select("prj", "grp", r6(F.col("x"), "x"), r6(F.col("y"), "y"))


@query("dissolved_areas")
def _(v):
    return buffers.dissolved_areas(rows.dissolved_borders(v.lines, "prj"), "prj").select("prj", "grp", *[r6(F.col(c), c) for c in ("area", "x", "y")])


@query("dissolved_rings")
def _(v):
    from furrow.sources.shared import checkpointed

    points = buffers.dissolved_rings(checkpointed(rows.dissolved_borders(v.lines, "prj")), "prj")
    return points.select("prj", "grp", F.col("ring.idx").alias("ring_idx"), F.col("ring.piece").alias("ring_piece"), "place", "step", r6(F.col("x"), "x"), r6(F.col("y"), "y"))


_NEAR = f"round({_point_segment('p.x', 'p.y', 'l.x1', 'l.y1', 'l.x2', 'l.y2')}, 9)"


@query("nearest_line", f"SELECT prj, point, idx, round(dist, 6) AS dist FROM (SELECT p.prj, point, idx, {_NEAR} AS dist, row_number() OVER (PARTITION BY p.prj, point ORDER BY {_NEAR}, idx) AS i FROM points p JOIN lines l ON l.prj = p.prj) WHERE i = 1")
def _(v):
    return rows.nearest_line(v.points, v.lines, "prj", cell=5.0).select("prj", "point", "idx", r6(F.col("dist"), "dist"))


@query("closest_to_probe", "SELECT prj, idx, round(dist, 6) AS dist FROM (SELECT prj, idx, round(sqrt((5000 - (x1 + x2) / 2) ** 2 + (7000 - (y1 + y2) / 2) ** 2), 9) AS dist, row_number() OVER (PARTITION BY prj ORDER BY round(sqrt((5000 - (x1 + x2) / 2) ** 2 + (7000 - (y1 + y2) / 2) ** 2), 9), idx) AS i FROM lines) WHERE i = 1")
def _(v):
    probes = v.lines.select("prj").distinct().select("prj", F.lit(5000.0).alias("x"), F.lit(7000.0).alias("y"))
    return rows.closest_to_probe(v.lines, probes, "prj").select("prj", "idx", r6(F.col("dist"), "dist"))


@query("select_lines", "SELECT prj, idx, d FROM lines JOIN (SELECT prj AS p, idx AS i FROM lines WHERE idx % 3 = 0 UNION ALL SELECT prj, idx FROM lines WHERE idx % 2 = 0) ON p = prj AND i = idx")
def _(v):
    chosen = v.lines.where("idx % 3 = 0").select("prj", "idx").union(v.lines.where("idx % 2 = 0").select("prj", "idx"))
    return rows.select_lines(chosen, v.lines, "prj").select("prj", "idx", "d")


_STAT = f"""WITH RECURSIVE {_SPANS.format("lines")}, s1 AS {_GAP.format("spans", 0.4)}, s2 AS {_GAP.format("s1", 0.9)}"""


@query("statistical_rows", f"{_STAT}, f AS (SELECT prj, d, min(idx) AS idx FROM s2 JOIN lines USING (prj, d) GROUP BY ALL) SELECT prj, d, idx, row_number() OVER (PARTITION BY prj ORDER BY d) - 1 AS id FROM f")
def _(v):
    return rows.statistical_rows(v.lines, "prj").select("prj", "d", "idx", F.col("id").cast("long").alias("id"))


@query("result_counts", f"{_STAT} SELECT prj, candidatelines, coalesce(resultinglines, 0) AS resultinglines FROM (SELECT prj, count(DISTINCT d) AS candidatelines FROM lines GROUP BY prj) LEFT JOIN (SELECT prj, count(*) AS resultinglines FROM s2 GROUP BY prj) USING (prj)")
def _(v):
    return rows.result_counts(v.lines, "prj")


@query(
    "geometric_rows",
    f"""WITH RECURSIVE {_GROUPS}, w AS (SELECT g.prj, g.grp, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my, sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) AS w FROM grp g JOIN lines USING (idx)),
    c AS (SELECT prj, grp AS point, sum(mx * w) / sum(w) AS x, sum(my * w) / sum(w) AS y FROM w GROUP BY ALL),
    n AS (SELECT p.prj, point, idx, row_number() OVER (PARTITION BY p.prj, point ORDER BY {_NEAR}, idx) AS i FROM c p JOIN lines l ON l.prj = p.prj AND abs(l.x1 - p.x) < 30 AND abs(l.y1 - p.y) < 30)
    SELECT prj, point AS grp, idx, row_number() OVER (PARTITION BY prj ORDER BY point) - 1 AS idg FROM n WHERE i = 1""",
)
def _(v):
    return rows.geometric_rows(v.lines, "prj").select("prj", "grp", "idx", F.col("idg").cast("long").alias("idg"))


# Manifests, indexes, masks


@query("result_manifest", f"{_STAT} SELECT l.prj, 'kml/' || l.prj AS kml, epsg, candidatelines, coalesce(resultinglines, 0) AS resultinglines FROM (SELECT prj, count(DISTINCT d) AS candidatelines FROM lines GROUP BY prj) l LEFT JOIN (SELECT prj, count(*) AS resultinglines FROM s2 GROUP BY prj) r USING (prj) JOIN projects p ON p.prj = l.prj")
def _(v):
    made = manifests.result_manifest(rows.result_counts(v.lines, "prj"), v.projects.withColumn("mask", F.lit("m")))
    return made.select("prj", "kml", "epsg", "candidatelines", "resultinglines")


@query(
    "tile_index",
    """WITH f AS (SELECT prj, '{"type":"Feature","properties":{"col":' || col || ',"row":' || row || '},"geometry":{"type":"Point","coordinates":[' || col || ',' || row || ']}}' AS f FROM grid)
    SELECT prj, '{"type":"FeatureCollection","features":[' || array_to_string(list_sort(list(f)), ',') || ']}' AS body FROM f GROUP BY prj""",
)
def _(v):
    g = grid.tile_grid(grid.grid_facts(v.projects))
    features = g.select("prj", names.feature(names.point_geojson(F.col("col"), F.col("row")), col=F.col("col"), row=F.col("row")).alias("feature"))
    return vectors.feature_collection(features, "prj")


@query("mask_edges", "SELECT prj, i - 1 AS i, x1, y1, x2, y2 FROM mask_edges")
def _(v):
    return vectors.mask_edges(v.masks).withColumn("i", F.col("i").cast("long"))


@query("with_project", "SELECT idx, epsg, round(psx, 6) AS psx FROM lines JOIN projects USING (prj)")
def _(v):
    facts = v.projects.select("prj", "epsg", r6(F.get("pixel_size", F.lit(0)), "psx"))
    return lines.with_project(v.lines, facts).select("idx", "epsg", "psx")


@query("catalog_filter", "SELECT p_partkey, p_type FROM part WHERE p_type IN (SELECT min(p_type) FROM part UNION ALL SELECT 'POLYGON')")
def _(v):
    part = v.table("part")
    types = [r[0] for r in part.agg(F.min("p_type")).collect()]
    return lines.catalog_filter(part, *types, "POLYGON", column="p_type").select("p_partkey", "p_type")


@query("locate_pixels", "SELECT p.prj, p.x, p.y, sum(CASE WHEN (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1 THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM pixels p JOIN mask_edges e ON e.prj = p.prj GROUP BY ALL")
def _(v):
    met = v.pixels.join(v.masks, "prj")
    return met.select(*PIX, geometry.in_ring(F.col("x").cast("double"), F.col("y").cast("double"), F.col("ring")).alias("inside"))


@query("convex_hull_bounds", "SELECT contour_id, min(x)::DOUBLE AS x0, max(x)::DOUBLE AS x1, min(y)::DOUBLE AS y0, max(y)::DOUBLE AS y1 FROM contours GROUP BY contour_id")
def _(v):
    hull = contours.contour_hulls(v.contours, "contour_id").select("contour_id", F.explode("hull").alias("p"))
    return hull.groupBy("contour_id").agg(F.min("p.x").alias("x0"), F.max("p.x").alias("x1"), F.min("p.y").alias("y0"), F.max("p.y").alias("y1"))


_VERTICES = """WITH p AS (SELECT DISTINCT contour_id, x::DOUBLE AS x, y::DOUBLE AS y FROM contours),
    e AS (SELECT a.contour_id, a.x, a.y FROM p a JOIN p b ON a.contour_id = b.contour_id AND (a.x <> b.x OR a.y <> b.y) JOIN p r ON r.contour_id = a.contour_id GROUP BY a.contour_id, a.x, a.y, b.x, b.y
        HAVING bool_and((b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x) > 0 OR ((b.x - a.x) * (r.y - a.y) = (b.y - a.y) * (r.x - a.x) AND r.x BETWEEN least(a.x, b.x) AND greatest(a.x, b.x) AND r.y BETWEEN least(a.y, b.y) AND greatest(a.y, b.y))))
    SELECT DISTINCT contour_id, x, y FROM e UNION ALL SELECT contour_id, min(x), min(y) FROM p GROUP BY contour_id HAVING count(*) = 1"""


@query("convex_hull_vertices", _VERTICES)
def _(v):
    return contours.contour_hulls(v.contours, "contour_id").select("contour_id", F.explode("hull").alias("p")).select("contour_id", "p.x", "p.y")


@query("mosaic_tiles", "SELECT prj, col, row, px, py, r, g, b FROM tpix")
def _(v):
    """Tiles written as TIFF files in the shared folder and read back by window."""
    from furrow.operators.kernels import tile_images
    from furrow.sources import mosaics, shared

    path = shared.shared_folder(v.spark)
    mosaics.write_mosaics(tile_images(v.tpix).withColumn("name", F.concat_ws("-", "prj", "col", "row")), path)
    part = F.split("prj", "-")
    back = mosaics.read_mosaics(v.spark, path)
    return back.select(part[0].alias("prj"), part[1].cast("int").alias("col"), part[2].cast("int").alias("row"), F.col("x").alias("px"), F.col("y").alias("py"), "r", "g", "b")


@query("trace_contours")
def _(v):
    return regions.trace_contours(v.bpix.where("mask > 0"), *TILE)
