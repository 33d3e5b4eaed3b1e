"""Raster algebra over long pixel tables (prj, col, row, px, py, ...) in window form.

Every window is partitioned by the tile and a line of it, so no task holds more than a line; each call makes one
shuffle for rows and one for columns. In production furrow.operators.kernels runs the whole chain a tile at a time
after a single shuffle; the two forms agree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import geometry
from furrow.functions.spectral import luminance, relight

TILE = ("prj", "col", "row")


def histogram(pixels: DataFrame, value: str, tile: tuple = TILE) -> DataFrame:
    """tile, v, n: the counts of each level; partial counts of at most 256 levels a tile move."""
    return pixels.groupBy(*tile, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))


def otsu_thresholds(pixels: DataFrame, value: str, tile: tuple = TILE) -> DataFrame:
    """tile, threshold: the first level of the greatest between-class variance. A tile of one level has that level."""
    all_rows = Window.partitionBy(*tile)
    up_to = all_rows.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    sums = histogram(pixels, value, tile).select(
        *tile,
        "v",
        F.sum("n").over(up_to).alias("n0"),
        F.sum(F.col("n") * F.col("v")).over(up_to).alias("s0"),
        F.sum("n").over(all_rows).alias("n"),
        F.sum(F.col("n") * F.col("v")).over(all_rows).alias("s"),
    )
    n0, n1 = F.col("n0").cast("double"), (F.col("n") - F.col("n0")).cast("double")
    gap = F.col("s0") / n0 - (F.col("s") - F.col("s0")) / F.when(n1 > 0, n1).otherwise(F.lit(1.0))
    variance = F.when(n1 > 0, n0 * n1 / (F.col("n").cast("double") * F.col("n")) * gap * gap).otherwise(F.lit(0.0))
    ranked = sums.withColumn("i", F.row_number().over(all_rows.orderBy(F.round(variance, 9).desc(), "v")))
    return ranked.where("i = 1").select(*tile, F.col("v").alias("threshold"))


def otsu(pixels: DataFrame, value: str, tile: tuple = TILE) -> DataFrame:
    """pixels with mask: 255 above the tile's threshold, else 0."""
    met = pixels.join(otsu_thresholds(pixels, value, tile), list(tile))
    return met.withColumn("mask", F.when(F.col(value) > F.col("threshold"), 255).otherwise(0)).drop("threshold")


def contrast_stretch(pixels: DataFrame, value: str, keys: tuple, add_low: bool = True) -> DataFrame:
    """pixels with stretched: (v - p5) * 255 / (p95 - p5), plus p5 unless add_low is false; null if p95 = p5. The percentiles are exact."""
    cuts = pixels.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.05), F.lit(0.95))).alias("p"))
    cuts = cuts.select(*keys, F.get("p", F.lit(0)).alias("p5"), F.get("p", F.lit(1)).alias("p95"))
    span = F.col("p95") - F.col("p5")
    out = F.when(span != 0, (F.col(value) - F.col("p5")) * 255 / F.when(span != 0, span).otherwise(F.lit(1.0)) + (F.col("p5") if add_low else F.lit(0.0)))
    return pixels.join(cuts, list(keys)).withColumn("stretched", out).drop("p5", "p95")


def equalize(pixels: DataFrame, tile: tuple = TILE) -> DataFrame:
    """Pixels whose r, g, b have their tile's luminance equalised; the old columns stay as they were, r_eq, g_eq, b_eq are new."""
    lit = pixels.withColumn("lum", luminance(F.col("r"), F.col("g"), F.col("b")))
    all_rows = Window.partitionBy(*tile)
    cdf = histogram(lit, "lum", tile).select(
        *tile,
        F.col("v").alias("lum"),
        F.sum("n").over(all_rows.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("cdf"),
        F.sum("n").over(all_rows).alias("total"),
        F.first("n").over(all_rows.orderBy("v")).alias("low"),
    )
    span = F.col("total") - F.col("low")
    level = F.when(span > 0, F.floor((F.col("cdf") - F.col("low")) * 255 / F.when(span > 0, span).otherwise(1) + 0.5)).otherwise(F.col("lum")).cast("int")
    met = lit.join(cdf.select(*tile, "lum", level.alias("level")), [*tile, "lum"])
    bands = relight(F.col("r"), F.col("g"), F.col("b"), F.col("lum"), F.col("level"))
    return met.select("*", *[c.alias(f"{n}_eq") for n, c in zip("rgb", bands)]).drop("lum", "level")


def _reach(k: int, n: int) -> tuple[int, int]:
    """How far n passes of a k-wide kernel reach before and after a pixel; an even kernel is off centre by one."""
    return n * (k // 2), n * (k - 1 - k // 2)


def _morph(pixels: DataFrame, value: str, k: int, n: int, function, tile: tuple) -> DataFrame:
    before, after = _reach(k, n)
    across = Window.partitionBy(*tile, "py").orderBy("px").rangeBetween(-before, after)
    down = Window.partitionBy(*tile, "px").orderBy("py").rangeBetween(-before, after)
    return pixels.withColumn(value, function(value).over(across)).withColumn(value, function(value).over(down))


def dilate(pixels: DataFrame, value: str = "mask", k: int = 3, n: int = 1, tile: tuple = TILE) -> DataFrame:
    """The greatest value within n passes of a k by k square; pixels beyond the tile don't count."""
    return _morph(pixels, value, k, n, F.max, tile)


def erode(pixels: DataFrame, value: str = "mask", k: int = 3, n: int = 1, tile: tuple = TILE) -> DataFrame:
    """The least value within n passes of a k by k square; pixels beyond the tile don't count."""
    return _morph(pixels, value, k, n, F.min, tile)


def morph_open(pixels: DataFrame, value: str = "mask", k: int = 9, tile: tuple = TILE) -> DataFrame:
    return dilate(erode(pixels, value, k, 1, tile), value, k, 1, tile)


def morph_close(pixels: DataFrame, value: str = "mask", k: int = 9, tile: tuple = TILE) -> DataFrame:
    return erode(dilate(pixels, value, k, 1, tile), value, k, 1, tile)


def gaussian_weights(k: int, sigma: float = 0.0) -> list[float]:
    """Weights that add up to 1; without a sigma, the one that fits the width."""
    sigma = sigma or 0.3 * ((k - 1) / 2 - 1) + 0.8
    raw = [math.exp(-((i - k // 2) ** 2) / (2 * sigma * sigma)) for i in range(k)]
    return [w / sum(raw) for w in raw]


def gaussian_blur(pixels: DataFrame, value: str, k: int = 5, sigma: float = 0.0, tile: tuple = TILE) -> DataFrame:
    """A separable blur with the border mirrored about its pixel, rounded half up to a level. Lines are dense: every pixel is there."""
    weights, half = gaussian_weights(k, sigma), k // 2

    def along(df: DataFrame, line: str, place: str) -> DataFrame:
        w = Window.partitionBy(*tile, line).orderBy(place)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        low, high = F.min(place).over(whole), F.max(place).over(whole)
        out = df.withColumn("_low", low).withColumn("_high", high)
        total = F.lit(0.0)
        for i, weight in enumerate(weights):
            d = i - half
            picked = F.lead(value, d).over(w) if d >= 0 else F.lag(value, -d).over(w)
            for room in range(abs(d)):  # room pixels lie between this one and the border
                step = (2 * room - d) if d > 0 else -(2 * room + d)
                mirror = F.lead(value, step).over(w) if step >= 0 else F.lag(value, -step).over(w)
                at_border = (F.col("_high") - F.col(place) == room) if d > 0 else (F.col(place) - F.col("_low") == room)
                picked = F.when(at_border, mirror).otherwise(picked)
            total = total + picked * weight
        return out.withColumn(value, total).drop("_low", "_high")

    blurred = along(along(pixels.withColumn(value, F.col(value).cast("double")), "py", "px"), "px", "py")
    return blurred.withColumn(value, F.floor(F.round(F.col(value), 9) + 0.5).cast("int"))


def median_binary(pixels: DataFrame, value: str = "mask", k: int = 15, tile: tuple = TILE) -> DataFrame:
    """The k by k median of a mask of 0 and 255: 255 where the majority of the square is set, the border replicated."""
    half = k // 2
    whole = lambda line, place: Window.partitionBy(*tile, line).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def sums(df: DataFrame, line: str, place: str) -> DataFrame:
        near = Window.partitionBy(*tile, line).orderBy(place).rangeBetween(-half, half)
        w = whole(line, place)
        before = F.greatest(F.lit(0), F.min(place).over(w) + half - F.col(place))
        after = F.greatest(F.lit(0), F.col(place) + half - F.max(place).over(w))
        return df.withColumn("_n", F.sum("_n").over(near) + before * F.first("_n").over(w) + after * F.last("_n").over(w))

    counted = pixels.withColumn("_n", F.when(F.col(value) > 0, 1).otherwise(0))
    out = sums(sums(counted, "py", "px"), "px", "py")
    return out.withColumn(value, F.when(F.col("_n") > k * k // 2, 255).otherwise(0)).drop("_n")


def auto_edge_bounds(pixels: DataFrame, value: str, keys: tuple, sigma: float = 0.33) -> DataFrame:
    """keys, median, low, high: the median level and the bounds a share sigma below and above it, cut to whole levels in 0 to 255."""
    middle = pixels.groupBy(*keys).agg(F.median(value).alias("median"))
    low = F.greatest(F.lit(0.0), (1 - sigma) * F.col("median"))
    high = F.least(F.lit(255.0), (1 + sigma) * F.col("median"))
    return middle.select(*keys, "median", F.floor(low).cast("int").alias("low"), F.floor(high).cast("int").alias("high"))


def band_stats(pixels: DataFrame, keys: tuple = ("prj",), bands: tuple = ("r", "g", "b")) -> DataFrame:
    """keys, band, min, max, mean, std (of the population)."""
    long = pixels.select(*keys, *bands).unpivot(list(keys), list(bands), "band", "v")
    return long.groupBy(*keys, "band").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def non_empty_tiles(pixels: DataFrame, value: str = "mask", tile: tuple = TILE) -> DataFrame:
    """Tiles with any set pixel, and their share of set pixels."""
    found = pixels.groupBy(*tile).agg(F.max(value).alias("most"), F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("share"))
    return found.where("most > 0").drop("most")


def clip_raster(pixels: DataFrame, masks: DataFrame, bands: tuple = ("r", "g", "b"), nodata: int | None = None) -> DataFrame:
    """Pixels inside their project's mask polygon (first, by even-odd); outside they are dropped, or set to nodata within its bounds.

    The bounds cut first; only pixels within them are held against the ring, in their own row.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxed = masks.select("prj", "ring", F.array_min(xs).alias("bx0"), F.array_max(xs).alias("bx1"), F.array_min(ys).alias("by0"), F.array_max(ys).alias("by1"))
    near = pixels.join(boxed, "prj").where("x between bx0 and bx1 and y between by0 and by1")
    inside = geometry.in_ring(F.col("x").cast("double"), F.col("y").cast("double"), F.col("ring"))
    if nodata is None:
        out = near.where(inside)
    else:
        out = near.withColumn("inside", inside)
        for band in bands:
            out = out.withColumn(band, F.when(F.col("inside"), F.col(band)).otherwise(nodata))
    return out.drop("ring", "bx0", "bx1", "by0", "by1", "inside")
