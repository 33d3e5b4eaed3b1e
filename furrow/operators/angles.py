"""Row angles: of contours, of tiles and of fields. Angles are degrees; a tile without a valid angle has NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.params import DEFAULTS


def _not_nan(name: str) -> Column:
    return F.when(~F.isnan(name), F.col(name))


def seed_range(seed: Column, tolerance: float = DEFAULTS.seed_tolerance, ranges: tuple = DEFAULTS.seed_ranges) -> tuple[Column, Column]:
    """The widened range of angles of a seed: -1, or 1 to 4."""
    place = F.when(seed == -1, 0).otherwise(seed)
    table = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in ranges])
    return F.get(table, place)["lo"] - tolerance, F.get(table, place)["hi"] + tolerance


def filter_angles(contours: DataFrame, tolerance: float = DEFAULTS.seed_tolerance) -> DataFrame:
    """Contours whose angle lies in the widened range of their seed."""
    low, high = seed_range(F.col("seed"), tolerance)
    return contours.where(F.col("angle").between(low, high))


def tile_angles(contours: DataFrame, *tile: str, top: int = DEFAULTS.top_contours, deviation: float = DEFAULTS.max_angle_deviation) -> DataFrame:
    """tile, n, std (of the population), max, min, avg, angle: the mean if there are more than top / 2 + 2 angles and their spread is at
    most `deviation`, else NaN. A tile without angles has no row."""
    a = _not_nan("angle")
    stats = contours.groupBy(*tile).agg(F.count(a).alias("n"), F.stddev_pop(a).alias("std"), F.max(a).alias("max"), F.min(a).alias("min"), F.avg(a).alias("avg"))
    valid = (F.col("n") > top // 2 + 2) & (F.round("std", 9) <= deviation)
    return stats.where("n > 0").withColumn("angle", F.when(valid, F.col("avg")).otherwise(F.lit(float("nan"))))


def field_angle(tiles: DataFrame, *keys: str) -> DataFrame:
    """keys, angle_mean, angle_std over tiles with an angle; null for a field without any, which is to be put aside (see
    fields.without_angle): one field is no reason to end the job of all."""
    a = _not_nan("angle")
    return tiles.groupBy(*keys).agg(F.avg(a).alias("angle_mean"), F.stddev_pop(a).alias("angle_std"))


def rect_angles(contours: DataFrame, *tile: str, top: int = DEFAULTS.top_contours, deviation: float = DEFAULTS.max_angle_deviation) -> DataFrame:
    """The same of the contours' rectangle angles, under the same gate."""
    return tile_angles(contours.withColumn("angle", F.col("rect_angle")), *tile, top=top, deviation=deviation)


def fallback_angle(contours: DataFrame, *tile: str) -> DataFrame:
    """tile, angle: the mean rectangle angle, for use where the field angle is -1."""
    return contours.groupBy(*tile).agg(F.avg("rect_angle").alias("angle"))


def tile_filter_expr(tiles: DataFrame, *keys: str) -> DataFrame:
    """keys, expr: a filter expression that lists the tiles. The list is one project's tiles."""
    quoted = F.sort_array(F.collect_set(F.concat(F.lit("'"), F.col("colrow"), F.lit("'"))))
    return tiles.groupBy(*keys).agg(F.concat(F.lit('"colrow" in ('), F.concat_ws(",", quoted), F.lit(")")).alias("expr"))


def angle_report(tiles: DataFrame) -> DataFrame:
    """tile and angle of the tiles that have one."""
    return tiles.where(~F.isnan("angle")).select(F.col("colrow").alias("tile"), "angle")
