"""Names, paths and parsed values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.params import SEED_NAMES


def colrow(col: Column, row: Column) -> Column:
    return F.concat_ws("_", col.cast("string"), row.cast("string"))


def tile_name(col: Column, row: Column) -> Column:
    """A tile's dataset name."""
    return F.format_string("mosaic-cl_%d-rw_%d", col, row)


def parse_ints(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: F.trim(x).cast("int"))


def parse_doubles(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: F.trim(x).cast("double"))


def leading_token(text: Column) -> Column:
    return F.split_part(text, F.lit("_"), F.lit(1))


def relative_path(path: Column, drop: int = 2) -> Column:
    """A path without its first parts."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(drop + 1), F.greatest(F.size(parts) - drop, F.lit(0))), "/")


def project_stamp(ts: Column, prefix: str = "rows_") -> Column:
    """A name of a run by its time; the prefix is free."""
    return F.concat(F.lit(prefix), F.date_format(ts, "yyyyMMdd-HHmmss"))


def epsg_code(text: Column) -> Column:
    """The digits of EPSG:nnnn."""
    return F.substring(text, 6, 10).cast("int")


def seed_name(seed: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in SEED_NAMES.items() for x in pair]), seed)


def stepped(start: Column, end: Column, step: Column) -> Column:
    """An inclusive range."""
    return F.sequence(start, end, step)


def ring_geojson(ring: Column) -> Column:
    """A polygon geometry from a closed ring of points."""
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))


def line_geojson(coords: Column) -> Column:
    return F.struct(F.lit("LineString").alias("type"), F.transform(coords, lambda p: F.array(p["x"], p["y"])).alias("coordinates"))


def point_geojson(x: Column, y: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))


def feature(geometry: Column, **properties: Column) -> Column:
    """A GeoJSON feature as text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*[c.alias(k) for k, c in properties.items()]).alias("properties"), geometry.alias("geometry")))
