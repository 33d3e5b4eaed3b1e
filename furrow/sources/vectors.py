"""Vector data in and out: GeoJSON masks, lines, points and tile indexes; KML; tables; angle reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import geometry, names

_GEOJSON = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """prj (the file's name), ring: the outer ring of the first polygon of each GeoJSON file."""
    raw = spark.read.schema(_GEOJSON).option("multiLine", True).json(path)
    ring = F.get(F.get("features", F.lit(0))["geometry"]["coordinates"], F.lit(0))
    points = F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1).alias("prj"), points.alias("ring")).where(F.size("ring") > 3)


def mask_edges(masks: DataFrame) -> DataFrame:
    """A row per edge: x1, y1, x2, y2."""
    n = F.size("ring") - 1
    pairs = F.zip_with(F.slice("ring", F.lit(1), n), F.slice("ring", F.lit(2), n), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return masks.select("prj", F.posexplode(pairs).alias("i", "e")).select("prj", "i", "e.*")


def feature_collection(features: DataFrame, *keys: str, feature: str = "feature") -> DataFrame:
    """keys, body: one GeoJSON FeatureCollection a key. For tile indexes, whose features a project are few; lines go out one a row."""
    body = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", F.sort_array(F.collect_list(feature))), F.lit("]}"))
    return features.groupBy(*keys).agg(body.alias("body"))


def tile_features(tiles: DataFrame) -> DataFrame:
    """prj, col, row, feature of tiles with rings."""
    return tiles.select("prj", "col", "row", names.feature(names.ring_geojson(F.col("ring")), col=F.col("col"), row=F.col("row"), colrow=F.col("colrow")).alias("feature"))


def line_features(lines: DataFrame, *properties: str) -> DataFrame:
    """prj, feature of lines x1, y1, x2, y2."""
    ends = F.array(*[F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("x1", "y1"), ("x2", "y2"))])
    return lines.select("prj", names.feature(names.line_geojson(ends), **{p: F.col(p) for p in properties}).alias("feature"))


def write_geojson_rows(features: DataFrame, path: str) -> None:
    """A feature a line, a folder a project."""
    features.select("prj", "feature").write.partitionBy("prj").mode("overwrite").text(path)


def placemark(name: Column, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return F.format_string("<Placemark><name>%s</name><LineString><coordinates>%.8f,%.8f %.8f,%.8f</coordinates></LineString></Placemark>", name.cast("string"), lon1, lat1, lon2, lat2)


def kml_lines(rows: DataFrame) -> DataFrame:
    """prj, i, line: KML text of rows (prj, id, epsg, x1, y1, x2, y2 in metres), in WGS 84: a head, a placemark a row, a foot."""
    (lon1, lat1), (lon2, lat2) = (geometry.utm_to_wgs84(F.col(a), F.col(b), F.col("epsg")) for a, b in (("x1", "y1"), ("x2", "y2")))
    marks = rows.select("prj", F.col("id").cast("long").alias("i"), placemark(F.col("id"), lon1, lat1, lon2, lat2).alias("line"))
    projects = rows.select("prj").distinct()
    head = projects.select("prj", F.lit(-1).cast("long").alias("i"), F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>'), "prj", F.lit("</name>")).alias("line"))
    foot = projects.select("prj", F.lit(2**62).cast("long").alias("i"), F.lit("</Document></kml>").alias("line"))
    return head.unionByName(marks).unionByName(foot)


def write_kml(rows: DataFrame, path: str) -> None:
    """One KML text a project: rows of a project come together, sorted, in one folder."""
    kml_lines(rows).repartition("prj").sortWithinPartitions("prj", "i").select("prj", "line").write.partitionBy("prj").mode("overwrite").text(path)


def write_angle_report(report: DataFrame, path: str) -> None:
    """tile;angle with a header."""
    report.write.option("sep", ";").option("header", True).mode("overwrite").csv(path)


def write_table(df: DataFrame, path: str, name: str) -> str:
    """A named Parquet dataset below a path."""
    df.write.mode("overwrite").parquet(f"{path}/{name}")
    return f"{path}/{name}"
