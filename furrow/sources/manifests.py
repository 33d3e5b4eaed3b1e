"""Project and result manifests in XML, many at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.names import parse_doubles, parse_ints
from furrow.schemas import PROJECT_XML, RESULT_XML

_XML = {"rowTag": "filename"}


def typed_projects(raw: DataFrame) -> DataFrame:
    """Rows of PROJECT_XML with comma lists as arrays. A missing prj is the name."""
    return raw.select(
        F.coalesce("prj", "_name").alias("prj"), F.col("_name").alias("name"), F.col("_mask").alias("mask"), parse_ints(F.col("image_dimensions")).alias("image_dimensions"),
        parse_ints(F.col("image_origin")).alias("image_origin"), parse_doubles(F.col("pixel_size")).alias("pixel_size"), parse_doubles(F.col("image_extents")).alias("image_extents"),
        "epsg", "projwtk", "seed",
    )


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """All project manifests below a path."""
    return typed_projects(spark.read.format("xml").options(**_XML).schema(PROJECT_XML).load(path))


def write_projects(projects: DataFrame, path: str) -> None:
    """Manifests of projects, arrays as comma lists."""
    lists = {c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c) for c in ("image_dimensions", "image_origin", "pixel_size", "image_extents")}
    projects.select(F.col("name").alias("_name"), F.col("mask").alias("_mask"), *lists.values(), "epsg", "projwtk", "seed", "prj").write.format("xml").options(rowTag="filename", rootTag="projects").mode("overwrite").save(path)


def result_manifest(counts: DataFrame, projects: DataFrame) -> DataFrame:
    """One row a project: where its datasets lie, its reference system and mask, and its two line counts."""
    at = lambda name: F.format_string(f"{name}/%s", "prj")
    met = counts.join(projects.select("prj", "epsg", F.col("mask").alias("vectormask")), "prj")
    return met.select(
        "prj", at("rows").alias("result"), at("buffers").alias("buffer"), at("tiles").alias("tile"), at("export").alias("export"), at("kml").alias("kml"), "epsg", "vectormask", "candidatelines", "resultinglines"
    )


def write_results(manifest: DataFrame, path: str) -> None:
    manifest.write.format("xml").options(rowTag="result_set", rootTag="results").mode("overwrite").save(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result manifests; each named dataset is read with spark.read.parquet(base + name)."""
    return spark.read.format("xml").options(rowTag="result_set").schema(RESULT_XML).load(path)
