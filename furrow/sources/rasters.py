"""Rasters as tables: image files, ASCII grids and stored tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """prj (the file's name), x, y, r, g, b of each pixel of image files that Spark's image source can decode. One file is one task:
    feed large mosaics pre-cut."""
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    flat = images.select(F.regexp_extract("image.origin", r"([^/]+)\.[^./]+$", 1).alias("prj"), "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches):
        for batch in batches:
            for t in batch.itertuples():
                # Stored rows by pixel as blue, green, red (and alpha), or one grey band.
                bands = np.frombuffer(t.data, np.uint8).reshape(t.height, t.width, t.nChannels)
                rgb = bands[..., 2::-1] if t.nChannels >= 3 else np.repeat(bands, 3, axis=2)
                for top in range(0, t.height, max(1, 200_000 // t.width)):
                    part = rgb[top : top + max(1, 200_000 // t.width)]
                    y, x = np.mgrid[top : top + part.shape[0], 0 : t.width]
                    yield pd.DataFrame({"prj": t.prj, "x": x.ravel(), "y": y.ravel(), **{c: part[..., i].ravel().astype(np.int32) for i, c in enumerate("rgb")}})

    return flat.mapInPandas(run, "prj string, x int, y int, r int, g int, b int")


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """name, row, col, value of ASCII grids with six header lines; nodata cells and lines after the last row are left out."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.split("value", r"\r?\n").alias("line"))
    header = lambda key: F.regexp_extract(F.array_join(F.slice("line", 1, 6), "\n"), rf"(?i){key}\s+(\S+)", 1)
    body = files.select("name", header("nodata_value").cast("double").alias("nodata"), header("nrows").cast("int").alias("n_rows"), header("ncols").cast("int").alias("n_cols"), F.posexplode(F.slice("line", F.lit(7), F.size("line"))).alias("row", "text"))
    cells = body.where("row < n_rows").select("name", "row", "n_cols", "nodata", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("col", "cell")).where("col < n_cols")
    return cells.select("name", "row", "col", F.col("cell").cast("double").alias("value"), "nodata").where("nodata is null or value <> nodata").drop("nodata")


def write_tile_images(tiles: DataFrame, path: str) -> None:
    """Tiles of images, a folder a project."""
    tiles.write.partitionBy("prj").mode("overwrite").parquet(path)


def write_contours(contours: DataFrame, path: str) -> None:
    contours.write.partitionBy("prj").mode("overwrite").parquet(path)


def read_contours(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
