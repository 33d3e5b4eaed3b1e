"""Mosaics by window: every layout against the image itself, pruning by filters, files there and back."""

import itertools
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import grid
from furrow.sources import mosaics
from furrow.sources.mosaics import DEFLATE, NONE, PACKBITS, MosaicReader, read_header, read_mosaics, tiff_bytes

RNG = np.random.default_rng(2)


def image(df, w, h, name=None):
    rows = (df.where(F.col("prj") == name) if name else df).select("x", "y", "r", "g", "b").toPandas()
    out = np.full((h, w, 3), -1)
    out[rows["y"], rows["x"]] = rows[["r", "g", "b"]].to_numpy()
    assert len(rows) == w * h
    return out


def test_every_layout_reads_back(spark, tmp_path):
    rgb = RNG.integers(0, 256, (37, 53, 3)).astype(np.uint8)
    layouts = list(itertools.product((None, (16, 32)), (NONE, DEFLATE, PACKBITS), (1, 2), (False, True), "<>", (False, True)))
    for i, (window, compression, predictor, big, order, planar) in enumerate(layouts):
        (tmp_path / f"m{i}.tif").write_bytes(tiff_bytes(rgb, window, 10, compression, predictor, big, order, planar))
    (tmp_path / "four.TIFF").write_bytes(tiff_bytes(np.concatenate([rgb, rgb[..., :1]], axis=2)))
    (tmp_path / "grey.tif").write_bytes(tiff_bytes(rgb[..., :1]))
    (tmp_path / "note.txt").write_text("no mosaic")
    pixels = read_mosaics(spark, str(tmp_path)).cache()
    for name in [f"m{i}" for i in range(len(layouts))] + ["four"]:
        assert (image(pixels, 53, 37, name) == rgb).all()
    assert (image(pixels, 53, 37, "grey") == rgb[..., :1]).all()
    assert pixels.select("prj").distinct().count() == len(layouts) + 2


def test_a_wide_mosaic_is_many_tasks_and_a_filter_reads_its_windows_only(spark, tmp_path):
    w, h = 20_000, 900
    rgb = np.stack([np.add.outer(np.arange(h), np.arange(w)) % m for m in (251, 241, 239)], axis=2).astype(np.uint8)
    path = f"file://{tmp_path}/wide.tif"
    (tmp_path / "wide.tif").write_bytes(tiff_bytes(rgb, (256, 256), big=True, compression=NONE, scale=0.02, corner=(1000.0, 2000.0)))
    df = read_mosaics(spark, path, tile_m=20.0, partition_pixels=150_000)
    assert df.rdd.getNumPartitions() >= 100
    sums = df.groupBy().agg(*[F.sum(c) for c in "rgb"], F.count("x")).first()
    assert list(sums) == [*(int(rgb[..., k].sum()) for k in range(3)), w * h]
    # Only what the filter leaves is read: all other windows' bytes lie beyond the end of the file from here on.
    head = read_header(path)
    tile = df.where("col = 3 and row = 1")
    inside = [j * head.grid[0] + i for j in range(head.grid[1]) for i in range(head.grid[0]) if i * 256 < 3000 and i * 256 + 256 > 2000]
    data = bytearray((tmp_path / "wide.tif").read_bytes())
    at = data.index(struct.pack(f"<{len(head.offsets)}Q", *head.offsets))
    for k in range(len(head.offsets)):
        if k not in inside:
            data[at + 8 * k : at + 8 * k + 8] = struct.pack("<Q", len(data) * 2)
    (tmp_path / "wide.tif").write_bytes(bytes(data))
    got = tile.toPandas()
    assert len(got) == 1000 * h and (got["x"] // 1000 == 2).all()
    assert (got[["r", "g", "b"]].to_numpy() == rgb[got["y"], got["x"]]).all()
    with pytest.raises(Exception):
        df.where("col = 5").count()
    assert read_mosaics(spark, path).where("prj = 'other'").count() == 0
    assert read_mosaics(spark, path).where("x >= 2100 and x < 2104 and y in (3, 5)").count() == 8


def test_pushed_filters_choose_windows(tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff_bytes(np.zeros((100, 100, 3), np.uint8), (16, 16)))
    head = read_header(f"{tmp_path}/a.tif")
    reader = lambda *f, **o: (lambda r: (list(r.pushFilters(f)), r)[1])(MosaicReader({"path": str(tmp_path), **o}))
    assert len(reader().wanted(head)) == 49
    assert reader(mosaics.GreaterThan(("x",), 40), mosaics.LessThan(("x",), 50), mosaics.EqualTo(("y",), 99)).wanted(head) == [44, 45]
    assert len(reader(mosaics.In(("col",), (2, 3)), tilepx="32").wanted(head)) == 7 * 5
    assert reader(mosaics.EqualTo(("x",), 500)).wanted(head) == []
    assert [p.numbers for p in reader(mosaics.EqualTo(("y",), 0), partitionpixels="512").partitions()] == [[0, 1], [2, 3], [4, 5], [6]]
    assert len(reader(mosaics.EqualTo(("y",), 0)).partitions()[0].head.offsets) == 7


def test_facts_grid_and_tiles_there_and_back(spark, tmp_path):
    rgb = RNG.integers(0, 256, (90, 130, 3)).astype(np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.tif").write_bytes(tiff_bytes(rgb, scale=0.7, corner=(500.0, 900.0)))
    facts = mosaics.mosaic_facts(spark, f"{tmp_path}/in").first()
    assert (facts["prj"], facts["image_dimensions"], facts["windows"]) == ("f", [130, 90], 2)
    assert facts["pixel_size"] == [0.7, -0.7] and facts["image_extents"] == pytest.approx([500, 900 - 63, 500 + 91, 900])
    pixels = read_mosaics(spark, f"{tmp_path}/in", tile_m=20.0)
    placed = grid.assign_tile(pixels.drop("col", "row"), grid.grid_facts(mosaics.mosaic_facts(spark, f"{tmp_path}/in")))
    assert pixels.select("x", "y", "col", "row").exceptAll(placed.select("x", "y", "col", "row")).count() == 0
    named = spark.createDataFrame([(f"t{i}", 130, 30, bytearray(rgb[30 * i : 30 * i + 30].tobytes())) for i in range(3)], "name string, w int, h int, data binary")
    mosaics.write_mosaics(named, f"{tmp_path}/out")
    mosaics.write_mosaics(named, f"{tmp_path}/out")  # again, as a task that was lost would
    back = read_mosaics(spark, f"{tmp_path}/out")
    assert all((image(back, 130, 30, f"t{i}") == rgb[30 * i : 30 * i + 30]).all() for i in range(3))


def test_what_can_not_be_read_is_an_error(spark, tmp_path):
    good = tiff_bytes(np.zeros((4, 4, 3), np.uint8), compression=NONE)
    (tmp_path / "lzw.tif").write_bytes(good.replace(struct.pack("<HHIH", 259, 3, 1, 1), struct.pack("<HHIH", 259, 3, 1, 5)))
    with pytest.raises(ValueError, match="lzw.tif"):
        read_header(f"{tmp_path}/lzw.tif")
    (tmp_path / "text.tif").write_text("this is no mosaic")
    with pytest.raises(ValueError, match="text.tif"):
        read_header(f"{tmp_path}/text.tif")
    (tmp_path / "empty").mkdir()
    assert read_mosaics(spark, f"{tmp_path}/empty").count() == 0
