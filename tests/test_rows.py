"""Hand-made rasters and lines: kernels against brute force and invariants, files there and back, the whole chain on a striped field."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from furrow.functions import geometry
from furrow.jobs import fields
from furrow.operators import blocks, contours, grid, kernels, lines, nearest, overlaps, raster, rows
from furrow.sources import manifests, rasters, vectors
from furrow.streaming import landing

RNG = np.random.default_rng(0)


def long(image, name="mask"):
    y, x = np.mgrid[: image.shape[0], : image.shape[1]]
    return pd.DataFrame({"prj": "p", "col": 1, "row": 1, "px": x.ravel(), "py": y.ravel(), name: image.ravel().astype(int)})


def back(df, name="mask"):
    pdf = df.toPandas()
    out = np.zeros((pdf["py"].max() + 1, pdf["px"].max() + 1), int)
    out[pdf["py"], pdf["px"]] = pdf[name]
    return out


@pytest.mark.parametrize("k, n", [(3, 1), (3, 3), (4, 2), (9, 1)])
def test_window_form_equals_kernel(spark, k, n):
    mask = np.where(RNG.random((17, 23)) < 0.6, 255, 0).astype(np.uint8)
    df = spark.createDataFrame(long(mask))
    assert (back(raster.dilate(df, k=k, n=n)) == kernels.dilate(mask, k, n)).all()
    assert (back(raster.erode(df, k=k, n=n)) == kernels.erode(mask, k, n)).all()


def test_blurs_agree(spark):
    image = RNG.integers(0, 256, (14, 19)).astype(np.uint8)
    df = spark.createDataFrame(long(image, "v"))
    assert np.abs(back(raster.gaussian_blur(df, "v", 5), "v") - kernels.gaussian_blur(image, 5).astype(int)).max() <= 1
    mask = np.where(image > 128, 255, 0).astype(np.uint8)
    assert (back(raster.median_binary(spark.createDataFrame(long(mask)), k=5)) == kernels.median_binary(mask, 5)).all()
    assert (kernels.median_binary(mask, 3) == kernels.median_blur(mask, 3)).all()


def test_components_and_distance():
    mask = RNG.random((30, 40)) < 0.35
    label = kernels.label_image(mask)
    seen = np.zeros(mask.shape, int)
    for y, x in np.argwhere(mask):
        if not seen[y, x]:
            stack, k = [(y, x)], seen.max() + 1
            while stack:
                a, b = stack.pop()
                if 0 <= a < 30 and 0 <= b < 40 and mask[a, b] and not seen[a, b]:
                    seen[a, b] = k
                    stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert len(set(zip(label[mask], seen[mask]))) == seen.max() == label.max()
    ground = np.argwhere(~mask)
    exact = np.array([[math.sqrt(((ground - (y, x)) ** 2).sum(axis=1).min()) for x in range(40)] for y in range(30)])
    assert np.allclose(kernels.distance_transform(np.where(mask, 255, 0)), exact)
    assert not kernels.distance_mask(np.full((5, 5), 255, np.uint8)).any() and not kernels.distance_mask(np.zeros((5, 5), np.uint8)).any()


def test_borders():
    frame = np.zeros((6, 6), int)
    frame[1:5, 1:5] = 1
    frame[2:4, 2:4] = 0
    found = kernels.trace_borders(frame)
    assert found[0] == ([(1, 1), (1, 4), (4, 4), (4, 1)], False) and [hole for _, hole in found] == [False, True]
    assert kernels.trace_borders(np.eye(3)) == [([(0, 0), (2, 2)], False)]
    one = np.zeros((3, 3), int)
    one[1, 1] = 1
    assert kernels.trace_borders(one) == [([(1, 1)], False)]


@pytest.mark.parametrize("theta", [10, 45, 90, 135, 170])
def test_shapes_of_a_turned_ellipse(theta):
    t, a = np.linspace(0, 2 * math.pi, 40, endpoint=False), math.radians(theta)
    pts = np.outer(30 * np.cos(t), [-math.sin(a), math.cos(a)]) + np.outer(8 * np.sin(t), [math.cos(a), math.sin(a)]) + 50
    assert kernels.ellipse_angle(pts) == pytest.approx(theta, abs=0.01)
    cx, cy, w, h, angle, corners = kernels.min_area_rect(pts)
    assert (cx, cy) == pytest.approx((50, 50), abs=0.5) and sorted((w, h)) == pytest.approx([16, 60], abs=0.5) and -90 <= angle < 0
    assert w * h <= np.ptp(pts[:, 0]) * np.ptp(pts[:, 1]) + 1e-9
    x, y, r = kernels.min_circle(pts)
    assert (np.hypot(pts[:, 0] - x, pts[:, 1] - y) <= r + 1e-6).all() and r == pytest.approx(30, abs=0.3)
    hull = kernels.convex_hull(pts)
    e = np.roll(hull, -1, axis=0) - hull
    assert all((e[:, 0] * (p[1] - hull[:, 1]) - e[:, 1] * (p[0] - hull[:, 0]) >= -1e-6).all() for p in pts)
    smooth = kernels.resample_closed(pts)
    assert len(smooth) == 25 and max(np.abs(np.hypot(*(pts - p).T)).min() for p in smooth) < 4


def test_span_groups_and_gaps(spark):
    df = spark.createDataFrame([("k", v) for v in (0.5, 1.0, 1.7, 1.9, 3.3)] + [("m", 2.0)], "k string, d double")
    assert [(r["k"], r["d"]) for r in lines.span_groups(df, "k").orderBy("k", "d").collect()] == [("k", 1.7), ("k", 1.9), ("k", 3.3), ("m", 2.0)]
    assert [r["d"] for r in lines.gap_filter(df, "k", gap=0.7).orderBy("k", "d").collect()] == [1.7, 3.3, 2.0]


def test_concave_mask_gives_two_parts(spark):
    ring = [(0, 0), (60, 0), (60, 40), (40, 40), (40, 15), (20, 15), (20, 40), (0, 40), (0, 0)]
    df = spark.createDataFrame([(1, -10.0, 30.0, 70.0, 30.0, [{"x": float(x), "y": float(y)} for x, y in ring])], "idx int, x1 double, y1 double, x2 double, y2 double, ring array<struct<x:double,y:double>>")
    out = lines.clip_to_polygon(df).first()
    assert [(p["x1"], p["x2"]) for p in out["parts"]] == [(pytest.approx(0), pytest.approx(20)), (pytest.approx(40), pytest.approx(60))] and out["inside_length"] == pytest.approx(40)


def test_overlap_and_nearest_at_cell_edges(spark):
    data = [("p", i, float(x), float(y), float(x) + 0.1, float(y) + 9) for i, (x, y) in enumerate(RNG.uniform(0, 60, (60, 2)))]
    df = spark.createDataFrame(data, "prj string, idx long, x1 double, y1 double, x2 double, y2 double")
    pairs = {(r["a"], r["b"]) for r in rows.overlap_pairs(df, "prj", width=1.5).collect()}
    assert pairs == {(r["a"], r["b"]) for r in rows.overlap_pairs(df, "prj", width=1.5, cell=500.0).collect()} and pairs
    points = spark.createDataFrame([("p", 1, 500.0, 500.0), ("p", 2, 30.0, 30.0), ("none", 3, 0.0, 0.0)], "prj string, point int, x double, y double")
    a = {(r["point"], r["idx"]) for r in rows.nearest_line(points, df, "prj", cell=3.0).collect()}
    assert a == {(r["point"], r["idx"]) for r in rows.nearest_line(points, df, "prj", cell=4000.0).collect()} and len(a) == 2


def test_utm(spark):
    lon, lat = geometry.utm_to_wgs84(F.lit(500000.0), F.lit(4649776.22482), F.lit(32618))
    assert tuple(spark.range(1).select(lon, lat).first()) == (pytest.approx(-75.0), pytest.approx(42.0, abs=1e-6))


def test_hull_reduction_keeps_the_hull(spark):
    pts = RNG.integers(0, 50, (400, 2))
    df = spark.createDataFrame(pd.DataFrame({"prj": "p", "x": pts[:, 0], "y": pts[:, 1]}))
    hull = contours.convex_hulls(df, "prj").first()["hull"]
    assert {(p["x"], p["y"]) for p in hull} == set(map(tuple, kernels.convex_hull(pts).tolist()))


PROJECT = [("p1", "n1", "m1", [1000, 800], [3, 4], [0.02, -0.02], [3.0, 4.0, 23.0, 20.0], "EPSG:32618", "wkt", 4)]
SCHEMA = "prj string, name string, mask string, image_dimensions array<int>, image_origin array<int>, pixel_size array<double>, image_extents array<double>, epsg string, projwtk string, seed int"


def test_manifests_there_and_back(spark, tmp_path):
    df = spark.createDataFrame(PROJECT, SCHEMA)
    manifests.write_projects(df, f"{tmp_path}/m")
    assert manifests.read_projects(spark, f"{tmp_path}/m").collect() == df.collect()
    counts = spark.createDataFrame([("p1", 7, 5)], "prj string, candidatelines long, resultinglines long")
    results = manifests.result_manifest(counts, df)
    manifests.write_results(results, f"{tmp_path}/r")
    assert manifests.read_results(spark, f"{tmp_path}/r").select(results.columns).collect() == results.collect()


def test_landing_folder_takes_each_project_once(spark, tmp_path):
    df = spark.createDataFrame(PROJECT, SCHEMA)
    manifests.write_projects(df, f"{tmp_path}/in/a")
    args = (spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/ckpt")
    seen = []
    landing.stream_projects(*args, then=lambda new: seen.append(new.count())).awaitTermination()
    manifests.write_projects(df.union(df.withColumn("prj", F.lit("p2"))), f"{tmp_path}/in/b")
    landing.stream_projects(*args).awaitTermination()
    landing.stream_projects(*args).awaitTermination()
    assert sorted(r["prj"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["p1", "p2"] and seen == [1]


def test_ascii_grid(spark, tmp_path):
    head = "NCOLS 10\nNROWS 10\nXLLCENTER 1\nYLLCENTER 2\nDX 10\nNODATA_VALUE -9999\n"
    (tmp_path / "g.asc").write_text(head + "\n".join(" ".join(map(str, range(10))) for _ in range(9)) + "\n0 1 2 3 4 5 6 7 8 -9999\nlabel one\nlabel two\n")
    df = rasters.read_ascii_grid(spark, f"{tmp_path}/g.asc")
    stats = df.agg(F.count("value"), F.min("value"), F.max("value")).first()
    assert tuple(stats) == (99, 0.0, 9.0)
    whole = df.where("row < 9").agg(F.avg("value"), F.stddev_pop("value")).first()
    assert tuple(whole) == (4.5, pytest.approx(2.872281323269))


def test_images(spark, tmp_path):
    import struct
    import zlib

    rgb = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = b"".join(b"\0" + row.tobytes() for row in rgb)
    (tmp_path / "f.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b""))
    got = {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in rasters.read_images(spark, str(tmp_path)).collect()}
    assert got == {(x, y): tuple(int(v) for v in rgb[y, x]) for x in range(4) for y in range(2)}


def test_vector_files(spark, tmp_path):
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 0.0]]
    (tmp_path / "field.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}, indent=1))
    masks = vectors.read_masks(spark, f"{tmp_path}/field.json")
    assert [(r["prj"], len(r["ring"])) for r in masks.collect()] == [("field", 4)] and vectors.mask_edges(masks).count() == 3
    rows_ = spark.createDataFrame([("p", 0, 32618, 500000.0, 4649776.0, 500010.0, 4649776.0)], "prj string, id int, epsg int, x1 double, y1 double, x2 double, y2 double")
    vectors.write_kml(rows_, f"{tmp_path}/kml")
    text = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/kml").collect())
    assert text.startswith("<?xml") and text.count("<Placemark>") == 1 and text.endswith("</kml>") and "-75.0000" in text
    body = vectors.feature_collection(vectors.line_features(rows_, "id"), "prj").first()["body"]
    assert json.loads(body)["features"][0]["geometry"]["type"] == "LineString"
    vectors.write_angle_report(spark.createDataFrame([("1_1", 45.0)], "tile string, angle double"), f"{tmp_path}/csv")
    assert spark.read.text(f"{tmp_path}/csv").collect()[0]["value"] == "tile;angle"
    buffer = geometry.segment_buffer((F.lit(0.0), F.lit(0.0)), (F.lit(3.0), F.lit(0.0)), 0.3)
    pts = [(p["x"], p["y"]) for p in spark.range(1).select(buffer).first()[0]]
    assert pts[0] == pts[-1] and all(abs(math.hypot(x - min(3, max(0, x)), y) - 0.3) < 1e-9 for x, y in pts)


def test_striped_field_end_to_end(spark):
    """Rows 2 m apart, upright in the image: the field angle is theirs, and each row comes out once, but for the first: it is 1 m from the point
    that distances are measured from, nearer than the least gap."""
    w = h = 400
    y, x = np.mgrid[:h, :w]
    plant = (x % 40 > 12) & (x % 40 < 28)
    rgb = np.where(plant[..., None], [40, 160, 40], [150, 120, 90]) + RNG.integers(0, 6, (h, w, 3))
    pixels = spark.createDataFrame(pd.DataFrame({"prj": "p", "x": x.ravel(), "y": y.ravel(), **{c: rgb[..., i].ravel() for i, c in enumerate("rgb")}}))
    projects = spark.createDataFrame([("p", "p", "p", [w, h], [0, 0], [0.05, -0.05], [1000.0, 2000.0, 1020.0, 2020.0], "EPSG:32618", "", 2)], SCHEMA)
    masks = spark.createDataFrame([("p", [{"x": float(a), "y": float(b)} for a, b in ((999, 1999), (1021, 1999), (1021, 2021), (999, 2021), (999, 1999))])], "prj string, ring array<struct<x:double,y:double>>")
    out = fields.run(pixels, projects, masks, least_px=5.0)
    assert out["field_angles"].first()["angle_mean"] % 180 == pytest.approx(0, abs=1) or out["field_angles"].first()["angle_mean"] % 180 == pytest.approx(180, abs=1)
    assert out["candidates"].count() == 10 and out["rows"].count() == 9 and out["counts"].first()["candidatelines"] == 9
    xs = sorted((r["x1"] + r["x2"]) / 2 for r in out["rows"].collect())
    assert all(1.5 < b - a < 2.5 for a, b in zip(xs, xs[1:]))


def test_a_tile_of_more_rows_than_angles_keeps_them_all(spark):
    y, x = np.mgrid[:400, :400]
    plant = (x % 28 > 8) & (x % 28 < 20)
    rgb = np.where(plant[..., None], [40, 160, 40], [150, 120, 90]) + RNG.integers(0, 6, (400, 400, 3))
    pixels = spark.createDataFrame(pd.DataFrame({"prj": "p", "x": x.ravel(), "y": y.ravel(), **{c: rgb[..., i].ravel() for i, c in enumerate("rgb")}}))
    projects = spark.createDataFrame([("p", "p", "p", [400, 400], [0, 0], [0.05, -0.05], [1000.0, 2000.0, 1020.0, 2020.0], "EPSG:32618", "", 2)], SCHEMA)
    facts = grid.grid_facts(projects)
    found = fields.tile_contours(fields.segment_tiles(pixels, facts), least_px=5.0).cache()
    tiles, field = fields.generate_angles(found, projects)
    assert found.count() == 14 and sorted(r["contour_id"] for r in found.collect()) == list(range(14)) and tiles.first()["n"] <= 10
    assert fields.generate_lines(found, facts, field).count() == 14


def test_a_cropped_tile_is_segmented_alike_away_from_the_cut():
    y, x = np.mgrid[:400, :400]
    plant = (x % 40 > 12) & (x % 40 < 28) & (y % 90 > 6)
    rgb = (np.where(plant[..., None], [40, 160, 40], [150, 120, 90]) + np.random.default_rng(3).integers(0, 6, (400, 400, 3))).astype(np.uint8)
    whole, half = kernels.run_tile(rgb, pixel_m=0.05)[0], kernels.run_tile(rgb[:, :200], pixel_m=0.05)[0]
    assert whole.any() and ((whole > 0)[:, :120] == (half > 0)[:, :120]).mean() > 0.97


def test_a_tile_of_full_size_at_its_own_resolution():
    side = 1084
    y, x = np.mgrid[:side, :side]
    plant = (x % 108 > 30) & (x % 108 < 78)
    rgb = (np.where(plant[..., None], [40, 160, 40], [150, 120, 90]) + np.random.default_rng(4).integers(0, 6, (side, side, 3))).astype(np.uint8)
    mask = kernels.run_tile(rgb)[0] > 0
    inner = mask[100:-100, 100:-100]
    assert 0.02 < inner.mean() < plant.mean() and not (inner & ~plant[100:-100, 100:-100]).any()


@pytest.mark.parametrize("name", ["exg", "exr", "cive", "exgr", "ndi", "ndvi"])
def test_kernel_indices_equal_the_expressions(spark, name):
    from furrow.functions import spectral

    rgb = np.random.default_rng(5).integers(0, 256, (9, 11, 3)).astype(np.uint8)
    rgb[0, 0] = rgb[3, 3] = 0
    y, x = np.mgrid[:9, :11]
    df = spark.createDataFrame(pd.DataFrame({"px": x.ravel(), "py": y.ravel(), **{c: rgb[..., i].ravel().astype(int) for i, c in enumerate("rgb")}}))
    got = df.withColumn("v", spectral.to_byte(spectral.veg_index(name, F.col("r"), F.col("g"), F.col("b"))))
    assert np.abs(back(got, "v") - kernels.index_bytes(rgb, name).astype(int)).max() == 0


def test_overlap_of_field_long_lines_equals_all_pairs(spark):
    rng = np.random.default_rng(6)
    data = []
    for i in range(120):
        base, a = rng.uniform(0, 60), math.radians(37 + rng.uniform(-0.3, 0.3) + (180 if i % 2 else 0) + (90 if i > 112 else 0))
        length = rng.choice([0.0, 2.0, 40.0, 300.0])
        x, y = 500 - base * math.sin(a), 900 + base * math.cos(a) + rng.uniform(0, 100) * (i % 3 == 0)
        data.append(("p" if i % 5 else "q", i, *map(float, (x, y, x + length * math.cos(a), y + length * math.sin(a)))))
    df = spark.createDataFrame(data, "prj string, idx long, x1 double, y1 double, x2 double, y2 double")
    ends = lambda s: ((F.col(f"x1{s}"), F.col(f"y1{s}")), (F.col(f"x2{s}"), F.col(f"y2{s}")))
    other = df.select("prj", *[F.col(c).alias(f"{c}_b") for c in ("idx", "x1", "y1", "x2", "y2")])
    want = df.join(other, "prj").where((F.col("idx") < F.col("idx_b")) & (geometry.segment_distance(*ends(""), *ends("_b")) < 0.6)).select("prj", "idx", "idx_b")
    assert sorted(map(tuple, rows.overlap_pairs(df, "prj", width=0.6).collect())) == sorted(map(tuple, want.collect())) and want.count() > 20


def test_products_restart_and_a_field_without_an_angle(spark, tmp_path):
    y, x = np.mgrid[:400, :400]
    plant = (x % 40 > 12) & (x % 40 < 28)
    rgb = np.where(plant[..., None], [40, 160, 40], [150, 120, 90]) + RNG.integers(0, 6, (400, 400, 3))
    field = pd.DataFrame({"prj": "p", "x": x.ravel(), "y": y.ravel(), **{c: rgb[..., i].ravel() for i, c in enumerate("rgb")}})
    bare = field[(field["x"] < 60) & (field["y"] < 60)].assign(prj="bare", r=150, g=120, b=90)
    pixels = spark.createDataFrame(pd.concat([field, bare]))
    project = lambda n: (n, n, n, [400, 400], [0, 0], [0.05, -0.05], [1000.0, 2000.0, 1020.0, 2020.0], "EPSG:32618", "", 2)
    projects = spark.createDataFrame([project("p"), project("bare")], SCHEMA)
    ring = [{"x": float(a), "y": float(b)} for a, b in ((999, 1999), (1021, 1999), (1021, 2021), (999, 2021), (999, 1999))]
    masks = spark.createDataFrame([("p", ring), ("bare", ring)], "prj string, ring array<struct<x:double,y:double>>")
    out = fields.run(pixels, projects, masks, least_px=5.0)
    assert [tuple(r) for r in out["errors"].collect()] == [("bare", "no tile has a row angle")]
    assert out["points"].count() == 3 * out["candidates"].count() == 30
    fields.write_products(out, projects, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/export").count() == spark.read.parquet(f"{tmp_path}/buffers").count() == out["rows"].count() == 9
    kml = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/kml").collect())
    assert kml.count("<Placemark>") == 9 and manifests.read_results(spark, f"{tmp_path}/results").first()["candidatelines"] == 9
    assert spark.read.option("header", True).option("sep", ";").csv(f"{tmp_path}/angles").count() == out["tile_angles"].where("not isnan(angle)").count()
    done = spark.read.parquet(f"{tmp_path}/contours")
    again = fields.run(pixels.where("prj = 'none'"), projects, masks, least_px=5.0, done=done)
    assert sorted(map(str, again["rows"].select("prj", "idg").collect())) == sorted(map(str, out["rows"].select("prj", "idg").collect()))


def test_a_broken_projects_table_is_an_error(spark, tmp_path):
    assert landing.existing(spark, f"{tmp_path}/none") is None
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_text("no table")
    with pytest.raises(Exception):
        landing.existing(spark, f"{tmp_path}/broken").collect()


def test_contours_and_tile_images_there_and_back(spark, tmp_path):
    found = spark.createDataFrame([("p", 1, 2, 0, [(1, 2), (5, 2), (5, 9)])], "prj string, col int, row int, contour_id int, pts array<struct<x:int,y:int>>")
    rasters.write_contours(found, f"{tmp_path}/c")
    assert [r.asDict(True) for r in rasters.read_contours(spark, f"{tmp_path}/c").select(found.columns).collect()] == [r.asDict(True) for r in found.collect()]
    path = vectors.write_table(found, str(tmp_path), "named")
    assert path.endswith("/named") and spark.read.parquet(path).count() == 1


def test_statistical_rows_keep_the_outermost_line_and_number_from_its_side(spark):
    """Ten upright rows 2 m apart, each in two tiles: the row farthest to the left of the first line is number 0, at the probe's 1 m."""
    data = [("p", 1 + i % 2, 1, k * 2 + i % 2, 1000.0 + 2 * k + 0.001 * (i % 2), 2000.0 + 10 * (i % 2), 1000.0 + 2 * k + 0.001 * (i % 2), 2008.0 + 10 * (i % 2)) for k in range(10) for i in range(2)]
    tile_lines = spark.createDataFrame(data, "prj string, col int, row int, idx long, x1 double, y1 double, x2 double, y2 double").withColumns({"d": F.lit(0.0), "id": F.lit(0)})
    ring = [{"x": float(a), "y": float(b)} for a, b in ((999, 1999), (1020, 1999), (1020, 2021), (999, 2021), (999, 1999))]
    masks = spark.createDataFrame([("p", ring)], "prj string, ring array<struct<x:double,y:double>>")
    geometric, statistical, counts = fields.build_rows(tile_lines, masks)
    found = sorted((r["id"], round(r["geo_dist"], 3), round(r["x1"])) for r in statistical.collect())
    assert [f[0] for f in found] == list(range(10)) and [f[1] for f in found] == pytest.approx([1 + 2 * k for k in range(10)], abs=0.01)
    assert [f[2] for f in found] == [1000 + 2 * k for k in range(10)]  # the lines run north, so the left is the west
    assert counts.first()["resultinglines"] == 10 and geometric.count() == 10


def _mixed_lines(spark):
    """Parallel, square, crossing, long and repeated lines, dense enough for large groups."""
    rng = np.random.default_rng(7)
    made = []
    for i in range(260):
        x, y = rng.uniform(0, 14, 2)
        size, turn = (0.0, 0.0) if i % 50 == 3 else (rng.uniform(0.2, 4), rng.normal(1.2, 0.05)) if i % 20 else (rng.uniform(3, 40), rng.uniform(0, 3))
        made.append((f"p{i % 2}", i, float(x), float(y), float(x + size * np.cos(turn)), float(y + size * np.sin(turn))))
    made += [(p, i + 1000, *ends) for p, i, *ends in made[:20]]
    return made, spark.createDataFrame(made, "prj string, idx long, x1 double, y1 double, x2 double, y2 double")


def test_overlap_pairs_come_once_and_are_not_written(spark, monkeypatch):
    made, frame = _mixed_lines(spark)
    cross = spark.createDataFrame([(*a, *b[1:]) for a in made for b in made if a[0] == b[0] and a[1] < b[1]], "prj string, i long, ax double, ay double, bx double, by double, j long, cx double, cy double, dx double, dy double")
    far = geometry.segment_distance(*[(F.col(f"{c}x"), F.col(f"{c}y")) for c in "abcd"])
    want = sorted(tuple(r) for r in cross.where(far < 0.6).select("prj", "i", "j").collect())

    def written(df):
        raise AssertionError("pairs written")

    monkeypatch.setattr(rows, "checkpointed", written)
    assert sorted(tuple(r) for r in rows.overlap_pairs(frame, "prj").collect()) == want and len(want) > 500


def test_overlap_groups_without_all_pairs(spark):
    _, frame = _mixed_lines(spark)
    for part in (frame, frame.where("idx % 5 = 0"), frame.where("idx % 50 = 3"), frame.where("idx < 0")):
        want = rows.dissolve_groups(part, rows.overlap_pairs(part, "prj"), "prj")
        assert sorted(tuple(r) for r in rows.overlap_groups(part, "prj").collect()) == sorted(tuple(r) for r in want.collect())


def test_tile_lines_at_one_distance_but_for_the_last_bits(spark):
    made = [("p", c, 1, 2 * c + i, (c - 1) * 40 + 20 + s * (0.1 + c / 7), 10.0) for c in range(1, 60) for i, s in ((0, 1), (1, -1))]
    frame = spark.createDataFrame([(*m, m[4], 13.0) for m in made], "prj string, col int, row int, idx long, x1 double, y1 double, x2 double, y2 double")
    tiles = spark.createDataFrame([("p", c, 1, 1, (c - 1) * 40.0, 0.0, c * 40.0, 40.0) for c in range(1, 60)], "prj string, col int, row int, seed int, xmin double, ymin double, xmax double, ymax double")
    assert {r["col"]: r["idx"] for r in lines.clean_tile_lines(frame, tiles).collect()} == {c: 2 * c for c in range(1, 60)}


def test_tile_distances_to_the_last_bit(spark):
    """Without a gap, lines are one only if their distances are the same double, with the functions of the C library as in SQL."""
    rng, data, tiles, want = np.random.default_rng(12), [], [], {}
    for t in range(300):
        seed, x0, y0 = t % 4 + 1, 40.0 * t, 40.0 * (t % 7)
        tiles.append(("p", t, 0, seed, x0, y0, x0 + 40, y0 + 40))
        for i in range(6):
            x, y, dx, dy = (float(c) for c in (*rng.uniform(15, 25, 2), *rng.uniform(-9, 9, 2)))
            line = (x0 + x, y0 + y, x0 + x + dx, y0 + y + dy)
            data.append(("p", t, 0, t * 6 + i, *line))
            (ax, bx), (ay, by) = ((p - (q - p), p + (q - p)) for p, q in ((line[0], line[2]), (line[1], line[3])))  # as extended, and cut to all of itself
            line = (ax, ay, ax + (bx - ax), ay + (by - ay))
            if i == 0:
                azimuth = math.degrees(math.atan2(line[2] - line[0], line[3] - line[1]))
                angle = math.radians((azimuth + 360 if azimuth <= 0 else azimuth) + 270)
            corner = x0 if seed == 3 else x0 + 40
            sx = {1: (x0 + x0 + 40) / 2, 2: x0}.get(seed, corner + math.sin(angle) * 100)
            sy = {1: y0 + 40, 2: (y0 + y0 + 40) / 2}.get(seed, y0 + 40 + math.cos(angle) * 100)
            want[t * 6 + i] = math.sqrt(math.pow(sx - (line[0] + line[2]) / 2, 2) + math.pow(sy - (line[1] + line[3]) / 2, 2))
    table = spark.createDataFrame(data, "prj string, col int, row int, idx long, x1 double, y1 double, x2 double, y2 double")
    facts = spark.createDataFrame(tiles, "prj string, col int, row int, seed int, xmin double, ymin double, xmax double, ymax double")
    got = {r["idx"]: r["d"] for r in lines.clean_tile_lines(table, facts, ratio=1.0, gap=0.0).collect()}
    assert len(got) > 1700 and all(want[i] == d for i, d in got.items())


@pytest.mark.parametrize("parcel", [7, 1 << 18])
def test_nearest_lines_candidates_are_not_moved(spark, monkeypatch, parcel):
    """Points at one place, lines at one place, ties, points far off and fields without lines: as from all pairs, in parts of any size, and no aggregate sorts the pairs."""
    rng, made, asked = np.random.default_rng(5), [], []
    for i in range(400):
        x, y = np.round(rng.uniform(0, 30, 2), 1)
        dx, dy = ((0.0, 0.0), (1.0, 3.0), (-2.0, 3.0), (25.0, 1.0))[min(i % 23, 3)]
        made.append((f"p{i % 2}", 400 - i, float(x), float(y), float(x + dx), float(y + dy)))
    made += [(p, i + 1000, *ends) for p, i, *ends in made[::3]]
    for i in range(300):
        x, y = np.round(rng.uniform(-2, 32, 2), 1) if i % 40 else (900.0, -700.0)
        asked.append((f"p{i % 3}", i, float(x), float(y)))
    asked += [(p, i + 1000, x, y) for p, i, x, y in asked[:90]] + [("p0", 5000, None, 1.0)]
    lines_ = spark.createDataFrame(made, "prj string, idx long, x1 double, y1 double, x2 double, y2 double").repartition(3)
    points = spark.createDataFrame(asked, "prj string, point int, x double, y double").repartition(3)
    plans, keep = [], nearest.checkpointed

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(nearest, "checkpointed", seen)
    monkeypatch.setattr(nearest, "PARCEL", parcel)
    got = {(r["prj"], r["point"]): (r["idx"], r["dist"]) for r in rows.nearest_line(points, lines_, "prj", cell=3.0).collect()}
    want = {}
    for p, i, x, y in asked:
        for q, k, ax, ay, bx, by in made:
            if p == q and x is not None:
                dx, dy = bx - ax, by - ay
                t = min(1.0, max(0.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
                want[p, i] = min(want.get((p, i), (math.inf, 0)), (round(math.hypot(x - (ax + dx * t), y - (ay + dy * t)), 9), k))
    assert len(got) == len(want) > 250 and all(got[k][0] == v[1] and abs(got[k][1] - v[0]) < 2e-9 for k, v in want.items())
    assert plans and not any("SortAggregate" in p for p in plans)


@pytest.mark.parametrize("parcel, most, few", [(1 << 18, 1 << 12, 1e9), (50, 3, 20.0)])
def test_overlapping_lines_at_one_place_are_measured_once(spark, monkeypatch, parcel, most, few):
    """Lines come as lists, those at one place as one; all pairs follow, each once, in blocks and lists of any size, and nothing joins lines."""
    made, _ = _mixed_lines(spark)
    made = [(p, i + 1300 * k, *ends) for k in range(6) for p, i, *ends in made[k::2]] + [("p0", 99_999, None, 1.0, 2.0, 3.0)]
    frame = spark.createDataFrame(made, "prj string, idx long, x1 double, y1 double, x2 double, y2 double").repartition(5)
    for module, name, value in ((blocks, "PARCEL", parcel), (overlaps, "PARCEL", parcel), (overlaps, "LIST", most), (overlaps, "BLOCK", few)):
        monkeypatch.setattr(module, name, value)
    lists = overlaps.near_lists(frame, rows._frames(frame, "prj", least=2.4), "prj", width=0.6).collect()
    got = sorted(tuple(r) for r in rows.overlap_pairs(frame, "prj").collect())
    n = {i: ends for _, i, *ends in made}
    both = [(a[0], a[1], b[1]) for a in made for b in made if a[0] == b[0] and a[1] < b[1] and a[2] is not None and b[2] is not None]
    far = kernels.segments_apart(*np.array([n[a] + n[b] for _, a, b in both], float).T)[0]
    want = sorted(p for p, d in zip(both, far) if d < 0.6)
    assert got == want and len(want) > 5_000
    assert len(lists) < len(want) and all(max(len(r["as"]), len(r["bs"])) < 2 * most for r in lists)
    assert "Join" not in rows.overlap_pairs(frame, "prj")._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
