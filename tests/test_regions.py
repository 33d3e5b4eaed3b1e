"""Components, borders and distances of masks against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from furrow.operators import chains
from furrow.sources.shared import checkpointed
from furrow.operators import kernels, regions

RNG = np.random.default_rng(11)


def masks():
    frame = np.zeros((9, 9), int)
    frame[1:8, 1:8] = 1
    frame[2:7, 2:7] = 0
    frame[4, 4] = 1  # an island in a hole
    line = np.zeros((5, 200), int)
    line[2, 3:190] = 1
    return {"noise": (RNG.random((40, 70)) < 0.45).astype(int), "few": (RNG.random((30, 30)) < 0.1).astype(int), "eye": np.eye(6, dtype=int), "frame": frame, "line": line, "full": np.ones((7, 4), int), "none": np.zeros((3, 3), int), "blob": kernels.dilate(np.where(RNG.random((50, 50)) < 0.01, 255, 0).astype(np.uint8), 7) // 255}


def pixels(spark, dense=False):
    rows = []
    for name, m in masks_once.items():
        for y in range(m.shape[0]):
            for x in range(m.shape[1]):
                if dense or m[y, x]:
                    rows.append((name, x, y, 255 if m[y, x] else 0))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["k", "px", "py", "mask"]))


masks_once = masks()


def walk(m):
    """The least place of each set pixel's component, by a walk from each."""
    label = {}
    for y, x in np.argwhere(m):
        if (x, y) in label:
            continue
        stack = [(int(x), int(y))]
        while stack:
            a, b = stack.pop()
            if 0 <= b < m.shape[0] and 0 <= a < m.shape[1] and m[b, a] and (a, b) not in label:
                label[(a, b)] = int(y) * (1 << 31) + int(x)
                stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return label


def test_components(spark):
    got = {}
    for r in regions.components(pixels(spark), "k").collect():
        got.setdefault(r["k"], {})[(r["px"], r["py"])] = (r["label"], r["area"])
    for name, m in masks_once.items():
        want = walk(m)
        area = pd.Series(list(want.values())).value_counts().to_dict()
        assert got.get(name, {}) == {p: (v, area[v]) for p, v in want.items()}
    large = regions.components(pixels(spark), "k", least_area=5)
    assert large.agg(F.min("area")).first()[0] >= 5


def test_a_strip_over_two_tiles_is_one_component(spark):
    strip = spark.createDataFrame([("p", x, 5 + x // 40) for x in range(30, 170)], "prj string, x int, y int")
    whole = regions.components(strip, "prj", x="x", y="y")
    assert whole.select("label", "area").distinct().collect() == [(5 * (1 << 31) + 30, 140)]
    tiled = strip.withColumn("col", F.floor(F.col("x") / 100))
    assert regions.components(tiled, "prj", "col", x="x", y="y").select("label").distinct().count() == 2


def cycle(points):
    """A ring of points whatever its start."""
    at = points.index(min(points))
    return tuple(points[at:] + points[:at])


def test_borders(spark):
    got = {}
    for r in regions.trace_contours(pixels(spark), "k").collect():
        got.setdefault(r["k"], []).append((cycle([(p["x"], p["y"]) for p in r["pts"]]), r["hole"]))
    for name, m in masks_once.items():
        want = [(cycle([tuple(map(int, p)) for p in pts]), hole) for pts, hole in kernels.trace_borders(m > 0)] if m.any() else []
        assert sorted(got.get(name, [])) == sorted(want), name


def test_distances(spark):
    got, cores = {}, {}
    dense = pixels(spark, dense=True)
    for r in regions.distances(dense, "k").collect():
        got[(r["k"], r["px"], r["py"])] = r["distance"]
    for r in regions.distance_mask(dense, "k").collect():
        cores[(r["k"], r["px"], r["py"])] = r["core"]
    for name, m in masks_once.items():
        ground, core = np.argwhere(m == 0), kernels.distance_mask(np.where(m > 0, 255, 0).astype(np.uint8))
        for y in range(m.shape[0]):
            for x in range(m.shape[1]):
                want = math.sqrt(((ground - (y, x)) ** 2).sum(axis=1).min()) if len(ground) else 0.0
                assert got[(name, x, y)] == pytest.approx(want, abs=1e-9) and cores[(name, x, y)] == core[y, x]


def test_distances_hold_no_python_objects_and_labels_are_not_broadcast(spark, monkeypatch):
    image = spark.range(3000).select(F.lit("i").alias("k"), (F.col("id") % 60).cast("int").alias("px"), F.floor(F.col("id") / 60).cast("int").alias("py"), F.when(F.col("id") % 7 == 0, 0).otherwise(255).alias("mask"))
    away = regions.distances(image, "k")
    assert "MapInPandas" not in away._jdf.queryExecution().executedPlan().toString() and away.count() == 3000
    plans = []
    monkeypatch.setattr(chains, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or checkpointed(df))
    nodes = spark.range(50).select(F.lit("i").alias("k"), F.col("id").alias("node"))
    links = spark.range(49).select(F.lit("i").alias("k"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["label"] for r in chains.least_labels(nodes, links, "k").collect()} == {0}
    assert plans and not any("Broadcast" in p for p in plans)


def test_tiles_are_traced_where_their_pixels_meet(spark, monkeypatch):
    """The rings, holes, order and first points of `borders`, in parts of a few images; nothing is written."""
    moved = pixels(spark).withColumns({"px": F.col("px") + 30, "py": F.col("py") + 7})
    rings = regions.borders(moved, "k").groupBy("k", "ring", "hole").agg(F.array_sort(F.collect_list(F.struct("place", "px", "py"))).alias("p")).collect()
    wanted = {}
    for r in sorted(rings, key=lambda r: (r["k"], r["hole"], r["ring"])):
        wanted.setdefault(r["k"], []).append((r["hole"], [(p["px"], p["py"]) for p in r["p"]]))
    written = []
    monkeypatch.setattr(regions, "checkpointed", lambda df: written.append(df) or checkpointed(df))
    monkeypatch.setattr(chains, "checkpointed", lambda df: written.append(df) or checkpointed(df))
    for most in (1, 500, 1 << 18):
        got = {}
        for r in sorted(regions.trace_contours(moved.repartition(5), "k", most=most).collect(), key=lambda r: (r["k"], r["contour_id"])):
            got.setdefault(r["k"], []).append((r["hole"], [(p["x"], p["y"]) for p in r["pts"]]))
            assert r["contour_id"] == len(got[r["k"]]) - 1
        assert got == wanted
    assert not written
