"""Shapes of contours against the array kernels and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import blocks, contours, kernels, shapes

SCHEMA = "k int, pts array<struct<x:double,y:double>>"


def frame(spark, lists):
    return spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in pts]) for i, pts in enumerate(lists)], SCHEMA)


def ellipse(theta, a=30.0, b=8.0, n=40, noise=0.0, seed=1):
    t, angle = np.linspace(0, 2 * math.pi, n, endpoint=False), math.radians(theta)
    pts = np.outer(a * np.cos(t), [-math.sin(angle), math.cos(angle)]) + np.outer(b * np.sin(t), [math.cos(angle), math.sin(angle)]) + 50
    return pts + np.random.default_rng(seed).normal(0, noise, pts.shape)


def smallest(pts):
    """The least circle among those about two points and through three."""
    best = (math.inf,)
    holds = lambda x, y, r: all(math.hypot(px - x, py - y) <= r + 1e-7 for px, py in pts)
    for p, q in itertools.combinations(pts, 2):
        c = ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2, math.dist(p, q) / 2)
        if c[2] < best[0] and holds(*c):
            best = (c[2], c[0], c[1])
    for p, q, k in itertools.combinations(pts, 3):
        d = 2 * ((q[0] - p[0]) * (k[1] - p[1]) - (q[1] - p[1]) * (k[0] - p[0]))
        if abs(d) > 1e-12:
            b2, c2 = (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2, (k[0] - p[0]) ** 2 + (k[1] - p[1]) ** 2
            ux, uy = ((k[1] - p[1]) * b2 - (q[1] - p[1]) * c2) / d, ((q[0] - p[0]) * c2 - (k[0] - p[0]) * b2) / d
            c = (p[0] + ux, p[1] + uy, math.hypot(ux, uy))
            if c[2] < best[0] and holds(*c):
                best = (c[2], c[0], c[1])
    return best


def test_least_circles(spark):
    rng = np.random.default_rng(5)
    lists = [[tuple(map(float, p)) for p in rng.integers(0, 12, (n, 2))] for n in (2, 3, 5, 9, 14, 14)] + [[(0.0, 0.0), (1.0, 1.0), (5.0, 5.0)], [(0.0, 0.0), (0.0, 0.0), (4.0, 0.0)]]
    got = frame(spark, lists).select("k", shapes.min_circle(F.col("pts")).alias("c")).collect()
    for r in got:
        want = smallest(lists[r["k"]])
        assert (r["c"]["r"], r["c"]["x"], r["c"]["y"]) == pytest.approx(want, abs=1e-6)
    odd = frame(spark, [[(3, 4)], []]).select("k", shapes.min_circle(F.col("pts")).alias("c")).orderBy("k").collect()
    assert tuple(odd[0]["c"]) == (3.0, 4.0, 0.0) and odd[1]["c"] is None


def test_ellipses_and_rectangles(spark):
    lists = [ellipse(t) for t in (0.0, 10, 45, 90, 135, 170)] + [ellipse(t, noise=0.7, seed=t) for t in (20, 77, 160)] + [[(0, 0), (1, 0), (2, 1), (0, 5)], [(i, i) for i in range(9)], [(i, i * i) for i in range(-5, 6)]]
    df = frame(spark, lists)
    got = {r["k"]: r for r in shapes.contour_shapes(df, "k").collect()}
    for i, pts in enumerate(lists[:9]):
        assert abs((got[i]["ellipse_angle"] - kernels.ellipse_angle(pts) + 90) % 180 - 90) < 1e-6
        cx, cy, w, h, angle, _ = kernels.min_area_rect(pts)
        assert got[i]["w"] * got[i]["h"] == pytest.approx(w * h, abs=1e-4)
        assert all(math.dist((c["x"], c["y"]), (got[i]["cx"], got[i]["cy"])) == pytest.approx(math.hypot(w, h) / 2, abs=0.2) for c in got[i]["corners"]) and -90 <= got[i]["rect_angle"] < 0
    assert [got[i]["ellipse_angle"] for i in (9, 10)] == [None, None]  # four points, points on a line
    assert got[11]["ellipse_angle"] is None or got[11]["ellipse_angle"] >= 0  # a parabola
    points = spark.range(20_000).select((F.col("id") % 4).alias("k"), (100 + 9 * F.cos(F.col("id") * 0.01)).alias("x"), (70 + 4 * F.sin(F.col("id") * 0.01)).alias("y"))
    assert all(r["angle"] == pytest.approx(90, abs=0.1) for r in shapes.ellipse_angles(points, "k").collect())


def test_hulls_and_rectangles_of_contours_move_no_points(spark):
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, k, (n, 2)).tolist() for k in (1, 3, 12, 200) for n in (1, 2, 3, 7, 60)] + [[[i, i * i] for i in range(40)], [[i, -abs(i - 20)] for i in range(40)], [[2, i] for i in range(9)]]
    frame = spark.createDataFrame([(i, [tuple(p) for p in s]) for i, s in enumerate(sets)] + [(99, [])], "k long, pts array<struct<x:int,y:int>>")
    got = {r["k"]: [tuple(p) for p in r["hull"]] for r in contours.contour_hulls(frame, "k").collect()}
    assert got == {i: [tuple(p) for p in kernels.convex_hull(np.array(s, float)).tolist()] for i, s in enumerate(sets)}
    plan = shapes.min_rectangles(frame, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("d, whole", [(1.0, True), (1.0, False), (0.7, False)])
def test_close_contours_come_once_and_are_not_moved(spark, d, whole):
    """Many points of a contour near many of another, some on the borders of cells and blocks, one contour in two rows: no pair twice, none lost."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(160):
        pts = rng.normal(rng.uniform(-9, 9, 2), 4, (int(rng.integers(0, 9)), 2))
        pts = (np.round(pts) if whole else np.round(pts, 1)).tolist()
        rows.append(("f", i % 2, i // 2 if i < 150 else 3, [{"x": x, "y": y} for x, y in pts]))
    out = contours.close_contours(spark.createDataFrame(rows, "prj string, col int, contour_id long, pts array<struct<x:double,y:double>>").repartition(3), "prj", "col", d=d)
    met = sorted((r["prj"], r["col"], r["a"], r["b"]) for r in out.collect())
    wanted = {
        (p, c, i, j) for p, c, i, u in rows for _, e, j, v in rows
        if c == e and i < j and any((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 < d * d for a in u for b in v)
    }
    assert met == sorted(wanted) and len(wanted) > 50
    assert out._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")  # nothing moves pairs


def test_contours_smoothed_many_at_once(spark, monkeypatch):
    """The same points as one at a time: lengths from one point to more than the short ones, points in a row alike, closed twice, on one line; none and null."""
    rng = np.random.default_rng(8)
    rings = [np.round(rng.normal(50, 20, (int(k), 2))).astype(int).tolist() for k in rng.integers(1, 45, 400)]
    rings += [[[5, 5]] * 4, [[1, 1], [1, 1], [4, 4], [4, 4], [9, 1], [1, 1]], [[0, 0], [5, 0], [10, 0], [5, 0]], [[0, 0], [3, 0], [0, 0]], [[0, 0], [3, 0], [0, 0], [3, 0]], [[-3, -7], [8, -7], [8, 2]]]
    wanted = {i: kernels.resample_closed(r).tolist() for i, r in enumerate(rings)} | {9000: [], 9001: None}
    rows = [(i, [{"x": x, "y": y} for x, y in r]) for i, r in enumerate(rings)] + [(9000, []), (9001, None)]
    calls = []
    one = kernels.resample_closed
    monkeypatch.setattr(kernels, "resample_closed", lambda *a: calls.append(1) or one(*a))
    flat = [p for r in rings for p in r]
    many = kernels.resample_many(np.append(0, np.cumsum([len(r) for r in rings])), *np.array(flat).T)
    assert many.tolist() == [wanted[i] for i in range(len(rings))] and len(calls) < len(rings) / 2
    monkeypatch.undo()
    frame_ = spark.createDataFrame(rows, "id int, pts array<struct<x:int,y:int>>").repartition(2)
    out = contours.smooth_contours(frame_)
    assert out.schema["pts"].dataType == frame_.schema["pts"].dataType
    assert {r["id"]: r["pts"] and [[p["x"], p["y"]] for p in r["pts"]] for r in out.collect()} == wanted


def test_ellipses_of_contours_in_their_rows_in_point_order(spark):
    """Points on two lines have no ellipse but for the last bits, which follow from the order of the points alone; nothing moves."""
    rng = np.random.default_rng(3)
    lists = [[(int(a), int(rng.integers(0, 2)) * 7 + int(a) * int(t)) for a in rng.integers(0, 40, 7)] for t in rng.integers(-3, 4, 300)] + [ellipse(t) for t in (0.0, 45, 135)]
    df = frame(spark, lists)
    out = shapes.contour_ellipse_angles(df, "k")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: r["angle"] for r in out.collect()}
    again = {r["k"]: r["angle"] for r in shapes.contour_ellipse_angles(df.repartition(7), "k").collect()}
    assert got == again and len(got) == len(lists)
    for i, t in enumerate((0.0, 45, 135)):
        assert abs((got[300 + i] - kernels.ellipse_angle(lists[300 + i]) + 90) % 180 - 90) < 1e-6
    for k, pts in enumerate(lists[:300]):
        (x, y), n = np.array(pts, float).T, len(pts)
        far = max(abs(c - c.sum() / n).max() for c in (x, y)) or 1.0
        u, v = ((c - c.sum() / n) / far for c in (x, y))
        one = kernels.power_sums(np.zeros(n, int), 1, x, y, shapes._POWERS)
        for (i, j), s in zip(shapes._POWERS, one):
            want = 0.0
            for a, b in zip(u, v):
                p = 1.0
                for c in (a,) * i + (b,) * j:
                    p *= c
                want += p
            assert s[0] == want


@pytest.mark.parametrize("parcel, most", [(1 << 18, 1 << 12), (20, 2)])
def test_contours_of_the_same_points_meet_others_as_one(spark, monkeypatch, parcel, most):
    """Points in any order and twice, zeros of either sign, nulls: lists name contours of the same points together, and all pairs follow, each once, in chunks and lists of any size."""
    rng, data = np.random.default_rng(9), []
    kinds = [np.round(rng.normal(rng.uniform(-6, 6, 2), 3, (int(rng.integers(0, 6)), 2))).tolist() for _ in range(30)]
    for i in range(240):
        pts = [kinds[i % 30][k] for k in rng.permutation(len(kinds[i % 30]))]
        pts = [{"x": -x if x == 0 and i % 2 else x, "y": y} for x, y in (pts + pts[:1] if i % 3 else pts)]
        data.append(("f", i // 30 % 2, (i * 7) % 240, pts + [{"x": None, "y": 1.0}, {"x": float("nan"), "y": 1.0}] * (i % 5 == 0)))
    for module, name, value in ((contours, "PARCEL", parcel), (contours, "LIST", most)):
        monkeypatch.setattr(module, name, value)
    frame_ = spark.createDataFrame(data, "prj string, col int, contour_id long, pts array<struct<x:double,y:double>>").repartition(3)
    lists = contours.close_lists(frame_, "prj", "col")
    plain = {i: {(p["x"], p["y"]) for p in pts if p["x"] is not None} for _, _, i, pts in data}
    wanted = sorted((p, c, i, j) for p, c, i, _ in data for _, e, j, _ in data if c == e and i < j and plain[i] & plain[j])
    for got in (blocks.pairs_of(lists, "prj", "col"), contours.close_contours(frame_, "prj", "col")):
        assert sorted(tuple(r) for r in got.collect()) == wanted and len(wanted) > 500
    rows = lists.collect()
    assert all(max(len(r["as"]), len(r["bs"])) < 2 * most for r in rows) and (most < 9 or len(rows) < len(wanted) / 4)
