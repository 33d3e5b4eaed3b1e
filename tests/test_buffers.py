"""Dissolved buffers against counts of a fine raster; rings against their areas; ring ranking and label spreading against plain walks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import buffers, chains, rows

LINES = "prj string, idx long, x1 double, y1 double, x2 double, y2 double"


def raster(lines, r, step=0.004):
    """(area, x, y) of the union of capsules by counting cells."""
    pts = np.array(lines)
    x0, y0, x1, y1 = pts[:, [0, 2]].min() - r, pts[:, [1, 3]].min() - r, pts[:, [0, 2]].max() + r, pts[:, [1, 3]].max() + r
    x, y = np.meshgrid(np.arange(x0, x1, step) + step / 2, np.arange(y0, y1, step) + step / 2)
    hit = np.zeros(x.shape, bool)
    for ax, ay, bx, by in lines:
        dx, dy = bx - ax, by - ay
        t = np.clip(((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy), 0, 1) if dx or dy else 0
        hit |= np.hypot(x - ax - t * dx, y - ay - t * dy) <= r
    return hit.sum() * step * step, x[hit].mean(), y[hit].mean()


def cases():
    at = lambda x, y, *lines: [(a + x, b + y, c + x, d + y) for a, b, c, d in lines]
    rng = np.random.default_rng(3)
    turned = [(*rng.uniform(0, 1.5, 2), *rng.uniform(0, 1.5, 2)) for _ in range(9)]
    return [
        at(0, 0, (0, 0, 2, 0)),
        at(10, 0, (0, 0, 2, 0), (0, 0, 2, 0)),  # the same line twice
        at(20, 0, (0, 0, 2, 0), (1, 0, 3, 0)),  # one along the other
        at(30, 0, (0, 0, 2, 0), (1, -1, 1, 1)),  # a cross
        at(40, 0, (0, 0, 2, 0), (2, 0, 2, 2), (2, 2, 0, 2), (0, 2, 0, 0)),  # a frame with a hole
        at(50, 0, (0, 0, 0, 0), (0.3, 0.1, 0.3, 0.1)),  # points
        at(60, 0, *turned),
        at(300_000, 4_600_000, (0, 0, 1, 2), (0.2, 0, 1.3, 2), (0.5, 0.1, 1.5, 2.2)),
    ]


@pytest.fixture(scope="module")
def made(spark):
    data, i = [], 0
    for group in cases():
        for line in group:
            data.append(("p", i, *map(float, line)))
            i += 1
    lines = spark.createDataFrame(data, LINES)
    pairs = rows.overlap_pairs(lines, "prj", width=0.6).cache()
    groups = rows.dissolve_groups(lines, pairs, "prj")
    borders = buffers.union_borders(lines, groups, pairs, "prj", radius=0.3).cache()
    return {r["grp"]: r for r in buffers.dissolved_areas(borders, "prj", radius=0.3).collect()}, borders


def test_areas_and_centroids(made):
    areas, _ = made
    first = 0
    for group in cases():
        got, (area, x, y) = areas[first], raster(group, 0.3)
        assert got["area"] == pytest.approx(area, rel=0.01) and (got["x"], got["y"]) == pytest.approx((x, y), abs=0.01)
        first += len(group)
    assert len(areas) == len(cases()) and areas[0]["area"] == pytest.approx(2 * 0.6 + math.pi * 0.09, abs=1e-12)


def test_rings(made):
    areas, borders = made
    points = buffers.dissolved_rings(borders, "prj", radius=0.3).collect()
    rings = {}
    for r in points:
        rings.setdefault((r["grp"], r["ring"]), []).append((r["place"], r["step"], r["x"], r["y"]))
    total, holes = {}, 0
    for (grp, _), pts in rings.items():
        x, y = np.array([p[2:] for p in sorted(pts)]).T
        x, y = x - x.min(), y - y.min()
        signed = float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)
        holes += signed < 0
        total[grp] = total.get(grp, 0.0) + signed
        assert [p for p, _, _, _ in sorted(pts)][0] == 0
    assert total.keys() == areas.keys() and all(total[g] == pytest.approx(areas[g]["area"], rel=0.005) for g in total)
    assert holes >= 1


def test_ring_places(spark):
    rng, data, want = np.random.default_rng(4), [], {}
    for k in range(3):
        order = rng.permutation(500).tolist()
        for size in (1, 2, 3, 90, 404):
            ring, order = order[:size], order[size:]
            data += [(k, a, b) for a, b in zip(ring, ring[1:] + ring[:1])]
            at = ring.index(min(ring))
            want |= {(k, n): (min(ring), (i - at) % size) for i, n in enumerate(ring)}
    got = chains.ring_places(spark.createDataFrame(data, "k long, node long, next long"), "k").collect()
    assert {(r["k"], r["node"]): (r["ring"], r["place"]) for r in got} == want


def test_least_labels(spark):
    links = [("k", i, i + 1) for i in range(100, 400)] + [("k", 7, 250), ("k", 9, 9), ("m", 1, 2), ("m", 5, 2)]
    nodes = [("k", i) for i in (7, 9, *range(100, 401))] + [("m", i) for i in (1, 2, 3, 5)]
    got = chains.least_labels(spark.createDataFrame(nodes, "k string, node long"), spark.createDataFrame(links, "k string, a long, b long"), "k").collect()
    assert {(r["k"], r["node"]): r["label"] for r in got} == {("k", i): 9 if i == 9 else 7 for i in (7, 9, *range(100, 401))} | {("m", 1): 1, ("m", 2): 1, ("m", 3): 3, ("m", 5): 1}


def test_no_lines(spark):
    lines, none = spark.createDataFrame([], LINES), spark.createDataFrame([], "prj string, a long, b long")
    borders = buffers.union_borders(lines, spark.createDataFrame([], "prj string, idx long, grp long"), none, "prj")
    assert buffers.dissolved_areas(borders, "prj").count() == 0 and buffers.dissolved_rings(borders, "prj").count() == 0


def test_borders_without_pairs(spark, monkeypatch):
    """Lines of all directions over many blocks, crowded and sparse, points, reversed and repeated ones: as held against all pairs, without them."""
    rng = np.random.default_rng(6)
    near = lambda n, x, y, side: [(x + a, y + b, x + a + 1 + c / 9, y + b + 3) for a, b, c in rng.uniform(0, side, (n, 3))]
    lines = near(250, 0, 0, 3) + near(60, 8, -4, 25) + [(*rng.uniform(-9, 30, 2), *rng.uniform(-9, 30, 2)) for _ in range(6)] + [(-20, -20, 50, 60), (50, 60, -20, -20), (4, 4, 4, 4), (40, 0, 40, 0)]
    lines += lines[:5]
    table = spark.createDataFrame([(k, i, *map(float, line)) for k in "pq" for i, line in enumerate(lines) if k == "p" or i % 3], LINES)
    own = table.groupBy("prj", "x1", "y1", "x2", "y2").agg(F.min("idx").alias("idx"))
    pairs = rows.overlap_pairs(own, "prj", width=0.6).cache()
    want = buffers.union_borders(own, rows.dissolve_groups(own, pairs, "prj"), pairs, "prj", radius=0.3)

    def fault(*a, **k):
        raise AssertionError("all pairs of lines")

    monkeypatch.setattr(rows, "overlap_pairs", fault)
    seen = lambda df: sorted((r["prj"], r["grp"], r["idx"], r["piece"], round(r["s"], 7), round(r["e"], 7)) for r in df.collect())
    got = rows.dissolved_borders(table, "prj", width=0.6)
    assert seen(got) == seen(want) and got.count() > 500
    assert seen(rows.dissolved_borders(table, "prj", width=0.6, block=3.0)) == seen(want)
    assert rows.dissolved_borders(table.limit(0), "prj").count() == 0


def test_ring_places_in_tasks_and_in_rounds(spark, monkeypatch):
    """Small keys are ranked without a round over tables, larger ones in rounds, with the same places; nodes may be structs."""
    rng, data = np.random.default_rng(8), []
    for k in range(40):
        order = rng.permutation(300).tolist()
        for size in (1, 2, 50 + k, 247 - k):
            ring, order = order[:size], order[size:]
            data += [(str(k % 7), k, (a // 9, a % 9, a / 8), (b // 9, b % 9, b / 8)) for a, b in zip(ring, ring[1:] + ring[:1])]
    data += [("z", 0, (a, 0, 0.5), ((a + 1) % 900, 0, 0.5)) for a in range(900)]
    node = "struct<idx:long,piece:int,s:double>"
    steps = spark.createDataFrame(data, f"k string, g long, node {node}, next {node}")
    seen = lambda df: sorted((r["k"], r["g"], tuple(r["node"]), tuple(r["ring"]), r["place"]) for r in df.collect())
    want = seen(chains.ring_places(steps, "k", "g", at_once=0))
    assert len(want) == len(data) and seen(chains.ring_places(steps, "k", "g", at_once=500)) == want

    def fault(*a, **k):
        raise AssertionError("rounds over tables")

    monkeypatch.setattr(chains, "_ring_places", fault)
    assert seen(chains.ring_places(steps, "k", "g")) == want
