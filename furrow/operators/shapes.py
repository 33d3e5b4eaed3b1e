"""Shapes of contours as column expressions: least rectangle, least circle, ellipse. pts is an array of (x, y); whatever is summed or
folded is a contour's own points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators import contours as _contours
from furrow.operators import kernels


def min_rectangles(contours: DataFrame, *keys: str) -> DataFrame:
    """keys, cx, cy, w, h, rect_angle (in [-90, 0)), corners: the least rectangle about each contour's points along an edge of their hull; w
    is its side along rect_angle, h the other. Contours without points have no row."""
    box = _contours.ombb(_contours.contour_hulls(contours, *keys), *keys)
    c, s = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
    back = lambda u, v: (u * c - v * s, u * s + v * c)
    mid = back((F.col("u0") + F.col("u1")) / 2, (F.col("v0") + F.col("v1")) / 2)
    ring = [back(F.col(u), F.col(v)) for u, v in (("u0", "v0"), ("u1", "v0"), ("u1", "v1"), ("u0", "v1"))]
    corners = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ring])
    wide, tall = F.col("v1") - F.col("v0"), F.col("u1") - F.col("u0")
    return box.select(*keys, mid[0].alias("cx"), mid[1].alias("cy"), wide.alias("w"), tall.alias("h"), (F.col("angle") - 90).alias("rect_angle"), corners.alias("corners"))


def _round(x: Column, y: Column, r: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), r.alias("r"))


def _about_two(p: Column, q: Column) -> Column:
    dx, dy = p["x"] - q["x"], p["y"] - q["y"]
    return _round((p["x"] + q["x"]) / 2, (p["y"] + q["y"]) / 2, F.sqrt(dx * dx + dy * dy) / 2)


def _about_three(p: Column, q: Column, k: Column) -> Column:
    """The circle through three points; of three on a line that about the two farthest apart."""
    bx, by, cx, cy = q["x"] - p["x"], q["y"] - p["y"], k["x"] - p["x"], k["y"] - p["y"]
    d = 2 * (bx * cy - by * cx)
    safe = F.when(F.abs(d) > 1e-12, d)
    ux = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / safe
    uy = (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / safe
    widest = F.array_max(F.transform(F.array(_about_two(p, q), _about_two(p, k), _about_two(q, k)), lambda c: F.struct(c["r"].alias("r"), c["x"].alias("x"), c["y"].alias("y"))))
    return F.when(safe.isNull(), _round(widest["x"], widest["y"], widest["r"])).otherwise(_round(p["x"] + ux, p["y"] + uy, F.sqrt(ux * ux + uy * uy)))


def min_circle(pts: Column) -> Column:
    """The least circle (x, y, r) about points, null without any: points are taken in turn, and one outside the circle so far lies on the border of the circle about it and
    all before it, which is found the same way, with one and then two such points fixed."""
    plain = F.array_distinct(F.transform(pts, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))))
    numbered = F.transform(plain, lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), i.alias("i")))
    none = F.lit(None).cast("struct<x:double,y:double,r:double>")

    def outside(c: Column, p: Column) -> Column:
        dx, dy = p["x"] - c["x"], p["y"] - c["y"]
        return c.isNull() | (F.sqrt(dx * dx + dy * dy) > c["r"] + 1e-9)

    def with_two(p: Column, q: Column) -> Column:
        return F.aggregate(F.slice(plain, F.lit(1), q["i"]), _about_two(p, q), lambda c, k: F.when(outside(c, k), _about_three(p, q, k)).otherwise(c))

    def with_one(p: Column) -> Column:
        first = _round(p["x"], p["y"], F.lit(0.0))
        return F.aggregate(F.slice(numbered, F.lit(1), p["i"]), first, lambda c, q: F.when(outside(c, q), with_two(p, q)).otherwise(c))

    return F.aggregate(numbered, none, lambda c, p: F.when(outside(c, p), with_one(p)).otherwise(c))


_TERMS = ((2, 0), (1, 1), (0, 2), (1, 0), (0, 1))  # of the conic a x^2 + b xy + c y^2 + d x + e y = 1
_POWERS = sorted({(p[0] + q[0], p[1] + q[1]) for p in _TERMS for q in (*_TERMS, (0, 0))})


def conics(points: DataFrame, *keys: str) -> DataFrame:
    """keys, n, a, b, c, d, e of the conic nearest to each key's points (x, y) by algebraic least squares, in coordinates from their mean, scaled by the
    farthest of them. Sums of products of powers are partial aggregates, 14 numbers a key, whatever the number of points; the five equations are solved in a row.
    Fewer than five points, or points whose equations have no one solution, give null."""
    facts = points.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    scale = F.greatest(F.col("x1") - F.col("mx"), F.col("mx") - F.col("x0"), F.col("y1") - F.col("my"), F.col("my") - F.col("y0"))
    facts = facts.select(*keys, "mx", "my", F.when(scale > 0, scale).otherwise(F.lit(1.0)).alias("far"))
    near = points.join(facts, list(keys)).withColumn("_u", (F.col("x") - F.col("mx")) / F.col("far")).withColumn("_v", (F.col("y") - F.col("my")) / F.col("far"))

    def product(i: int, j: int) -> Column:
        out = F.lit(1.0)
        for _ in range(i):
            out = out * F.col("_u")
        for _ in range(j):
            out = out * F.col("_v")
        return out

    sums = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(product(i, j)).alias(f"s{i}{j}") for i, j in _POWERS])
    return _solved(sums, *keys)


def contour_conics(contours: DataFrame, *keys: str) -> DataFrame:
    """As conics, of each row's own points (pts); rows without points are left out. Nothing moves, and sums are taken in the order of the points, so that they end in the
    same bits wherever a contour lies: of points on two lines the last ones decide whether an ellipse fits."""
    packed = contours.where(F.size("pts") > 0).select(*keys, F.transform("pts", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("pts"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema if f.name != "pts")
    names = [f"s{i}{j}" for i, j in _POWERS]

    def run(batches):
        for batch in batches:
            pts = batch.column("pts")
            x, y = (c.to_numpy(zero_copy_only=False) for c in pts.flatten().flatten())
            n = np.diff(np.asarray(pts.offsets))
            sums = kernels.power_sums(np.repeat(np.arange(len(n)), n), len(n), x, y, _POWERS)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(n.astype(np.int64)), *[pa.array(c) for c in sums]], names=[*keys, "n", *names])

    return _solved(packed.mapInArrow(run, ", ".join([kept, "n bigint", *[f"{c} double" for c in names]])), *keys)


def _solved(sums: DataFrame, *keys: str) -> DataFrame:
    """The conics from n and the sums of products of powers."""
    rows = F.array(*[F.array(*[F.col(f"s{p[0] + q[0]}{p[1] + q[1]}") for q in (*_TERMS, (0, 0))]) for p in _TERMS])

    def eliminated(m: Column, k: Column) -> Column:
        """Column k left with a 1 in row k alone; all null if row k has nothing to divide by."""
        pivot = F.get(F.get(m, k), k)
        lead = F.transform(F.get(m, k), lambda v: v / F.when(F.abs(pivot) > 1e-9, pivot))
        return F.transform(m, lambda row, i: F.when(i == k, lead).otherwise(F.zip_with(row, lead, lambda v, p: v - F.get(row, k) * p)))

    solved = sums.select(*keys, "n", rows.alias("m")).withColumn("m", F.aggregate(F.array(*[F.lit(i) for i in range(5)]), F.col("m"), eliminated))
    value = lambda i: F.when(F.col("n") >= 5, F.get(F.get("m", F.lit(i)), F.lit(5)))
    return solved.select(*keys, "n", *[value(i).alias(c) for i, c in enumerate("abcde")])


def ellipse_angles(points: DataFrame, *keys: str) -> DataFrame:
    """keys, angle: the direction of the major axis of the ellipse nearest to each key's points, 0 to 180 degrees from the vertical, so that (-sin, cos) of it
    points along the axis with y downwards; null where no ellipse fits."""
    return _angles(conics(points, *keys), *keys)


def contour_ellipse_angles(contours: DataFrame, *keys: str) -> DataFrame:
    """As ellipse_angles, of contours (keys, pts), each in its row."""
    return _angles(contour_conics(contours, *keys), *keys)


def _angles(found: DataFrame, *keys: str) -> DataFrame:
    sign = F.when(F.col("a") < 0, -1).otherwise(1)
    angle = F.pmod(F.degrees(F.atan2(F.col("b") * sign, (F.col("a") - F.col("c")) * sign) / 2), F.lit(180.0))
    return found.select(*keys, F.when(F.col("b") * F.col("b") - 4 * F.col("a") * F.col("c") < 0, angle).alias("angle"))


def contour_shapes(contours: DataFrame, *keys: str) -> DataFrame:
    """keys, the least rectangle (cx, cy, w, h, rect_angle, corners), the least circle (circle_x, circle_y, circle_r) and the ellipse's angle of contours (keys, pts)."""
    rings = contours.select(*keys, min_circle(F.col("pts")).alias("c")).select(*keys, *[F.col(f"c.{k}").alias(f"circle_{k}") for k in "xyr"])
    angle = contour_ellipse_angles(contours, *keys).withColumnRenamed("angle", "ellipse_angle")
    return min_rectangles(contours, *keys).join(rings, list(keys)).join(angle, list(keys))
