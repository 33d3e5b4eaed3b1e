"""Plane geometry as Column expressions. Points are (x, y) pairs of Columns in metres; boxes are x0, y0, x1, y1."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def _c_library(f):
    """f of doubles as a Column function; null without all of them, NaN where f has no value."""

    def run(*x):
        if None in x:
            return None
        return f(*x) if all(map(math.isfinite, x)) else math.nan

    return lambda *columns: F.udf(run, "double", useArrow=True)(*columns)


class Functions:
    """The functions of angles and squares that Spark has; Spark's are Java's."""

    atan2, sin, cos = staticmethod(F.atan2), staticmethod(F.sin), staticmethod(F.cos)
    square = staticmethod(lambda x: x * x)


class CLibrary(Functions):
    """Those of the C library, which SQL engines use: they differ from Java's in the last bit, a square too (it is a power there). For results that last bits decide."""

    atan2, sin, cos = (staticmethod(_c_library(f)) for f in (math.atan2, math.sin, math.cos))
    square = staticmethod(_c_library(lambda x: math.pow(x, 2.0) if abs(x) < 1e150 else x * x))


def azimuth(a: Point, b: Point, by: type[Functions] = Functions) -> Column:
    """Degrees from north, clockwise, in (0, 360]."""
    angle = F.degrees(by.atan2(b[0] - a[0], b[1] - a[1]))
    return F.when(angle <= 0, angle + 360).otherwise(angle)


def angle_between(u: Point, v: Point) -> Column:
    """Degrees from vector u to vector v, counter-clockwise, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(v[1], v[0]) - F.atan2(u[1], u[0])), F.lit(360.0))


def midpoint(a: Point, b: Point) -> Point:
    return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2


def distance(a: Point, b: Point, by: type[Functions] = Functions) -> Column:
    dx, dy = a[0] - b[0], a[1] - b[1]
    return F.sqrt(by.square(dx) + by.square(dy))


def project_point(a: Point, degrees: Column, length, by: type[Functions] = Functions) -> Point:
    """The point at an azimuth and a distance from a."""
    return a[0] + by.sin(F.radians(degrees)) * length, a[1] + by.cos(F.radians(degrees)) * length


def extend_line(start: Point, end: Point, ratio: float = 500.0) -> tuple[Point, Point]:
    """The line from `ratio` lengths before its start to `ratio` lengths after it."""
    dx, dy = end[0] - start[0], end[1] - start[1]
    return (start[0] - dx * ratio, start[1] - dy * ratio), (start[0] + dx * ratio, start[1] + dy * ratio)


def last_two(coords: Column) -> tuple[Point, Point]:
    """The last two vertices of an array of points."""
    a, b = F.element_at(coords, -2), F.element_at(coords, -1)
    return (a["x"], a["y"]), (b["x"], b["y"])


def line_length(coords: Column) -> Column:
    """The summed length of an array of points."""
    pairs = F.zip_with(F.slice(coords, F.lit(1), F.size(coords) - 1), F.slice(coords, F.lit(2), F.size(coords) - 1), lambda a, b: distance((a["x"], a["y"]), (b["x"], b["y"])))
    return F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)


def _range_in(value: Column, step: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The range of t in which value + t * step lies in [low, high]; an empty one is (1, 0)."""
    safe = F.when(step != 0, step).otherwise(F.lit(1.0))
    p, q = (low - value) / safe, (high - value) / safe
    inside = (value >= low) & (value <= high)
    first = F.when(step != 0, F.least(p, q)).when(inside, F.lit(-math.inf)).otherwise(F.lit(1.0))
    last = F.when(step != 0, F.greatest(p, q)).when(inside, F.lit(math.inf)).otherwise(F.lit(0.0))
    return first, last


def clip_to_box(a: Point, b: Point, low: Point, high: Point) -> tuple[Column, Column]:
    """The t range in [0, 1] of the part of a to b in an axis-aligned box; empty if the first exceeds the last."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    fx, lx = _range_in(a[0], dx, low[0], high[0])
    fy, ly = _range_in(a[1], dy, low[1], high[1])
    return F.greatest(F.lit(0.0), fx, fy), F.least(F.lit(1.0), lx, ly)


def clip_to_oriented(a: Point, b: Point, centre: Point, degrees: Column, half_w: Column, half_h: Column) -> tuple[Column, Column]:
    """As clip_to_box for a box about a centre, turned by degrees."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))

    def turned(p: Point) -> Point:
        dx, dy = p[0] - centre[0], p[1] - centre[1]
        return dx * c + dy * s, dy * c - dx * s

    return clip_to_box(turned(a), turned(b), (-half_w, -half_h), (half_w, half_h))


def along(a: Point, b: Point, t: Column) -> Point:
    return a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t


def order_points(corners: Column) -> Column:
    """Four corners as an array tl, tr, br, bl (y upwards as given): the two leftmost by y, then the others by distance from tl."""
    by_x = F.array_sort(F.transform(corners, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    left = F.array_sort(F.transform(F.slice(by_x, 1, 2), lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))
    tl, bl = F.get(left, F.lit(0)), F.get(left, F.lit(1))
    right = F.array_sort(F.transform(F.slice(by_x, 3, 2), lambda p: F.struct(distance((p["x"], p["y"]), (tl["x"], tl["y"])).alias("d"), p["x"].alias("x"), p["y"].alias("y"))))
    tr, br = F.get(right, F.lit(0)), F.get(right, F.lit(1))
    return F.array(*[F.struct(p["x"].alias("x"), p["y"].alias("y")) for p in (tl, tr, br, bl)])


def major_axis(corners: Column, cm_per_px: Column) -> Column:
    """The longer of the two lines between mid-points of opposite sides of ordered corners, in centimetres."""
    p = [(F.get(corners, F.lit(i))["x"], F.get(corners, F.lit(i))["y"]) for i in range(4)]
    tops, sides = distance(midpoint(p[0], p[1]), midpoint(p[2], p[3])), distance(midpoint(p[0], p[3]), midpoint(p[1], p[2]))
    return F.greatest(tops, sides) * cm_per_px


def contour_line(centre: Point, length: Column, degrees: Column) -> tuple[Point, Point]:
    """The ends of a candidate line in pixels: a quarter of the length to both sides of the centre, along the row angle."""
    dx, dy = F.sin(F.radians(degrees)) * length / 4, F.cos(F.radians(degrees)) * length / 4
    return (centre[0] - dx, centre[1] + dy), (centre[0] + dx, centre[1] - dy)


def segment_buffer(a: Point, b: Point, radius: float, quarter: int = 16) -> Column:
    """The ring of points at a radius around a segment: a half circle of 2 * quarter steps at each end, closed."""
    heading = F.atan2(b[1] - a[1], b[0] - a[0])

    def cap(p: Point, start: float) -> Column:
        steps = F.sequence(F.lit(0), F.lit(2 * quarter))
        angle = lambda i: heading + start + i * (math.pi / (2 * quarter))
        return F.transform(steps, lambda i: F.struct((p[0] + radius * F.cos(angle(i))).alias("x"), (p[1] + radius * F.sin(angle(i))).alias("y")))

    ring = F.concat(cap(b, -math.pi / 2), cap(a, math.pi / 2))
    return F.concat(ring, F.slice(ring, 1, 1))


def utm_to_wgs84(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees from UTM metres, EPSG 326zz (north) or 327zz (south): the inverse series on the WGS 84 ellipsoid."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    ep2 = e2 / (1 - e2)
    zone = F.pmod(epsg, F.lit(100))
    north = F.when(F.floor(epsg / 100) == 327, y - 10000000.0).otherwise(y)
    mu = north / k0 / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    phi = (
        mu
        + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu)
        + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
        + (151 * e1**3 / 96) * F.sin(6 * mu)
        + (1097 * e1**4 / 512) * F.sin(8 * mu)
    )
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi)
    c1, t1 = ep2 * c * c, t * t
    base = 1 - e2 * s * s
    n1, r1 = a / F.sqrt(base), a * (1 - e2) / (base * F.sqrt(base))
    d = (x - 500000.0) / (n1 * k0)
    d2 = d * d
    lat = phi - (n1 * t / r1) * (
        d2 / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - 9 * ep2) * d2 * d2 / 24 + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - 252 * ep2 - 3 * c1 * c1) * d2 * d2 * d2 / 720
    )
    lon = (d - (1 + 2 * t1 + c1) * d * d2 / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + 8 * ep2 + 24 * t1 * t1) * d * d2 * d2 / 120) / c
    return F.degrees(lon) + zone * 6 - 183, F.degrees(lat)


def crosses_ray(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a ray from (px, py) to the right crosses an edge, for the even-odd rule."""
    over = (y1 > py) != (y2 > py)
    safe = F.when(y1 != y2, y2 - y1).otherwise(F.lit(1.0))
    return over & (px < (x2 - x1) * (py - y1) / safe + x1)


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point lies in a closed ring of points, by the even-odd rule; evaluated within the row."""
    n = F.size(ring)
    edges = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda a, b: crosses_ray(px, py, a["x"], a["y"], b["x"], b["y"]))
    return F.aggregate(edges, F.lit(0), lambda s, e: s + e.cast("int")) % 2 == 1


def segment_distance(a: Point, b: Point, c: Point, d: Point) -> Column:
    """The distance between segments a-b and c-d; 0 if they cross."""

    def to(p: Point, u: Point, v: Point) -> Column:
        dx, dy = v[0] - u[0], v[1] - u[1]
        square = dx * dx + dy * dy
        t = F.when(square > 0, ((p[0] - u[0]) * dx + (p[1] - u[1]) * dy) / F.when(square > 0, square).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))
        return distance(p, along(u, v, F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))))

    def side(p: Point, u: Point, v: Point) -> Column:
        return F.signum((v[0] - u[0]) * (p[1] - u[1]) - (v[1] - u[1]) * (p[0] - u[0]))

    cross = (side(c, a, b) * side(d, a, b) < 0) & (side(a, c, d) * side(b, c, d) < 0)
    return F.when(cross, F.lit(0.0)).otherwise(F.least(to(a, c, d), to(b, c, d), to(c, a, b), to(d, a, b)))
