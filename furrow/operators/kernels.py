"""Array kernels for one tile or one contour, and the job that runs the whole chain a tile at a time.

Images are 2-D numpy arrays (rows, columns), colour images 3-D. Each kernel is vectorised over the image or over a
border; the jobs around them are mapInPandas over rows that hold one tile each.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import spectral
from furrow.operators.raster import gaussian_weights
from furrow.params import DEFAULTS, Params


def as_image(data: bytes, h: int, w: int, bands: int = 1) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape((h, w, bands) if bands > 1 else (h, w))


# Neighbourhoods


def _lines(image: np.ndarray, weights: list[float], axis: int) -> np.ndarray:
    half, n = len(weights) // 2, image.shape[axis]
    place = np.arange(-half, n + half)
    place = np.abs(place)
    place = np.where(place >= n, 2 * (n - 1) - place, place) if n > 1 else np.zeros_like(place)
    padded = np.take(image, place, axis=axis)
    return sum(w * np.take(padded, np.arange(i, i + n), axis=axis) for i, w in enumerate(weights))


def gaussian_blur(image: np.ndarray, k: int, sigma: float = 0.0) -> np.ndarray:
    """Separable, the border mirrored about its pixel, rounded half up. Tiles narrower than the kernel mirror what they have."""
    weights = gaussian_weights(k, sigma)
    out = _lines(_lines(image.astype(float), weights, 1), weights, 0)
    return np.floor(np.round(out, 9) + 0.5).astype(np.uint8)


def median_blur(image: np.ndarray, k: int = 3) -> np.ndarray:
    """The median of each k by k square, the border replicated."""
    half = k // 2
    padded = np.pad(image, [(half, half), (half, half)] + [(0, 0)] * (image.ndim - 2), mode="edge")
    h, w = image.shape[:2]
    stack = np.stack([padded[i : i + h, j : j + w] for i in range(k) for j in range(k)])
    return np.median(stack, axis=0).astype(image.dtype)


def median_binary(mask: np.ndarray, k: int = 15) -> np.ndarray:
    """The median of a 0 and 255 mask by box sums."""
    half = k // 2
    padded = np.pad((mask > 0).astype(np.int64), half, mode="edge")
    sums = np.pad(padded.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h, w = mask.shape
    box = sums[k : k + h, k : k + w] - sums[:h, k : k + w] - sums[k : k + h, :w] + sums[:h, :w]
    return np.where(box > k * k // 2, 255, 0).astype(np.uint8)


def _window(image: np.ndarray, before: int, after: int, axis: int, function, edge: int) -> np.ndarray:
    """The extreme over [-before, after] along an axis, by doubling steps: log2 of the width passes."""
    width, n = before + after + 1, image.shape[axis]
    pad = [(0, 0)] * image.ndim
    pad[axis] = (before, after)
    out = np.pad(image, pad, constant_values=edge)
    have = 1
    take = lambda x, a, b: np.take(x, np.arange(a, b), axis=axis)
    while have < width:
        step = min(have, width - have)
        length = out.shape[axis] - step
        out = function(take(out, 0, length), take(out, step, step + length))
        have += step
    return take(out, 0, n)


def dilate(mask: np.ndarray, k: int, n: int = 1) -> np.ndarray:
    before, after = n * (k // 2), n * (k - 1 - k // 2)
    return _window(_window(mask, before, after, 1, np.maximum, 0), before, after, 0, np.maximum, 0)


def erode(mask: np.ndarray, k: int, n: int = 1) -> np.ndarray:
    before, after = n * (k // 2), n * (k - 1 - k // 2)
    return _window(_window(mask, before, after, 1, np.minimum, 255), before, after, 0, np.minimum, 255)


def morph_open(mask: np.ndarray, k: int) -> np.ndarray:
    return dilate(erode(mask, k), k)


def morph_close(mask: np.ndarray, k: int) -> np.ndarray:
    return erode(dilate(mask, k), k)


def otsu_mask(image: np.ndarray) -> np.ndarray:
    """255 above the first level of greatest between-class variance."""
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    n0, s0 = n.cumsum(), (n * np.arange(256)).cumsum()
    n1 = n0[-1] - n0
    gap = s0 / np.maximum(n0, 1) - (s0[-1] - s0) / np.maximum(n1, 1)
    variance = np.where((n0 > 0) & (n1 > 0), n0 * n1 / n0[-1] ** 2 * gap * gap, 0.0)
    present = np.flatnonzero(n)
    t = present[np.argmax(np.round(variance[present], 9))]
    return np.where(image > t, 255, 0).astype(np.uint8)


def label_image(image: np.ndarray) -> np.ndarray:
    """Labels 1, 2, ... of 8-connected components, 0 elsewhere: runs of each row joined to touching runs of the row above."""
    h, w = image.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = image
    change = np.diff(padded, axis=1)
    row, start = np.nonzero(change == 1)
    _, end = np.nonzero(change == -1)
    parent = np.arange(len(row))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] <= end[j] and start[j] <= end[i]:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(i) for i in range(len(row))], int)
    _, number = np.unique(roots, return_inverse=True)
    out = np.zeros((h, w + 1), np.int64)
    np.add.at(out, (row, start), number + 1)
    np.add.at(out, (row, end), -(number + 1))
    return out.cumsum(axis=1)[:, :w]


def large_components(mask: np.ndarray, least: int) -> np.ndarray:
    """The mask without components of fewer than `least` pixels."""
    label = label_image(mask > 0)
    area = np.bincount(label.ravel())
    area[0] = 0
    return np.where(area[label] >= least, mask, 0).astype(np.uint8)


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """The exact distance of each set pixel to the nearest unset one; all 0 if there is none. Squared distances along columns, then the
    lower envelope along rows, offset by offset until no farther one can be nearer."""
    h, w = mask.shape
    if (mask > 0).all():
        return np.zeros((h, w))
    far = float(h + w)
    column = np.where(mask > 0, far, 0.0)
    for y in range(1, h):
        column[y] = np.minimum(column[y], column[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        column[y] = np.minimum(column[y], column[y + 1] + 1)
    square = column * column
    best = square.copy()
    for d in range(1, w):
        if d * d >= best.max():
            break
        best[:, d:] = np.minimum(best[:, d:], square[:, :-d] + d * d)
        best[:, :-d] = np.minimum(best[:, :-d], square[:, d:] + d * d)
    return np.sqrt(best)


def distance_mask(mask: np.ndarray, share: float = 0.4) -> np.ndarray:
    """255 where the distance to the background, scaled to 0 to 1 over the tile, is at least `share`."""
    d = distance_transform(mask)
    span = d.max() - d.min()
    if span == 0:
        return np.zeros(mask.shape, np.uint8)
    return np.where((d - d.min()) / span >= share, 255, 0).astype(np.uint8)


# Colours


def index_bytes(rgb: np.ndarray, name: str = "exg") -> np.ndarray:
    """A vegetation index of spectral.veg_index as wrapped bytes; pixels without one are 0."""
    r, g, b = (rgb[..., i].astype(float) for i in range(3))
    if name in ("ndi", "ndvi"):
        x, y = (g, r) if name == "ndi" else (r, b)
        total = x + y
        some = total > 0 if name == "ndi" else np.ones(total.shape, bool)
        value = (x - y) / np.where(total > 0, total, 0.01)
    else:
        total = r + g + b
        some = total > 0
        value = spectral.INDICES[name](*(c / np.where(some, total, 1) for c in (r, g, b)))
    return (np.trunc(np.where(some, value, 0.0) * 255).astype(np.int64) % 256).astype(np.uint8)


def green_raw(rgb: np.ndarray, sensitivity: int) -> np.ndarray:
    r, g, b = (rgb[..., i].astype(float) for i in range(3))
    high, low = rgb.max(axis=2).astype(float), rgb.min(axis=2).astype(float)
    span = high - low
    safe = np.where(span > 0, span, 1)
    degrees = np.where(high == r, 60 * (g - b) / safe, np.where(high == g, 120 + 60 * (b - r) / safe, 240 + 60 * (r - g) / safe))
    degrees = np.where(span == 0, 0, np.where(degrees < 0, degrees + 360, degrees))
    hue = np.floor(degrees / 2 + 0.5)
    hue[hue >= 180] = 0
    saturation = np.floor(255 * span / np.where(high > 0, high, 1) + 0.5)
    return np.where((hue >= 60 - sensitivity) & (hue <= 80 + sensitivity) & (saturation >= 30) & (high >= 30), 255, 0).astype(np.uint8)


# The chain of a tile


def prepare(rgb: np.ndarray) -> np.ndarray:
    """Median 3, then Gaussian 5, of each band."""
    calm = median_blur(rgb, 3)
    return np.stack([gaussian_blur(calm[..., i], 5) for i in range(3)], axis=2)


def _scaled(scale: float, *sizes: int) -> list[int]:
    """Kernel sizes at another ground resolution than Params.kernel_pixel_m. They never depend on how much of a tile there is."""
    return [max(1, round(s * scale)) for s in sizes]


def _odd(n: int) -> int:
    return n | 1


def segment(index: np.ndarray, p: Params = DEFAULTS, scale: float = 1.0) -> np.ndarray:
    """Plant strips in an index image: blur, Otsu, open 9, dilate 3 nine times, erode 20 nine times, large components, erode 9
    three times, median 15; sizes at scale 1 (see _scaled)."""
    opened, grown, shrunk, last, middle = _scaled(scale, 9, 9, 20, 9, 15)
    mask = otsu_mask(gaussian_blur(index, 5, 2.0))
    mask = erode(dilate(morph_open(mask, _odd(opened)), 3, grown), shrunk, grown)
    mask = large_components(mask, max(1, round(p.segment_min_area * scale * scale)))
    return median_binary(erode(mask, last, 3), _odd(middle))


def green(rgb: np.ndarray, p: Params = DEFAULTS, scale: float = 1.0) -> np.ndarray:
    """Green plants, 1 where set: blur, colour range, open, close, large components, their cores, dilate."""
    (k,) = _scaled(scale, 9)
    blurred = np.stack([gaussian_blur(rgb[..., i], 7) for i in range(3)], axis=2)
    raw = morph_close(morph_open(green_raw(blurred, p.green_sensitivity), _odd(k)), _odd(k))
    core = dilate(distance_mask(large_components(raw, max(1, round(p.green_min_area * scale * scale)))), 3, 1)
    return np.where((core > 0) & (raw > 0), 1, 0).astype(np.uint8)


def run_tile(rgb: np.ndarray, p: Params = DEFAULTS, pixel_m: float | None = None, index: str = "exg") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mask, masked colours, index) of a tile of pixels of pixel_m metres (kernel_pixel_m if not given)."""
    scale = p.kernel_pixel_m / (pixel_m or p.kernel_pixel_m)
    calm = prepare(rgb)
    found = index_bytes(calm, index)
    mask = np.minimum(segment(found, p, scale).astype(int) + green(calm, p, scale), 255).astype(np.uint8)
    return mask, np.minimum(mask[..., None], rgb), found


def tile_pipeline(tiles: DataFrame, p: Params = DEFAULTS, index: str = "exg") -> DataFrame:
    """tile_images rows (prj, col, row, w, h, data, and pixel_m, the ground size of a pixel, if not kernel_pixel_m) to prj, col, row, w, h,
    mask, masked, index (binary), plants (pixels set in mask). index: a name of spectral.veg_index. A row is a tile: give Arrow
    small batches (spark.sql.execution.arrow.maxRecordsPerBatch). All-black tiles are dropped before the chain."""
    size = F.col("pixel_m") if "pixel_m" in tiles.columns else F.lit(None).cast("double").alias("pixel_m")

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.itertuples():
                rgb = as_image(t.data, t.h, t.w, 3)
                if rgb.any():
                    found = run_tile(rgb, p, t.pixel_m if t.pixel_m and t.pixel_m > 0 else None, index)
                    rows.append((t.prj, t.col, t.row, t.w, t.h, *(x.tobytes() for x in found), int((found[0] > 0).sum())))
            yield pd.DataFrame(rows, columns=["prj", "col", "row", "w", "h", "mask", "masked", "index", "plants"])

    return tiles.select("prj", "col", "row", "w", "h", "data", size).mapInPandas(run, "prj string, col int, row int, w int, h int, mask binary, masked binary, index binary, plants long")


def tile_images(pixels: DataFrame) -> DataFrame:
    """Long pixels (prj, col, row, px, py, r, g, b) to a row a tile with its bytes: the one large shuffle. A tile is one group; its size is
    bounded by the grid. Missing pixels are black."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        w, h = int(group["px"].max()) + 1, int(group["py"].max()) + 1
        image = np.zeros((h, w, 3), np.uint8)
        image[group["py"], group["px"]] = group[["r", "g", "b"]].to_numpy()
        return pd.DataFrame([[*key, w, h, image.tobytes()]], columns=["prj", "col", "row", "w", "h", "data"])

    return pixels.select("prj", "col", "row", "px", "py", "r", "g", "b").groupBy("prj", "col", "row").applyInPandas(run, "prj string, col int, row int, w int, h int, data binary")


# Borders and shapes

_AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]  # clockwise from the right, (row, column)


def _follow(label: np.ndarray, start: tuple[int, int], back: int) -> list[tuple[int, int]]:
    """The border through start whose pixel in direction `back` is background, as (row, column) in padded coordinates."""
    y, x = start
    for turn in range(8):
        d = (back + turn) % 8
        if label[y + _AROUND[d][0], x + _AROUND[d][1]]:
            break
    else:
        return [start]
    first = (y + _AROUND[d][0], x + _AROUND[d][1])
    out, here, came = [], start, d
    while True:
        out.append(here)
        for turn in range(1, 9):
            d = (came - turn) % 8
            if label[here[0] + _AROUND[d][0], here[1] + _AROUND[d][1]]:
                break
        after = (here[0] + _AROUND[d][0], here[1] + _AROUND[d][1])
        if after == start and here == first:
            return out
        came, here = (d + 4) % 8, after


def trace_borders(mask: np.ndarray) -> list[tuple[list[tuple[int, int]], bool]]:
    """(points (x, y), is hole) of the outer border of each 8-connected component and of each hole in it, straight runs compressed."""
    padded = np.pad(mask.astype(bool), 1)
    out = []
    for image, hole in ((padded, False), (None, True)):
        if hole:
            background = _label4(~padded)
            outside = background[0, 0]
            regions = [k for k in np.unique(background) if k not in (0, outside)]
            for k in regions:
                y, x = np.argwhere(background == k)[0]
                out.append((_compress(_follow(padded, (int(y) - 1, int(x)), 2)), True))
        else:
            label = label_image(image)
            flat = label.ravel()
            _, starts = np.unique(flat, return_index=True)
            for at in starts[1:] if flat[starts[0]] == 0 else starts:
                y, x = divmod(int(at), label.shape[1])
                out.append((_compress(_follow(padded, (y, x), 4)), False))
    return out


def _label4(image: np.ndarray) -> np.ndarray:
    """Labels of 4-connected components, 0 elsewhere."""
    h, w = image.shape
    parent = np.arange(h * w)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in [*zip(*_joined(image, 0)), *zip(*_joined(image, 1))]:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    roots = np.array([find(i) for i in range(h * w)]).reshape(h, w)
    return np.where(image, roots + 1, 0)


def _joined(image: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    place = np.arange(image.size).reshape(image.shape)
    one, two = (slice(1, None), slice(None)), (slice(None, -1), slice(None))
    if axis:
        one, two = one[::-1], two[::-1]
    both = image[one] & image[two]
    return place[two][both], place[one][both]


def _compress(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Border points as (x, y) of the unpadded mask, only those where the direction changes."""
    xy = np.array([(x - 1, y - 1) for y, x in points])
    if len(xy) < 3:
        return [tuple(p) for p in xy.tolist()]
    before, after = xy - np.roll(xy, 1, axis=0), np.roll(xy, -1, axis=0) - xy
    return [tuple(p) for p in xy[(before != after).any(axis=1)].tolist()]


def convex_hull(xy: np.ndarray) -> np.ndarray:
    """The vertices of the convex hull, counter-clockwise from the leftmost: monotone chains."""
    pts = np.unique(np.asarray(xy, float), axis=0)
    if len(pts) < 3:
        return pts

    def chain(order) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def _turning_left(owner: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points in order by owner without those on or left of the way between the two beside them, until none is."""
    while len(owner) > 2:
        same = (owner[1:-1] == owner[:-2]) & (owner[1:-1] == owner[2:])
        stay = ~(same & ((x[1:-1] - x[:-2]) * (y[2:] - y[:-2]) - (y[1:-1] - y[:-2]) * (x[2:] - x[:-2]) <= 0))
        if stay.all():
            break
        stay = np.concatenate([[True], stay, [True]])
        owner, x, y = owner[stay], x[stay], y[stay]
    return owner, x, y


def convex_hulls(owner: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """convex_hull of many sets of points at once: owner names each point's set, from 0; sets come in order, each counter-clockwise from its leftmost."""
    order = np.lexsort((y, x, owner))
    owner, x, y = owner[order], x[order], y[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(owner)]
    owner, x, y = owner[new], x[new], y[new]
    parts = []
    for back, (o, u, v) in ((False, _turning_left(owner, x, y)), (True, _turning_left(owner[::-1], x[::-1], y[::-1]))):
        last = np.append(o[1:] != o[:-1], True)[: len(o)]
        alone = last & np.append(True, o[1:] != o[:-1])[: len(o)]
        stay = ~last | (alone & (not back))
        parts.append((o[stay], u[stay], v[stay]))
    owner, x, y = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(owner, kind="stable")
    return owner[order], x[order], y[order]


def min_area_rect(xy) -> tuple[float, float, float, float, float, list]:
    """(cx, cy, w, h, angle in [-90, 0), corners) of the least rectangle about points; its width lies along the angle."""
    hull = convex_hull(np.asarray(xy, float))
    if len(hull) == 1:
        x, y = hull[0]
        return x, y, 0.0, 0.0, -90.0, [(x, y)] * 4
    edges = np.roll(hull, -1, axis=0) - hull
    angles = np.unique(np.round(np.arctan2(edges[:, 1], edges[:, 0]) % (math.pi / 2), 12))
    c, s = np.cos(angles), np.sin(angles)
    u, v = hull @ np.stack([c, s]), hull @ np.stack([-s, c])
    area = (u.max(0) - u.min(0)) * (v.max(0) - v.min(0))
    i = int(np.argmin(np.round(area, 9)))
    u0, u1, v0, v1 = u[:, i].min(), u[:, i].max(), v[:, i].min(), v[:, i].max()
    back = lambda p, q: (float(p * c[i] - q * s[i]), float(p * s[i] + q * c[i]))
    centre = back((u0 + u1) / 2, (v0 + v1) / 2)
    return *centre, float(v1 - v0), float(u1 - u0), math.degrees(angles[i]) - 90.0, [back(u0, v0), back(u1, v0), back(u1, v1), back(u0, v1)]


def min_circle(xy) -> tuple[float, float, float]:
    """(x, y, radius) of the least circle about points: grown point by point."""
    pts = [tuple(map(float, p)) for p in np.unique(np.asarray(xy, float), axis=0)]
    inside = lambda c, p: c is not None and math.hypot(p[0] - c[0], p[1] - c[1]) <= c[2] + 1e-9
    two = lambda a, b: ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2, math.dist(a, b) / 2)

    def three(a, b, c):
        bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
        d = 2 * (bx * cy - by * cx)
        if abs(d) < 1e-12:
            return max((two(a, b), two(a, c), two(b, c)), key=lambda k: k[2])
        ux = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d
        uy = (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return a[0] + ux, a[1] + uy, math.hypot(ux, uy)

    circle = None
    for i, p in enumerate(pts):
        if inside(circle, p):
            continue
        circle = (*p, 0.0)
        for j, q in enumerate(pts[:i]):
            if inside(circle, q):
                continue
            circle = two(p, q)
            for k in pts[:j]:
                if not inside(circle, k):
                    circle = three(p, q, k)
    return circle


def ellipse_angle(xy) -> float:
    """The direction of an ellipse's major axis, fitted by algebraic least squares to at least five points: 0 to 180 degrees from the
    vertical, so that (-sin, cos) of it points along the axis with y downwards. NaN if no ellipse fits."""
    pts = np.asarray(xy, float)
    if len(pts) < 5:
        return math.nan
    centre = pts.mean(axis=0)
    scale = np.abs(pts - centre).max() or 1.0
    x, y = ((pts - centre) / scale).T
    try:
        a, b, c, _, _ = np.linalg.lstsq(np.stack([x * x, x * y, y * y, x, y], axis=1), np.ones(len(x)), rcond=None)[0]
    except np.linalg.LinAlgError:
        return math.nan
    if b * b - 4 * a * c >= 0:
        return math.nan
    values, vectors = np.linalg.eigh(np.array([[a, b / 2], [b / 2, c]]) * np.sign(a))
    dx, dy = vectors[:, 0]  # the long axis has the small eigenvalue
    return math.degrees(math.atan2(-dx, dy)) % 180


def segments_apart(ax, ay, bx, by, cx, cy, dx, dy) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, x, y) of segments a-b and c-d, arrays of each end: 0 if they cross, and the middle between their two nearest points."""
    side = lambda px, py, ux, uy, vx, vy: np.sign((vx - ux) * (py - uy) - (vy - uy) * (px - ux))
    cross = (side(cx, cy, ax, ay, bx, by) * side(dx, dy, ax, ay, bx, by) < 0) & (side(ax, ay, cx, cy, dx, dy) * side(bx, by, cx, cy, dx, dy) < 0)
    far = mx = my = None
    for px, py, ux, uy, vx, vy in ((ax, ay, cx, cy, dx, dy), (bx, by, cx, cy, dx, dy), (cx, cy, ax, ay, bx, by), (dx, dy, ax, ay, bx, by)):
        lx, ly = vx - ux, vy - uy
        square = lx * lx + ly * ly
        t = np.where(square > 0, ((px - ux) * lx + (py - uy) * ly) / np.where(square > 0, square, 1.0), 0.0)
        t = np.minimum(1.0, np.maximum(0.0, t))
        fx, fy = ux + lx * t, uy + ly * t
        d = np.sqrt((px - fx) * (px - fx) + (py - fy) * (py - fy))
        if far is None:
            far, mx, my = d, (px + fx) / 2, (py + fy) / 2
        else:
            less = d < far
            far, mx, my = np.where(less, d, far), np.where(less, (px + fx) / 2, mx), np.where(less, (py + fy) / 2, my)
    if cross.any():
        den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
        t = np.minimum(1.0, np.maximum(0.0, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / np.where(den != 0, den, 1.0)))
        far, mx, my = np.where(cross, 0.0, far), np.where(cross, ax + (bx - ax) * t, mx), np.where(cross, ay + (by - ay) * t, my)
    return far, mx, my


def resample_closed(points, n: int = 25) -> np.ndarray:
    """n whole points at equal steps of arc length on a closed cubic curve through the points (slopes from neighbours)."""
    pts = np.asarray(points, float)
    pts = pts[np.append(True, (pts[1:] != pts[:-1]).any(axis=1))]
    if len(pts) > 1 and (pts[0] == pts[-1]).all():
        pts = pts[:-1]
    if len(pts) < 3:
        return np.resize(pts, (n, 2)).astype(int)
    ahead, behind = np.roll(pts, -1, axis=0), np.roll(pts, 1, axis=0)
    slope = (ahead - behind) / 2
    t = np.linspace(0, 1, 16, endpoint=False)[:, None, None]
    curve = (2 * t**3 - 3 * t**2 + 1) * pts + (t**3 - 2 * t**2 + t) * slope + (3 * t**2 - 2 * t**3) * ahead + (t**3 - t**2) * np.roll(slope, -1, axis=0)
    curve = curve.transpose(1, 0, 2).reshape(-1, 2)
    curve = np.vstack([curve, curve[:1]])
    length = np.append(0, np.linalg.norm(np.diff(curve, axis=0), axis=1).cumsum())
    at = np.linspace(0, length[-1], n, endpoint=False)
    return np.stack([np.interp(at, length, curve[:, i]) for i in range(2)], axis=1).astype(int)


def resample_many(ends: np.ndarray, x: np.ndarray, y: np.ndarray, n: int = 25, short: int = 32) -> np.ndarray:
    """resample_closed of many rings at once, to the last bit: ring i is x, y from ends[i] to ends[i + 1], none empty. Rings of as many points are one array."""
    pts, owner = np.stack([x, y], axis=1).astype(float), np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    first = np.zeros(len(pts), bool)
    first[ends[:-1]] = True
    new = first.copy()
    new[1:] |= (pts[1:] != pts[:-1]).any(axis=1)
    pts, owner = pts[new], owner[new]
    size = np.bincount(owner, minlength=len(ends) - 1)
    begin = size.cumsum() - size
    size -= (size > 1) & (pts[begin] == pts[begin + size - 1]).all(axis=1)
    out = np.empty((len(size), n, 2), int)
    for k in np.unique(size):
        rings = np.flatnonzero(size == k)
        if k < 3 or k > short:
            for i in rings:
                out[i] = resample_closed(pts[begin[i] : begin[i] + k], n)
        else:
            out[rings] = _resampled(pts[begin[rings][:, None] + np.arange(k)], n)
    return out


def _resampled(pts: np.ndarray, n: int) -> np.ndarray:
    """resample_closed of rings (rings, points, 2) of as many points, three at least, none equal to the one before it."""
    ahead, behind = np.roll(pts, -1, axis=1), np.roll(pts, 1, axis=1)
    slope = (ahead - behind) / 2
    t = np.linspace(0, 1, 16, endpoint=False)[:, None]
    pts, ahead, slope, then = (c[:, :, None, :] for c in (pts, ahead, slope, np.roll(slope, -1, axis=1)))
    curve = (2 * t**3 - 3 * t**2 + 1) * pts + (t**3 - 2 * t**2 + t) * slope + (3 * t**2 - 2 * t**3) * ahead + (t**3 - t**2) * then
    curve = curve.reshape(len(pts), -1, 2)
    curve = np.concatenate([curve, curve[:, :1]], axis=1)
    length = np.linalg.norm(np.diff(curve, axis=1), axis=2).cumsum(axis=1)
    length = np.concatenate([np.zeros((len(pts), 1)), length], axis=1)
    at = np.linspace(0, length[:, -1], n, endpoint=False, axis=1)
    j = np.stack([(length <= at[:, i : i + 1]).sum(axis=1) - 1 for i in range(n)], axis=1)
    j = np.minimum(j, length.shape[1] - 2)  # a ring of no length is its first point
    l0, l1 = (np.take_along_axis(length, j + i, axis=1) for i in (0, 1))
    c0, c1 = (np.take_along_axis(curve, (j + i)[:, :, None], axis=1) for i in (0, 1))
    rise = (c1 - c0) / np.where(l1 > l0, l1 - l0, 1.0)[:, :, None]
    return np.where((at == l0)[:, :, None], c0, rise * (at - l0)[:, :, None] + c0).astype(int)


def distinct_points(owner: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each owner's different points, by owner, x and y; points with a null or NaN are left out, and there is one zero."""
    known = ~(np.isnan(x) | np.isnan(y))
    owner, x, y = owner[known], x[known] + 0.0, y[known] + 0.0
    order = np.lexsort((y, x, owner))
    owner, x, y = owner[order], x[order], y[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return owner[new], x[new], y[new]


def group_starts(table, keys) -> np.ndarray:
    """Where the groups of an Arrow table's rows, sorted by keys, begin."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode().indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def group_codes(table, keys) -> np.ndarray:
    """A number for each row of an Arrow table, the same for rows with the same keys."""
    code = np.zeros(table.num_rows, np.int64)
    for k in keys:
        value = table.column(k).combine_chunks().dictionary_encode()
        code = np.unique(code * (len(value.dictionary) + 1) + value.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return code


def expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, k) for each k of each range low[i] to high[i]."""
    size = np.maximum(high - low, 0)
    i = np.repeat(np.arange(len(low)), size)
    return i, np.arange(len(i)) - np.repeat(size.cumsum() - size, size) + low[i]


def in_parts(size: np.ndarray, most: int):
    """Slices of rows whose sizes add up to most, or of one row."""
    total, begin = size.cumsum(), 0
    while begin < len(size):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, "right")))
        yield slice(begin, end)
        begin = end


def _marks(cx: np.ndarray, cy: np.ndarray, ends: np.ndarray, words: int = 4) -> np.ndarray:
    """Bits in words numbers for each row's cells, ends[i] to ends[i + 1]."""
    h = (cx.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + cy.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    word, bit = h % np.uint64(words), np.uint64(1) << ((h >> np.uint64(8)) & np.uint64(63))
    out, some = np.zeros((words, len(ends) - 1), np.uint64), np.flatnonzero(ends[1:] > ends[:-1])
    for w in range(words):
        out[w, some] = np.bitwise_or.reduceat(np.where(word == w, bit, np.uint64(0)), ends[some]) if len(some) else 0
    return out


def near_owners(group, owner, place, ends, x, y, cx, cy, d: float, side: int, most: int = 1 << 16):
    """Yields (a, b): rows of points of one group nearer than d, the owner of a before that of b. Two owners have one such pair in all groups: the least (by a's, then b's point)
    of all their near points, in the group whose block a's point lies in. Row i is the point number place of its owner's, which are sorted and stand in x, y from ends[i]
    to ends[i + 1]. Its group has the points of a block (cx, cy) of side x side cells of side d, and those in the cells around it."""
    at = ends[:-1] + place
    fx, fy = np.floor(x / d).astype(np.int64), np.floor(y / d).astype(np.int64)
    rx, ry = fx[at] - cx * side + 1, fy[at] - cy * side + 1
    wide, owners = side + 2, int(owner.max(initial=0)) + 1
    code = (group * wide + rx) * wide + ry
    order = np.lexsort((owner, y[at], x[at], code))
    code, sx, sy, so = code[order], x[at][order], y[at][order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (code[1:] != code[:-1]) | (sx[1:] != sx[:-1]) | (sy[1:] != sy[:-1])
    spot, first = new.cumsum() - 1, np.flatnonzero(new)
    after, member, cell = np.append(first[1:], len(order)), spot * owners + so, code[first]
    # Marks of the cells of an owner's points, and of those about its points before this one: without a common one no lesser pair is near.
    lesser, k = expanded(ends[:-1], at)
    about = [np.stack([f[k] + s for s in steps], axis=1).ravel() for f, steps in ((fx, np.repeat((-1, 0, 1), 3)), (fy, np.tile((-1, 0, 1), 3)))]
    before, own = _marks(*about, 9 * np.append(0, place.cumsum())), _marks(fx, fy, ends)
    _, same, times = np.unique(group * owners + owner, return_inverse=True, return_counts=True)
    twice = times[same] > 1

    def least(a, b):
        """Of pairs of near points those that are their owners' least."""
        out, n = np.ones(len(a), bool), ends[b + 1] - ends[b]
        for part in in_parts((place[a] + 1) * n, most):
            i, j = expanded(np.zeros_like(n[part]), (place[a[part]] + 1) * n[part])
            p, q = ends[a[part]][i] + j // n[part][i], ends[b[part]][i] + j % n[part][i]
            near = (x[p] - x[q]) * (x[p] - x[q]) + (y[p] - y[q]) * (y[p] - y[q]) < d * d
            near &= (p < at[a[part]][i]) | (q < at[b[part]][i])
            out[part.start + i[near]] = False
        return out

    ours = np.flatnonzero(((rx >= 1) & (rx <= side) & (ry >= 1) & (ry <= side))[order][first])
    for step in (-1, 0, 1):
        low, high = (np.searchsorted(cell, cell[ours] + step * wide + s, way) for s, way in ((-1, "left"), (1, "right")))
        for part in in_parts(high - low, most):
            p, q = expanded(low[part], high[part])
            p, (u, v) = ours[part][p], (first[ours[part][p]], first[q])
            near = (sx[u] - sx[v]) * (sx[u] - sx[v]) + (sy[u] - sy[v]) * (sy[u] - sy[v]) < d * d
            p, q = p[near], q[near]
            for few in in_parts(after[p] - first[p], most):
                i, k = expanded(first[p[few]], after[p[few]])
                to = q[few][i]
                begin = np.searchsorted(member, to * owners + so[k], "right")
                for some in in_parts(after[to] - begin, most):
                    i, other = expanded(begin[some], after[to[some]])
                    a, b = order[k[some][i]], order[other]
                    doubt = twice[b]
                    for f, g in zip(before, own):
                        doubt |= (f[a] & g[b]) != 0
                    doubt = np.flatnonzero(doubt)
                    keep = np.ones(len(a), bool)
                    keep[doubt] = least(a[doubt], b[doubt])
                    yield a[keep], b[keep]


#: For each side of a pixel (top, left, bottom, right), run with the pixel on the left: the step out of it, the steps to the pixels ahead on the right and on the left, and the side
#: that follows if the first is set, if the second is, if none is.
_SIDES = (((0, -1), (-1, -1), (-1, 0), 3, 0, 1), ((-1, 0), (-1, 1), (0, 1), 0, 1, 2), ((0, 1), (1, 1), (1, 0), 1, 2, 3), ((1, 0), (1, -1), (0, -1), 2, 3, 0))


def traced(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(image, number, hole, x, y) of the turning points of the borders of many images' set pixels (image, from 0, x, y), in order. Borders are numbered within their image: outer ones,
    then holes, each by place of its first side; a border begins there. As regions.borders, which it equals."""
    if not len(x):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, bool, np.int64, np.int64))
    wide, high = int(x.max() - x.min()) + 3, int(y.max() - y.min()) + 3
    code = np.unique((image.astype(np.int64) * high + (y - y.min() + 1)) * wide + (x - x.min() + 1))
    count = len(code)

    # Where each pixel's neighbours stand, -1 if they are not set: a row's three stand side by side.
    at = {}
    for dy in (-1, 0, 1):
        place = np.searchsorted(code, code + dy * wide - 1)
        for dx in (-1, 0, 1):
            here = np.minimum(place, count - 1)
            found = (place < count) & (code[here] == code + dy * wide + dx)
            at[dx, dy] = np.where(found, here, -1)
            place = place + found
    bare = np.stack([at[out] < 0 for out, *_ in _SIDES], axis=1)
    name = np.cumsum(bare.ravel()).reshape(count, 4) - 1  # of a side, by place and side
    follows, dx, dy = (np.empty(int(bare.sum()), np.int64) for _ in range(3))
    for side, (_, right, left, if_right, if_left, if_none) in enumerate(_SIDES):
        own = np.flatnonzero(bare[:, side])
        r, l = at[right][own], at[left][own]
        to = np.where(r >= 0, name[r, if_right], np.where(l >= 0, name[l, if_left], name[own, if_none]))
        me = name[own, side]
        follows[me] = to
        for i, d in enumerate((dx, dy)):
            d[me] = np.where(r >= 0, right[i], np.where(l >= 0, left[i], 0))
    pixel, side = np.nonzero(bare)

    # The least side of each ring, then the steps from each side to the last before it, by doubling.
    ring, jump = np.arange(len(follows)), follows
    while True:
        lower = np.minimum(ring, ring[jump])
        if (lower == ring).all():
            break
        ring, jump = lower, jump[jump]
    last = follows == ring
    jump, left = np.where(last, np.arange(len(follows)), follows), (~last).astype(np.int64)
    while (step := left[jump]).any():
        left, jump = left + step, jump[jump]

    out = (dx != 0) | (dy != 0)
    leaves = np.bincount(ring, out, len(ring)) > 0
    kept = np.flatnonzero(out | (~leaves[ring] & (ring == np.arange(len(ring)))))
    hole = side[ring] == 2
    owner = code // (wide * high)
    kept = kept[np.lexsort((-left[kept], ring[kept], hole[kept], owner[pixel[kept]]))]
    ring, dx, dy = ring[kept], dx[kept], dy[kept]
    new = np.append(True, ring[1:] != ring[:-1])
    first = np.flatnonzero(new)
    before = np.arange(-1, len(kept) - 1)
    before[first] = np.append(first[1:], len(kept)) - 1
    turned = (dx != dx[before]) | (dy != dy[before]) | ~leaves[ring]
    pixel, hole = pixel[kept], hole[kept]
    image = owner[pixel]
    number = new.cumsum() - 1
    number -= number[np.searchsorted(image, image)]
    place = code[pixel] % (wide * high)
    return tuple(c[turned] for c in (image, number, hole, place % wide + x.min() - 1, place // wide + y.min() - 1))


def power_sums(owner: np.ndarray, count: int, x: np.ndarray, y: np.ndarray, powers) -> list[np.ndarray]:
    """For each (i, j) of powers the sum of u^i v^j over each of count owners' points, one after the other: u and v are x and y from the owner's mean, by the farthest
    of its points along x or y. Points with a null or NaN add nothing."""
    known = ~(np.isnan(x) | np.isnan(y))
    owner, x, y = owner[known], x[known], y[known]
    total = lambda c: np.bincount(owner, c, count)  # adds in order
    n, far, about = np.maximum(np.bincount(owner, minlength=count), 1), np.zeros(count), []
    for c in (x, y):
        mean = total(c) / n
        np.maximum.at(far, owner, np.abs(c - mean[owner]))
        about.append(c - mean[owner])
    u, v = (c / np.where(far > 0, far, 1.0)[owner] for c in about)
    out = []
    for i, j in powers:
        product = np.ones(len(owner))
        for _ in range(i):
            product = product * u
        for _ in range(j):
            product = product * v
        out.append(total(product))
    return out


def nearest_segments(group, px, py, reach, best, rank, at, x1, y1, x2, y2, order, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(distance, line) for each point: the nearest of the lines x1 .. y2 (at: their group) of its group, no farther than its reach, the one of least order on a tie; distances are rounded to
    9 places. best and rank are the distance and order of what it has already; where that stays, line is -1. Points at one place look once. Lines are looked up in the cells of
    the points, of a size that lines cover few of."""
    by = np.lexsort((py, px, group))
    new = np.ones(len(by), bool)
    new[1:] = (group[by][1:] != group[by][:-1]) | (px[by][1:] != px[by][:-1]) | (py[by][1:] != py[by][:-1])
    place = np.empty(len(by), np.int64)
    place[by] = new.cumsum() - 1
    one = by[new]
    g, qx, qy, best, rank = group[one], px[one], py[one], np.where(best > reach, np.inf, best)[one], rank[one].copy()
    pick, reach = np.full(len(one), -1), reach[one]
    count = int(max(group.max(initial=-1), at.max(initial=-1))) + 1
    kept = np.flatnonzero(np.bincount(g, minlength=count)[at] > 0)
    if not len(kept):
        return best[place], pick[place]

    far, left, low = np.zeros(count), np.full(count, np.inf), np.full(count, np.inf)
    np.maximum.at(far, g, reach)
    np.minimum.at(left, g, qx)
    np.minimum.at(low, g, qy)
    lines = np.bincount(at, minlength=count)
    size = np.maximum(2 * far, np.bincount(at, np.maximum(np.abs(x2 - x1), np.abs(y2 - y1)), count) / (3 * np.maximum(lines, 1)))
    cell = lambda g, x, y: [np.floor((c - o[g]) / size[g]) for c, o in ((x, left), (y, low))]
    cx, cy = (c.astype(np.int64) for c in cell(g, qx, qy))
    wide, high = int(cx.max()) + 1, int(cy.max()) + 1
    code = (g * wide + cx) * high + cy
    sort = np.argsort(code, kind="stable")
    cells, first, members = np.unique(code[sort], return_index=True, return_counts=True)

    own, margin = at[kept], far[at[kept]] * 1.0001 + 1e-8
    ends = [c[kept] for c in (x1, y1, x2, y2)]
    box = [np.minimum(ends[0], ends[2]), np.minimum(ends[1], ends[3]), np.maximum(ends[0], ends[2]), np.maximum(ends[1], ends[3])]
    lx, ly = (np.maximum(c, 0).astype(np.int64) for c in cell(own, box[0] - margin, box[1] - margin))
    hx, hy = (np.minimum(c, m - 1).astype(np.int64) for c, m in zip(cell(own, box[2] + margin, box[3] + margin), (wide, high)))
    nx, ny = np.maximum(hx - lx + 1, 0), np.maximum(hy - ly + 1, 0)
    for part in in_parts(nx * ny, most):
        i, k = expanded(np.zeros_like(nx[part]), (nx * ny)[part])
        i += part.start
        want = (own[i] * wide + lx[i] + k // ny[i]) * high + ly[i] + k % ny[i]
        spot = np.minimum(np.searchsorted(cells, want), len(cells) - 1)
        hit = np.flatnonzero(cells[spot] == want)
        i, spot = i[hit], spot[hit]
        for few in in_parts(members[spot], most):
            j, q = expanded(first[spot[few]], (first + members)[spot[few]])
            j, q = i[few][j], sort[q]
            within = np.minimum(best, reach)[q] + 1e-8
            ok = (qx[q] >= box[0][j] - within) & (qx[q] <= box[2][j] + within) & (qy[q] >= box[1][j] - within) & (qy[q] <= box[3][j] + within)
            j, q = j[ok], q[ok]
            ax, ay, dx, dy = ends[0][j], ends[1][j], ends[2][j] - ends[0][j], ends[3][j] - ends[1][j]
            square = dx * dx + dy * dy
            t = np.where(square > 0, ((qx[q] - ax) * dx + (qy[q] - ay) * dy) / np.where(square > 0, square, 1.0), 0.0)
            t = np.minimum(1.0, np.maximum(0.0, t))
            fx, fy = qx[q] - (ax + dx * t), qy[q] - (ay + dy * t)
            d = np.sqrt(fx * fx + fy * fy) * 1e9
            whole = np.floor(d)
            d = (whole + (d - whole >= 0.5)) / 1e9
            ok = d <= np.minimum(best, reach)[q]
            j, q, d = kept[j[ok]], q[ok], d[ok]
            sorted_ = np.lexsort((order[j], d, q))
            lead = np.ones(len(sorted_), bool)
            lead[1:] = q[sorted_][1:] != q[sorted_][:-1]
            j, q, d = (c[sorted_[lead]] for c in (j, q, d))
            ok = (d < best[q]) | (order[j] < rank[q])
            j, q, d = j[ok], q[ok], d[ok]
            best[q], rank[q], pick[q] = d, order[j], j
    return best[place], pick[place]


def strips(u1, v1, u2, v2, su, sv, half: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, cu, cs) of the intervals of side su and strips of side sv that lines from u1, v1 to u2, v2 (u1 the less), widened by half, touch. As rows._dealt."""
    i, cu = expanded(np.floor((u1 - half) / su).astype(np.int64), np.floor((u2 + half) / su).astype(np.int64) + 1)
    long = (u2 - u1)[i]
    some = np.where(long > 0, long, 1.0)
    # The line at the interval's two ends, widened; a line square to the others has one interval and all of itself.
    at = [np.where(long > 0, v1[i] + (v2 - v1)[i] * np.clip((x - u1[i]) / some, 0.0, 1.0), v[i]) for x, v in ((cu * su[i] - half, v1), ((cu + 1) * su[i] + half, v2))]
    j, cs = expanded(np.floor((np.minimum(*at) - half) / sv[i]).astype(np.int64), np.floor((np.maximum(*at) + half) / sv[i]).astype(np.int64) + 1)
    return i[j], cu[j], cs


def near_pairs(group, n, turned, times, width: float, half: float, most: int = 1 << 15):
    """Yields (r, s): lines of a group (a block bx, by of nu x nv cells) nearer than width, pairs of a line r one after the other, each once: where the middle between its nearest points
    lies in the block. A line is paired with itself if it stands for several (times)."""
    i, cu, cs = strips(*turned, n["su"], n["sv"], half)
    du, ds = (c - n[b][i] * n[k][i].astype(np.int64) for c, b, k in ((cu, "bx", "nu"), (cs, "by", "nv")))
    nu, nv = (n[k][i].astype(np.int64) for k in ("nu", "nv"))
    own = np.flatnonzero((du >= 0) & (du < nu) & (ds >= 0) & (ds < nv))
    if not len(own):
        return
    i, cu, cs = i[own], cu[own], cs[own]
    code = (group[i] * (int(nu.max()) + 1) + du[own]) * (int(nv.max()) + 1) + ds[own]
    u1, v1, u2, v2 = turned
    vl, vh = np.minimum(v1, v2), np.maximum(v1, v2)
    order = np.lexsort((vl[i], code))
    i, cu, cs, code = i[order], cu[order], cs[order], code[order]
    # In a cell, by their lower side: those after a line that begin below its upper side and width are near it across.
    both = np.lexsort((np.append(np.ones(len(i)), np.zeros(len(i))), np.append(vl[i], vh[i] + width), np.append(code, code)))
    before = np.cumsum(both < len(i))
    high = np.empty(len(i), np.int64)
    asked = both >= len(i)
    high[both[asked] - len(i)] = before[asked]
    low = np.arange(len(i)) + (times[i] < 2)
    ends = [n[c] for c in ("x1", "y1", "x2", "y2")]
    for part in in_parts(np.maximum(high - low, 0), most):
        p, q = expanded(low[part], high[part])
        p += part.start
        r, s = i[p], i[q]
        ok = np.flatnonzero((u1[s] < u2[r] + width) & (u1[r] < u2[s] + width))
        p, r, s = p[ok], r[ok], s[ok]
        if not len(p):
            continue
        far, mx, my = segments_apart(*[c[r] for c in ends], *[c[s] for c in ends])
        ok = (far < width) & (np.floor((mx * n["fc"][r] + my * n["fs"][r]) / n["su"][r]) == cu[p]) & (np.floor((my * n["fc"][r] - mx * n["fs"][r]) / n["sv"][r]) == cs[p])
        if ok.any():
            yield r[ok], s[ok]
