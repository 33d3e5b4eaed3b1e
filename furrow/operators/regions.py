"""Regions of masks as tables: components, borders and distances, over tiles or whole mosaics alike. Keys name the image; x and y are pixels.

Components are joined from the runs of each image row. Borders run along the sides of set pixels between set and unset; where a side leads is decided by the
eight neighbours, and rings are ranked by doubling. Distances take the nearest unset pixel of each column, then the lower envelope of each row. No image is
one group: a window holds a row or a column of pixels, a join a stretch of a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators import kernels
from furrow.operators.chains import least_labels, ring_places
from furrow.sources.shared import checkpointed

CELL = 64  # pixels of a row within which runs of neighbouring rows meet
SIDES = ("top", "left", "bottom", "right")


def _place(x: Column, y: Column) -> Column:
    """A pixel's place, row by row, as one number."""
    return y.cast("long") * (1 << 31) + x


def pixel_runs(pixels: DataFrame, *keys: str, x: str = "px", y: str = "py") -> DataFrame:
    """pixels with x0: where the pixel's run of set pixels along its row begins."""
    row = Window.partitionBy(*keys, y).orderBy(x)
    begins = F.when(F.coalesce(F.col(x) - F.lag(x).over(row) != 1, F.lit(True)), F.col(x))
    return pixels.withColumn("_b", begins).withColumn("x0", F.max("_b").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_b")


def components(pixels: DataFrame, *keys: str, x: str = "px", y: str = "py", least_area: int = 1) -> DataFrame:
    """Set pixels (keys, x, y; each once) with label, the least place (y * 2^31 + x) of their 8-connected component, and area, where area is at least least_area.
    With the mosaic as key and x, y in it, components run across tiles."""
    marked = checkpointed(pixel_runs(pixels.select(*keys, x, y), *keys, x=x, y=y))
    runs = marked.groupBy(*keys, y, "x0").agg(F.max(x).alias("x1")).withColumn("node", _place(F.col("x0"), F.col(y)))
    cells = lambda low, high: F.sequence(F.floor(F.col(low) / CELL), F.floor(F.col(high) / CELL))
    above = runs.select(*keys, F.col(y).alias("_y"), "x0", "x1", "node", F.explode(cells("x0", "x1")).alias("cell"))
    below = runs.select(*keys, (F.col(y) - 1).alias("_y"), (F.col("x0") - 1).alias("z0"), (F.col("x1") + 1).alias("z1"), F.col("node").alias("b")).withColumn("cell", F.explode(cells("z0", "z1")))
    links = above.join(below, [*keys, "_y", "cell"]).where("x0 <= z1 and z0 <= x1").select(*keys, F.col("node").alias("a"), "b")
    labels = least_labels(runs.select(*keys, "node"), links, *keys)
    sized = runs.join(labels.hint("merge"), [*keys, "node"]).select(*keys, y, "x0", (F.col("x1") - F.col("x0") + 1).alias("_n"), "label")
    area = sized.groupBy(*keys, "label").agg(F.sum("_n").alias("area")).where(F.col("area") >= least_area)
    return marked.join(sized.drop("_n").hint("merge"), [*keys, y, "x0"]).join(area.hint("merge"), [*keys, "label"]).drop("x0")


def neighbours(pixels: DataFrame, *keys: str, x: str = "px", y: str = "py") -> DataFrame:
    """Set pixels with around: bit 3 * (dy + 1) + dx + 1 for each set pixel at (x + dx, y + dy), dx and dy from -1 to 1."""
    steps = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    rows = pixels.select(*keys, x, y, steps.alias("_d")).groupBy(*keys, (F.col(x) - F.col("_d")).alias(x), y).agg(F.sum(F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), F.col("_d") + 1)).cast("int").alias("_r"))
    met = rows.select(*keys, x, y, "_r", steps.alias("_d")).groupBy(*keys, x, (F.col(y) - F.col("_d")).alias(y)).agg(F.sum(F.col("_r") * F.pow(F.lit(8), F.col("_d") + 1)).cast("int").alias("around"))
    return met.where(F.col("around").bitwiseAND(16) > 0)


def _set(dx: int, dy: int) -> Column:
    return F.col("around").bitwiseAND(1 << (3 * (dy + 1) + dx + 1)) > 0


#: For each side, run with its pixel on the left: the pixels ahead on the right and on the left, and what follows in turn if the first is set, if the second is, if none is.
_AHEAD = {0: ((-1, -1), (-1, 0), 3, 1), 1: ((-1, 1), (0, 1), 0, 2), 2: ((1, 1), (1, 0), 1, 3), 3: ((1, -1), (0, -1), 2, 0)}
_OUTSIDE = {0: (0, -1), 1: (-1, 0), 2: (0, 1), 3: (1, 0)}


def border_edges(pixels: DataFrame, *keys: str, x: str = "px", y: str = "py") -> DataFrame:
    """keys, x, y, side (0 top, 1 left, 2 bottom, 3 right), next_x, next_y, next_side: the sides of set pixels (each once) between set and unset, and the side
    that follows with the set pixels on the left. Pixels that touch at a corner are one region, so a border crosses there."""
    near = neighbours(pixels, *keys, x=x, y=y)
    made = []
    for side, (right, left, at_right, same) in _AHEAD.items():
        turn = [F.when(_set(*right), F.lit(right[i])).when(_set(*left), F.lit(left[i])).otherwise(F.lit(0)) for i in range(2)]
        after = F.when(_set(*right), F.lit(at_right)).when(_set(*left), F.lit(side)).otherwise(F.lit(same))
        made.append(F.when(~_set(*_OUTSIDE[side]), F.struct(F.lit(side).alias("side"), (F.col(x) + turn[0]).alias("next_x"), (F.col(y) + turn[1]).alias("next_y"), after.alias("next_side"))))
    return near.select(*keys, x, y, F.explode(F.filter(F.array(*made), lambda e: e.isNotNull())).alias("e")).select(*keys, x, y, "e.*")


def borders(pixels: DataFrame, *keys: str, x: str = "px", y: str = "py") -> DataFrame:
    """keys, ring, hole, place, x, y: the pixels of the outer border of each 8-connected region and of each hole in it, in order (outer borders against the
    clock as seen, holes with it), where the direction changes. place orders a ring's points and is not gapless; ring is its least side's name."""
    edges = checkpointed(border_edges(pixels, *keys, x=x, y=y))
    name = lambda a, b, s: _place(F.col(a), F.col(b)) * 4 + F.col(s)
    steps = edges.select(*keys, name(x, y, "side").alias("node"), name("next_x", "next_y", "next_side").alias("next"), x, y, (F.col("next_x") - F.col(x)).alias("dx"), (F.col("next_y") - F.col(y)).alias("dy"))
    steps = checkpointed(steps)
    ranked = checkpointed(ring_places(steps.select(*keys, "node", "next"), *keys).join(steps, [*keys, "node"]))
    # A point is where a pixel is left for another; in how it was entered, out how it is left.
    size = ranked.groupBy(*keys, "ring").agg(F.count(F.lit(1)).alias("size"), F.max(F.when((F.col("dx") != 0) | (F.col("dy") != 0), F.col("place"))).alias("last"))
    moves = ranked.join(size, [*keys, "ring"])
    leaves = checkpointed(moves.where("dx <> 0 or dy <> 0 or (last is null and place = 0)"))
    # Each leaving is at most four sides after the one before it: a pixel has four.
    onward = leaves.select(*keys, "ring", F.explode(F.array(*[F.pmod(F.col("place") + i, F.col("size")) for i in range(1, 5)])).alias("place"), F.col("place").alias("from"), F.col("dx").alias("ix"), F.col("dy").alias("iy"))
    gap = F.pmod(F.col("place") - F.col("from"), F.col("size"))
    came = leaves.join(onward, [*keys, "ring", "place"]).groupBy(*keys, "ring", "place").agg(F.min(F.struct(F.when(gap == 0, F.col("size")).otherwise(gap).alias("gap"), "ix", "iy")).alias("m"))
    turned = leaves.join(came, [*keys, "ring", "place"], "left").where("m is null or m.ix <> dx or m.iy <> dy or last is null")
    return turned.select(*keys, "ring", (F.col("ring") % 4 == 2).alias("hole"), "place", x, y)


def trace_contours(pixels: DataFrame, *keys: str, x: str = "px", y: str = "py", most: int = 1 << 18) -> DataFrame:
    """keys, contour_id (from 0: outer borders, then holes, each by place of its first pixel), pts, hole: borders as arrays of their turning points. For images
    whose pixels fit a row, tiles for example: they move once and are traced where they meet, many small images at once (about `most` pixels). `borders` has those of images of any size."""
    packed = pixels.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.collect_list(F.col(y).cast("long") * (1 << 32) + F.col(x)).alias("p"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema if f.name != "p")

    def run(batches):
        for batch in batches:
            size = pc.list_value_length(batch.column("p")).to_numpy()
            for part in kernels.in_parts(size, most):
                few = batch.slice(part.start, part.stop - part.start)
                p = few.column("p").flatten().to_numpy()
                image, number, hole, px, py = kernels.traced(np.repeat(np.arange(few.num_rows), size[part]), ((p + (1 << 31)) & 0xFFFFFFFF) - (1 << 31), (p + (1 << 31)) >> 32)
                first = np.flatnonzero(np.append(True, (image[1:] != image[:-1]) | (number[1:] != number[:-1]))[: len(image)])
                points = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in (px, py)], names=["x", "y"])
                pts = pa.ListArray.from_arrays(pa.array(np.append(first, len(image)).astype(np.int32)), points)
                rows = pa.array(image[first])
                yield pa.RecordBatch.from_arrays([*[few.column(k).take(rows) for k in keys], pa.array(number[first].astype(np.int32)), pts, pa.array(hole[first])], names=[*keys, "contour_id", "pts", "hole"])

    return packed.mapInArrow(run, f"{kept}, contour_id int, pts array<struct<x:int,y:int>>, hole boolean")


def _envelopes(squares: np.ndarray) -> np.ndarray:
    """For each row of squared column distances the least of (x - x')^2 + square(x') over all x'."""
    best, n = squares.copy(), squares.shape[1]
    for d in range(1, n):
        if d * d >= best.max(initial=0):
            break
        best[:, d:] = np.minimum(best[:, d:], squares[:, :-d] + d * d)
        best[:, :-d] = np.minimum(best[:, :-d], squares[:, d:] + d * d)
    return best


def distances(pixels: DataFrame, *keys: str, value: str = "mask", x: str = "px", y: str = "py") -> DataFrame:
    """keys, x, y, distance: of each pixel of a whole image (keys, x, y, value) the distance to the nearest unset one (value 0), 0 for unset ones and
    where an image has none. Columns are windows; a row of an image is one array."""
    down = Window.partitionBy(*keys, x).orderBy(y)
    unset = F.when(F.col(value) == 0, F.col(y))
    before = F.max(unset).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    up = Window.partitionBy(*keys, x).orderBy(F.desc(y))
    after = F.min(unset).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    gap = F.least(F.col(y) - before, after - F.col(y))  # the one that is there, if one is null
    rows = pixels.withColumn("_g", gap.cast("double")).groupBy(*keys, y).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.coalesce("_g", F.lit(-1.0)).alias("g")))).alias("line"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "line")

    def run(batches):
        for batch in batches:
            line = batch.column("line")
            ends = np.asarray(line.offsets) - line.offsets[0].as_py()
            at, g = (c.to_numpy(zero_copy_only=False) for c in line.flatten().flatten())
            d = np.zeros(len(at))
            for i, j in zip(ends[:-1], ends[1:]):
                place = at[i:j] - at[i]  # sorted
                square = np.full((1, place[-1] + 1), np.inf)
                square[0, place] = np.where(g[i:j] >= 0, g[i:j] * g[i:j], np.inf)
                d[i:j] = np.sqrt(_envelopes(square))[0, place]
            d[~np.isfinite(d)] = 0.0
            away = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(d)], names=["x", "d"]))
            kept = [n for n in batch.schema.names if n != "line"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], away], names=[*kept, "line"])

    done = rows.mapInArrow(run, f"{schema}, line array<struct<x:int,d:double>>")
    return done.select(*keys, y, F.explode("line").alias("_p")).select(*keys, F.col("_p.x").alias(x), y, F.col("_p.d").alias("distance"))


def distance_mask(pixels: DataFrame, *keys: str, value: str = "mask", x: str = "px", y: str = "py", share: float = 0.4) -> DataFrame:
    """keys, x, y, core: 255 where the distance to the background, scaled from 0 to 1 over the image, is at least share; 0 in an image of one distance."""
    away = distances(pixels, *keys, value=value, x=x, y=y)
    ends = away.groupBy(*keys).agg(F.min("distance").alias("_low"), F.max("distance").alias("_high"))
    span = F.col("_high") - F.col("_low")
    core = F.when((span > 0) & ((F.col("distance") - F.col("_low")) / F.when(span > 0, span) >= share), 255).otherwise(0)
    return away.join(ends, list(keys)).select(*keys, x, y, core.alias("core"))
