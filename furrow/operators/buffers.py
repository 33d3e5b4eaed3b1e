"""Dissolved buffers: the union of the buffers of grouped lines, with its border, area and centroid.

A line's buffer is a capsule: two sides and two half circles, run counter-clockwise. A piece of its border belongs to the union's border where no other
buffer of a pair covers it. For each pair the places where the piece may enter or leave the other capsule cut it; what lies inside between two
places is covered. The covered intervals of all pairs are swept in order, and what is left is the arrangement's border. Area and centroid
are its line integrals, exact for arcs too; borders are joined end to start into rings by list ranking. A group of any size stays spread over tasks:
nothing but a piece's own intervals is brought together.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import geometry
from furrow.operators.chains import least_labels, ring_places
from furrow.operators.cover import TOUCH, Block
from furrow.params import DEFAULTS
from furrow.sources.shared import checkpointed


def _shape() -> list[Column]:
    """turn, ux, uy, vx, vy of a piece of the buffer about x1, y1 to x2, y2."""
    heading = F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    turn = heading + F.when(F.col("piece").isin(0, 1), -math.pi / 2).otherwise(math.pi / 2)
    end = F.col("piece").isin(1, 2)  # pieces 1 and 2 begin at the line's end
    return [
        turn.alias("turn"), F.when(end, F.col("x2")).otherwise(F.col("x1")).alias("ux"), F.when(end, F.col("y2")).otherwise(F.col("y1")).alias("uy"),
        F.when(F.col("piece") == 0, F.col("x2")).when(F.col("piece") == 2, F.col("x1")).alias("vx"), F.when(F.col("piece") == 0, F.col("y2")).when(F.col("piece") == 2, F.col("y1")).alias("vy"),
    ]


def _pieces(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, idx, piece (0 right side, 1 arc at the end, 2 left side, 3 arc at the start), ux, uy (the centre or corner offset from), turn (an arc's first angle, or the
    side's normal), x1 .. y2. A line of no length has no sides."""
    dealt = lines.select(*keys, "idx", "x1", "y1", "x2", "y2", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("piece"))
    return dealt.where("piece in (1, 3) or x1 <> x2 or y1 <> y2").select(*keys, "idx", "piece", *_shape())


def _at(t: Column, radius: float) -> geometry.Point:
    """The point of a piece at t in [0, 1]."""
    turn = F.col("turn") + F.when(F.col("vx").isNull(), t * math.pi).otherwise(F.lit(0.0))
    x, y = (F.col(f"u{c}") + F.when(F.col("vx").isNull(), F.lit(0.0)).otherwise((F.col(f"v{c}") - F.col(f"u{c}")) * t) for c in "xy")
    return x + radius * F.cos(turn), y + radius * F.sin(turn)


def _acos(x: Column) -> Column:
    return F.when(F.abs(x) <= 1, F.acos(x))


def _cuts(radius: float) -> Column:
    """The places t of a piece where it may cross the border of the capsule about (ox1, oy1) to (ox2, oy2)."""
    heading = F.atan2(F.col("oy2") - F.col("oy1"), F.col("ox2") - F.col("ox1"))
    nx, ny = -F.sin(heading), F.cos(heading)
    arc, side = [], []
    sx, sy = _at(F.lit(0.0), radius)
    ex, ey = _at(F.lit(1.0), radius)
    dx, dy = ex - sx, ey - sy
    square = F.when(dx * dx + dy * dy > 0, dx * dx + dy * dy)
    for i in (1, 2):
        px, py = F.col(f"ox{i}") - F.col("ux"), F.col(f"oy{i}") - F.col("uy")
        half = _acos(F.sqrt(px * px + py * py) / (2 * radius))
        arc += [F.atan2(py, px) + half, F.atan2(py, px) - half]
        fx, fy = F.col(f"ox{i}") - sx, F.col(f"oy{i}") - sy
        near = (fx * dx + fy * dy) / square
        root = F.sqrt(F.greatest(near * near - (fx * fx + fy * fy - radius * radius) / square, F.lit(0.0)))
        side += [near + root, near - root]
    for sign in (-1.0, 1.0):
        away = nx * (F.col("ox1") - F.col("ux")) + ny * (F.col("oy1") - F.col("uy")) + sign * radius
        turn = _acos(away / radius)
        arc += [F.atan2(ny, nx) + turn, F.atan2(ny, nx) - turn]
        slope = nx * dx + ny * dy
        side.append((nx * (F.col("ox1") - sx) + ny * (F.col("oy1") - sy) + sign * radius) / F.when(F.abs(slope) > 1e-15, slope))
    arcs = F.transform(F.array(*arc), lambda a: F.pmod(a - F.col("turn"), F.lit(2 * math.pi)) / math.pi)
    found = F.filter(F.when(F.col("vx").isNull(), arcs).otherwise(F.array(*side)), lambda t: t.isNotNull() & (t > 0) & (t < 1))
    return F.concat(F.array(F.lit(0.0)), F.array_sort(found), F.array(F.lit(1.0)))


def _covered(radius: float) -> Column:
    """The intervals of a piece between its cuts that lie in the other capsule. Where two borders run as one, the line with the lesser idx has it."""
    pairs = F.zip_with(F.slice("cuts", F.lit(1), F.size("cuts") - 1), F.slice("cuts", F.lit(2), F.size("cuts") - 1), lambda s, e: F.struct(s.alias("s"), e.alias("e")))

    def inside(t: Column) -> Column:
        x, y = _at((t["s"] + t["e"]) / 2, radius)
        dx, dy = F.col("ox2") - F.col("ox1"), F.col("oy2") - F.col("oy1")
        square = F.when(dx * dx + dy * dy > 0, dx * dx + dy * dy)
        along = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - F.col("ox1")) * dx + (y - F.col("oy1")) * dy) / square)), F.lit(0.0))
        far = geometry.distance((x, y), (F.col("ox1") + dx * along, F.col("oy1") + dy * along))
        return (t["e"] > t["s"]) & ((far < radius - TOUCH) | ((far <= radius + TOUCH) & (F.col("other") < F.col("idx"))))

    return F.filter(pairs, inside)


def union_borders(lines: DataFrame, groups: DataFrame, pairs: DataFrame, *keys: str, radius: float = DEFAULTS.row_buffer_m) -> DataFrame:
    """keys, grp, idx, piece, s, e and the piece's shape: what of each buffer's border lies on its group's border. lines: keys, idx, x1, y1, x2, y2; groups: keys, idx,
    grp; pairs: keys, a, b with overlapping buffers, a before b (see rows.overlap_pairs)."""
    lines = checkpointed(lines.select(*keys, "idx", "x1", "y1", "x2", "y2"))
    pieces = checkpointed(_pieces(lines, *keys))
    both = pairs.select(*keys, F.col("a").alias("idx"), F.col("b").alias("other")).union(pairs.select(*keys, "b", "a"))
    other = lines.select(*keys, F.col("idx").alias("other"), *[F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2")])
    met = pieces.join(both.join(other, [*keys, "other"]), [*keys, "idx"]).withColumn("cuts", _cuts(radius))
    covered = met.select(*keys, "idx", "piece", F.explode(_covered(radius)).alias("c")).select(*keys, "idx", "piece", "c.s", "c.e")
    # A last interval [1, 1] ends the sweep of each piece, covered or not.
    swept = covered.unionByName(pieces.select(*keys, "idx", "piece", F.lit(1.0).alias("s"), F.lit(1.0).alias("e")))
    order = Window.partitionBy(*keys, "idx", "piece").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    left = swept.withColumn("from", F.coalesce(F.max("e").over(order), F.lit(0.0))).where(F.col("s") - F.col("from") > TOUCH)
    left = left.select(*keys, "idx", "piece", F.col("from").alias("s"), F.col("s").alias("e"))
    return left.join(pieces, [*keys, "idx", "piece"]).join(groups.select(*keys, "idx", "grp"), [*keys, "idx"])


def block_borders(dealt: DataFrame, *keys: str, radius: float = DEFAULTS.row_buffer_m) -> DataFrame:
    """As union_borders, with the groups, without pairs. dealt: keys, idx, x1, y1, x2, y2 of lines that differ, once for each block cu, cs of ground that the line widened by twice
    the radius touches, and the blocks' sides su, sv in the direction fc, fs (see rows._dealt). A block's lines meet in one task; a side belongs to the blocks that its line runs
    through, an arc to that of its centre. A block names the least line of those that hang together there, and lines in several blocks join these names."""
    ends, names = ("x1", "y1", "x2", "y2"), [*keys, "idx", "comp", "x1", "y1", "x2", "y2", "piece", "s", "e"]
    types = {f.name: f.dataType.simpleString() for f in dealt.schema}
    schema = ", ".join(f"`{n}` {types.get(n) or {'comp': types['idx'], 'piece': 'int'}.get(n, 'double')}" for n in names)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx").combine_chunks()
        first = [table.column(n)[0].as_py() for n in ("fc", "fs", "su", "sv", "cu", "cs")]
        block = Block(*[table.column(n).to_numpy() for n in ends], *first, radius)
        group = block.groups()
        i, piece, s, e = block.borders()
        members = np.arange(len(group))  # a row of piece -1 for each line names its group here
        rows, zeros = np.append(members, i), np.zeros(len(members))
        out = table.take(pa.array(rows))
        made = {"comp": table.column("idx").take(pa.array(group[rows])), "piece": pa.array(np.append(zeros - 1, piece).astype(np.int32)), "s": pa.array(np.append(zeros, s)), "e": pa.array(np.append(zeros, e))}
        return pa.table({n: made[n] if n in made else out.column(n) for n in names})

    found = checkpointed(dealt.groupBy(*keys, "cu", "cs").applyInArrow(run, schema))
    met = found.where("piece = -1").groupBy(*keys, "idx").agg(F.min("comp").alias("a"), F.collect_set("comp").alias("b"))
    links = checkpointed(met.where("size(b) > 1").select(*keys, "a", F.explode("b").alias("b")).where("a <> b").distinct())
    nodes = links.select(*keys, F.col("a").alias("node")).union(links.select(*keys, "b")).distinct()
    labels = least_labels(nodes, links, *keys).withColumnRenamed("node", "comp")
    # Sides cut between blocks become whole again.
    order = Window.partitionBy(*keys, "idx", "piece").orderBy("s")
    new = F.when(F.col("s") == F.lag("e").over(order), 0).otherwise(1)
    whole = found.where("piece >= 0").withColumn("_n", new).withColumn("_n", F.sum("_n").over(order))
    same = [F.first(c).alias(c) for c in ends]
    whole = whole.groupBy(*keys, "idx", "piece", "_n").agg(F.min("comp").alias("comp"), *same, F.min("s").alias("s"), F.max("e").alias("e"))
    grp = whole.join(labels, [*keys, "comp"], "left").withColumn("grp", F.coalesce("label", "comp"))
    return grp.select(*keys, "idx", "piece", "s", "e", *_shape(), "grp")


def _integrals(radius: float) -> tuple[Column, Column, Column]:
    """(area, x moment, y moment) that a border piece adds, in coordinates from (rx, ry)."""
    x0, y0 = _at(F.col("s"), radius)
    x1, y1 = _at(F.col("e"), radius)
    x0, x1, y0, y1 = x0 - F.col("rx"), x1 - F.col("rx"), y0 - F.col("ry"), y1 - F.col("ry")
    side = ((x0 * y1 - x1 * y0) / 2, (y1 - y0) * (x0 * x0 + x0 * x1 + x1 * x1) / 6, -(x1 - x0) * (y0 * y0 + y0 * y1 + y1 * y1) / 6)
    cx, cy = F.col("ux") - F.col("rx"), F.col("uy") - F.col("ry")
    p, q = F.col("turn") + F.col("s") * math.pi, F.col("turn") + F.col("e") * math.pi
    span, twice = q - p, (F.sin(2 * q) - F.sin(2 * p)) / 2
    c1, c2, c3 = F.sin(q) - F.sin(p), (span + twice) / 2, F.sin(q) - F.pow(F.sin(q), 3) / 3 - F.sin(p) + F.pow(F.sin(p), 3) / 3
    s1, s2, s3 = F.cos(p) - F.cos(q), (span - twice) / 2, F.cos(p) - F.pow(F.cos(p), 3) / 3 - F.cos(q) + F.pow(F.cos(q), 3) / 3
    arc = (
        radius * (cx * c1 + cy * s1 + radius * span) / 2,
        radius * (cx * cx * c1 + 2 * cx * radius * c2 + radius * radius * c3) / 2,
        radius * (cy * cy * s1 + 2 * cy * radius * s2 + radius * radius * s3) / 2,
    )
    return tuple(F.when(F.col("vx").isNull(), a).otherwise(b) for a, b in zip(arc, side))


def dissolved_areas(borders: DataFrame, *keys: str, radius: float = DEFAULTS.row_buffer_m) -> DataFrame:
    """keys, grp, area, x, y: area and centroid of each group's dissolved buffer, holes left out, from union_borders."""
    place = borders.groupBy(*keys, "grp").agg(F.min("ux").alias("rx"), F.min("uy").alias("ry"))
    a, mx, my = _integrals(radius)
    sums = borders.join(place, [*keys, "grp"]).groupBy(*keys, "grp", "rx", "ry").agg(F.sum(a).alias("area"), F.sum(mx).alias("mx"), F.sum(my).alias("my"))
    return sums.select(*keys, "grp", "area", (F.col("mx") / F.col("area") + F.col("rx")).alias("x"), (F.col("my") / F.col("area") + F.col("ry")).alias("y"))


def dissolved_rings(borders: DataFrame, *keys: str, radius: float = DEFAULTS.row_buffer_m, quarter: int = 16, near: float = 1e-4) -> DataFrame:
    """keys, grp, ring, place, x, y: the points of the rings around each group's dissolved buffer, outer ones counter-clockwise, holes clockwise; arcs in
    steps of a right angle / quarter. A ring is named by its least piece (idx, piece, s). A piece's end and the start of the one after it are the same place but for
    rounding: they meet in cells of side `near`."""
    node = F.struct("idx", "piece", F.round("s", 9).alias("s"))
    x0, y0 = _at(F.col("s"), radius)
    x1, y1 = _at(F.col("e"), radius)
    own = borders.select(*keys, "grp", node.alias("node"), "s", "e", "turn", "ux", "uy", "vx", "vy", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    cell = lambda c, by=0.0: F.floor((F.col(c) + by) / near)
    starts = own.select(*keys, "grp", F.col("node").alias("next"), F.col("x0").alias("sx"), F.col("y0").alias("sy"), cell("x0").alias("cx"), cell("y0").alias("cy"))
    about = lambda c: F.array_distinct(F.array(cell(c, -near / 10), cell(c, near / 10)))
    ends = own.select(*keys, "grp", "node", "x1", "y1", F.explode(about("x1")).alias("cx")).withColumn("cy", F.explode(about("y1")))
    met = ends.join(starts, [*keys, "grp", "cx", "cy"]).withColumn("gap", geometry.distance((F.col("x1"), F.col("y1")), (F.col("sx"), F.col("sy"))))
    follows = met.where(F.col("gap") < near / 10).groupBy(*keys, "grp", "node").agg(F.min(F.struct("gap", "next")).alias("m")).select(*keys, "grp", "node", "m.next")
    ranked = ring_places(follows, *keys, "grp").join(own, [*keys, "grp", "node"])
    steps = F.when(F.col("vx").isNull(), F.greatest(F.lit(1), F.ceil((F.col("e") - F.col("s")) * 2 * quarter))).otherwise(F.lit(1)).cast("int")
    points = ranked.withColumn("steps", steps).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)))
    x, y = _at(F.col("s") + (F.col("e") - F.col("s")) * F.col("step") / F.col("steps"), radius)
    return points.select(*keys, "grp", "ring", "place", "step", x.alias("x"), y.alias("y"))
