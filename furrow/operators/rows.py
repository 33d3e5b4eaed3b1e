"""Final rows of a field: overlapping lines grouped, one line chosen for each group, in two branches.

All lines of a field are nearly parallel, so lines whose buffers overlap lie in the same or a neighbouring strip
along the rows; strips, cut into intervals along them, bound the pairs to look at. Keys are a project with a cell until the last step, so one
very large field is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import geometry
from furrow.operators import buffers, kernels, ordered, overlaps
from furrow.operators.blocks import pairs_of
from furrow.operators.chains import least_labels
from furrow.operators.lines import distinct_sorted, first_index_of, gap_filter, number_lines, span_groups
from furrow.operators.nearest import nearest_line
from furrow.params import DEFAULTS
from furrow.sources.shared import checkpointed


def _ends(suffix: str = "") -> tuple[geometry.Point, geometry.Point]:
    return (F.col(f"x1{suffix}"), F.col(f"y1{suffix}")), (F.col(f"x2{suffix}"), F.col(f"y2{suffix}"))


def _frames(lines: DataFrame, *keys: str, least: float) -> DataFrame:
    """keys, fc, fs, fl: cosine and sine of the lines' common direction, whichever way each points, and their mean length; a row a key."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    sums = lines.groupBy(*keys).agg(F.sum(2 * dx * dy).alias("s"), F.sum(dx * dx - dy * dy).alias("c"), F.avg(F.sqrt(dx * dx + dy * dy)).alias("l"))
    angle = F.atan2("s", "c") / 2
    return sums.select(*keys, F.cos(angle).alias("fc"), F.sin(angle).alias("fs"), F.greatest("l", F.lit(float(least))).alias("fl"))


def _dealt(lines: DataFrame, *keys: str, width: float, cell: float | None = None) -> DataFrame:
    """A row for each interval cu and strip cs that a line of keys, widened by half of width, touches, with its ends u1, u2 and its box vl, vh in the common direction."""
    turned = lines.join(_frames(lines, *keys, least=4 * width), list(keys))
    u = lambda i: F.col(f"x{i}") * F.col("fc") + F.col(f"y{i}") * F.col("fs")
    v = lambda i: F.col(f"y{i}") * F.col("fc") - F.col(f"x{i}") * F.col("fs")
    side, strip, half = (F.lit(float(cell)) if cell else F.col("fl")), float(cell or 2 * width), 0.500001 * width
    first = u(1) <= u(2)
    ends = turned.select("*", side.alias("su"), *[F.when(first, x).otherwise(y).alias(n) for n, x, y in (("u1", u(1), u(2)), ("u2", u(2), u(1)), ("v1", v(1), v(2)), ("v2", v(2), v(1)))])
    cut = ends.withColumn("cu", F.explode(F.sequence(F.floor((F.col("u1") - half) / F.col("su")), F.floor((F.col("u2") + half) / F.col("su")))))
    long = F.col("u2") - F.col("u1")
    # The line at the interval's two ends, widened; a line square to the others has one interval and all of itself.
    at = lambda x: F.when(long > 0, F.col("v1") + (F.col("v2") - F.col("v1")) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - F.col("u1")) / F.when(long > 0, long))))
    low, high = F.coalesce(at(F.col("cu") * F.col("su") - half), "v1"), F.coalesce(at((F.col("cu") + 1) * F.col("su") + half), "v2")
    strips = F.sequence(F.floor((F.least(low, high) - half) / strip), F.floor((F.greatest(low, high) + half) / strip))
    box = {"vl": F.least("v1", "v2"), "vh": F.greatest("v1", "v2")}
    return cut.withColumns(box).select(*lines.columns, "fc", "fs", "su", F.lit(strip).alias("sv"), "u1", "u2", "vl", "vh", "cu", F.explode(strips).alias("cs"))


def _meetings(dealt: DataFrame, other: DataFrame, *keys: str, width: float, wanted: Column, keep: tuple[str, ...] = ("idx", "idx_b")) -> DataFrame:
    """keys and keep (columns of dealt, and of other with _b) of the wanted pairs of lines nearer than width. Boxes in the common direction are held apart before the
    distance is worked out. Each pair comes once: from the interval and strip where the middle between its two nearest points lies, which both lines, widened by half of
    width, touch. So pairs are neither written nor brought together again."""
    boxes = lambda low, high: (F.col(low) < F.col(f"{high}_b") + width) & (F.col(f"{low}_b") < F.col(high) + width)
    ends = [f"{c}{i}" for i in ("", "_b") for c in ("x1", "y1", "x2", "y2")]
    met = dealt.join(other, [*keys, "cu", "cs"]).where(wanted & boxes("vl", "vh") & boxes("u1", "u2"))
    met = met.select(*keys, *keep, *ends, "fc", "fs", "su", "sv", "cu", "cs")
    out = [*keys, *keep]

    def run(batches):
        for batch in batches:
            n = {c: batch.column(c).to_numpy() for c in (*ends, "fc", "fs", "su", "sv", "cu", "cs")}
            far, mx, my = kernels.segments_apart(*[n[c] for c in ends])
            place = np.floor((mx * n["fc"] + my * n["fs"]) / n["su"]) == n["cu"]
            place &= np.floor((my * n["fc"] - mx * n["fs"]) / n["sv"]) == n["cs"]
            yield batch.select(out).filter(pa.array((far < width) & place))

    return met.mapInArrow(run, met.select(*out).schema)


_MET = ("idx", "x1", "y1", "x2", "y2", "u1", "u2", "vl", "vh")


def overlap_pairs(lines: DataFrame, *keys: str, width: float = 2 * DEFAULTS.row_buffer_m, cell: float | None = None) -> DataFrame:
    """keys, a, b: pairs of lines (idx, a before b) nearer than width. The lines of a key are turned into their common direction and dealt
    to intervals along it, about a line long, and in each of these to the strips across that their part there comes near. A line along
    the others touches a few cells, however long it is; one across them the cells along itself. Pairs that meet are measured exactly."""
    lists = overlaps.near_lists(lines, _frames(lines, *keys, least=4 * width), *keys, width=width, cell=cell)
    return pairs_of(lists, *keys)


def dissolve_groups(lines: DataFrame, pairs: DataFrame, *keys: str, most_rounds: int = 100) -> DataFrame:
    """keys, idx, grp: the least idx that a line is joined to by pairs. Least labels spread with pointer jumping; each round ends in a
    reliable checkpoint (spark.checkpoint.dir)."""
    both = checkpointed(pairs.select(*keys, "a", "b").union(pairs.select(*keys, "b", "a")).toDF(*keys, "idx", "to"))
    labels = checkpointed(lines.select(*keys, "idx", F.col("idx").alias("grp")))
    for _ in range(most_rounds):
        near = both.join(labels.select(*keys, F.col("idx").alias("to"), F.col("grp").alias("g")), [*keys, "to"]).groupBy(*keys, "idx").agg(F.min("g").alias("g"))
        lower = labels.join(near, [*keys, "idx"], "left").withColumn("low", F.least("grp", "g"))
        jump = labels.select(*keys, F.col("idx").alias("low"), F.col("grp").alias("next"))
        moved = checkpointed(lower.join(jump, [*keys, "low"]).select(*keys, "idx", "grp", F.least("low", "next").alias("new")))
        changed = moved.where("grp <> new").limit(1).count()
        labels = moved.select(*keys, "idx", F.col("new").alias("grp"))
        if not changed:
            return labels
    raise RuntimeError("groups did not settle")


def _hubs(lines: DataFrame, *keys: str, width: float) -> DataFrame:
    """lines with hubs: names of the short stretches across the common direction, at equal steps along it, that each line runs through. A stretch is shorter than width, so all
    lines through one hang together; those of odd steps are moved by half, so that neighbouring ones hang together, too."""
    turned = lines.join(_frames(lines, *keys, least=4 * width), list(keys))
    u = lambda i: F.col(f"x{i}") * F.col("fc") + F.col(f"y{i}") * F.col("fs")
    v = lambda i: F.col(f"y{i}") * F.col("fc") - F.col(f"x{i}") * F.col("fs")
    first, step, stretch = u(1) <= u(2), F.col("fl") / 2, 0.98 * width
    ends = turned.select(*lines.columns, step.alias("_q"), *[F.when(first, x).otherwise(y).alias(n) for n, x, y in (("_u1", u(1), u(2)), ("_u2", u(2), u(1)), ("_v1", v(1), v(2)), ("_v2", v(2), v(1)))])
    cut = ends.withColumn("_k1", F.ceil(F.col("_u1") / F.col("_q"))).withColumn("_k2", F.floor(F.col("_u2") / F.col("_q")))
    long = F.col("_u2") - F.col("_u1")
    slope = F.coalesce((F.col("_v2") - F.col("_v1")) / F.when(long > 0, long), F.lit(0.0))
    across = lambda k: F.col("_v1") + slope * (k * F.col("_q") - F.col("_u1"))
    hub = lambda k: k * (1 << 32) + F.floor(across(k) / stretch + F.pmod(k, F.lit(2)) / 2)
    found = F.when(F.col("_k1") <= F.col("_k2"), F.transform(F.sequence("_k1", "_k2"), hub)).otherwise(F.array().cast("array<bigint>"))
    return cut.select(*lines.columns, found.alias("hubs"))


def overlap_groups(lines: DataFrame, *keys: str, width: float = 2 * DEFAULTS.row_buffer_m) -> DataFrame:
    """keys, idx, grp: as dissolve_groups over overlap_pairs, without all pairs, whose number grows with the square of a field's lines. Lines through one hub (see _hubs) hang
    together, and hubs through one line; hubs are as many as the field's ground has room for, however many lines there are. Only lines that hubs leave in different groups, and only in
    the cells where such meet, are then measured against each other."""
    lines = lines.select(*keys, "idx", "x1", "y1", "x2", "y2")
    through = checkpointed(_hubs(lines, *keys, width=width))
    hubs = through.select(*keys, F.explode("hubs").alias("node")).distinct()
    n = F.size("hubs") - 1
    steps = F.zip_with(F.slice("hubs", F.lit(1), n), F.slice("hubs", F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    links = through.where("size(hubs) > 1").select(*keys, F.explode(steps).alias("e")).select(*keys, "e.a", "e.b").distinct()
    labels = least_labels(hubs, links, *keys)
    named = through.withColumn("node", F.get("hubs", F.lit(0))).drop("hubs").join(labels, [*keys, "node"], "left").drop("node")
    named = checkpointed(named)
    least = named.where("label is not null").groupBy(*keys, "label").agg(F.min("idx").alias("_g"))
    begun = checkpointed(named.join(least, [*keys, "label"], "left").withColumn("grp", F.coalesce("_g", "idx")).drop("label", "_g"))
    dealt = checkpointed(_dealt(begun, *keys, width=width))
    mixed = dealt.groupBy(*keys, "cu", "cs").agg(F.min("grp").alias("_a"), F.max("grp").alias("_b")).where("_a < _b").drop("_a", "_b")
    left = checkpointed(dealt.join(mixed, [*keys, "cu", "cs"], "left_semi"))
    other = left.select(*keys, "cu", "cs", *[F.col(c).alias(f"{c}_b") for c in (*_MET, "grp")])
    apart = (F.col("idx") < F.col("idx_b")) & (F.col("grp") != F.col("grp_b"))
    joined = checkpointed(_meetings(left, other, *keys, width=width, wanted=apart, keep=("grp", "grp_b")).distinct().toDF(*keys, "a", "b"))
    ends = joined.select(*keys, F.col("a").alias("node")).union(joined.select(*keys, "b")).distinct()
    last = least_labels(ends, joined, *keys).withColumnRenamed("node", "grp")
    return begun.select(*keys, "idx", "grp").join(last, [*keys, "grp"], "left").select(*keys, "idx", F.coalesce("label", "grp").alias("grp"))


def dissolved_borders(lines: DataFrame, *keys: str, width: float = 2 * DEFAULTS.row_buffer_m, block: float = 12.0) -> DataFrame:
    """buffers.union_borders of lines in groups of overlapping buffers. Of lines with the same ends the least idx stands for all: it covers what they cover and has their border.
    Neither pairs nor their number matter: lines meet in blocks of ground of side block times width (see buffers.block_borders)."""
    ends = ("x1", "y1", "x2", "y2")
    own = checkpointed(lines.groupBy(*keys, *ends).agg(F.min("idx").alias("idx")))
    return buffers.block_borders(_dealt(own, *keys, width=2 * width, cell=block * width), *keys, radius=width / 2)


def group_centroids(lines: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    """keys, grp, x, y: the mean of the members' mid-points, weighted by length."""
    mx, my = geometry.midpoint(*_ends())
    length = geometry.distance(*_ends())
    met = groups.join(lines, [*keys, "idx"]).withColumn("_w", F.greatest(length, F.lit(1e-9)))
    return met.groupBy(*keys, "grp").agg((F.sum(mx * F.col("_w")) / F.sum("_w")).alias("x"), (F.sum(my * F.col("_w")) / F.sum("_w")).alias("y"))


def closest_to_probe(lines: DataFrame, probes: DataFrame, *keys: str) -> DataFrame:
    """keys, idx, dist: the line whose mid-point is closest to its key's probe point (x, y); the least idx on a tie."""
    d = geometry.distance(geometry.midpoint(*_ends()), (F.col("x"), F.col("y")))
    met = lines.join(probes.select(*keys, "x", "y"), list(keys)).groupBy(*keys).agg(F.min(F.struct(F.round(d, 9).alias("dist"), F.col("idx"))).alias("m"))
    return met.select(*keys, "m.idx", "m.dist")


def select_lines(chosen: DataFrame, lines: DataFrame, *keys: str) -> DataFrame:
    """The lines of a list of idx; one chosen twice comes twice."""
    return chosen.select(*keys, "idx").join(lines, [*keys, "idx"])


def geometric_rows(lines: DataFrame, *keys: str, width: float = 2 * DEFAULTS.row_buffer_m, dissolved: bool = False) -> DataFrame:
    """Lines chosen for groups of overlapping buffers: keys, grp, idx (the line nearest to the group's centroid), numbered idg from 0. The centroid is the
    mean of the lines' mid-points by length, or with dissolved that of the dissolved buffers' area."""
    if dissolved:
        centres = buffers.dissolved_areas(dissolved_borders(lines, *keys, width=width), *keys, radius=width / 2).drop("area")
    else:
        centres = checkpointed(group_centroids(lines, overlap_groups(lines, *keys, width=width), *keys))
    near = nearest_line(centres, lines, *keys, point="grp")
    return number_lines(near, *keys, order=("grp",), name="idg")


def _spaced(lines: DataFrame, *keys: str, p) -> DataFrame:
    """keys, d, id: spans of different distances, then two gaps, numbered from 0. Fields of up to p.fold_values distances are folded one a group; if
    any has more, all go by sorted ranges, which gives the same."""
    values = checkpointed(distinct_sorted(lines, *keys))
    most = values.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= p.fold_values:
        spans = span_groups(values, *keys, span=p.group_span).select(*keys, "d")
        return number_lines(gap_filter(gap_filter(spans, *keys, gap=p.gap_small), *keys, gap=p.gap_large), *keys)
    spans = ordered.span_groups(ordered.order_values(values, *keys), *keys, span=p.group_span).select(*keys, "d", "part")
    return ordered.numbered(ordered.gap_filter(ordered.gap_filter(spans, *keys, gap=p.gap_small), *keys, gap=p.gap_large), *keys).drop("part")


def statistical_rows(lines: DataFrame, *keys: str, p=DEFAULTS) -> DataFrame:
    """Lines (idx, d) chosen by distance alone: keys, d, idx, numbered id from 0. Spans, then two gaps, then the first line at that distance."""
    spaced = _spaced(lines, *keys, p=p)
    return first_index_of(spaced, lines, *keys).join(spaced, [*keys, "d"]).select(*keys, "d", "idx", "id")


def result_counts(lines: DataFrame, *keys: str, p=DEFAULTS) -> DataFrame:
    """keys, candidatelines (different distances) and resultinglines (those of the statistical branch)."""
    candidates = distinct_sorted(lines, *keys).groupBy(*keys).agg(F.count("d").alias("candidatelines"))
    results = _spaced(lines, *keys, p=p).groupBy(*keys).agg(F.count(F.lit(1)).alias("resultinglines"))
    return candidates.join(results, list(keys), "left").na.fill(0, ["resultinglines"])
