"""Nearest lines of points: both meet in blocks of ground, each line moved once for the blocks it comes near, and a pair is worked out where it is tried."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators import kernels
from furrow.operators.blocks import BLOCK, ENDS, PARCEL, finite, parcels
from furrow.sources.shared import checkpointed


def _facts(lines: DataFrame, *keys: str, cell: float) -> DataFrame:
    """keys, reach, side: within reach of a point there will be some lines, in a block of that side some thousands, as far as their number, their length and the ground they lie on tell."""
    spot = F.struct(F.floor(F.col("x1") / cell), F.floor(F.col("y1") / cell))
    wide, high = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    sums = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.struct(*ENDS)).alias("different"), F.approx_count_distinct(spot).alias("spots"), F.avg(F.sqrt(wide * wide + high * high)).alias("long"), F.avg(F.greatest(wide, high)).alias("extent"))
    ground = F.col("spots") * (cell * cell) / F.col("different")  # of a line
    reach = F.greatest(F.lit(cell / 4096), F.least(F.lit(float(cell)), 2.5 * F.sqrt(ground), 10 * ground / F.when(F.col("long") > 0, F.col("long"))))
    return sums.select(*keys, reach.alias("reach"), F.greatest(8 * reach, F.sqrt(ground * F.col("different") / F.col("n") * BLOCK), 2 * F.col("extent")).alias("side"))


def _parcels(frame: DataFrame, *keys: str, name: str, coords: tuple[str, ...], spare: float) -> DataFrame:
    """blocks.parcels of points or lines (x, y of each end) in each block that they come nearer to than spare times reach."""

    def deal(n):
        far = spare * n["reach"]
        low, high = ([np.floor((f([n[c] for c in coords[i::2]], axis=0) + s * far) / n["side"]).astype(np.int64) for i in (0, 1)] for f, s in ((np.min, -1), (np.max, 1)))
        i, bx = kernels.expanded(low[0], high[0] + 1)
        j, by = kernels.expanded(low[1][i], high[1][i] + 1)
        return i[j], bx[j], by

    return parcels(frame, *keys, name=name, coords=coords, facts=("reach", "side"), kept=("reach",), deal=deal)


def _within(points: DataFrame, lines: DataFrame, facts: DataFrame, *keys: str, point: str) -> DataFrame:
    """keys, point, x, y, idx, dist: for each point the nearest line no farther than its key's reach, the least idx on a tie; without one idx and dist are null. A block's points are held
    while its lines pass by."""
    asked = _parcels(points.join(facts, list(keys)), *keys, name=point, coords=("x", "y"), spare=0.0).withColumn("_line", F.lit(False))
    blocks = checkpointed(asked.select(*keys, "bx", "by").distinct())
    box = [F.col("_x0") - 2 * F.col("reach"), F.col("_y0") - 2 * F.col("reach"), F.col("_x1") + 2 * F.col("reach"), F.col("_y1") + 2 * F.col("reach")]
    near = (F.greatest("x1", "x2") >= box[0]) & (F.greatest("y1", "y2") >= box[1]) & (F.least("x1", "x2") <= box[2]) & (F.least("y1", "y2") <= box[3])
    dealt = _parcels(lines.join(facts, list(keys)).where(near), *keys, name="idx", coords=ENDS, spare=1.001).join(blocks, [*keys, "bx", "by"], "left_semi")
    dealt = dealt.withColumnRenamed("idx", "_idx").withColumnRenamed("at", "_ends").withColumn("_line", F.lit(True))
    block = [*keys, "bx", "by"]
    met = asked.unionByName(dealt, allowMissingColumns=True).repartition(*block).sortWithinPartitions(*block, "_line")
    types = {f.name: f.dataType.simpleString() for f in (*points.schema, *lines.schema)}
    names = [*keys, point, "x", "y", "idx", "dist"]
    schema = ", ".join(f"`{n}` {types.get(n, 'double')}" for n in names)

    def lists(rows, name, n):
        """(row, values) of an array column, n values each."""
        held = rows.column(name).combine_chunks()
        size = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False) // n
        return np.repeat(np.arange(len(size)), size), held.flatten()

    def meet(rows, rest):
        """(points of blocks that are done, those of the last block)."""
        rows = rows.combine_chunks()
        starts = kernels.group_starts(rows, block)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
        (pr, names_), (lr, idx) = lists(rows, point, 1), lists(rows, "_idx", 1)
        x, y = lists(rows, "at", 2)[1].to_numpy(zero_copy_only=False).reshape(-1, 2).T
        ends = lists(rows, "_ends", 4)[1].to_numpy(zero_copy_only=False).reshape(-1, 4).T
        fresh = {n: rows.column(n).take(pa.array(pr)) for n in (*block, "reach")} | {point: names_, "x": pa.array(x), "y": pa.array(y)}
        fresh |= {"idx": pa.nulls(len(pr), idx.type), "dist": pa.array(np.full(len(pr), np.inf))}
        table, done = pa.table(fresh), []
        place = group[pr]
        if rest is not None:
            if all(rest.column(n)[0] == rows.column(n)[0] for n in block):
                table, place = pa.concat_tables([rest, table]), np.append(np.zeros(rest.num_rows, np.int64), place)
            else:
                done.append(rest)
        both = pa.concat_arrays([*table.column("idx").chunks, idx])
        rank = pc.rank(both, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
        n = table.num_rows
        known = [table.column(c).to_numpy() for c in ("x", "y", "reach", "dist")]
        dist, pick = kernels.nearest_segments(place, *known, rank[:n], group[lr], *ends, rank[n:])
        chosen = np.where(pick >= 0, pick + n, np.arange(n))
        table = table.set_column(table.schema.get_field_index("idx"), "idx", both.take(pa.array(chosen)))
        table = table.set_column(table.schema.get_field_index("dist"), "dist", pa.array(dist))
        last = place == group[-1]
        done.append(table.filter(pa.array(~last)))
        return pa.concat_tables(done), table.filter(pa.array(last)) if last.any() else None

    def out(table):
        dist = table.column("dist").to_numpy()
        some = pa.array(np.where(np.isinf(dist), np.nan, dist), from_pandas=True)
        return table.set_column(table.schema.get_field_index("dist"), "dist", some).select(names).combine_chunks().to_batches()

    def run(batches):
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for part in kernels.in_parts(pc.fill_null(pc.list_value_length(batch.column("_idx")), 0).to_numpy(zero_copy_only=False), PARCEL):
                done, rest = meet(rows.slice(part.start, part.stop - part.start), rest)
                yield from out(done)
        if rest is not None:
            yield from out(rest)

    return met.mapInArrow(run, schema)


def nearest_line(points: DataFrame, lines: DataFrame, *keys: str, point: str = "point", cell: float = 20.0) -> DataFrame:
    """keys, point, idx, dist: the nearest line to each point, the least idx on a tie.

    Points and lines meet in blocks of ground: a point goes to its block, a line to those it comes within reach of, packed by the thousand, and candidates are tried in the block's task, so
    none is moved, sorted or written. A block's points are held, its lines pass by in parts. The reach is at most cell and less where lines are dense; points without a line so near look
    again with a reach four times as wide, among the lines within reach of the box of their key's waiting points. Points of a key without lines, or without a place, have no row.
    """
    lines = finite(lines.select(*keys, "idx", *ENDS), *ENDS)
    facts = checkpointed(_facts(lines, *keys, cell=cell))
    waiting = finite(points.select(*keys, point, "x", "y"), "x", "y")
    out = None
    while True:
        box = waiting.groupBy(*keys).agg(*[f(c).alias(n) for c in "xy" for n, f in ((f"_{c}0", F.min), (f"_{c}1", F.max))])
        found = checkpointed(_within(waiting, lines, checkpointed(facts.join(box, list(keys))), *keys, point=point))
        near = found.where("dist is not null").select(*keys, point, "idx", "dist")
        out = near if out is None else out.unionByName(near)
        waiting = found.where("dist is null").select(*keys, point, "x", "y")
        if not waiting.limit(1).count():
            return out
        facts = facts.withColumns({c: F.col(c) * 4 for c in ("reach", "side")})
