"""Ordered folds over the values of a key that may be too many for one task: sorted ranges instead of one window a key.

`order_values` deals distinct values to sorted ranges of about the same number of rows, whatever their keys, and keeps each row's range in
`part`. What a range must know of the ranges before or after it is one row a range and key (`carried`), so that
neighbours, ranks and running values are exact with no key in one task. Filters keep the order, so several folds share one dealing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.params import DEFAULTS
from furrow.sources.shared import checkpointed


def parts_of(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def order_values(values: DataFrame, *keys: str, value: str = "d", parts: int | None = None) -> DataFrame:
    """The rows with part, 0 to parts - 1: ranges by keys, then value. Nulls of value come first. Written, so that ranges stay as they are."""
    dealt = values.repartitionByRange(parts or parts_of(values), *keys, value)
    return checkpointed(dealt.withColumn("part", F.spark_partition_id()))


def carried(ordered: DataFrame, keys: tuple, what: Column, *, after: bool = False) -> DataFrame:
    """part, keys, carry: of the nearest range before (or after) that holds the key, its aggregate `what`."""
    near = Window.partitionBy(*keys).orderBy(F.desc("part") if after else F.asc("part"))
    return ordered.groupBy("part", *keys).agg(what.alias("_w")).select("part", *keys, F.lag("_w").over(near).alias("carry"))


def with_before(ordered: DataFrame, *keys: str, value: str = "d", name: str = "before") -> DataFrame:
    """The rows with the value before theirs, null for a key's first."""
    inside = F.lag(value).over(Window.partitionBy("part", *keys).orderBy(value))
    met = ordered.withColumn("_i", inside).join(carried(ordered, keys, F.max(value)), ["part", *keys])
    return met.withColumn(name, F.coalesce("_i", "carry")).drop("_i", "carry")


def gap_filter(ordered: DataFrame, *keys: str, value: str = "d", gap: float = DEFAULTS.min_row_gap_m) -> DataFrame:
    """lines.gap_filter over ordered values: those at least a gap away from the one before them, kept or not; before the first comes 0."""
    return with_before(ordered, *keys, value=value, name="_b").where(F.abs(F.col(value) - F.coalesce("_b", F.lit(0.0))) >= gap).drop("_b")


def numbered(ordered: DataFrame, *keys: str, value: str = "d", name: str = "id") -> DataFrame:
    """The rows numbered from 0 within their key: the rank inside the range after the rows of the ranges before."""
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ordered.groupBy("part", *keys).agg(F.count(F.lit(1)).alias("_n")).select("part", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    inside = F.row_number().over(Window.partitionBy("part", *keys).orderBy(value)) - 1
    return ordered.withColumn("_i", inside).join(counts, ["part", *keys]).withColumn(name, (F.col("_i") + F.col("_n")).cast("int")).drop("_i", "_n")


def _successors(values: DataFrame, *keys: str, span: float, parts: int) -> DataFrame:
    """keys, d, to, last: the first value more than span above d, null without one, and the value before that one. values: keys, d, before, after.

    Values and the places d + span are sorted together: the place lies between the last value up to it and the first one above. Which of these is
    the first with value - d > span is decided by that difference itself, as in the fold."""
    both = values.select(*keys, F.col("d").alias("at"), F.lit(0).alias("asks"), F.struct("d", "before", "after").alias("v"))
    both = order_values(both.unionByName(values.select(*keys, (F.col("d") + span).alias("at"), F.lit(1).alias("asks"), F.struct("d", "before", "after").alias("v"))), *keys, value="at", parts=parts)
    own = F.when(F.col("asks") == 0, F.col("v"))
    up = Window.partitionBy("part", *keys).orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("part", *keys).orderBy(F.desc("at"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("low", F.max(own).over(up)).withColumn("high", F.min(own).over(down))
    for name, what, after in (("low", F.max(own), False), ("high", F.min(own), True)):
        far = Window.partitionBy(*keys).orderBy(F.desc("part") if after else F.asc("part")).rowsBetween(Window.unboundedPreceding, -1)
        ends = both.groupBy("part", *keys).agg(what.alias("_w"))
        ends = ends.select("part", *keys, (F.min("_w") if after else F.max("_w")).over(far).alias("carry"))
        met = met.join(ends, ["part", *keys]).withColumn(name, F.coalesce(name, "carry")).drop("carry")
    d = F.col("v.d")
    to = F.when(F.col("low.d") - d > span, F.col("low.d")).when(F.col("high.d") - d > span, F.col("high.d")).otherwise(F.col("high.after"))
    last = F.when(F.col("low.d") - d > span, F.col("low.before")).when(F.col("high.d") - d > span, F.col("high.before")).otherwise(F.coalesce("high.d", "low.d"))
    return met.where("asks = 1").select(*keys, d.alias("d"), to.alias("to"), last.alias("last"))


def span_groups(ordered: DataFrame, *keys: str, span: float = DEFAULTS.group_span, parts: int | None = None) -> DataFrame:
    """lines.span_groups over ordered distinct values d: keys, grp, d (each group's greatest), with part.

    A value more than span above the one before it begins a group whatever came before, so values fall into stretches. A stretch no longer than span
    is one group. In a longer one each value points to the first value more than span above it; the groups' firsts are what the stretch's
    first reaches, found by doubling the pointers: as many rounds as the logarithm of the most groups in a stretch."""
    parts = parts or parts_of(ordered)
    near = with_before(ordered, *keys, name="before")
    ahead = F.lead("d").over(Window.partitionBy("part", *keys).orderBy("d"))
    near = near.withColumn("_a", ahead).join(carried(ordered, keys, F.min("d"), after=True), ["part", *keys]).withColumn("after", F.coalesce("_a", "carry")).drop("_a", "carry")
    begins = near.withColumn("_s", F.when(F.col("before").isNull() | (F.col("d") - F.col("before") > span), F.col("d")))
    running = Window.partitionBy("part", *keys).orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = begins.groupBy("part", *keys).agg(F.max("_s").alias("_w"))
    far = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("part", *keys, F.max("_w").over(far).alias("carry"))
    stretched = checkpointed(begins.withColumn("_r", F.max("_s").over(running)).join(ends, ["part", *keys]).withColumn("stretch", F.coalesce("_r", "carry")).drop("_s", "_r", "carry", "part"))
    reach = stretched.groupBy(*keys, "stretch").agg(F.max("d").alias("top"))
    short = reach.where(F.col("top") - F.col("stretch") <= span).select(*keys, F.col("top").alias("d"))
    wide = reach.where(F.col("top") - F.col("stretch") > span)
    found = short
    if wide.limit(1).count():
        own = (*keys, "stretch")
        inside = stretched.join(wide.select(*own), list(own)).withColumn("after", F.when(F.col("after") - F.col("d") <= span, F.col("after")))
        steps = checkpointed(_successors(inside, *own, span=span, parts=parts))
        marked = checkpointed(wide.select(*own, F.col("stretch").alias("d")))
        jump = steps.where("to is not null").select(*own, "d", "to")
        while True:
            # marked holds the firsts of each stretch's first 2^k groups, jump leads 2^k groups on
            new = checkpointed(marked.join(jump, [*own, "d"]).select(*own, F.col("to").alias("d")))
            if not new.limit(1).count():
                break
            marked = checkpointed(marked.union(new))
            ahead = jump.select(*own, F.col("d").alias("to"), F.col("to").alias("next"))
            jump = checkpointed(jump.join(ahead, [*own, "to"]).select(*own, "d", F.col("next").alias("to")))
        found = short.union(marked.join(steps, [*own, "d"]).select(*keys, F.col("last").alias("d")))
    return numbered(order_values(found, *keys, parts=parts), *keys, name="grp").select(*keys, "grp", "d", "part")
