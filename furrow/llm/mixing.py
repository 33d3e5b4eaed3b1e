"""Mixing sources to target weights with a time-varying curriculum. DataFrame functions only.

Each source gets a target number of words: its weight's share of the whole mix, capped at a number
of passes over the source. A source's weight changes over training time t in [0, 1]: it is
``1 + slope * (2t - 1)``, whose integral ``C(t) = t + slope * (t*t - t)`` is the share of the
source's target that is due by t. A source's documents, in a fixed random order, fill its demand
one after another; the document that starts at demand c gets position ``C^-1(c / target)``. The mix
is range-sorted by that position, so the sources interleave as their schedules ask. The schedules also say how much of the
whole mix is due before a position, so ranges of equal size are known without a look at the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import WORD, checkpointed, scratch

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Slopes of the schedules, repeating: from more at the start to more at the end.
SLOPES = (-0.5, 0.0, 0.5)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_md5(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _each(values, i: Column) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), (i % len(values)).cast("int"))


def _ranked(sizes: DataFrame) -> DataFrame:
    """sizes with i, each source's place in code point order from 0, null last: places within ranges of sources, then the ranges' sums."""
    key = F.col("source").isNull(), F.col("source").cast("binary")
    dealt = sizes.withColumns({"none": key[0], "key": key[1]}).repartitionByRange("none", "key").sortWithinPartitions("none", "key")
    dealt = checkpointed(dealt.withColumn("range", F.spark_partition_id()))
    here = F.row_number().over(Window.partitionBy("range").orderBy("none", "key")) - 1
    counts, before = {r["range"]: r["count"] for r in dealt.groupBy("range").count().collect()}, [0]  # a row a range
    for i in range(max(counts, default=0)):
        before.append(before[-1] + counts.get(i, 0))
    return checkpointed(dealt.withColumn("i", here + F.get(F.array(*map(F.lit, before)), F.col("range"))).drop("none", "key", "range"))


def source_targets(sizes: DataFrame, share: float = 1.5, passes: float = 2.0, weights=WEIGHTS, slopes=SLOPES) -> DataFrame:
    """(source, source_size, target, slope) from (source, source_size), a row per source.

    Sources are in code point order, null last. Targets are share * all sizes dealt by weight; one
    above passes * source_size stops there and the excess is dealt again, until none is above. Sources may be many: each time
    of dealing is one sum over them.
    """
    ranked = (
        _ranked(sizes)
        .withColumn("weight", _each(weights, F.col("i")))
        .withColumn("slope", _each(slopes, F.col("i")))
        .withColumn("cap", F.col("source_size") * F.lit(float(passes)))
    )
    level, known = 0.0, None
    while True:
        held = F.col("cap") < F.lit(level) * F.col("weight")
        sums = ranked.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(held, F.col("cap"))).alias("capped"), F.sum(F.when(~held, F.col("weight"))).alias("free"), F.sum(held.cast("long")).alias("n")
        ).first()
        if not sums["free"] or sums["n"] == known:
            break
        known, level = sums["n"], (sums["all"] * float(share) - (sums["capped"] or 0.0)) / sums["free"]
    full = sums["free"] is None or not sums["free"]
    target = F.col("cap") if full else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"), "slope")


def in_order(df: DataFrame, demand: Column, *order, rest: Column | None = None) -> DataFrame:
    """df sorted by order, dealt by the share of the mix (0 to 1) that is due before each row: as many equal ranges as there are shuffle
    partitions. Rows without one come last, dealt in the same way by rest, if given. order must sort by what demand and rest follow from."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = lambda share: F.least(F.floor(share * n), F.lit(n - 1)).cast("int")
    if rest is None:
        return df.repartitionById(n, place(F.coalesce(demand, F.lit(1.0)))).sortWithinPartitions(*order)
    part = F.when(demand.isNotNull(), place(demand)).otherwise(n + place(rest))
    return df.repartitionById(2 * n, part).sortWithinPartitions(*order)


def curriculum_mix(docs: DataFrame, share: float = 1.5, passes: float = 2.0, weights=WEIGHTS, slopes=SLOPES) -> DataFrame:
    """One row per row of docs, sorted by its first training position (those not taken last).

    Columns: doc_id, text_md5, source, size, source_size, target, taken, and epochs: an array of
    (position, words, demand), one for each time the document is taken; demand is the share of the whole mix that is due before that
    position. The document at the end of a source's target is taken in part, so a source's taken words add up to its target's whole words.

    docs needs doc_id, text and source; other columns are ignored. A null text has size 0 and is not
    taken; a null source is a source of its own. Equal rows share their order's place and are
    interchangeable. No rows give no rows. Reruns agree: the order within a source is by the
    MD5 of doc_id, then of text. A source may hold any share of the rows: running sums are taken in two steps, over 4096
    slices of a source's order and within a slice. The result is a written table of one narrow row a document (see common.scratch).
    """
    with scratch(docs.sparkSession) as result:
        return result(_mix(docs, share, passes, weights, slopes))


def _mix(docs, share, passes, weights, slopes) -> DataFrame:
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = checkpointed(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            order.alias("order"),
            text_md5(F.col("text")).alias("text_md5"),
        ).withColumn("slice", F.substring("order", 1, 3))
    )
    slices = checkpointed(sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")))
    running = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = slices.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(running), F.lit(0)).cast("long"))
    targets = checkpointed(source_targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), share, passes, weights, slopes))
    whole = targets.agg(F.sum("target").alias("target"), F.sum(F.col("target") * F.col("slope")).alias("slope")).first()
    mean = F.lit(whole["slope"] / whole["target"] if whole["target"] else 0.0)
    facts = placed.join(targets, placed["source"].eqNullSafe(targets["source"])).select(
        placed["source"].alias("fact_source"), F.col("slice").alias("fact_slice"), "slice_start", "source_size", "target", "slope"
    )
    within = Window.partitionBy("source", "slice").orderBy("order", "doc_id", "text_md5").rowsBetween(Window.unboundedPreceding, -1)
    local = sized.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)).cast("long"))
    met = local.join(facts, (F.col("slice") == F.col("fact_slice")) & F.col("source").eqNullSafe(F.col("fact_source")))
    start = F.col("slice_start") + F.col("before")
    due = F.floor(F.col("target")).cast("long")
    epochs = []
    for e in range(int(-(-passes // 1))):
        words = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), due - start - F.col("source_size") * e))
        position = _position(F.try_divide(start + F.col("source_size") * e, F.col("target")), F.col("slope"))
        epochs.append(F.struct(position.alias("position"), words.alias("words"), (position + mean * (position * position - position)).alias("demand")))
    none = F.array().cast("array<struct<position:double,words:bigint,demand:double>>")
    out = met.select(
        "doc_id",
        "text_md5",
        "source",
        "size",
        "source_size",
        "target",
        F.when(F.col("target") > 0, F.filter(F.array(*epochs), lambda x: x["words"] > 0)).otherwise(none).alias("epochs"),
        "order",
    ).withColumn("taken", F.aggregate("epochs", F.lit(0).cast("long"), lambda a, x: a + x["words"]))
    first = F.get("epochs", F.lit(0))
    rest = F.conv(F.substring("order", 1, 6), 16, 10).cast("double") / (1 << 24)
    ordered = in_order(out, first["demand"], first["position"].asc_nulls_last(), "order", "doc_id", "text_md5", rest=rest)
    return ordered.select("doc_id", "text_md5", "source", "size", "source_size", "target", "taken", "epochs")


def _position(due: Column, slope: Column) -> Column:
    """The t in [0, 1] with t + slope * (t*t - t) = due."""
    due = F.least(F.greatest(due, F.lit(0.0)), F.lit(1.0))
    b = 1 - slope
    root = F.sqrt(b * b + 4 * slope * due)
    return F.when(slope == 0, due).otherwise(2 * due / (b + root))
