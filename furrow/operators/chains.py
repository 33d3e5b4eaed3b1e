"""Label spreading and list ranking over tables of links, in rounds that double what they have: no ring, chain or component of any size in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.params import DEFAULTS
from furrow.sources.shared import checkpointed

BUCKET = 50_000  # nodes of small keys that one task ranks at once, on average


def ring_places(steps: DataFrame, *keys: str, at_once: int = DEFAULTS.fold_values) -> DataFrame:
    """keys, node, ring, place from keys, node, next, where each node is the next of one other, so that nodes lie on rings: ring is
    the least node of a node's ring, place the number of steps to the node from there. Keys of up to at_once nodes are ranked a few in a task, larger ones in rounds over tables.
    Nodes are numbers or structs of numbers."""
    steps = checkpointed(steps.select(*keys, "node", "next"))
    sizes = checkpointed(steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    fits = F.col("_n") <= at_once
    few, most = sizes.agg(F.sum(F.when(fits, F.col("_n"))), F.max("_n")).first()
    small = steps.join(sizes.where(fits), list(keys), "left_semi")
    bucket = F.pmod(F.xxhash64(*keys), F.lit((few or 0) // BUCKET + 1)).alias("_bucket")
    types = {f.name: f.dataType.simpleString() for f in steps.schema}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], f"node {types['node']}", f"ring {types['node']}", "place bigint"])
    ranked = small.select(*keys, "node", "next", bucket).groupBy("_bucket").applyInArrow(lambda table: _ranked(table, *keys), schema)
    if (most or 0) <= at_once:
        return ranked
    return ranked.unionByName(_ring_places(steps.join(sizes.where(~fits), list(keys), "left_semi"), *keys))


def _ranked(table: pa.Table, *keys: str) -> pa.Table:
    """ring_places of the keys in a table, by the same doubling."""
    table, n = table.combine_chunks(), table.num_rows
    parts = []
    for name in ("node", "next"):
        column = table.column(name).combine_chunks()
        values = column.flatten() if pa.types.is_struct(column.type) else [column]
        parts.append([*[table.column(k).combine_chunks().dictionary_encode().indices.to_numpy() for k in keys], *[v.to_numpy(zero_copy_only=False) for v in values]])
    both = [np.concatenate(c) for c in zip(*parts)]
    order = np.lexsort(both[::-1])
    differ = np.zeros(2 * n, np.int64)
    for c in both:
        differ[1:] |= c[order][1:] != c[order][:-1]
    rank = np.empty(2 * n, np.int64)
    rank[order] = differ.cumsum()
    row = np.full(2 * n + 1, n)  # the row of each rank; n: none
    row[rank[:n]] = np.arange(n)
    least, to = np.append(rank[:n], 2 * n), np.append(row[rank[n:]], n)
    rounds = max(1, n.bit_length())
    for _ in range(rounds):
        least, to = np.minimum(least, least[to]), to[to]
    on, ring = to[:n] < n, row[least[:n]]  # nodes that lead to none lie on no ring
    after = row[rank[n:]]
    goes = on & (after != ring)
    to, left = np.append(np.where(goes, after, n), n), np.append(goes.astype(np.int64), 0)
    for _ in range(rounds):
        left, to = left + left[to], to[to]
    rows = np.flatnonzero(on)
    place = np.bincount(ring[rows], minlength=n + 1)[ring[rows]] - 1 - left[rows]
    out = table.take(pa.array(rows))
    return pa.table({**{k: out.column(k) for k in keys}, "node": out.column("node"), "ring": table.column("node").take(pa.array(ring[rows])), "place": pa.array(place)})


def _ring_places(steps: DataFrame, *keys: str, most_rounds: int = 64) -> DataFrame:
    """ring_places in rounds over tables.

    Round k knows the least node of the 2^k nodes from each one on and where the 2^k steps lead; once no least node changes, a ring has one. Places are then the
    lengths of the ways to the node before the least one, found by doubling pointers that end there."""
    jump = checkpointed(steps.select(*keys, "node", "next", F.least("node", "next").alias("ring")))
    for _ in range(most_rounds):
        ahead = jump.select(*keys, F.col("node").alias("next"), F.col("next").alias("far"), F.col("ring").alias("other"))
        moved = checkpointed(jump.join(ahead, [*keys, "next"]).select(*keys, "node", F.col("far").alias("next"), "ring", F.least("ring", "other").alias("new")))
        changed = moved.where("new <> ring").limit(1).count()
        jump = moved.select(*keys, "node", "next", F.col("new").alias("ring"))
        if not changed:
            break
    else:
        raise RuntimeError("rings did not settle")
    named = jump.select(*keys, "node", "ring").join(steps.select(*keys, "node", "next"), [*keys, "node"])
    # to: a node further on, null past the last one before the ring's least node; left: steps from here to the last.
    way = checkpointed(named.select(*keys, "node", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("to"), F.when(F.col("next") != F.col("ring"), 1).otherwise(0).cast("long").alias("left")))
    for _ in range(most_rounds):
        if not way.where("to is not null").limit(1).count():
            break
        ahead = way.select(*keys, F.col("node").alias("to"), F.col("to").alias("far"), F.col("left").alias("more"))
        way = checkpointed(way.join(ahead, [*keys, "to"], "left").select(*keys, "node", "ring", F.col("far").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    size = way.groupBy(*keys, "ring").agg(F.count(F.lit(1)).alias("size"))
    return way.join(size, [*keys, "ring"]).select(*keys, "node", "ring", (F.col("size") - 1 - F.col("left")).alias("place"))


def least_labels(nodes: DataFrame, links: DataFrame, *keys: str, most_rounds: int = 100) -> DataFrame:
    """keys, node, label: the least node that a node of nodes (keys, node) reaches by links (keys, a, b), either way. Each round takes the least label among
    neighbours, hands it to the node that gave its own label, and follows labels' own labels. Labels are merged, not broadcast: as files they are small for
    the rows they hold, and the driver would gather them in each round."""
    both = checkpointed(links.select(*keys, "a", "b").union(links.select(*keys, F.col("b"), F.col("a"))).distinct().toDF(*keys, "node", "to"))
    labels = checkpointed(nodes.select(*keys, "node", F.col("node").alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels.select(*keys, F.col("node").alias("to"), F.col("label").alias("near")).hint("merge"), [*keys, "to"]).groupBy(*keys, "node").agg(F.min("near").alias("near"))
        lower = labels.join(near.hint("merge"), [*keys, "node"], "left").withColumn("low", F.least("label", "near"))
        # A node's new label holds for the node that was its label before, too.
        hooked = lower.groupBy(*keys, F.col("label").alias("node")).agg(F.min("low").alias("hook"))
        low = checkpointed(lower.join(hooked.hint("merge"), [*keys, "node"], "left").select(*keys, "node", "label", F.least("low", "hook").alias("low")))
        jump = low.select(*keys, F.col("node").alias("low"), F.col("low").alias("next"))
        moved = checkpointed(low.join(jump.hint("merge"), [*keys, "low"]).select(*keys, "node", "label", F.least("low", "next").alias("new")))
        changed = moved.where("label <> new").limit(1).count()
        labels = moved.select(*keys, "node", F.col("new").alias("label"))
        if not changed:
            return labels
    raise RuntimeError("labels did not settle")
