"""Connected components of an edge table: joined within parts of bounded size, then by smallest labels with pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import checkpointed


def _join_part(batches):
    """All edges (a, b) of one part, nodes being bytes, to (node, label): the smallest node of its part's component."""
    pairs = [(x, y) for batch in batches for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
    if not pairs:
        return
    names = sorted({x for pair in pairs for x in pair})
    number = {x: i for i, x in enumerate(names)}
    up = np.arange(len(names)).tolist()

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for x, y in pairs:
        i, j = top(number[x]), top(number[y])
        up[max(i, j)] = min(i, j)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([names[top(i)] for i in range(len(names))], pa.binary())], names=["node", "label"])


def components(edges: DataFrame, part_edges: int = 500_000, most_rounds: int = 200) -> DataFrame:
    """(node, label) for each node of edges (a, b), nodes being binary: the label is the smallest node it can reach.

    Edges are dealt into parts of about part_edges, as many as it takes, and joined inside each; of one part that is the result. Of several,
    the parts' (node, label) pairs are the edges of what follows, in which each component's parts are stars. Each round takes the smallest label among a node and its neighbours, then follows that label's own
    label, so chains shorten by half or more. A checkpoint in the shared folder ends each round.
    Minima are combined before they move, so a node with very many edges costs no task more.
    """
    edges = checkpointed(edges.select("a", "b").where("a <> b"))
    parts = -(-edges.count() // part_edges) or 1
    joined = checkpointed(edges.repartition(parts).mapInArrow(_join_part, "node binary, label binary"))
    if parts == 1:
        return joined
    edges = joined.toDF("a", "b")
    both = checkpointed(edges.union(edges.select("b", "a")).where("a <> b").distinct().toDF("a", "b"))
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels.toDF("b", "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.toDF("low", "next")
        moved = checkpointed(lower.join(jump, "low").select("node", "label", F.least("low", "next").alias("new")))
        changed = moved.where("label <> new").limit(1).count()
        labels = moved.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
