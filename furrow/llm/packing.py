"""Harmonic packing of documents into sequences of fixed capacity.

Class k holds pieces of exactly ``capacity // k`` tokens, and a bin of class k holds k of them. A document is
cut greedily: whole sequences first, then each time the largest class length that still fits, so
a rest of r tokens leaves less than about r*r/capacity for the next cut and three or four pieces do.
Every task fills its own bins, k pieces each, without word from any other. What is left of
each class in a task, fewer than k pieces, is filled into bins again over all tasks by rank, and what is
left then (fewer than k pieces of each class in all: a constant) is packed largest class first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import as_text, pick, written
from furrow.llm.tokens import encoder

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, class int, part long, rank long"
_NAMES = [x.split()[0] for x in _PIECE.split(", ")]
_SECOND, _THIRD = 1 << 62, (1 << 62) + (1 << 61)


def cuts(n: int, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, class) of the pieces of a document of n tokens; together they are 0 to n."""
    out, at = [], 0
    while n - at >= capacity:
        out.append((at, capacity, 1))
        at += capacity
    while at < n:
        rest = n - at
        k = -(-capacity // rest)
        if k > 1 and capacity // (k - 1) <= rest:
            k -= 1
        length = capacity // k
        out.append((at, length, capacity // length))
        at += length
    return out


def _pack(tokenizer_path, ranks_path, pattern, capacity, end_id):
    def run(batches):
        encode, part = encoder(tokenizer_path, ranks_path, pattern), TaskContext.get().partitionId()
        waiting: dict[int, list] = {}
        bins = 0
        for batch in batches:
            ids, texts, rows = batch.column("doc_id").to_pylist(), as_text(batch.column("text")), []
            for i, doc_id in enumerate(ids):
                tokens = np.array([*encode([texts[i].as_py()])[0], end_id], dtype="<u4")
                for start, length, k in cuts(len(tokens), capacity):
                    crc = zlib.crc32(tokens[start : start + length].tobytes())
                    line = waiting.setdefault(k, [])
                    line.append((doc_id, start, length, crc, len(tokens)))
                    if len(line) == k:
                        rows += [(*x, (part << 32) + bins, j * length, k, part, None) for j, x in enumerate(line)]
                        bins += 1
                        waiting[k] = []
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
        rest = [(*x, None, None, k, part, j) for k, line in sorted(waiting.items()) for j, x in enumerate(line)]
        if rest:
            yield _batch(rest)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "class" else pa.int64()) for n, c in zip(_NAMES, columns)], names=_NAMES)


def _last_bins(left: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(class, rank, bin, offset) for left[k] pieces of each class k: largest first, each into the first bin with room."""
    used: list[int] = []
    out = []
    for k in sorted(left):
        length, rank, b = capacity // k, 0, 0
        while rank < left[k]:
            if b == len(used):
                used.append(0)
            while rank < left[k] and used[b] + length <= capacity:
                out.append((k, rank, b, used[b]))
                used[b] += length
                rank += 1
            b += 1
    return out


def harmonic_pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class.

    docs needs doc_id and text; other columns are ignored. A document's ids are the tokenizer's, then end_id,
    so a null or empty text is one token. Each id lies in exactly one piece; offsets in a sequence have
    no gaps; sequence_id is unique over all tasks. Repeated rows are packed each. No rows give no rows.
    A sequence of class k has k * (capacity // k) tokens: padding is below k tokens for long pieces and below one
    piece's length for short ones.

    The files must lie at the same paths on all executors.
    """
    pieces = written(pick(docs, doc_id="long", text="string").mapInArrow(_pack(tokenizer_path, ranks_path, pattern, capacity, end_id), _PIECE), "pieces")
    full = pieces.where(F.col("sequence_id").isNotNull())
    rest = pieces.where(F.col("sequence_id").isNull()).drop("sequence_id", "offset")

    # Ranks of the rest over all tasks: counts of the tasks before, then the rank within the task.
    counts = rest.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
    ranked = rest.join(before, ["class", "part"]).withColumn("rank", F.col("rank") + F.col("before"))

    totals = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # at most a row a class
    left = {k: n % k for k, n in totals.items() if n % k}
    last = _last_bins(left, capacity)  # fewer than k rows a class
    spark = docs.sparkSession
    table = spark.createDataFrame([(k, totals[k] - left[k] + r, _THIRD + b, o) for k, r, b, o in last] or [(0, 0, 0, 0)], "class int, rank long, last_id long, last_offset long")
    whole = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, n - n % k)]) if totals else F.create_map(F.lit(0), F.lit(0))
    k = F.col("class").cast("long")
    binned = (
        ranked.join(F.broadcast(table), ["class", "rank"], "left")
        .withColumn("in_bin", F.col("rank") < F.element_at(whole, F.col("class")))
        .withColumn("bin", F.floor(F.col("rank") / k).cast("long"))
        .withColumn("sequence_id", F.when(F.col("in_bin"), F.lit(_SECOND) + k * (1 << 45) + F.col("bin")).otherwise(F.col("last_id")))
        .withColumn("offset", F.when(F.col("in_bin"), F.pmod("rank", k) * F.col("length")).otherwise(F.col("last_offset")))
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class"]
    return full.select(columns).unionByName(binned.select(columns))
