"""Hard negatives by bit-sliced integer products: for each anchor its nearest rows of the same label, and for each of these the best rows of other
labels whose score lies in a window below.

Rows are packed into blocks where they are read, anchors into blocks of about the same number; each block of rows is held against each
block of anchors inside a task (a stated query set against all rows). There a row's components are taken bit-plane by bit-plane, the
sign first, then the most significant bits. After each plane a pair's score lies in an interval: what the planes so far give, and what the rest
can add at least and at most for this anchor. Pairs whose interval can't qualify any more are dropped, so that few are
left for the last planes. Scores are exact integers; what is kept is what all products in full would keep.

A first pass finds the positives, a second one the negatives in the windows that they set. A task hands on the best few of an anchor over all
blocks it has read; ranks over all tasks are taken after that, from rows that are already few.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.llm.common import pick, scratch, written

BLOCK = "n int, ids binary, labels binary, rows binary"
ANCHORS = "anchor_block int, a_n int, a_no binary, a_ids binary, a_labels binary, a_rows binary, a_positives binary"
LIMIT = 2**31


def components_of(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows take part, their integer components): a null vector, a null or non-finite component, or one
    beyond 31 bits takes no part. Shorter vectors end in zeros."""
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    size = np.diff(offsets)
    flat = vectors.values.slice(offsets[0], offsets[-1] - offsets[0])
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
    good = np.isfinite(x)
    whole = np.floor(scale * np.where(good, x, 0.0))
    good &= np.abs(whole) < LIMIT
    bad = np.append(0, np.cumsum(~good))
    at = offsets - offsets[0]
    ok = (bad[at[1:]] == bad[at[:-1]]) & ~vectors.is_null().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), int(size.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(x)) - np.repeat(at[:-1], size)] = whole
    return ok, out[ok]


def _matrix(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.int32).reshape(n, -1) if n else np.zeros((0, 0), np.int32)


def _pack(scale: int, size: int):
    """Rows (vec_id, label, vector) to blocks of different rows."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, size):
                some = batch.slice(first, size)
                ok, rows = components_of(some.column("vector"), scale)
                ids, labels = (some.column(c).to_numpy(zero_copy_only=False)[ok] for c in ("vec_id", "label"))
                if not len(ids):
                    continue
                whole = np.hstack([ids.astype(np.int64)[:, None], labels.astype(np.int64)[:, None], rows])
                whole = np.unique(whole, axis=0)
                parts = [whole[:, 0].tobytes(), whole[:, 1].tobytes(), np.ascontiguousarray(whole[:, 2:].astype(np.int32)).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([len(whole)], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], names=["n", "ids", "labels", "rows"])

    return run


def _singly(scale: int):
    """Rows (vec_id, label, vector) to (vec_id, label, row) of those that take part."""

    def run(batches):
        for batch in batches:
            ok, rows = components_of(batch.column("vector"), scale)
            keep, size = pa.array(ok), np.diff(batch.column("vector").offsets.to_numpy())[ok]
            packed = [row[:n].astype(np.int32).tobytes() for row, n in zip(rows, size.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(keep), batch.column("label").filter(keep), pa.array(packed, pa.binary())], names=["vec_id", "label", "row"])

    return run


def planes_of(rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(weight, 0/1 matrix) of each bit-plane of integer rows in two's complement, most significant first."""
    top = int(max(rows.max(initial=0), -rows.min(initial=0) - 1)).bit_length()
    return [(-(1 << top), rows < 0)] + [(1 << b, (rows >> b) & 1) for b in range(top - 1, -1, -1)]


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's kth greatest value."""
    return np.full(len(x), -np.inf) if x.shape[1] < k else np.partition(x, -k, axis=1)[:, -k]


def _positives_left(lo, hi, open_, floor, k):
    """Pairs that may still be among the k greatest of their anchor."""
    return open_ & (hi >= np.maximum(floor, _kth(np.where(open_, lo, -np.inf), k))[:, None])


def _windows_left(lo, hi, open_, positives, floors, k, percent):
    """Pairs that may still be among the k greatest inside one of their anchor's windows."""
    out = np.zeros_like(open_)
    for j in range(positives.shape[1]):
        most = positives[:, j : j + 1]
        meets = open_ & (100 * hi >= percent * most) & (lo <= most)
        inside = meets & (100 * lo >= percent * most) & (hi <= most)
        least = np.maximum(floors[:, j], _kth(np.where(inside, lo, -np.inf), k))
        out |= meets & (hi >= least[:, None])
    return out


def surviving(anchors: np.ndarray, rows: np.ndarray, open_: np.ndarray, left) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs in open_ that left(lo, hi, open_) keeps to the last plane. While many pairs are open, planes are multiplied whole;
    then pair by pair, without the test once a plane rules out little."""
    width = max(anchors.shape[1], rows.shape[1])
    anchors, rows = (np.pad(x.astype(np.int64), ((0, 0), (0, width - x.shape[1]))) for x in (anchors, rows))
    plus, minus = np.maximum(anchors, 0).sum(axis=1), np.minimum(anchors, 0).sum(axis=1)
    planes = planes_of(rows)
    reach = float((plus - minus).max(initial=0)) * (1 << len(planes))
    kind = np.float64 if reach < 2.0**53 else np.int64
    thin = np.float32 if float((plus - minus).max(initial=0)) < 2.0**24 else kind
    score, a = np.zeros(open_.shape, kind), anchors.astype(thin)
    done = 0
    for done, (weight, plane) in enumerate(planes, 1):
        score += weight * (a @ plane.T.astype(thin)).astype(kind)
        rest = (1 << (len(planes) - done)) - 1
        open_ = left(score + rest * minus[:, None], score + rest * plus[:, None], open_)
        if 16 * np.count_nonzero(open_) < open_.size:
            break
    i, j = np.nonzero(open_)
    out = score[i, j].astype(np.int64)
    for first in range(0, len(i), 1 << 16):
        x, y = i[first : first + (1 << 16)], j[first : first + (1 << 16)]
        low = rows[y] & ((1 << (len(planes) - done)) - 1)  # what the planes not yet taken hold
        out[first : first + (1 << 16)] += np.einsum("pd,pd->p", anchors[x], low)
    return i, j, out


class _Best:
    """The k best (score, id) of each slot over the blocks a task has read: higher scores first, ties by smaller id, each (score, id) once."""

    def __init__(self, slots: int, k: int):
        self.k, self.slot = k, np.empty(0, np.int64)
        self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64)
        self.floor = np.full(slots, -np.inf)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = np.append(self.slot, slot), np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        new = np.append(True, (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1]))
        slot, score, ids = slot[new], score[new], ids[new]
        begins = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        rank = np.arange(len(slot)) - np.repeat(begins, np.diff(np.append(begins, len(slot))))
        keep = rank < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        full = rank == self.k - 1
        self.floor[slot[full]] = score[full]


def _search(k: int, most: int, percent: int | None):
    """Blocks of rows joined with blocks of anchors to (no, of, id, score): with percent None an anchor's best rows of the same label (of is 0);
    otherwise the best rows of other labels in the window of each positive score (of: its number). Handed on whenever `most` anchors are held."""

    def handed_on(held):
        for numbers, best, per in held.values():
            if len(best.slot):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[best.slot // per]), pa.array((best.slot % per).astype(np.int32)), pa.array(best.id), pa.array(best.score)], names=["no", "of", "id", "score"]
                )

    def run(batches):
        held: dict = {}
        for batch in batches:
            for r in range(batch.num_rows):
                take = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                ids, labels = (np.frombuffer(take[c], np.int64) for c in ("ids", "labels"))
                rows, anchors = _matrix(take["rows"], take["n"]), _matrix(take["a_rows"], take["a_n"])
                numbers, own, own_label = (np.frombuffer(take[c], np.int64) for c in ("a_no", "a_ids", "a_labels"))
                positives = np.frombuffer(take["a_positives"], np.int64).reshape(take["a_n"], -1).astype(np.float64)
                per = 1 if percent is None else positives.shape[1]
                if take["anchor_block"] not in held:
                    if sum(len(h[0]) for h in held.values()) + len(own) > most:
                        yield from handed_on(held)
                        held = {}
                    held[take["anchor_block"]] = (numbers, _Best(len(own) * per, k), per)
                best = held[take["anchor_block"]][1]
                if percent is None:
                    for label in np.intersect1d(own_label, labels).tolist():  # pairs of one label only
                        mine, theirs = np.flatnonzero(own_label == label), np.flatnonzero(labels == label)
                        open_ = own[mine][:, None] != ids[theirs]
                        i, j, s = surviving(anchors[mine], rows[theirs], open_, lambda lo, hi, o: _positives_left(lo, hi, o, best.floor[mine], k))
                        best.add(mine[i], s, ids[theirs[j]])
                    continue
                floors = best.floor.reshape(len(own), per)
                i, j, s = surviving(anchors, rows, own_label[:, None] != labels, lambda lo, hi, o: _windows_left(lo, hi, o, positives, floors, k, percent))
                for p in range(per):
                    inside = (s <= positives[i, p]) & (100 * s >= percent * positives[i, p])
                    best.add(i[inside] * per + p, s[inside], ids[j[inside]])
        yield from handed_on(held)

    return run


def _anchor_blocks(anchors: DataFrame, blocks: int, positives: int) -> DataFrame:
    """Anchors (no, vec_id, label, row, scores) in blocks; missing scores as the least long, whose window is empty."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        width = max(len(x) for x in group["row"]) // 4
        rows = np.zeros((len(group), width), np.int32)
        scores = np.full((len(group), positives), -(2**62), np.int64)
        for i, (row, own) in enumerate(zip(group["row"], group["scores"])):
            rows[i, : len(row) // 4] = np.frombuffer(row, np.int32)
            scores[i, : len(own)] = own
        fixed = [group[c].to_numpy(np.int64).tobytes() for c in ("no", "vec_id", "label")]
        return pd.DataFrame([(key[0], len(group), *fixed, rows.tobytes(), scores.tobytes())], columns=[c.split()[0] for c in ANCHORS.split(", ")])

    return anchors.groupBy(F.pmod(F.xxhash64("no"), F.lit(blocks)).cast("int").alias("anchor_block")).applyInPandas(run, ANCHORS)


def _met(blocks: DataFrame, anchors: DataFrame, count: int, most_broadcast: int, bytes_: int) -> DataFrame:
    """Each block of rows with each block of anchors. Anchors below the checked size go to the tasks that read the rows; more of them
    meet the rows in a shuffle, dealt by block of anchors and a salt that spreads one block's rows."""
    out = blocks.withColumn("anchor_block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    if bytes_ <= most_broadcast:
        return out.join(F.broadcast(anchors), "anchor_block")
    salts = 64
    salted = anchors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return out.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int")).join(salted.hint("shuffle_hash"), ["anchor_block", "salt"]).drop("salt")


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each anchor and window over all tasks. Spark ranks inside tasks before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k)


@contextmanager
def _small_batches(spark: SparkSession, most: int):
    """Arrow batches of at most `most` bytes, or one joined pair of blocks."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hard_negatives(
    vectors: DataFrame,
    anchor_every: int = 100,
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
    scale: int = 256,
    rows_in_block: int = 4096,
    anchors_in_block: int = 512,
    most_broadcast: int = 32 << 20,
) -> DataFrame:
    """For each anchor and each of its positives the hard negatives: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    vectors needs vec_id, label and vector (an array of numbers); other columns are ignored. Components are taken as floor(scale * x). Rows with a null
    id, label or vector, a null or non-finite component, or one beyond 31 bits take no part; a shorter vector ends in zeros. Anchors are the rows whose vec_id is divisible
    by anchor_every. A score is the integer inner product with the anchor; higher scores come first, ties by smaller vec_id. Positives are the first
    `positives` rows of the anchor's label with another vec_id; negatives the first `negatives` rows of other labels with percent * p <= 100 * s <= 100 * p
    for a positive's score p. Rows alike in all three columns count once; rows of one vec_id that differ count each, as anchors too. No rows give no rows.
    The result is a written table (see common.scratch). most_broadcast: bytes of anchors up to which they are sent to the tasks.
    """
    spark = vectors.sparkSession
    with scratch(spark) as result, _small_batches(spark, 16 << 20):
        return result(_mine(vectors, anchor_every, positives, negatives, percent, scale, rows_in_block, anchors_in_block, most_broadcast))


def _mine(vectors, anchor_every, positives, negatives, percent, scale, rows_in_block, anchors_in_block, most_broadcast) -> DataFrame:
    plain = pick(vectors, vec_id="long", label="long", vector="array<double>").where("vec_id is not null and label is not null and vector is not null")
    blocks = written(plain.mapInArrow(_pack(scale, rows_in_block), BLOCK), "blocks")
    one = plain.where(F.pmod("vec_id", F.lit(anchor_every)) == 0)
    one = one.mapInArrow(_singly(scale), "vec_id long, label long, row binary").distinct()
    named = written(one.withColumn("no", F.monotonically_increasing_id()), "anchors")
    facts = named.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("row") + 64).alias("bytes")).first()
    count = max(1, -(-facts["n"] // anchors_in_block))
    no_scores = named.withColumn("scores", F.array().cast("array<long>"))
    met = _met(blocks, _anchor_blocks(no_scores, count, 0), count, most_broadcast, facts["bytes"] or 0)
    found = "no long, of int, id long, score long"
    nearest = written(_best(met.mapInArrow(_search(positives, 1 << 20, None), found), ["no"], positives), "positives")
    scores = nearest.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("x")).select("no", F.col("x.score").alias("scores"))
    met = _met(blocks, _anchor_blocks(named.join(scores, "no"), count, positives), count, most_broadcast, (facts["bytes"] or 0) + 8 * positives * facts["n"])
    mined = _best(met.mapInArrow(_search(negatives, 1 << 18, percent), found), ["no", "of"], negatives)
    chosen = nearest.select("no", (F.col("rank") - 1).alias("of"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = mined.join(chosen, ["no", "of"]).join(named.select("no", F.col("vec_id").alias("anchor_id")), "no")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
