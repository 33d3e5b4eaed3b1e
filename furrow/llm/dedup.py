"""Exact deduplication by deterministic block naming.

Each normalised text is cut into fixed-size blocks. Equal blocks meet in one place, are sorted,
and get one integer name; adjacent names are then paired and the pairs named the same way, until
each document has one (level, name). Names compare contents, never hashes, so two documents share
an identity exactly when their texts are equal.

Every naming step first drops repeats inside a batch, so a block that a third of all rows share
reaches its place once a batch, not once a row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import checkpointed, pick, scratch, written

_LOCAL = "kind int, row_id long, doc_id long, sha string, refs array<long>, ref long, block binary"
_LOCAL_ARROW = pa.schema(
    [
        ("kind", pa.int32()),
        ("row_id", pa.int64()),
        ("doc_id", pa.int64()),
        ("sha", pa.string()),
        ("refs", pa.list_(pa.int64())),
        ("ref", pa.int64()),
        ("block", pa.binary()),
    ]
)


class _Local:
    """Numbers the distinct blocks of one task; forgets them past `most` bytes (a repeat then gets a second
    number, and both numbers get the same name later)."""

    def __init__(self, most: int):
        self.base, self.n, self.held, self.most, self.known = TaskContext.get().partitionId() << 36, 0, 0, most, {}

    def number(self, block: bytes, new: list) -> int:
        ref = self.known.get(block)
        if ref is None:
            if self.held > self.most:
                self.known, self.held = {}, 0
            ref = self.known[block] = self.base + self.n
            self.n += 1
            self.held += len(block) + 100
            new.append((ref, block))
        return ref


def _rows(docs: list, new: list) -> pa.RecordBatch:
    """docs: (row_id, doc_id, sha, refs); new: (ref, block)."""
    d, b = len(docs), len(new)
    columns = [
        pa.array([0] * d + [1] * b, pa.int32()),
        pa.array([x[0] for x in docs] + [None] * b, pa.int64()),
        pa.array([x[1] for x in docs] + [None] * b, pa.int64()),
        pa.array([x[2] for x in docs] + [None] * b, pa.string()),
        pa.array([x[3] for x in docs] + [None] * b, pa.list_(pa.int64())),
        pa.array([None] * d + [x[0] for x in new], pa.int64()),
        pa.array([None] * d + [x[1] for x in new], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_LOCAL_ARROW)


def _cut(size: int, most: int):
    """Batches of (doc_id, text) to document rows with block numbers, and the blocks themselves."""

    def run(batches):
        local, row = _Local(most), TaskContext.get().partitionId() << 36
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = pc.ascii_lower(batch.column("text").fill_null("")).cast(pa.large_binary())
            docs, new = [], []
            for doc_id, text in zip(ids, texts):
                data = text.as_buffer().to_pybytes()
                refs = [local.number(data[i : i + size], new) for i in range(0, max(1, len(data)), size)]
                docs.append((row, doc_id, hashlib.sha256(data).hexdigest(), refs))
                row += 1
                if len(docs) >= 1000:
                    yield _rows(docs, new)
                    docs, new = [], []
            if docs:
                yield _rows(docs, new)

    return run


def _pair(most: int):
    """Batches of (row_id, names) to rows with numbers of adjacent pairs, and the pairs as 16-byte blocks."""

    def run(batches):
        local = _Local(most)
        for batch in batches:
            docs, new = [], []
            for row_id, names in zip(batch.column("row_id").to_pylist(), batch.column("names").to_pylist()):
                names = names + [-1] * (len(names) % 2)
                pairs = np.asarray(names, dtype=">i8").tobytes()
                refs = [local.number(pairs[i : i + 16], new) for i in range(0, len(pairs), 16)]
                docs.append((row_id, None, None, refs))
            if docs:
                yield _rows(docs, new)

    return run


def _name(batches):
    """Sorted blocks of one partition to (ref, name): the same name as long as the block stays the same."""
    name, last = (TaskContext.get().partitionId() << 36) - 1, None
    for batch in batches:
        refs, names = batch.column("ref"), []
        for block in batch.column("block"):
            data = block.as_py()
            if data != last:
                name, last = name + 1, data
            names.append(name)
        yield pa.RecordBatch.from_arrays([refs, pa.array(names, pa.int64())], names=["ref", "name"])


def _named(table: DataFrame) -> DataFrame:
    """(row_id, names) of the document rows of a written table of _rows()."""
    blocks = table.where("kind = 1").select("ref", "block")
    names = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_name, "ref long, name long")
    refs = table.where("kind = 0").select("row_id", F.posexplode("refs").alias("pos", "ref"))
    placed = refs.join(names, "ref").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("x"))
    return placed.select("row_id", F.col("x.name").alias("names"))


def block_names(docs: DataFrame, block_bytes: int = 16384, most_local: int = 32 << 20) -> DataFrame:
    """One row per row of docs: row_id, doc_id, sha (of the normalised text), level, name.

    docs needs doc_id and text; other columns are ignored. A null text counts as empty (one empty
    block). Rows have equal (level, name) exactly if their texts are equal after lower-casing A-Z.
    Repeated rows each keep a row_id of their own. An empty table gives an empty table.

    block_bytes: the fixed block size. most_local: bytes of blocks a task remembers to drop repeats.
    """
    cut = written(pick(docs, doc_id="long", text="string").mapInArrow(_cut(block_bytes, most_local), _LOCAL), "blocks")
    ids = cut.where("kind = 0").select("row_id", "doc_id", "sha")
    longest = cut.where("kind = 0").agg(F.max(F.size("refs"))).first()[0] or 1
    open_rows, level, done = checkpointed(_named(cut)), 0, None
    while True:
        ended = open_rows.where(F.size("names") == 1).select("row_id", F.lit(level).alias("level"), F.col("names")[0].alias("name"))
        done = ended if done is None else done.unionByName(ended)
        if longest == 1:
            break
        rest = open_rows.where(F.size("names") > 1)
        open_rows = checkpointed(_named(written(rest.mapInArrow(_pair(most_local), _LOCAL), "pairs")))
        longest, level = (longest + 1) // 2, level + 1
    return ids.join(done, "row_id")


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, row_id.

    Of equal texts the row with the largest doc_id stays; if that doc_id repeats with an equal text,
    one of the repeats stays. A null doc_id ranks below all others. The result is a written table of one narrow row a document
    (see common.scratch). Options: see block_names().
    """
    with scratch(docs.sparkSession) as result:
        named = checkpointed(block_names(docs, **options))
        # Written, so that the join deals out both sides itself and can split the rows of a large group.
        best = checkpointed(named.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row_id")).alias("best"), F.count(F.lit(1)).alias("group_size")))
        met = named.join(best, ["level", "name"])
        return result(
            met.select(
                "doc_id",
                F.col("best.doc_id").alias("keep_id"),
                "group_size",
                (F.col("row_id") == F.col("best.row_id")).alias("kept"),
                F.col("sha").alias("text_sha256"),
                "row_id",
            )
        )
