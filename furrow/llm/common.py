"""Helpers shared by the training-data operators: shared folder, written tables, text buffers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this subpackage: maximal runs of bytes outside these six.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a new one only where unset, in local mode. On a cluster
    an unset folder is an error: tables in folders of single machines can't be read back."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="furrow-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of df: write it as Parquet in the shared folder, inside the scratch folder in use if there is one, and read it back."""
    spark = df.sparkSession
    return _written(df, f"{_scratch.get() or shared_dir(spark)}/furrow-{uuid.uuid4().hex}/{name}")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A written table for a step of a loop. Unlike a checkpoint, whose size Spark goes on estimating as a product over all joins before
    it, a table has its true size, so that plans stay small and well chosen however many rounds there are."""
    return written(df, "step")


@contextmanager
def scratch(spark: SparkSession):
    """A folder for the tables written inside the block, removed at its end. Yields a function that writes a result which stays; what
    leaves the block must have gone through it."""
    folder = f"{shared_dir(spark)}/furrow-{uuid.uuid4().hex}"
    outside = _scratch.get()
    token = _scratch.set(folder)
    try:
        yield lambda df, name="result": _written(df, f"{outside or shared_dir(spark)}/furrow-{uuid.uuid4().hex}/{name}")
    finally:
        _scratch.reset(token)
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder with all in it, in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast to the given types: extra columns with clashing names do no harm."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()])


def text_slices(column: pa.Array, most: int = 1 << 20):
    """Cut an Arrow string column into (first row, last row) slices of about `most` bytes of text."""
    offsets = text_offsets(column)
    first, n = 0, len(column)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def text_offsets(column: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> np.ndarray:
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)


def as_text(column: pa.Array) -> pa.Array:
    """A string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def binary16(rows: np.ndarray) -> pa.Array:
    """An Arrow binary column of 16-byte values from an (n, 2) uint64 array."""
    data = np.ascontiguousarray(rows, dtype=np.uint64)
    offsets = (np.arange(len(data) + 1, dtype=np.int64) * 16).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def from_binary16(column: pa.Array) -> np.ndarray:
    """(n, 2) uint64 from a binary column of 16-byte values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.empty((0, 2), dtype=np.uint64)
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    first = int(np.frombuffer(column.buffers()[1], dtype=width)[column.offset])
    return np.frombuffer(column.buffers()[2], dtype=np.uint64, count=2 * n, offset=first).reshape(n, 2)
