"""Landing folder: new project manifests become rows of a projects table, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from furrow.schemas import PROJECT_XML, PROJECTS
from furrow.sources.manifests import typed_projects


def stream_projects(spark: SparkSession, landing: str, out: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None):
    """Start a query that takes all manifests that have arrived, appends those of projects not in the table yet, and ends.

    Run it again for later arrivals: the checkpoint remembers the files, and a replayed batch is dropped by the anti join, so no project
    comes twice. then: called with each batch's new projects, for the work on their mosaics.
    """
    raw = spark.readStream.format("xml").option("rowTag", "filename").schema(PROJECT_XML).load(landing)

    def take(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(["prj"])
        done = existing(spark, out)
        if done is not None:
            new = new.join(done.select("prj"), "prj", "left_anti")
        new = new.select([c.split()[0] for c in PROJECTS.split(", ")])
        new.write.mode("append").parquet(out)
        if then is not None:
            then(new)

    return typed_projects(raw).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, by Spark's own readers; None if there is no such path yet. A table that can't be read is an error."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(PROJECTS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
