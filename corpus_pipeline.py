"""A corpus pipeline of five stages over `documents`: rules, exact dedup, near-duplicate join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import scratch
from furrow.llm.dedup import exact_dedup
from furrow.llm.jaccard import jaccard_classes
from furrow.llm.mixing import curriculum_mix, in_order, text_md5
from furrow.llm.packing import harmonic_pack
from furrow.llm.quality import quality_rules
from furrow.llm.queries import tokenizer_files
from furrow.llm.urlgraph import LOWER, UPPER

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null text has no words and goes; other nulls, repeated rows and extra columns make no difference; no rows give none."""
    return quality_rules(docs).where("kept").select(*COLUMNS)


def _single(docs: DataFrame, key: Column) -> DataFrame:
    """p_key and the columns of docs, one row a key; rows with one key are repeats of each other in doc_id and text. Repeats meet in their own tasks first, so that
    of a page with very many of them one row a task moves."""
    least = F.min(F.struct("source", "lang", "n_chars", "doc_id", "text")).alias("p_row")
    return docs.withColumn("p_key", key).groupBy("p_key").agg(least).select("p_key", *[F.col(f"p_row.{c}").alias(c) for c in COLUMNS])


def _once(docs: DataFrame, key: Column, stay: DataFrame) -> DataFrame:
    """One row of docs for each key in stay (key), a table of different keys."""
    return _single(docs, key).join(stay.select(F.col("key").alias("p_key")), "p_key", "left_semi").select(*COLUMNS)


def _with_id(sha: Column) -> Column:
    """A digest of a text and its row's doc_id in one key that is never null."""
    return F.concat_ws(":", sha, F.col("doc_id").cast("string"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: one with the largest doc_id; null ranks below all others."""
    stay = exact_dedup(docs).where("kept").select(_with_id(F.col("text_sha256")).alias("key"))
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).cast("binary")
    return _once(docs, _with_id(F.sha2(low, 256)), stay)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of links: one with the smallest doc_id; null ranks above all others. The join names rows by a
    128-bit digest of doc_id and text, as a doc_id may be null or repeat with another text."""
    key = F.unhex(F.md5(_with_id(F.md5(F.coalesce("text", F.lit("")).cast("binary")))))
    classes = jaccard_classes(docs.select(key.alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), F.col("component_id").alias("of"))
    ids = docs.select(key.alias("row_key"), "doc_id").distinct()
    met = classes.join(ids, F.col("key") == F.col("row_key"))
    best = met.groupBy("of").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("x"))
    return _once(docs, key, best.select("x.key"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, in order of training position; a document that the mix takes in
    part ends after the last word taken. The plan is made without texts, which join it by doc_id, source and MD5; rows alike in these
    are repeats: one of them stands for all, once for each time that the plan takes any. Null ids, sources and texts match theirs; a text
    without words is not taken. No rows give no rows."""
    named = F.md5(F.to_json(F.struct("doc_id", "source", "text_md5"), {"ignoreNullFields": "false"}))
    plan = curriculum_mix(docs).select(named.alias("key"), "size", F.explode("epochs").alias("e"))
    keyed = docs.withColumn("text_md5", text_md5(F.col("text")))
    taken = _single(keyed, named).join(plan, F.col("p_key") == F.col("key"))
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    part = F.array_join(F.slice(pieces, F.lit(1), F.col("e.words").cast("int")), "")
    whole = F.col("e.words") >= F.col("size")
    out = taken.select(
        "doc_id",
        F.when(whole, F.col("text")).otherwise(part).alias("text"),
        "lang",
        "source",
        F.when(whole, F.col("n_chars")).otherwise(F.char_length(part).cast("long")).alias("n_chars"),
        F.col("e.position").alias("position"),
        F.col("e.demand").alias("demand"),
    )
    return in_order(out, F.col("demand"), "position", "doc_id").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens. A null or empty text is its end token alone; a very long one is many pieces; repeated
    rows and rows without an id are packed each; no rows give none."""
    return harmonic_pack(docs, **tokenizer_files())


STAGES = [
    ("quality rules", quality),
    ("exact dedup", dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: SQL can't express the last stage's token ids; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: the rows of the last one. No documents give no rows."""
    return _after(len(STAGES), spark, sf_dir)


def _after(n: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows after n stages, written. The table of the stage before goes with the scratch folder when they are."""
    if not n:
        return spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as result:
        return result(STAGES[n - 1][1](spark, _after(n - 1, spark, sf_dir), sf_dir))
