"""Each stage of the pipeline against brute force on the smallest tables, and every query of the operators against its SQL."""

import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from furrow.llm.common import written
from furrow.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_operators import brute_components
from tests.test_queries import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, con, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(con.execute(ORACLE_SQL[name]).fetchdf())


def test_stages(spark, sf, con):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), "stage")
        out.append([r.asDict() for r in docs.collect()])
    assert all(set(r) == set(corpus_pipeline.COLUMNS) for rows_ in out[:4] for r in rows_[:1])
    good, unique, different, mixed, packed = out
    assert {r["doc_id"] for r in good} == {i for (i,) in con.execute(f"SELECT doc_id FROM ({ORACLE_SQL['op4_divergence_rules']}) WHERE kept").fetchall()}
    low = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t)
    last = {}
    for r in sorted(good, key=lambda r: r["doc_id"]):
        last[low(r["text"])] = r["doc_id"]
    assert sorted(r["doc_id"] for r in unique) == sorted(last.values())
    assert sorted(r["doc_id"] for r in different) == sorted({c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in unique])})
    whole = {r["doc_id"]: r for r in different}
    times, taken = Counter(r["doc_id"] for r in mixed), Counter()
    for r in mixed:
        taken[r["source"]] += len(WORD.findall(r["text"]))
        assert whole[r["doc_id"]]["text"].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    size = Counter()
    for r in different:
        size[r["source"]] += len(WORD.findall(r["text"]))
    assert max(times.values()) <= 2 and all(n <= 2 * size[s] for s, n in taken.items()) and abs(sum(taken.values()) - 1.5 * sum(size.values())) <= len(size)
    assert sum(r["start"] == 0 for r in packed) == len(mixed) and {r["doc_id"] for r in packed} == set(times)
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append(r)
    assert all(sum(r["length"] for r in s) == max(r["offset"] + r["length"] for r in s) <= 2048 for s in by.values())


def test_stages_with_repeated_rows_and_null_ids(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(20))
    near = text("n") + " end"
    rows_ = [(1, text("a")), (1, text("a")), (1, text("A").lower()), (2, text("a").upper()), (None, text("a"))]  # one text
    rows_ += [(None, text("b")), (None, text("b")), (None, text("c")), (5, text("d")), (5, text("e")), (5, text("e"))]  # b, c, d, e
    rows_ += [(7, text("n")), (8, near), (8, near), (None, near + " x"), (None, text("g")), (None, text("g") + " y"), (None, None), (9, "")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows_], "doc_id long, text string, lang string, source string, n_chars long")
    order = lambda got: sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    unique = order(corpus_pipeline.dedup(spark, frame, ""))
    assert unique == sorted([(2, text("a").upper()), (None, text("b")), (None, text("c")), (5, text("d")), (5, text("e")), (7, text("n")), (8, near), (None, near + " x"), (None, text("g")), (None, text("g") + " y"), (9, "")], key=repr)
    words = frame.where("text <> ''")
    different = order(corpus_pipeline.near_dedup(spark, words, ""))
    assert [r for r in different if (r[1] or "")[:1] != "g"] == sorted([(1, text("a")), (None, text("b")), (None, text("c")), (5, text("d")), (5, text("e")), (7, text("n"))], key=repr)
    assert len([r for r in different if r[1][:1] == "g"]) == 1
    mixed = corpus_pipeline.mix(spark, words, "").collect()
    size = sum(len(t.split()) for _, t in rows_ if t)
    assert abs(sum(len(r["text"].split()) for r in mixed) - 1.5 * size) <= 1
    times = Counter((r["doc_id"], r["text"].split()[0]) for r in mixed)
    assert times[(1, "aw0")] <= 6 and times[(None, "bw0")] <= 4 and all(n >= 1 for n in times.values()) and len(times) == len({(i, t.split()[0]) for i, t in rows_ if t})


def test_stages_with_empty_tables_long_texts_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = {"p_key": F.lit("x"), "p_row": F.lit(1), "key": F.lit("k"), "kept": F.lit(True), "e": F.lit(0), "position": F.lit(0.5), "label": F.lit(1), "of": F.lit(2)}
    long = " ".join(f"w{i % 977} and then {i}" for i in range(60_000))
    plain = " ".join(f"the word {i} of the text and {i}" for i in range(12))
    frame = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, plain, None, None, None), (None, None, None, None, None), (3, "", "de", "t", 0)], schema).withColumns(clash)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), "").collect() == [], name
        kept = stage(spark, frame, "").collect()
        assert {1, 2} <= {r["doc_id"] for r in kept}, name
        if name == "packing":
            assert sum(r["length"] for r in kept if r["doc_id"] == 1) == next(r["doc_tokens"] for r in kept if r["doc_id"] == 1) > 100_000
            assert len([r for r in kept if r["doc_id"] is None]) == 1


def test_repeats_of_one_page_meet_before_they_move(spark):
    page = "word " * 500
    frame = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(page).alias("text"), F.lit("en").alias("lang"), (F.col("id") % 3).cast("string").alias("source"), F.lit(2500).cast("long").alias("n_chars"))
    assert [r["source"] for r in corpus_pipeline.dedup(spark, frame, "").collect()] == ["0"]
    plan = corpus_pipeline._single(frame, F.md5("text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min") > plan.index("Exchange")  # printed from the top: the partial minimum lies below the shuffle
