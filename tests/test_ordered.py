"""Folds over sorted ranges equal the plain folds, with keys of very different sizes and values at every kind of gap."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import lines, ordered


def plain_spans(values, span=1.3):
    out, first, last = [], None, None
    for v in sorted(values):
        if first is None or not v - first <= span:
            if last is not None:
                out.append(last)
            first = v
        last = v
    return out + [last]


def table(seed):
    rng = np.random.default_rng(seed)
    keys = {"dense": np.round(rng.uniform(0, 60, 900), 3), "rows": np.round(np.repeat(np.arange(40) * 2.0, 5) + rng.uniform(0, 0.1, 200), 4), "one": np.array([5.0]), "tenths": np.arange(0, 400) / 10, "far": np.array([1.0, 50.0, 51.3, 52.7, -3.0])}
    return {k: sorted(set(v.tolist())) for k, v in keys.items()}


@pytest.mark.parametrize("parts", [2, 11])
def test_folds_equal_the_plain_ones(spark, parts):
    have = table(parts)
    df = spark.createDataFrame([(k, v) for k, vs in have.items() for v in vs], "k string, d double")
    dealt = ordered.order_values(df, "k", parts=parts)
    assert dealt.select("part").distinct().count() == parts
    before = {(r["k"], r["d"]): r["before"] for r in ordered.with_before(dealt, "k").collect()}
    assert before == {(k, v): (vs[i - 1] if i else None) for k, vs in have.items() for i, v in enumerate(vs)}
    got = {}
    for r in ordered.span_groups(dealt, "k", parts=parts).collect():
        got.setdefault(r["k"], []).append((r["grp"], r["d"]))
    assert {k: [d for _, d in sorted(v)] for k, v in got.items()} == {k: plain_spans(vs) for k, vs in have.items()}
    assert all(sorted(g for g, _ in v) == list(range(len(v))) for v in got.values())
    kept = ordered.numbered(ordered.gap_filter(dealt, "k", gap=0.4), "k")
    want = lines.number_lines(lines.gap_filter(df, "k", gap=0.4), "k")
    assert sorted(map(tuple, kept.select("k", "d", "id").collect())) == sorted(map(tuple, want.select("k", "d", "id").collect()))


def test_a_very_large_field_is_spread(spark):
    n = 400_000
    df = spark.range(n).select(F.lit("f").alias("k"), (F.col("id") * 0.01).alias("d"))
    dealt = ordered.order_values(df, "k", parts=16)
    assert max(r["count"] for r in dealt.groupBy("part").count().collect()) < n / 8
    spans = ordered.span_groups(dealt, "k", parts=16)
    first, count = spans.agg(F.min("d"), F.count("d")).first()
    want = plain_spans((np.arange(n) * 0.01).tolist())
    assert count == len(want) and first == want[0] and spans.agg(F.sum("d")).first()[0] == pytest.approx(sum(want))


def test_rows_of_large_fields_equal_those_of_small_ones(spark):
    from furrow.operators import rows
    from furrow.params import Params

    data = [(k, i, v) for k, vs in table(7).items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(data, "k string, idx long, d double")
    small, large = Params(), Params(fold_values=10)
    for f in (rows.statistical_rows, rows.result_counts):
        assert sorted(map(tuple, f(df, "k", p=small).collect())) == sorted(map(tuple, f(df, "k", p=large).collect()))


def test_no_values_and_null_values(spark):
    none = spark.createDataFrame([], "k string, d double")
    assert ordered.span_groups(ordered.order_values(none, "k"), "k").count() == 0
    assert ordered.numbered(ordered.gap_filter(ordered.order_values(none, "k"), "k"), "k").count() == 0
