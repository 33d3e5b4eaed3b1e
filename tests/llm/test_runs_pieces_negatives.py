"""Periodic runs, pieces and hard negatives: brute force, the library itself, edge cases."""

import hashlib
import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from furrow.llm import negatives, pieces
from furrow.llm.negatives import hard_negatives
from furrow.llm.periodic import _runs_of, periodic_runs, planted_periods
from furrow.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


# Periodic runs


def naive_runs(words, least=12):
    """(start, length, period): for each period in turn the stretches of places that agree with the place one period on."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                found.setdefault((start, i - start + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def naive_planted(doc_id, text):
    words = text.encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(text.encode().split())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_of_random_texts():
    r = random.Random(5)
    for _ in range(60):
        texts = []
        for _ in range(r.randint(1, 10)):
            n, letters = r.randint(0, 90), r.choice([1, 2, 3, 20])
            words = [str(r.randrange(letters)) for _ in range(n)]
            if n and r.random() < 0.5:
                a = r.randrange(n)
                p = 1 + (n - a) // r.randint(3, 10)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(words)
        got, rest = _runs_of([" ".join(w).encode() for w in texts], 12)
        for words, runs, left in zip(texts, got, rest):
            want = naive_runs(words)
            assert [(x["start"], x["length"], x["period"]) for x in runs] == want
            drop = {i for s, n, q in want for i in range(s + q, s + n)}
            assert left.decode().split() == [w for i, w in enumerate(words) if i not in drop]


def test_runs_of_long_and_hostile_texts():
    start = time.time()
    assert _runs_of([b"a b " * 200_000], 12)[0] == [[{"start": 0, "length": 400_000, "period": 2}]]
    fib = ["a", "ab"]
    while len(fib[-1]) < 50_000:
        fib.append(fib[-1] + fib[-2])
    assert len(_runs_of([" ".join(fib[-1]).encode()], 12)[0][0]) > 10_000
    many = " ".join(str(i * i % 99_991) for i in range(300_000)).encode()
    assert [r["period"] for r in _runs_of([many], 12)[0][0]] == [99_991]
    assert time.time() - start < 30


def test_runs_query(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows, some = QUERIES["op13_name_levels"](spark, sf).collect(), 0
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        words = [w.decode() for w in naive_planted(r["doc_id"], docs[r["doc_id"]])]
        if len(words) > 3000:
            continue
        want = naive_runs(words)
        some += bool(want)
        assert r["n_runs"] == len(want) and r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in want))
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        drop = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r["collapsed_sha256"] == sha(" ".join(w for i, w in enumerate(words) if i not in drop))
    assert some > 10


def test_runs_edges(spark):
    text = " ".join("x y z".split() * 5)
    table = [(1, None, "a"), (None, "", "b"), (2, " \t\n ", "c"), (3, text, "d"), (3, text, "d"), (4, "q " * 11, "e"), (5, "q " * 12, "f"), (6, "Q q " * 6 + " ", "g")]
    docs = spark.createDataFrame(table, "doc_id long, text string, runs string")
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(docs).collect()), key=repr)
    want = [(1, [], ""), (None, [], ""), (2, [], ""), (3, [(0, 15, 3)], "x y z"), (3, [(0, 15, 3)], "x y z"), (4, [], "q " * 10 + "q"), (5, [(0, 12, 1)], "q"), (6, [(0, 12, 2)], "Q q  ")]
    assert got == sorted(want, key=repr)
    assert periodic_runs(docs.limit(0)).collect() == []
    same = docs.select(planted_periods(F.lit(None).cast("long"), F.col("text")).alias("t"), "text").collect()
    assert all(r["t"] == r["text"] for r in same)


# Pieces


def test_pieces_equal_the_library(spark, sf):
    processor, apart = pieces.load(MODEL)
    assert apart
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op11_chunk_table"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        ids = processor.encode(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(processor.decode(ids)))


def test_pieces_of_odd_texts():
    processor, _ = pieces.load(MODEL)
    table, r = pieces.ChunkTable(processor, 50), random.Random(3)
    odd = ["", " ", "  ", "a ", " a", "  a  b  ", "▁", "a▁b", "▁▁ a", "\n", "a\nb \n c", "\x00", "日本語 テスト", "😀 😀😀", "<s> </s> <unk> <0x0A>", "x y", "é", "﻿", "a" * 5000, "▁" * 40, " " * 99 + "a", "� a"]
    letters = "ab ▁\n\té日😀<>/s0x  .'the ing  "
    lots = [odd] + [["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(10)] for _ in range(100)]
    for texts in lots:  # the table is begun anew again and again
        ids, at, decoded = table.join(texts)
        for i, text in enumerate(texts):
            want = processor.encode(text)
            assert ids[at[i] : at[i + 1]].tolist() == want and decoded[i] == processor.decode(want)


def test_pieces_edges(spark, monkeypatch):
    docs = spark.createDataFrame([(1, None, 7), (None, "", 8), (2, "to be  or", 9), (2, "to be  or", 9)], "doc_id long, text string, ids int")
    processor, _ = pieces.load(MODEL)
    ids = processor.encode("to be  or")
    got = sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in pieces.encode_pieces(docs, MODEL).collect()), key=repr)
    assert got == sorted([(1, [], ""), (None, [], ""), (2, ids, "to be  or"), (2, ids, "to be  or")], key=repr)
    assert pieces.encode_pieces(docs.limit(0), MODEL).collect() == []


def test_models_whose_chunks_do_not_stand_apart():
    from sentencepiece import sentencepiece_model_pb2 as pb

    processor, _ = pieces.load(MODEL)
    for change in ("crossing", "charsmap", "own symbol"):
        model = pb.ModelProto()
        model.ParseFromString(processor.serialized_model_proto())
        if change == "crossing":
            model.pieces[-1].piece = "of▁the"
        elif change == "charsmap":
            model.normalizer_spec.precompiled_charsmap = b"x"
        else:
            model.pieces[-1].type = 4
        assert not pieces.stand_apart(model)


# Hard negatives


def naive_negatives(rows, every=100, k=5, percent=80, scale=256):
    """All products, in Python integers."""
    rows = {(i, y, tuple(math.floor(scale * x) for x in v)) for i, y, v in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, y, v in rows:
        if i % every:
            continue
        scored = sorted({(-sum(a * b for a, b in zip(v, w)), j, z == y) for j, z, w in rows})
        positives = sorted({(s, j) for s, j, same in scored if same and j != i})[:k]
        for s, j in positives:
            inside = sorted({(t, n) for t, n, same in scored if not same and percent * -s <= 100 * -t <= 100 * -s})[:k]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(inside, 1)]
    return sorted(out)


def random_vectors(n, dim, seed, labels=4):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.3) for _ in range(dim)] for _ in range(3)]
    return [(i, r.choice(range(labels)), [r.choice(centres)[d] + r.gauss(0, 0.1) for d in range(dim)]) for i in range(n)]


SCHEMA = "vec_id long, label int, vector array<float>, extra string"


@pytest.mark.parametrize("sizes", [{}, {"rows_in_block": 7, "anchors_in_block": 3}, {"rows_in_block": 16, "anchors_in_block": 2, "most_broadcast": 0}])
def test_negatives_equal_all_products(spark, sizes):
    f = lambda v: [float(np.float32(x)) for x in v]
    table = [(i, y, f(v)) for i, y, v in random_vectors(300, 9, 1)]
    table += table[:40] * 3 + [(100, 1, f([0.5] * 9)), (200, 2, table[200][2]), (901, 1, [0.0] * 9), (902, 1, [0.0] * 9)]  # repeats, one id with two rows, ties
    table += [(903, 0, []), (904, 1, f([0.4, 0.3])), (905, 2, f([0.3] * 12)), (1000, 3, f([0.3] * 12))]  # other lengths
    table += [(906, None, [1.0] * 9), (907, 1, None), (None, 1, [1.0] * 9), (908, 1, [1.0, float("nan")]), (909, 1, [float("inf")]), (910, 1, [None, 1.0])]
    got = hard_negatives(spark.createDataFrame([(*t, "x") for t in table], SCHEMA).repartition(3), anchor_every=20, **sizes).collect()
    want = naive_negatives(table, 20)
    assert len(want) > 100 and sorted(map(tuple, got)) == want


def test_negatives_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(empty).collect() == []
    assert hard_negatives(spark.createDataFrame([(0, 1, [1.0], ""), (1, 1, [1.0], "")], SCHEMA)).collect() == []  # no other label
    zero = [(0, 1, [0.0]), (1, 1, [0.0]), (3, 2, [0.0]), (2, 2, [0.0])]
    assert sorted(map(tuple, hard_negatives(spark.createDataFrame([(*t, "") for t in zero], SCHEMA)).collect())) == [(0, 1, 1, 2, 0, 0), (0, 1, 2, 3, 0, 0)]
    below = [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-1.0]), (3, 2, [-0.9])]  # a positive below zero has an empty window, but for its own score
    assert sorted(map(tuple, hard_negatives(spark.createDataFrame([(*t, "") for t in below], SCHEMA)).collect())) == naive_negatives(below)


def test_planes_and_large_components():
    r = np.random.Generator(np.random.PCG64(1))
    for most in (1, 7, 300, 2**20, 2**30):
        rows, anchors = r.integers(-most, most, (50, 6)), r.integers(-most, most, (4, 6))
        assert (sum(w * p.astype(np.int64) for w, p in negatives.planes_of(rows)) == rows).all()
        product = anchors @ rows.T
        i, j, s = negatives.surviving(anchors, rows, np.ones((4, 50), bool), lambda lo, hi, o: negatives._positives_left(lo, hi, o, np.full(4, -np.inf), 3))
        assert (product[i, j] == s).all()
        best = np.argsort(-product, axis=1, kind="stable")[:, :3]
        assert all((a, b) in set(zip(i.tolist(), j.tolist())) for a in range(4) for b in best[a].tolist())
    few, _, _ = negatives.surviving(r.integers(-99, 99, (4, 64)), r.integers(-99, 99, (4000, 64)), np.ones((4, 4000), bool), lambda lo, hi, o: negatives._positives_left(lo, hi, o, np.full(4, -np.inf), 3))
    assert len(few) < 1000  # most pairs are dropped before the last plane
