"""Retrieval kernels, passages and numbering against plain versions, over one and several partitions and blocks."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftwell.operators import evalset as E
from siftwell.operators import retrieval as R
from siftwell.operators.order import numbered


def top(scores, k):
    return [(c, s, i + 1) for i, (c, s) in enumerate(sorted(scores, key=lambda x: (-x[1], x[0]))[:k])]


def by_question(rows):
    out = {}
    for r in rows.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, r.score, r.rank))
    return out


@pytest.mark.parametrize("partitions, block", [(1, 100), (5, 2)])
def test_dense_top_k(spark, monkeypatch, partitions, block):
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(R._blocks, "__defaults__", (block,))
    rng = random.Random(3)
    grid = [[x / 4, y / 4, z / 4] for x in range(3) for y in range(3) for z in range(3)]  # many ties
    rows = [(f"c{i:03}", rng.choice(grid)) for i in range(120)] + [("n1", None), ("n2", [1.0, None, 0.0]), ("n3", [1.0, 0.0]), ("n4", [])]
    asked = [(q, [rng.random() for _ in range(3)]) for q in range(7)] + [(7, None), (8, [0.0, 1.0])]
    corpus = spark.createDataFrame(rows, "chunk_id string, vector array<double>").repartition(partitions)
    found = by_question(R.vector_topk(corpus, spark.createDataFrame(asked, "query_id long, vector array<double>"), 9))
    want = {}
    for q, v in asked:
        scores = [(c, round(sum(a * b for a, b in zip(v, w)), 6)) for c, w in rows if v and w and None not in w and len(w) == len(v)]
        if scores:
            want[q] = top(scores, 9)
    assert found == want


def bm25(rows, question, k, filled):
    tok = lambda t: re.findall("[a-z0-9_]+", (t or "").lower())
    docs = {i: Counter(tok(t)) for i, t in rows}
    n, mean = len(docs), sum(sum(d.values()) for d in docs.values()) / len(docs)
    df = Counter(w for d in docs.values() for w in d)
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: low if x < 0 else x for w, x in idf.items()}
    out = []
    for i, d in docs.items():
        some = [w for w in tok(question) if w in d]
        if some or filled:
            out.append((i, round(sum(idf[w] * d[w] * 2.5 / (d[w] + 1.5 * (0.25 + 0.75 * sum(d.values()) / mean)) for w in some), 6)))
    return top(out, k)


@pytest.mark.parametrize("filled", [False, True])
@pytest.mark.parametrize("partitions, block", [(1, 100), (4, 2)])
def test_bm25_top_k(spark, monkeypatch, partitions, block, filled):
    monkeypatch.setattr(R._blocks, "__defaults__", (block,))
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["the"] * 20
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(80)] + [(80, None), (81, ""), (82, "W1, w1; The!")]
    asked = [(1, "the w1 w1 w2"), (2, "w3"), (3, "absent words"), (4, ""), (5, None), (6, "the the")]
    found = by_question(R.bm25_topk(spark.createDataFrame(rows, "chunk_id long, content string").repartition(partitions), spark.createDataFrame(asked, "query_id long, question string"), 10, filled))
    want = {q: t for q, text in asked if (t := bm25(rows, text, 10, filled))}
    assert {q: [(c, pytest.approx(s, abs=2e-6), r) for c, s, r in t] for q, t in want.items()} == found


def test_empty_sides(spark):
    corpus, none = spark.createDataFrame([(1, "a b", [1.0])], "chunk_id long, content string, vector array<double>"), spark.createDataFrame([], "query_id long, question string, vector array<double>")
    assert R.bm25_topk(corpus, none, 3).count() == 0 and R.vector_topk(corpus, none, 3).count() == 0
    asked = spark.createDataFrame([(1, "a", [1.0])], "query_id long, question string, vector array<double>")
    assert R.bm25_topk(corpus.limit(0), asked, 3).count() == 0 and R.vector_topk(corpus.limit(0), asked, 3).count() == 0


def test_holders_of_passages(spark):
    rng = random.Random(2)
    words = ["alpha", "be", "gamma-ray", "Delta", "x1", "été", "e.g."]
    docs = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(60)] + [(60, None), (61, "")]
    passages = [(q, d[s : s + rng.randrange(3, 40)]) for q in range(40) for d in [docs[q][1]] for s in [rng.randrange(100)]] + [(90, "alpha"), (91, None), (92, "not in any of them at all")]
    found = {tuple(r) for r in E.holders(spark.createDataFrame(passages, "query_id long, passage string"), spark.createDataFrame(docs, "chunk_id long, content string")).collect()}
    assert found == {(q, i) for q, p in passages for i, t in docs if p is not None and t is not None and p in t}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_numbers_in_order(spark, kind):
    keys = random.Random(1).sample(range(-(10**6), 10**6), 5000) + [None]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select(F.col("k").cast(kind).alias("k")).repartition(7)
    out = {r.k: r["at"] for r in numbered(df, "k", parts=20).collect()}
    order = sorted((k if kind == "long" else str(k) for k in keys if k is not None))
    assert out == {None: 0} | {k: i + 1 for i, k in enumerate(order)}
    assert numbered(df.limit(0), "k").count() == 0
    assert [r.k for r in E.systematic_sample(df.filter("k is not null"), 10, "k").collect()] == order[::500][:10]


def test_a_grid_of_questions_and_chunks(spark, monkeypatch):
    """More questions than a block, in slices and cells, give what one block gives; both sides may come from one table."""
    import random

    from siftwell.operators import retrieval

    rng = random.Random(6)
    rows = [(i, [round(rng.gauss(0, 1), 2) for _ in range(4)]) for i in range(150)] + [(500, None), (501, [1.0]), (502, [1.0, None, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    chunks, asked = vectors.withColumnRenamed("id", "chunk_id"), vectors.selectExpr("id as query_id", "vector")
    want = sorted(map(tuple, retrieval.vector_topk(chunks, asked, 4).collect()))
    monkeypatch.setattr(retrieval, "BLOCK", 40)
    monkeypatch.setattr(retrieval, "CELL", 30)
    assert sorted(map(tuple, retrieval.vector_topk(chunks, asked, 4).collect())) == want
    monkeypatch.setattr(retrieval, "BLOCK", 4096)
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 1500)
    assert sorted(map(tuple, retrieval.vector_topk(chunks, asked, 4).collect())) == want
    assert len(want) == 151 * 4 - 3


def test_holders_of_short_and_long_passages(spark):
    from siftwell.operators import evalset

    texts = [(1, "the concatenated cat sat, on a mat"), (2, "A cat sat"), (3, None), (4, ""), (5, "mat! no cat sat on here; ÉTÉ là"), (6, "the the the")]
    asked = [(1, "cat"), (2, "cat"), (3, "cat sat"), (4, "cat sat, on"), (5, ""), (6, None), (7, "!"), (8, "ÉTÉ"), (9, "the the"), (10, "cat sat on"), (11, "at sat on he")]
    found = evalset.holders(spark.createDataFrame(asked, "query_id long, passage string"), spark.createDataFrame(texts, "chunk_id long, content string")).collect()
    assert sorted(map(tuple, found)) == sorted((q, i) for q, p in asked for i, t in texts if p and t and p in t)


def test_holders_by_words_and_by_automaton(spark, monkeypatch):
    """Passages within PASSAGE_BYTES are found without a shuffle of words or texts; the form for more of them gives the same rows."""
    from tests.test_inverted import shuffled

    texts = [(i, " ".join(f"w{(i * 7 + j) % 50} é{j}" for j in range(20))) for i in range(300)] + [(300, None), (301, "")]
    asked = [(q, texts[q * 3][1][q : q + 30]) for q in range(40)] + [(50, "w1"), (51, ""), (52, None), (53, texts[0][1][:30])]
    corpus = spark.createDataFrame(texts, "chunk_id long, content string").unionByName(spark.sql("select 400L as chunk_id, cast(unhex('C3286120622063C3') as string) as content"))
    passages = spark.createDataFrame(asked, "query_id long, passage string").unionByName(spark.sql("select 60L as query_id, cast(unhex('6120622063') as string) as passage"))
    want = sorted([(q, i) for q, p in asked for i, t in texts if p and t and p in t] + [(60, 400)])
    found = []
    assert shuffled(spark, lambda: found.extend(map(tuple, E.holders(passages, corpus).collect()))) <= len(want) + 50
    assert sorted(found) == want
    monkeypatch.setattr(E, "PASSAGE_BYTES", 64)
    assert sorted(map(tuple, E.holders(passages, corpus).collect())) == want


def test_numbers_and_samples_by_group(spark):
    from siftwell.operators import evalset, order

    rows = [("hot", i * 7 % 501) for i in range(501)] + [("small", i) for i in range(3)] + [(None, 1), (None, 0)]
    df = spark.createDataFrame(rows, "g string, k long").repartition(3)
    got = {(r.g, r.k): (r["at"], r["size"]) for r in order.numbered_by(df, "g", "k", parts=8).collect()}
    for g in ("hot", "small", None):
        keys = sorted(k for x, k in rows if x == g)
        assert [got[g, k] for k in keys] == [(i, len(keys)) for i in range(len(keys))]
    picked = evalset.systematic_sample_by(df.filter("g is not null"), 10, "g", "k").collect()
    assert sorted(r.k for r in picked if r.g == "hot") == list(range(0, 500, 50)) and sum(r.g == "small" for r in picked) == 3
