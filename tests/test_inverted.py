"""The stored index against the scan, which reads all texts, and against plain Python."""

import math
import random
import re
import shutil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.operators import inverted, retrieval


def corpus_rows(n=400, seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(words[min(59, int(rng.expovariate(0.12)))] for _ in range(rng.randint(0, 40)))
    return [(i * 3, text()) for i in range(n)]


def plain_topk(rows, questions, k):
    tokens = {i: re.findall("[a-z0-9_]+", (t or "").lower()) for i, t in rows}
    n, mean = len(rows), sum(map(len, tokens.values())) / len(rows) or 1.0
    df = {}
    for t in tokens.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    out = []
    for q, text in questions:
        scores = {}
        for w in re.findall("[a-z0-9_]+", (text or "").lower()):
            for i, t in tokens.items():
                if tf := t.count(w):
                    scores[i] = scores.get(i, 0.0) + (floor if idf[w] < 0 else idf[w]) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean))
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]
        out += [(q, i, round(s, 6), r + 1) for r, (i, s) in enumerate(best)]
    return out


def close(found, wanted):
    found, wanted = sorted(map(tuple, found), key=lambda r: (r[0], r[3])), sorted(wanted, key=lambda r: (r[0], r[3]))
    assert [(r[0], r[1], r[3]) for r in found] == [(r[0], r[1], r[3]) for r in wanted]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(found, wanted, strict=True))


@pytest.mark.parametrize("span, k", [(16, 3), (64, 10), (1024, 500)])
def test_index_equals_plain_scores(spark, tmp_path, span, k):
    rows = [*corpus_rows(), (5, None), (7, ""), (8, "w1 W1 w1, w2!")]
    asked = [(1, "w0 w1 w1 nothing"), (2, "w40 w59"), (3, "unknown words"), (4, None), (5, " ".join(f"w{i}" for i in range(60)))]
    corpus = spark.createDataFrame(rows, "chunk_id long, content string")
    questions = spark.createDataFrame(asked, "query_id long, question string")
    index = inverted.build(corpus, str(tmp_path / "ix"), span)
    close(inverted.topk(index, questions, k).collect(), plain_topk(rows, asked, k))


def test_index_needs_no_texts_and_is_built_once(spark, tmp_path):
    at = str(tmp_path / "docs")
    spark.createDataFrame([(str(i), t) for i, t in corpus_rows(120)], "chunk_id string, content string").write.parquet(at)
    corpus = spark.read.parquet(at)
    questions = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(20)], "query_id int, question string")
    index = inverted.stored(corpus)
    want = sorted(map(tuple, retrieval.bm25_topk(corpus, questions, 5).collect()))
    assert inverted.stored(spark.read.parquet(at)) == index  # by the files' names, sizes and times
    assert inverted.stored(corpus.withColumn("content", F.upper("content"))).folder != index.folder
    plan = inverted.topk(index, questions, 5)
    shutil.rmtree(at)  # what a later question reads is the index alone
    assert sorted(map(tuple, plan.collect())) == want
    assert sorted(map(tuple, inverted.topk(inverted.opened(spark, index.folder), questions, 5).collect())) == want


def test_bounds_leave_ranges_out(spark, tmp_path, monkeypatch):
    """A rare word's chunk settles a question, so most ranges are not scored."""
    rows = [(i, "common words here") for i in range(600)] + [(1000, "needle common words here"), (1001, "needle")]
    index = inverted.build(spark.createDataFrame(rows, "chunk_id long, content string"), str(tmp_path / "ix"), 16)
    scored, cell = [], inverted._scored
    monkeypatch.setattr(inverted, "_scored", lambda i, b, w, pairs, s, k: scored.append(pairs.count()) or cell(i, b, w, pairs, s, k))
    out = inverted.topk(index, spark.createDataFrame([(1, "needle common")], "query_id long, question string"), 2).collect()
    assert [r.chunk_id for r in sorted(out, key=lambda r: r.rank)] == [1001, 1000] or [r.chunk_id for r in sorted(out, key=lambda r: r.rank)] == [1000, 1001]
    assert scored[0] == 2 and sum(scored) < 38 // 2


def test_questions_in_slices_and_tiles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "SLICE", 7)
    rows, asked = corpus_rows(90, 8), [(i, f"w{i % 50} w{i % 7} w{i % 3}") for i in range(50)]
    index = inverted.build(spark.createDataFrame(rows, "chunk_id long, content string"), str(tmp_path / "ix"), 32)
    close(inverted.topk(index, spark.createDataFrame(asked, "query_id long, question string"), 4).collect(), plain_topk(rows, asked, 4))


def test_empty_corpus_and_repeated_ids(spark, tmp_path):
    asked = spark.createDataFrame([(1, "one")], "query_id long, question string")
    none = inverted.build(spark.createDataFrame([], "chunk_id long, content string"), str(tmp_path / "none"))
    assert inverted.topk(none, asked, 3).collect() == []
    rows = spark.createDataFrame([(4, "one two"), (4, "one two"), (None, "one"), (5, "three four five"), (6, "six")], "chunk_id long, content string")
    index = inverted.build(rows, str(tmp_path / "twice"))
    assert sorted((r.chunk_id is None, r.chunk_id) for r in inverted.topk(index, asked, 9).collect()) == [(False, 4), (False, 4), (True, None)]


def test_words_are_counted_in_runs():
    words = [["a", "b", "a"], [], ["c"] * (1 << 17), ["a"], ["d"]]
    given = pa.RecordBatch.from_arrays([pa.array([10, 11, 12, 13, 14]), pa.array(words, pa.list_(pa.string()))], ["doc_no", "words"])
    found = list(inverted.counted(iter([given])))
    assert len(found) > 1
    rows = sorted(tuple(r.values()) for b in found for r in b.to_pylist())
    assert rows == [("a", 10, 2, 3), ("a", 13, 1, 1), ("b", 10, 1, 3), ("c", 12, 1 << 17, 1 << 17), ("d", 14, 1, 1)]


def shuffled(spark, run):
    """Records that the stages of ``run`` write to shuffles."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    none = jvm.java.util.ArrayList()

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(jvm.double, 0), none)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    last = max(stages(), default=-1)
    run()
    return sum(n for i, n in stages().items() if i > last)


def test_building_shuffles_neither_texts_nor_postings(spark, tmp_path):
    corpus = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 40}" for j in range(20))) for i in range(2000)], "chunk_id long, content string")
    parts = corpus.rdd.getNumPartitions()
    assert shuffled(spark, lambda: inverted.build(corpus, str(tmp_path / "ix"), 16)) < 40 * parts + 50  # counts of words, and no row a chunk


def test_only_blocks_of_the_words_asked_are_shuffled(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 400}" for j in range(20)) + (" needle" if i % 100 == 0 else "")) for i in range(2000)]
    index = inverted.build(spark.createDataFrame(rows, "chunk_id long, content string"), str(tmp_path / "ix"), 16)
    asked = [(i, "needle") for i in range(50)]
    questions = spark.createDataFrame(asked, "query_id long, question string")
    found = []
    assert shuffled(spark, lambda: found.extend(inverted.topk(index, questions, 3).collect())) < 5000
    close(found, plain_topk(rows, asked, 3))


def test_ties_across_and_within_ranges_go_to_smaller_ids(spark, tmp_path):
    rows = [(1000 - i, f"same {['a', 'b c'][i % 2]}") for i in range(300)]  # the largest ids come first
    index = inverted.build(spark.createDataFrame(rows, "chunk_id long, content string"), str(tmp_path / "ix"), 8)
    asked = [(1, "a"), (2, "same c")]
    close(inverted.topk(index, spark.createDataFrame(asked, "query_id long, question string"), 5).collect(), plain_topk(rows, asked, 5))


def test_claims_search_once(spark, monkeypatch):
    from siftwell.queries import evaluation

    calls, topk = [], inverted.topk
    monkeypatch.setattr(inverted, "topk", lambda *a: calls.append(1) or topk(*a))
    assert evaluation.claims(spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1
