"""Published arithmetic, edge cases and invariants."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators import evalset as E
from siftwell.operators import metrics as M
from siftwell.operators import retrieval as R


def pairs(spark, rows):
    return spark.createDataFrame(rows, "id long, gold_hit boolean, base_score double, rag_score double, preferred string, base_correct boolean, rag_correct boolean")


def test_dead_zone_and_nulls(spark):
    d = [-5.1, -5.0, 0.0, 5.0, 5.1]
    rows = pairs(spark, [(i, True, 10.0, 10.0 + x, "rag", True, False) for i, x in enumerate(d)] + [(9, False, None, 1.0, "tie", None, None)])
    r = M.win_tie_loss(rows).first()
    assert (r.n, r.wins, r.ties, r.losses) == (5, 1, 3, 1)
    s = M.ablation_summary(rows).first()
    assert (s.n, s.n_invalid, s.rag_wins + s.ties + s.rag_losses) == (5, 1, 5)
    assert [x.gold_hit for x in M.lift_conditioned(rows).collect()] == [True]


def test_no_rows_give_nulls(spark):
    rows = pairs(spark, [])
    s = M.ablation_summary(rows).first()
    assert s.n == 0 and s.mean_lift is None and s.rag_correct_rate is None
    c = M.claim_coverage(spark.createDataFrame([], "in_corpus boolean, best_vrank int")).first()
    assert c.n == 0 and c.coverage_at_1 is None
    assert M.coverage_summary(spark.createDataFrame([], "covered boolean, gold_hit boolean")).first().coverage is None
    b = M.bootstrap_ci(M.valid_pairs(rows)).first()
    assert (b.n, b.low) == (0, None)


def test_draws_by_hash_are_not_shuffled(spark, monkeypatch):
    rows = spark.range(300).select("id", (F.col("id") % 7 - 3).cast("double").alias("diff"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = M.bootstrap_ci_hash(rows, iters=40)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(M, "DRAWN_BYTES", 0)
        assert found.collect() == M.bootstrap_ci_hash(rows, iters=40).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_claim_coverage_is_monotone(spark):
    rows = spark.createDataFrame([(True, 0), (True, 4), (True, 5), (True, None), (False, None), (True, 19)], "in_corpus boolean, best_vrank int")
    r = M.claim_coverage(rows).first()
    assert r.coverage_at_1 <= r.coverage_at_3 <= r.coverage_at_5 <= r.coverage_at_10 <= r.in_corpus_rate
    assert (r.coverage_at_5, r.in_corpus_rate, r.corpus_gap_rate, r.present_but_ranked_below5) == (0.333, 0.833, 0.167, 0.5)


def test_exact_bootstrap_equals_a_plain_one(spark):
    d = [float((i * 37) % 23 - 9) for i in range(20)]
    rows = spark.createDataFrame([("t", i, x) for i, x in enumerate(d)], "tool string, id long, diff double")
    rng = random.Random(0)
    means = sorted(sum(rng.choice(d) for _ in d) / len(d) for _ in range(2000))
    r = M.bootstrap_ci_exact(rows, "tool").first()
    assert (r.n, r.low, r.high) == (20, means[50], means[1950])


def test_zero_mean_ranks_first_and_null_last(spark):
    rows = spark.createDataFrame([("x", True, 0.0), ("y", True, None), ("z", True, 26.2)], "candidate string, docs_answerable boolean, base_score double")
    assert [r.candidate for r in E.selection_rank(rows).orderBy("position").collect()] == ["x", "z", "y"]


def test_published_wins_add_up():
    #: Wins, ties, losses and number of questions of three published comparisons.
    for wtl, n in (((64, 42, 30), 136), ((27, 12, 12), 51), ((106, 3, 1), 110)):
        assert sum(wtl) == n


def test_systematic_sample_sizes(spark):
    for n, m, expected in ((3, 5, [0, 1, 2]), (5, 5, [0, 1, 2, 3, 4]), (11, 5, [0, 2, 4, 6, 8])):
        rows = spark.range(n)
        assert [r.id for r in E.systematic_sample(rows, m, "id").collect()] == expected


def test_constant_pool_scales_to_zero_and_short_unions_stay_short(spark):
    a = spark.createDataFrame([(1, 1, 2.0, 1), (1, 2, 2.0, 2)], "query_id long, chunk_id long, score double, rank int")
    b = spark.createDataFrame([(1, 2, 9.0, 1), (1, 3, 1.0, 2)], "query_id long, chunk_id long, score double, rank int")
    out = [(r.chunk_id, r.score) for r in R.hybrid_topk(a, b, 10).orderBy("rank").collect()]
    assert out == [(2, 0.5), (1, 0.0), (3, 0.0)]


def test_plans_push_down_and_limit_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = docs.filter(F.col("doc_id") > 5).select("doc_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in plan and "ReadSchema: struct<doc_id:bigint>" in plan
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    v = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    q = e.filter("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert "WindowGroupLimit" in R.vector_topk(v, q, 3)._jdf.queryExecution().toString()


def test_bootstrap_queries_take_every_document(spark, tmp_path):
    from siftwell.queries import evaluation

    spark.range(400).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
    diff = {i: float(number(f"r{i}") % 101 - number(f"b{i}") % 101) for i in range(400) if i % 17 and i % 19}
    d = list(diff.values())
    exact = {r.tool: (r.n, r.low, r.high) for r in evaluation.bootstrap_ci_exact(spark, str(tmp_path)).collect()}
    assert sorted(exact) == list(range(8)) and sum(n for n, _, _ in exact.values()) == len(d)
    for tool in (0, 5):
        own, rng = [x for i, x in diff.items() if i // 50 == tool], random.Random(0)
        means = sorted(sum(rng.choice(own) for _ in own) / len(own) for _ in range(2000))
        assert exact[tool] == (len(own), means[50], means[1950])
    assert evaluation.bootstrap_ci(spark, str(tmp_path)).first().n == len(d)
    means = sorted(sum(d[number(f"{i}:{j}") % len(d)] for j in range(len(d))) / len(d) for i in range(2000))
    r = evaluation.bootstrap_ci_hash(spark, str(tmp_path)).first()
    assert (r.n, r.low, r.high) == (len(d), pytest.approx(means[50], abs=1e-6), pytest.approx(means[1950], abs=1e-6))


def plain_splits(diffs, iters, seed, block):
    """The same resamples by a walk over all halves, from the whole down."""
    import numpy as np

    n, sums = len(diffs), np.zeros(iters)

    def walk(low, high, counts):
        if high - low <= block:
            rng = np.random.default_rng([seed, low])
            for i, c in enumerate(counts):
                sums[i] += rng.multinomial(c, [1 / (high - low)] * (high - low)) @ np.array(diffs[low:high])
            return
        middle = low + block * max(1, (high - low) // block // 2)
        left = np.random.default_rng([seed, low, high]).binomial(counts, (middle - low) / (high - low))
        walk(low, middle, left)
        walk(middle, high, counts - left)

    walk(0, n, np.full(iters, n))
    return sorted(s / n for s in sums)


def test_bootstrap_by_splitting_equals_the_plain_walk(spark):
    import random

    rng = random.Random(1)
    for n, block in ((1, 4), (7, 2), (37, 8), (64, 16), (100, 128)):
        diffs = [round(rng.gauss(3, 10), 1) for _ in range(n)]
        rows = spark.createDataFrame([(i, d) for i, d in enumerate(diffs)] + [(1000, None)], "id long, diff double").repartition(3)
        got = M.bootstrap_ci(rows, iters=200, seed=5, block=block).first()
        want = plain_splits(diffs, 200, 5, block)
        assert got.n == n and abs(got.low - want[5]) < 1e-9 and abs(got.high - want[195]) < 1e-9


def test_bootstrap_by_splitting_draws_as_resampling_does():
    import numpy as np

    diffs = np.array([0.0, 1.0, 2.0, 10.0] * 25)
    means = np.sort(sum(M.block_sums(diffs[k : k + 8], 100, k, 3, 8, 4000) for k in range(0, 100, 8)) / 100)
    plain = np.sort(np.random.default_rng(0).choice(diffs, (4000, 100)).mean(1))
    assert abs(means.mean() - diffs.mean()) < 0.03 and abs(means.std() - plain.std()) < 0.02
    assert all(abs(means[k] - plain[k]) < 0.12 for k in (100, 2000, 3900))
