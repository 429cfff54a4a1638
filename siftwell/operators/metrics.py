"""Evaluation metrics over rows of results. Every rate and mean is null where there are no rows."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.order import numbered
from siftwell.operators.selection import order_statistic
from siftwell.session import ship

KS = (1, 3, 5, 10)
DEAD_ZONE = 5
RESAMPLES = 2000
#: Bytes of numbered rows that are broadcast to the draws of a bootstrap.
DRAWN_BYTES = 32 << 20


def rate(condition: Column) -> Column:
    """Share of all rows for which a condition holds; null counts as not."""
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)))


def recall_at_k(ranks: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS, by: tuple[str, ...] = ("method",), names: list[str] | None = None) -> DataFrame:
    """``ranks(by.., query_id, chunk_id, rank)``, ``gold(query_id, chunk_id)`` -> by.., n, recall_at_k: of all questions with gold, those
    with a gold chunk among the first k. ``names``: the values of ``by`` (a single column); without them they are looked for in ``ranks``, which
    runs what made them once more."""
    asked = gold.select("query_id").distinct()
    if names is not None:
        rows = asked.select("query_id", F.explode(F.array(*[F.lit(x) for x in names])).alias(by[0]))
        return _recall(rows, ranks, gold, ks, by)
    every = asked.crossJoin(F.broadcast(ranks.select(*by).distinct())) if by else asked  # a row a method
    return _recall(every, ranks, gold, ks, by)


def _recall(every: DataFrame, ranks: DataFrame, gold: DataFrame, ks: tuple[int, ...], by: tuple[str, ...]) -> DataFrame:
    best = ranks.join(gold, ["query_id", "chunk_id"], "left_semi").groupBy(*by, "query_id").agg(F.min("rank").alias("best"))
    rows = every.join(best, [*by, "query_id"], "left")
    values = [F.count("*").alias("n"), *[F.round(rate(F.col("best") <= k), 3).alias(f"recall_at_{k}") for k in ks]]
    return rows.groupBy(*by).agg(*values) if by else rows.agg(*values)


def coverage_summary(rows: DataFrame) -> DataFrame:
    """``rows(covered boolean, gold_hit boolean)``: strict coverage and exact recall over the rows with a verdict."""
    valid = F.col("covered").isNotNull()
    one = lambda c: F.round(F.avg(F.when(valid, F.when(c, F.lit(1.0)).otherwise(F.lit(0.0)))), 3)
    return rows.agg(F.count("*").alias("n"), F.count_if(valid).alias("n_valid"), F.count_if(~valid).alias("n_invalid"), one(F.col("covered")).alias("coverage"), one(F.col("gold_hit")).alias("exact_recall"))


def best_rank(ranks: Column) -> Column:
    """The least of an array of ranks, null if there is none."""
    return F.array_min(ranks)


def claim_coverage(rows: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """``rows(in_corpus boolean, best_vrank int from 0 or null)`` -> n, coverage_at_k, in_corpus_rate, corpus_gap_rate,
    present_but_ranked_below5. All rows count, so a reply that could not be read counts as a gap."""
    late = F.col("in_corpus") & (F.col("best_vrank").isNull() | (F.col("best_vrank") >= 5))
    return rows.agg(
        F.count("*").alias("n"), *[F.round(rate(F.col("best_vrank") < k), 3).alias(f"coverage_at_{k}") for k in ks],
        F.round(rate(F.col("in_corpus")), 3).alias("in_corpus_rate"), F.round(1 - rate(F.col("in_corpus")), 3).alias("corpus_gap_rate"), F.round(rate(late), 3).alias("present_but_ranked_below5"),
    )


def valid_pairs(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("base_score").isNotNull() & F.col("rag_score").isNotNull()).withColumn("diff", F.col("rag_score") - F.col("base_score"))


def win_tie_loss(rows: DataFrame, zone: float = DEAD_ZONE) -> DataFrame:
    d = F.col("diff")
    wins, losses = F.count_if(d > zone), F.count_if(d < -zone)
    return valid_pairs(rows).agg(F.count("*").alias("n"), wins.alias("wins"), (F.count("*") - wins - losses).alias("ties"), losses.alias("losses"))


def lift_conditioned(rows: DataFrame) -> DataFrame:
    """Means by whether gold was retrieved; a side without rows has no row."""
    return valid_pairs(rows).groupBy("gold_hit").agg(F.count("*").alias("n"), F.round(F.avg("base_score"), 1).alias("base_mean"), F.round(F.avg("rag_score"), 1).alias("rag_mean"))


def ablation_summary(rows: DataFrame, by: tuple[str, ...] = (), zone: float = DEAD_ZONE) -> DataFrame:
    """Means, lift, wins, preferences and correct rates of paired scores, per group or for all rows."""
    valid = F.col("base_score").isNotNull() & F.col("rag_score").isNotNull()
    d = F.when(valid, F.col("rag_score") - F.col("base_score"))
    mean = lambda c: F.round(F.avg(F.when(valid, c)), 1)
    share = lambda c: F.round(F.avg(F.when(valid, F.when(c, F.lit(1.0)).otherwise(F.lit(0.0)))), 3)
    n, wins, losses = F.count_if(valid), F.count_if(d > zone), F.count_if(d < -zone)
    chose = lambda x: F.count_if(valid & (F.col("preferred") == x))
    values = [
        n.alias("n"), (F.count("*") - n).alias("n_invalid"), mean(F.col("base_score")).alias("base_mean_score"), mean(F.col("rag_score")).alias("rag_mean_score"), F.round(F.avg(d), 1).alias("mean_lift"),
        wins.alias("rag_wins"), (n - wins - losses).alias("ties"), losses.alias("rag_losses"), chose("rag").alias("rag_preferred"), chose("base").alias("base_preferred"), chose("tie").alias("tie_preferred"),
        share(F.col("base_correct")).alias("base_correct_rate"), share(F.col("rag_correct")).alias("rag_correct_rate"),
    ]
    return rows.groupBy(*by).agg(*values) if by else rows.agg(*values)


def bootstrap_ci_hash(rows: DataFrame, key: str = "id", iters: int = RESAMPLES) -> DataFrame:
    """``rows(key, diff)`` -> n, low, high: order statistics int(0.025 iters) and int(0.975 iters) of the means of ``iters`` resamples.

    Draw j of resample i takes the row number md5("i:j") mod n, so any engine draws alike, resamples are spread over tasks and the rows
    are joined by number. Rows of up to DRAWN_BYTES go to the draws; more of them shuffle ``iters`` times the rows: ``bootstrap_ci`` is for these.
    """
    good = rows.filter("diff is not null").select(key, "diff")
    n = good.count()
    if not n:
        return rows.agg(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = np.divmod(np.asarray(batch.column(0)), n)
            found = b"".join([hashlib.md5(b"%d:%d" % pair).digest()[:4] for pair in zip(i.tolist(), j.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.frombuffer(found, ">u4").astype(np.int64) % n)], ["i", "at"])

    ship(rows.sparkSession)
    draws = rows.sparkSession.range(iters * n).mapInArrow(draw, "i long, at long")
    drawn = numbered(good, key).select("at", "diff")
    means = draws.join(F.broadcast(drawn) if 16 * n <= DRAWN_BYTES else drawn, "at").groupBy("i").agg(F.avg("diff").alias("m"))
    order = F.array_sort(F.collect_list("m"))
    return means.agg(F.lit(n).cast("long").alias("n"), F.element_at(order, int(0.025 * iters) + 1).alias("low"), F.element_at(order, int(0.975 * iters) + 1).alias("high"))


def split_counts(counts: np.ndarray, n: int, first: int, end: int, seed: int, block: int) -> np.ndarray:
    """How often each resample draws from the rows ``first:end`` of n, by halving the rows from all of them down to these: the draws of a half are binomial, given
    the whole's, and come from a generator of the half's own, so whoever walks down to a range of rows finds the same. ``counts``: draws of each
    resample; ``block``: rows of the ranges that are walked down to, a multiple of which ``first`` is."""
    low, high = 0, n
    while high - low > block:
        middle = low + block * max(1, (high - low) // block // 2)
        left = np.random.default_rng([seed, low, high]).binomial(counts, (middle - low) / (high - low))
        if first < middle:
            counts, high = left, middle
        else:
            counts, low = counts - left, middle
    assert (low, high) == (first, end)
    return counts


def block_sums(diff: np.ndarray, n: int, first: int, seed: int, block: int, iters: int) -> np.ndarray:
    """The sum that each resample draws from a block of rows: its draws of the block fall on the block's rows alike."""
    counts = split_counts(np.full(iters, n), n, first, first + len(diff), seed, block)
    rng, even = np.random.default_rng([seed, first]), np.full(len(diff), 1 / len(diff))
    return np.array([rng.multinomial(c, even) @ diff for c in counts])


def bootstrap_ci(rows: DataFrame, key: str = "id", iters: int = RESAMPLES, seed: int = 0, block: int = 1024) -> DataFrame:
    """``rows(key, diff)`` -> n, low, high: order statistics int(0.025 iters) and int(0.975 iters) of the means of ``iters`` resamples of n rows each, with
    replacement. A resample's draws are split between blocks of rows (``split_counts``), so a task draws for its own blocks and gives ``iters`` sums a block; no draw is
    shuffled, and the work is that of n times iters draws. The same seed gives the same interval however the rows lie."""
    good = rows.filter("diff is not null").select(key, F.col("diff").cast("double").alias("diff"))
    n = good.count()
    if not n:
        return rows.agg(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("at")
        sums = block_sums(part["diff"].to_numpy(), n, part["at"][0].as_py(), seed, block, iters)
        return pa.table({"i": pa.array(np.arange(iters)), "s": pa.array(sums)})

    ship(rows.sparkSession)
    dealt = numbered(good, key).select(F.expr(f"at div {block}").alias("block"), "at", "diff")
    means = dealt.groupBy("block").applyInArrow(run, "i long, s double").groupBy("i").agg((F.sum("s") / n).alias("m"))
    order = F.array_sort(F.collect_list("m"))  # ``iters`` values
    return means.agg(F.lit(n).cast("long").alias("n"), F.element_at(order, int(0.025 * iters) + 1).alias("low"), F.element_at(order, int(0.975 * iters) + 1).alias("high"))


def bootstrap_ci_exact(rows: DataFrame, group: str, key: str = "id", iters: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """The interval that Python's generator gives for a seed, with the rows of a group in order of their key. A group is one task's work:
    this is for evaluation sets, not for data of any size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values(key)["diff"].dropna().tolist()
        if not d:
            return pd.DataFrame({group: pdf[group].iloc[:1], "n": [0], "low": [None], "high": [None]})
        rng = random.Random(seed)
        means = sorted(sum(rng.choice(d) for _ in d) / len(d) for _ in range(iters))
        return pd.DataFrame({group: pdf[group].iloc[:1].tolist(), "n": [len(d)], "low": [means[int(0.025 * iters)]], "high": [means[int(0.975 * iters)]]})

    kind = dict(rows.dtypes)[group]
    return rows.select(group, key, "diff").groupBy(group).applyInPandas(run, f"{group} {kind}, n long, low double, high double")


def latency_p95(rows: DataFrame, by: str, value: str = "value") -> DataFrame:
    """n, mean and nearest-rank 95th percentile (the value at index int(0.95 (n - 1)) of the sorted ones) per group; null and not finite values are no
    measurements."""
    found = order_statistic(rows, by, value, lambda n: F.floor(F.lit(0.95) * (n - 1)))
    return found.select(F.col(f"`{by}`"), "n", F.round("mean", 1).alias("mean_ms"), F.round(F.col(f"`{value}`"), 1).alias("p95_ms"))


def usage_rollup(rows: DataFrame, model: str = "model", cost: str = "cost_usd") -> DataFrame:
    """Calls and cost per model and in total (model null)."""
    return rows.rollup(model).agg(F.grouping(model).cast("int").alias("is_total"), F.count("*").alias("calls"), F.round(F.sum(cost), 4).alias("cost_usd"))


#: Categories of unanswered questions.
GAP, MISLABEL, CHUNKING, EMBEDDING = "a_corpus_gap", "b_gold_mislabel", "c_chunking", "d_embedding"


def triage_category(supporting: Column, single_ok: Column, k: int = 5) -> Column:
    """By the ranks (from 0) of supporting chunks: none; one among the first k, so the label was wrong; only later ones, of which one is
    enough by itself, or not."""
    found = F.coalesce(F.size(supporting), F.lit(0)) > 0
    early = F.array_min(supporting) < k
    late = F.when(F.coalesce(single_ok, F.lit(False)), F.lit(EMBEDDING)).otherwise(F.lit(CHUNKING))
    return F.when(~found, F.lit(GAP)).when(early, F.lit(MISLABEL)).otherwise(late)


def triage_distribution(rows: DataFrame) -> DataFrame:
    """category, n, pct (of all rows, one digit)."""
    counts = rows.groupBy("category").agg(F.count("*").alias("n"))
    return counts.select("category", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1).alias("pct"))
