"""Questions to metrics. Each stage that calls a model writes its rows, so a later failure does not repeat the calls.

Chains take ``questions(query_id, question, ..)``, pools ``(query_id, chunk_id, position from 0)`` and ``chunks(chunk_id, doc_path, heading, content)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions import verdicts as J
from siftwell.functions.text import provenance, question_text, shorten
from siftwell.operators import evalset, metrics, retrieval
from siftwell.operators.order import numbered
from siftwell.services import client

STRICT = "Answer only from the context. Say so if it does not hold the answer."
FALLBACK = "Prefer the context; where it does not hold the answer, use what you know."


def retrieve(method: str, chunks: DataFrame, questions: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    """Ranked rows by ``vector``, ``bm25`` or ``hybrid``; chunks hold content and vector, questions question and vector."""
    if method == "vector":
        return retrieval.vector_topk(chunks, questions, k)
    if method == "bm25":
        return retrieval.bm25_topk(chunks, questions, k, zero_filled=True)
    if method == "hybrid":
        return retrieval.hybrid_topk(retrieve("vector", chunks, questions, retrieval.POOL), retrieve("bm25", chunks, questions, retrieval.POOL), k, alpha)
    raise ValueError(f"no retrieval method {method!r}")


def reranked(ranks: DataFrame, questions: DataFrame, chunks: DataFrame, k: int, scorer=retrieval.overlap_score) -> DataFrame:
    """Ranked rows scored anew against their questions, the k best of them."""
    pool = ranks.select("query_id", "chunk_id", "rank").join(questions.select("query_id", "question"), "query_id").join(chunks.select("chunk_id", "content"), "chunk_id")
    return retrieval.rerank(pool, k, scorer)


def recall(chunks: DataFrame, questions: DataFrame, gold: DataFrame, methods: tuple[str, ...] = ("vector", "bm25", "hybrid")) -> DataFrame:
    """recall@k of each method."""
    every = None
    for m in methods:
        rows = retrieve(m, chunks, questions, max(metrics.KS)).withColumn("method", F.lit(m))
        every = rows if every is None else every.unionByName(rows)
    return metrics.recall_at_k(every, gold, names=list(methods))


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def judged_pools(questions: DataFrame, pool: DataFrame, chunks: DataFrame, judge: client.Client, path: str, chars: int = 500, budget: int | None = None) -> DataFrame:
    """(query_id, reply, ids): the judge's parsed reply (null if it cannot be read) about each question's candidates, and the candidates' ids
    in order. A prompt is JSON: the question and the candidates' places and shortened contents. A question without candidates is
    not asked. Replies are written to ``path``."""
    label = provenance(F.col("doc_path"), F.col("heading"))
    found = pool.join(chunks, "chunk_id").select("query_id", "position", "chunk_id", F.struct(label.alias("place"), shorten(F.col("content"), chars).alias("content")).alias("candidate"))
    lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id", "candidate"))).alias("c"))
    rows = questions.join(lists, "query_id")
    prompts = rows.select(F.col("query_id").cast("string").alias("id"), F.to_json(F.struct("question", F.transform("c", lambda x: x["candidate"]).alias("candidates"))).alias("prompt"))
    replies = written(client.call(prompts, judge, "judge", budget=budget), path)
    ids = lists.select("query_id", F.col("query_id").cast("string").alias("id"), F.transform("c", lambda x: x["chunk_id"]).alias("ids"))
    return ids.join(replies.select("id", J.reply_object(F.col("text")).alias("reply")), "id", "left").drop("id")


def curation(questions: DataFrame, pool: DataFrame, chunks: DataFrame, judge: client.Client, folder: str, budget: int | None = None) -> DataFrame:
    """``questions(query_id, title, question, answer)`` -> (query_id, gold_chunk_ids) of those that pass the length filter and that the judge keeps
    with a candidate at least. ``pool`` is of the answer's and the question's nearest chunks and of BM25's."""
    good = evalset.prefilter_curate(questions)
    asked = good.select("query_id", question_text(F.col("title"), F.col("question"), " ").alias("question"))
    pool = pool.join(chunks.select("chunk_id"), "chunk_id", "left_semi")  # what the judge's indices count
    rows = judged_pools(asked, pool, chunks, judge, f"{folder}/curation", budget=budget)
    verdicts = rows.select("query_id", F.coalesce(J.flag(F.col("reply"), "keep"), F.lit(False)).alias("keep"), J.indices(F.col("reply"), "gold_indices", F.size("ids")).alias("gold_indices"))
    return evalset.curated(verdicts, pool)


def claim_rows(questions: DataFrame, pool: DataFrame, dense: DataFrame, chunks: DataFrame, judge: client.Client, folder: str, budget: int | None = None) -> DataFrame:
    """(query_id, in_corpus, best_vrank, sufficient, supporting_n) for each question; ``dense`` has the dense ranks, from 1. A question without
    candidates or without a reply that can be read has no support."""
    rows = judged_pools(questions, pool, chunks, judge, f"{folder}/claims", 550, budget)
    told = rows.select("query_id", "ids", J.indices(F.col("reply"), "supporting", F.size("ids")).alias("at"), J.flag(F.col("reply"), "sufficient").alias("sufficient"))
    support = told.select("query_id", F.explode(F.array_distinct("at")).alias("i"), "ids").select("query_id", F.get("ids", F.col("i")).alias("chunk_id"))
    ranks = support.join(dense.select("query_id", "chunk_id", (F.col("rank") - 1).alias("vrank")), ["query_id", "chunk_id"], "left")
    best = ranks.groupBy("query_id").agg(F.min("vrank").alias("best_vrank"), F.count("*").alias("supporting_n"))
    out = questions.select("query_id").join(best, "query_id", "left").join(told.select("query_id", "sufficient"), "query_id", "left")
    return out.select("query_id", F.col("supporting_n").isNotNull().alias("in_corpus"), "best_vrank", F.coalesce("sufficient", F.lit(False)).alias("sufficient"), F.coalesce("supporting_n", F.lit(0)).alias("supporting_n"))


def triage(covered: DataFrame, questions: DataFrame, pool: DataFrame, chunks: DataFrame, judge: client.Client, folder: str, k: int = 5, budget: int | None = None) -> DataFrame:
    """(query_id, category, supporting_ranks, single_chunk_sufficient) of the questions that ``covered(query_id, covered)`` has as not covered;
    those without a verdict are not among them."""
    asked = questions.join(covered.filter(~F.col("covered")).select("query_id"), "query_id", "left_semi")
    rows = judged_pools(asked, pool, chunks, judge, f"{folder}/triage", 600, budget)
    told = rows.select("query_id", J.indices(F.col("reply"), "supporting_ranks", F.size("ids")).alias("supporting_ranks"), J.flag(F.col("reply"), "single_chunk_sufficient").alias("single_chunk_sufficient"))
    out = asked.select("query_id").join(told, "query_id", "left")
    return out.select("query_id", metrics.triage_category(F.col("supporting_ranks"), F.col("single_chunk_sufficient"), k).alias("category"), "supporting_ranks", "single_chunk_sufficient")


def synthetic(chunks: DataFrame, n: int, generator: client.Client, folder: str, budget: int | None = None) -> DataFrame:
    """``chunks(chunk_id, content)`` -> (id, chunk_id, question, reference): of a systematic sample of 2 n substantive chunks, what the generator
    makes of the first n, by chunk, that it can use.

    The sample is called in waves in the order of its chunks, the first of n calls, later ones of as many as the share of accepted replies so far asks for, until n are
    accepted, the sample ends or ``budget`` calls are made: the rows are those of calling them all."""
    good = chunks.filter(evalset.is_substantive(F.col("content")))
    sample = written(numbered(evalset.systematic_sample(good, 2 * n, "chunk_id"), "chunk_id", "_at"), f"{folder}/sample")
    most = min(sample.count(), 2 * n if budget is None else budget)
    done = accepted = wave = 0
    usable = None
    while done < most and accepted < n:
        missing = n - accepted
        size = n if not done else -(-missing * done // accepted) if accepted else 2 * n
        upto = min(most, done + max(1, size))
        part = sample.filter((F.col("_at") >= done) & (F.col("_at") < upto))
        replies = written(client.call(part.select(F.col("chunk_id").alias("id"), F.col("content").alias("prompt")), generator, "generate"), f"{folder}/synthetic/wave={wave}")
        o = J.reply_object(F.col("text"))
        made = replies.select("id", J.flag(o, "usable").alias("usable"), J.string(o, "question").alias("question"), J.string(o, "reference").alias("reference"))
        found = evalset.usable_synthetic(part.select("chunk_id", F.col("chunk_id").cast("string").alias("id")).join(made, "id"))
        found = written(found, f"{folder}/usable/wave={wave}")
        usable = found if usable is None else usable.unionByName(found)
        accepted, done, wave = accepted + found.count(), upto, wave + 1
    if usable is None:
        none = F.lit(None).cast("string")
        return sample.limit(0).select(F.col("chunk_id").cast("string").alias("id"), "chunk_id", none.alias("question"), none.alias("reference"))
    return usable.orderBy("chunk_id").limit(n).select("id", "chunk_id", "question", "reference")


def familiarity(questions: DataFrame, model: client.Client, judge: client.Client, folder: str, m: int = 14, budget: int | None = None) -> DataFrame:
    """``questions(candidate, number, question, reference)`` -> the ranking of candidates by how well the model answers without their documents: a
    systematic sample of m questions each, answered, then judged as ``a`` against the reference ({a_score, docs_answerable})."""
    key = F.concat_ws("#", "candidate", "number")
    picked = evalset.systematic_sample_by(questions, m, "candidate", "number").withColumn("id", key)
    answers = written(client.call(picked.select("id", F.col("question").alias("prompt")), model, "answer"), f"{folder}/base")
    prompt = F.to_json(F.struct("reference", F.substring("text", 1, 3000).alias("a"), F.lit("").alias("b")))
    judged = written(client.call(picked.join(answers.select("id", "text"), "id").select("id", prompt.alias("prompt")), judge, "judge", budget=budget), f"{folder}/probe")
    o = J.reply_object(F.col("text"))
    scores = judged.select("id", J.number(o, "a_score").alias("base_score"), J.flag(o, "docs_answerable").alias("said"))
    return evalset.selection_rank(picked.join(scores, "id", "left").select("candidate", F.coalesce("said", F.col("base_score").isNotNull()).alias("docs_answerable"), "base_score"))


def run_metrics(questions: DataFrame, chunks: DataFrame, gold: DataFrame, model: client.Client, judge: client.Client, reader: client.Client, folder: str, rerank: bool = False) -> dict[str, DataFrame]:
    """The chain over one collection: claim coverage, recall of each method, and the ablation in both variants, by name. ``chunks`` also hold vectors,
    ``questions(query_id, question, reference, vector)``; ``reader`` judges pools. Ranks are made once and written. ``rerank``: the dense ranks
    of claim coverage and of the ablation are those of a reranked pool."""
    plain = written(retrieve("vector", chunks, questions, retrieval.POOL), f"{folder}/dense")
    dense = plain
    if rerank:
        dense = written(reranked(plain.filter(F.col("rank") <= retrieval.RERANK_POOL), questions, chunks, retrieval.RERANK_POOL), f"{folder}/reranked")
    lexical = written(retrieve("bm25", chunks, questions, retrieval.POOL), f"{folder}/bm25")
    hybrid = retrieval.hybrid_topk(plain, lexical, max(metrics.KS))
    ranks = [r.filter(F.col("rank") <= max(metrics.KS)).withColumn("method", F.lit(m)) for m, r in (("vector", plain), ("bm25", lexical), ("hybrid", hybrid))]
    pool = retrieval.candidate_pool(dense, lexical, per_list=20, most=40)
    top = dense.filter("rank <= 5")
    out = {"claim_coverage": metrics.claim_coverage(claim_rows(questions, pool, dense, chunks, reader, folder)), "recall": metrics.recall_at_k(ranks[0].unionByName(ranks[1]).unionByName(ranks[2]), gold, names=["vector", "bm25", "hybrid"])}
    for variant in ("strict", "fallback"):
        out[f"ablation_{variant}"] = metrics.ablation_summary(ablation(questions, chunks, top, gold, model, judge, f"{folder}/{variant}", variant))
    return out


def ablation(questions: DataFrame, chunks: DataFrame, ranks: DataFrame, gold: DataFrame, model: client.Client, judge: client.Client, folder: str, variant: str = "strict", budget: int | None = None) -> DataFrame:
    """Base answers, answers with retrieved context, blind joint judging, and the rows that the summaries read. ``questions(query_id,
    question, reference)``. Writes base, rag and verdict rows under ``folder``."""
    def stored(df: DataFrame, name: str) -> DataFrame:
        return written(df, f"{folder}/{name}")

    asked = questions.select(F.col("query_id").cast("string").alias("id"), "question", "reference")
    base = stored(client.call(asked.select("id", F.col("question").alias("prompt")), model, "answer"), "base")
    context = retrieval.build_context(ranks, chunks).select(F.col("query_id").cast("string").alias("id"), "context")
    prompt = F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion:\n"), F.col("question"))
    system = {"strict": STRICT, "fallback": FALLBACK}[variant]
    rag = stored(client.call(asked.join(context, "id", "left").select("id", prompt.alias("prompt")), model, "answer", system), "rag")
    both = asked.join(base.select("id", F.col("text").alias("base")), "id").join(rag.select("id", F.col("text").alias("rag")), "id").withColumn("base_is_a", evalset.ab_assignment(F.col("id")))
    pick = lambda x, y: F.substring(F.when(F.col("base_is_a"), F.col(x)).otherwise(F.col(y)), 1, 3000)
    judged = both.select("id", F.to_json(F.struct(F.substring("reference", 1, 3000).alias("reference"), pick("base", "rag").alias("a"), pick("rag", "base").alias("b"))).alias("prompt"))
    verdict = stored(client.call(judged, judge, "judge", budget=budget), "verdicts")
    o = J.reply_object(F.col("text"))
    scores = verdict.select("id", *[J.number(o, c).alias(c) for c in ("a_score", "b_score")], *[J.flag(o, c).alias(c) for c in ("a_correct", "b_correct")], J.string(o, "preferred").alias("preferred"))
    hit = ranks.join(gold, ["query_id", "chunk_id"], "left_semi").select(F.col("query_id").cast("string").alias("id")).distinct().withColumn("gold_hit", F.lit(True))
    rows = evalset.ab_unswap(both.select("id", "base_is_a").join(scores, "id"))
    return rows.join(hit, "id", "left").withColumn("gold_hit", F.coalesce("gold_hit", F.lit(False)))
