"""Metrics, evaluation sets, resuming and summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.functions.vectors import hash_number
from siftwell.operators import evalset as E
from siftwell.operators import metrics as M
from siftwell.operators import retrieval as R
from siftwell.plans import evaluate as P
from siftwell.plans import resumable
from siftwell.queries import retrieval as Q
from siftwell.queries.registry import query, table
from siftwell.services import client
from siftwell.sources import files
from siftwell.session import shared_folder
from siftwell.streaming import usage

GOLD = "gold AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))"


def gold(spark, sf_dir):
    """Documents that hold a question's whole passage."""
    return E.holders(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage")), Q.corpus(spark, sf_dir))


RECALL = "round(avg(CASE WHEN best <= {0} THEN 1.0::double ELSE 0.0::double END), 3) AS recall_at_{0}"


@query(f"""WITH {Q.bm25_sql()}, {GOLD}, top AS ({Q.rank_sql('bm25', 10)}), best AS (SELECT g.query_id, min(t.rank) AS best FROM gold g LEFT JOIN top t USING (query_id, chunk_id) GROUP BY g.query_id)
    SELECT 'bm25' AS method, count(*) AS n, {', '.join(RECALL.format(k) for k in M.KS)} FROM best""")
def recall_at_k(spark, sf_dir):
    ranks = Q.bm25(spark, sf_dir, 10).withColumn("method", F.lit("bm25"))
    return M.recall_at_k(ranks, gold(spark, sf_dir), names=["bm25"])


@query(f"""WITH {Q.bm25_sql()}, {GOLD}, top AS ({Q.rank_sql('bm25', 5)}), r AS (SELECT query_id, list(chunk_id) AS ids FROM top GROUP BY query_id), g AS (SELECT query_id, list(chunk_id) AS gold_ids FROM gold GROUP BY query_id)
    SELECT count(*) AS n, round(avg(CASE WHEN list_has_any(ids, gold_ids) THEN 1.0::double ELSE 0.0::double END), 3) AS hit_rate FROM g LEFT JOIN r USING (query_id)""")
def gold_hit_rate(spark, sf_dir):
    found = Q.bm25(spark, sf_dir, 5).groupBy("query_id").agg(F.collect_list("chunk_id").alias("ids"))
    return E.gold_hit_rate(found, gold(spark, sf_dir).groupBy("query_id").agg(F.collect_list("chunk_id").alias("gold_ids")))


@query("SELECT query_id, chunk_id FROM (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))")
def passage_holders(spark, sf_dir):
    return gold(spark, sf_dir)


@query(f"""WITH {Q.HYBRID}, {GOLD}, h10 AS ({Q.rank_sql('hybrid', 10)}), tops AS (SELECT 'vector' AS method, query_id, chunk_id, rank FROM d50 WHERE rank <= 10 UNION ALL SELECT 'bm25', query_id, chunk_id, rank FROM l50 WHERE rank <= 10 UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM h10),
    best AS (SELECT g.query_id, m.method, min(t.rank) AS best FROM gold g CROSS JOIN (SELECT DISTINCT method FROM tops) m LEFT JOIN tops t ON t.query_id = g.query_id AND t.chunk_id = g.chunk_id AND t.method = m.method GROUP BY ALL)
    SELECT method, count(*) AS n, {', '.join(RECALL.format(k) for k in M.KS)} FROM best GROUP BY method""")
def recall_at_k_methods(spark, sf_dir):
    """All three methods at once; vectors stand in for the questions' and the documents' own."""
    dense, lexical = Q.both(spark, sf_dir)
    lists = {"vector": dense.filter("rank <= 10"), "bm25": lexical.filter("rank <= 10"), "hybrid": R.hybrid_topk(dense, lexical, 10)}
    every = None
    for name, rows in lists.items():
        rows = rows.select("query_id", "chunk_id", "rank", F.lit(name).alias("method"))
        every = rows if every is None else every.unionByName(rows)
    return M.recall_at_k(every, gold(spark, sf_dir), names=list(lists))


@query(f"""WITH {Q.VECTORS.format('q.vec_id % 10 = 0 AND e.vec_id <> q.vec_id')}, top AS ({Q.rank_sql('dense', 10)}), best AS (SELECT q.vec_id, min(rank) FILTER (e.label = q.label) AS best FROM embeddings q LEFT JOIN top ON query_id = q.vec_id
    LEFT JOIN embeddings e ON e.vec_id = chunk_id WHERE q.vec_id % 10 = 0 GROUP BY q.vec_id) SELECT count(*) AS n, {', '.join(RECALL.format(k) for k in M.KS)} FROM best""")
def recall_at_k_dense(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    ranks = R.vector_topk(Q.vectors(spark, sf_dir), Q.asked(spark, sf_dir, "vec_id % 10 = 0"), 11).filter("query_id <> chunk_id")
    ranks = R.ranked(ranks, 10)
    label = e.select(F.col("vec_id").alias("chunk_id"), "label")
    pairs = ranks.join(label, "chunk_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id").filter("label = own")
    best = pairs.groupBy("query_id").agg(F.min("rank").alias("best"))
    rows = Q.asked(spark, sf_dir, "vec_id % 10 = 0").select("query_id").join(best, "query_id", "left")
    return rows.agg(F.count("*").alias("n"), *[F.round(M.rate(F.col("best") <= k), 3).alias(f"recall_at_{k}") for k in M.KS])


SCORED = """scored AS (SELECT doc_id AS id, doc_id % 4 = 0 AS gold_hit, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE (('0x' || substr(md5('b' || doc_id), 1, 8))::bigint % 101)::double END AS base_score,
    CASE WHEN doc_id % 19 = 0 THEN NULL ELSE (('0x' || substr(md5('r' || doc_id), 1, 8))::bigint % 101)::double END AS rag_score, ['rag', 'base', 'tie', 'other'][doc_id % 4 + 1] AS preferred, doc_id % 2 = 0 AS base_correct,
    CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 3 = 0 END AS rag_correct FROM documents)"""
VALID = "base_score IS NOT NULL AND rag_score IS NOT NULL"


def scored(spark, sf_dir):
    """Paired scores made from hashes: a stand-in for judged answers."""
    d = F.col("doc_id")
    draw = lambda c: (hash_number(F.concat(F.lit(c), d.cast("string"))) % 101).cast("double")
    return table(spark, sf_dir, "documents").select(
        d.alias("id"), (d % 4 == 0).alias("gold_hit"), F.when(d % 17 != 0, draw("b")).alias("base_score"), F.when(d % 19 != 0, draw("r")).alias("rag_score"),
        F.element_at(F.array(*[F.lit(x) for x in ("rag", "base", "tie", "other")]), (d % 4 + 1).cast("int")).alias("preferred"), (d % 2 == 0).alias("base_correct"), F.when(d % 5 != 0, d % 3 == 0).alias("rag_correct"),
    )


@query(f"WITH {SCORED} SELECT count(*) AS n, count(*) FILTER (rag_score - base_score > 5) AS wins, count(*) FILTER (abs(rag_score - base_score) <= 5) AS ties, count(*) FILTER (rag_score - base_score < -5) AS losses FROM scored WHERE {VALID}")
def win_tie_loss(spark, sf_dir):
    return M.win_tie_loss(scored(spark, sf_dir))


@query(f"WITH {SCORED} SELECT gold_hit, count(*) AS n, round(avg(base_score), 1) AS base_mean, round(avg(rag_score), 1) AS rag_mean FROM scored WHERE {VALID} GROUP BY gold_hit")
def lift_conditioned(spark, sf_dir):
    return M.lift_conditioned(scored(spark, sf_dir))


@query(f"""WITH {SCORED}, v AS (SELECT *, rag_score - base_score AS d FROM scored WHERE {VALID}) SELECT count(*) AS n, (SELECT count(*) FROM scored) - count(*) AS n_invalid, round(avg(base_score), 1) AS base_mean_score, round(avg(rag_score), 1) AS rag_mean_score,
    round(avg(d), 1) AS mean_lift, count(*) FILTER (d > 5) AS rag_wins, count(*) FILTER (abs(d) <= 5) AS ties, count(*) FILTER (d < -5) AS rag_losses, count(*) FILTER (preferred = 'rag') AS rag_preferred, count(*) FILTER (preferred = 'base') AS base_preferred,
    count(*) FILTER (preferred = 'tie') AS tie_preferred, round(avg(CASE WHEN base_correct THEN 1.0::double ELSE 0.0::double END), 3) AS base_correct_rate, round(avg(CASE WHEN rag_correct THEN 1.0::double ELSE 0.0::double END), 3) AS rag_correct_rate FROM v""")
def ablation_summary(spark, sf_dir):
    return M.ablation_summary(scored(spark, sf_dir))


@query(f"""WITH {SCORED}, v AS (SELECT row_number() OVER (ORDER BY id) - 1 AS pos, rag_score - base_score AS diff FROM scored WHERE {VALID}), n AS (SELECT count(*) AS n FROM v),
    m AS (SELECT i, avg(diff) AS m FROM (SELECT i, ('0x' || substr(md5(i || ':' || j), 1, 8))::bigint % n AS pos FROM n, range(2000) AS a(i), (SELECT pos AS j FROM v)) JOIN v USING (pos) GROUP BY i),
    o AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS r FROM m) SELECT (SELECT n FROM n) AS n, round(max(m) FILTER (r = 50), 6) AS low, round(max(m) FILTER (r = 1950), 6) AS high FROM o""")
def bootstrap_ci_hash(spark, sf_dir):
    """Over every scored document."""
    return M.bootstrap_ci_hash(M.valid_pairs(scored(spark, sf_dir))).select("n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query()
def bootstrap_ci(spark, sf_dir):
    """Over every scored document, draws split between blocks of rows."""
    return M.bootstrap_ci(M.valid_pairs(scored(spark, sf_dir)))


@query()
def bootstrap_ci_exact(spark, sf_dir):
    """Over every evaluation set; 50 scored documents are one."""
    rows = M.valid_pairs(scored(spark, sf_dir)).withColumn("tool", F.expr("id div 50"))
    return M.bootstrap_ci_exact(rows, "tool")


@query("SELECT event_type, count(*) AS n, round(avg(value), 1) AS mean_ms, round(max(value) FILTER (i = floor(0.95::double * (c - 1))), 1) AS p95_ms FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM events WHERE value IS NOT NULL) GROUP BY event_type")
def latency_p95(spark, sf_dir):
    return M.latency_p95(table(spark, sf_dir, "events"), "event_type")


@query("SELECT event_type AS model, grouping(event_type)::int AS is_total, count(*) AS calls, round(sum(value), 2) AS cost_usd FROM events GROUP BY ROLLUP (event_type)")
def usage_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("value").alias("cost_usd"))
    return M.usage_rollup(rows).withColumn("cost_usd", F.round("cost_usd", 2))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type AS model, count(*) AS calls, round(sum(value), 2) AS cost FROM events GROUP BY ALL")
def usage_windows(spark, sf_dir):
    return usage.windowed_usage(table(spark, sf_dir, "events")).withColumn("cost", F.round("cost", 2))


@query("SELECT event_type AS model, count(*) AS calls, round(sum(value), 2) AS cost_usd FROM events GROUP BY event_type")
def usage_ledger(spark, sf_dir):
    """A stream of calls whose batches are each written once, with totals from the batches' own sums."""
    at = folder(spark)
    calls = spark.readStream.schema(usage.EVENTS).parquet(usage.as_folder(spark, f"{sf_dir}/events.parquet", at)).select(F.col("event_type").alias("model"), F.col("value").alias("cost_usd"))
    usage.append_traces(calls, f"{at}/traces", f"{at}/checkpoint").awaitTermination()
    return usage.ledger_totals(spark, f"{at}/traces").withColumn("cost_usd", F.round("cost_usd", 2))


@query("SELECT event_id AS id, list_min([x for x in [event_id % 11, event_id % 7, event_id % 5] if x > 4]) AS best FROM events")
def best_rank(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("id"), M.best_rank(F.filter(F.array(e % 11, e % 7, e % 5), lambda x: x > 4)).alias("best"))


VERDICTS = "rows AS (SELECT doc_id, toxic = 0 AS covered, quality = 1 AS gold_hit FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"WITH {VERDICTS} SELECT count(*) AS n, count(covered) AS n_valid, count(*) - count(covered) AS n_invalid, round(avg(covered::int::double), 3) AS coverage, round(avg(gold_hit::int::double) FILTER (covered IS NOT NULL), 3) AS exact_recall FROM rows")
def coverage_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select((F.col("toxic") == 0).alias("covered"), (F.col("quality") == 1).alias("gold_hit"))
    return M.coverage_summary(rows)


CLAIMS = f"{Q.POOLED}, supp AS (SELECT query_id, min(r.rank - 1) AS best, count(*) AS c FROM pool p LEFT JOIN d50 r USING (query_id, chunk_id) WHERE (p.chunk_id + p.query_id) % 6 = 0 AND position < 40 GROUP BY query_id)"


def claims(spark, sf_dir):
    """Which candidates support a question is made up from ids: a stand-in for a judge."""
    at = folder(spark)
    dense, lexical = (P.written(x, f"{at}/{n}") for n, x in zip(("dense", "bm25"), Q.both(spark, sf_dir), strict=True))
    rows = R.candidate_pool(dense, lexical, per_list=20, most=40).filter("(chunk_id + query_id) % 6 = 0").join(dense.select("query_id", "chunk_id", (F.col("rank") - 1).alias("vrank")), ["query_id", "chunk_id"], "left")
    best = rows.groupBy("query_id").agg(F.min("vrank").alias("best_vrank"), F.count("*").alias("c"))
    return Q.questions(spark, sf_dir).select("query_id").join(best, "query_id", "left").select("query_id", F.col("c").isNotNull().alias("in_corpus"), "best_vrank")


ONE = "round(avg(CASE WHEN {0} THEN 1.0::double ELSE 0.0::double END), 3) AS {1}"


@query(f"""WITH {CLAIMS}, rows AS (SELECT item_id, c IS NOT NULL AS in_corpus, best FROM benchmark LEFT JOIN supp ON query_id = item_id) SELECT count(*) AS n, {', '.join(ONE.format(f'best < {k}', f'coverage_at_{k}') for k in M.KS)}, {ONE.format('in_corpus', 'in_corpus_rate')},
    round(1 - avg(CASE WHEN in_corpus THEN 1.0::double ELSE 0.0::double END), 3) AS corpus_gap_rate, {ONE.format('in_corpus AND (best IS NULL OR best >= 5)', 'present_but_ranked_below5')} FROM rows""")
def claim_coverage(spark, sf_dir):
    return M.claim_coverage(claims(spark, sf_dir))

SHARE = "100 * len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9_]+')), list_distinct(regexp_extract_all(lower(CASE WHEN length(d.text) > {0} THEN substr(d.text, 1, {0}) || ' …' ELSE d.text END), '[a-z0-9_]+')))) / greatest(1, len(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9_]+'))))"


def read_sql(chars: int, pool: str = "(SELECT * FROM pool WHERE position < 40)") -> str:
    """What the stand-in reader finds: ``cand(query_id, chunk_id, idx, share)``."""
    return f"cand AS (SELECT p.query_id, p.chunk_id, row_number() OVER (PARTITION BY p.query_id ORDER BY p.position) - 1 AS idx, {SHARE.format(chars)} AS share FROM {pool} p JOIN benchmark b ON b.item_id = p.query_id JOIN documents d ON d.doc_id = p.chunk_id)"


def folder(spark) -> str:
    return f"{shared_folder(spark)}/siftwell-{uuid.uuid4().hex}"


@query(f"""WITH {Q.POOLED}, {read_sql(550)}, supp AS (SELECT c.query_id, min(r.rank - 1) AS best, count(*) AS c FROM cand c LEFT JOIN d50 r USING (query_id, chunk_id) WHERE share >= 50 GROUP BY c.query_id),
    rows AS (SELECT item_id, c IS NOT NULL AS in_corpus, best FROM benchmark LEFT JOIN supp ON query_id = item_id) SELECT count(*) AS n, {', '.join(ONE.format(f'best < {k}', f'coverage_at_{k}') for k in M.KS)}, {ONE.format('in_corpus', 'in_corpus_rate')},
    round(1 - avg(CASE WHEN in_corpus THEN 1.0::double ELSE 0.0::double END), 3) AS corpus_gap_rate, {ONE.format('in_corpus AND (best IS NULL OR best >= 5)', 'present_but_ranked_below5')} FROM rows""")
def claim_coverage_judged(spark, sf_dir):
    """From questions to the metric: pools, prompts, a stand-in judge's replies, their ranks."""
    at = folder(spark)
    dense, lexical = (P.written(x, f"{at}/{n}") for n, x in zip(("dense", "bm25"), Q.both(spark, sf_dir), strict=True))
    pool = R.candidate_pool(dense, lexical, per_list=20, most=40)
    return M.claim_coverage(P.claim_rows(Q.questions(spark, sf_dir), pool, dense, Q.chunk_rows(spark, sf_dir), client.OverlapReader(), at))


@query(f"""WITH {Q.POOLED}, {read_sql(600)}, s AS (SELECT query_id, min(idx) FILTER (share >= 50) AS first, max(share) >= 80 AS alone FROM cand GROUP BY query_id)
    SELECT item_id AS query_id, CASE WHEN first IS NULL THEN 'a_corpus_gap' WHEN first < 5 THEN 'b_gold_mislabel' WHEN alone THEN 'd_embedding' ELSE 'c_chunking' END AS category FROM benchmark LEFT JOIN s ON query_id = item_id WHERE item_id % 3 = 1""")
def triage_judged(spark, sf_dir):
    """The questions whose (made up) verdict is that they are not covered, not those without one, by what the stand-in judge finds."""
    q = F.col("query_id")
    covered = Q.questions(spark, sf_dir).select("query_id", F.when(q % 3 == 0, True).when(q % 3 == 1, False).alias("covered"))
    return P.triage(covered, Q.questions(spark, sf_dir), Q.pool(spark, sf_dir), Q.chunk_rows(spark, sf_dir), client.OverlapReader(), folder(spark)).select("query_id", "category")


@query(f"""WITH {Q.BOTH}, {Q.ANSWER}, places AS (SELECT query_id, chunk_id, rank AS place FROM answer UNION ALL SELECT query_id, chunk_id, 10000000 + rank FROM d50 WHERE rank <= 5 UNION ALL SELECT query_id, chunk_id, 20000000 + rank FROM l50 WHERE rank <= 5),
    pool AS (SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY min(place)) - 1)::int AS position FROM places GROUP BY query_id, chunk_id), {read_sql(500, 'pool')}
    SELECT query_id, string_agg(chunk_id::varchar, ',' ORDER BY idx) AS gold_chunk_ids FROM cand JOIN benchmark ON item_id = query_id WHERE share >= 50 AND length(text) + 1 >= 40 AND length(text) >= 100 GROUP BY query_id""")
def curation_judged(spark, sf_dir):
    """From questions to an evaluation set: the length filter, three pools, the stand-in judge, valid indices."""
    rows = Q.questions(spark, sf_dir).select("query_id", F.lit("").alias("title"), "question", F.col("question").alias("answer"))
    out = P.curation(rows, P.written(Q.curated_pool(spark, sf_dir), f"{folder(spark)}/pool"), Q.chunk_rows(spark, sf_dir), client.OverlapReader(), folder(spark))
    return out.select("query_id", F.array_join(F.col("gold_chunk_ids").cast("array<string>"), ",").alias("gold_chunk_ids"))


@query("""WITH s AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS pos, greatest(1, count(*) OVER () // 40) AS step FROM documents WHERE length(text) BETWEEN 300 AND 2000 AND length(text) - length(replace(text, ' ', '')) > 40 AND length(text) - length(replace(text, chr(10), '')) < 60),
    g AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM s WHERE pos % step = 0 AND pos < 40 * step)
    SELECT doc_id::varchar AS id, doc_id AS chunk_id, array_to_string(w[1:5], ' ') AS question, substr(text, 1, 80) AS reference FROM g WHERE len(w) % 3 <> 0 AND len(w) > 0 ORDER BY doc_id LIMIT 20""")
def synthetic_judged(spark, sf_dir):
    """A synthetic evaluation set: a sample of substantive chunks, a stand-in generator's replies, the first 20 that are of use."""
    return P.synthetic(Q.corpus(spark, sf_dir), 20, client.FirstWords(), folder(spark))


def words_sql(text: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({text}), '[a-z0-9_]+'))"


@query(f"""WITH s AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, greatest(1, count(*) OVER (PARTITION BY source) // 14) AS step FROM documents),
    w AS (SELECT source, {words_sql('text')} AS ref, {words_sql("substr(string_split(text, chr(10))[1], 1, 3000)")} AS base FROM s WHERE pos % step = 0 AND pos < 14 * step),
    r AS (SELECT source AS candidate, count(*) AS sampled, count(*) AS docs_answerable, round(avg((100 * len(list_intersect(ref, base)) // greatest(1, len(ref)))::double), 1) AS base_mean_score FROM w GROUP BY source)
    SELECT *, row_number() OVER (ORDER BY base_mean_score NULLS LAST, candidate)::int AS position FROM r""")
def familiarity_probe(spark, sf_dir):
    """Collections (sources) by how well a stand-in model, which says a text's first line, answers 14 questions of each without documents."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("candidate"), F.col("doc_id").alias("number"), F.col("text").alias("question"), F.col("text").alias("reference"))
    return P.familiarity(rows, client.Echo(), client.WordShare(), folder(spark))


@query("""SELECT doc_id, CASE WHEN a THEN x ELSE y END AS base_score, CASE WHEN a THEN y ELSE x END AS rag_score, CASE p WHEN 'A' THEN CASE WHEN a THEN 'base' ELSE 'rag' END WHEN 'B' THEN CASE WHEN a THEN 'rag' ELSE 'base' END ELSE p END AS preferred
    FROM (SELECT doc_id, substr(sha256(doc_id::varchar), 64, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS a, doc_id % 101 AS x, doc_id % 97 AS y, ['A', 'B', 'tie', '?'][doc_id % 4 + 1] AS p FROM documents)""")
def ab_unswap(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", E.ab_assignment(d.cast("string")).alias("base_is_a"), (d % 101).alias("a_score"), (d % 97).alias("b_score"), F.lit(True).alias("a_correct"), F.lit(False).alias("b_correct"),
        F.element_at(F.array(*[F.lit(x) for x in ("A", "B", "tie", "?")]), (d % 4 + 1).cast("int")).alias("preferred"),
    )
    return E.ab_unswap(rows).select("doc_id", "base_score", "rag_score", "preferred")


@query("SELECT * FROM (SELECT item_id, text FROM (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS pos, (SELECT greatest(1, count(*) // 14) FROM benchmark) AS step FROM benchmark) WHERE pos % step = 0 ORDER BY item_id LIMIT 14)")
def systematic_sample(spark, sf_dir):
    return E.systematic_sample(table(spark, sf_dir, "benchmark"), 14, "item_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, greatest(1, count(*) OVER () // 40) AS step FROM documents WHERE length(text) BETWEEN 300 AND 2000 AND length(text) - length(replace(text, ' ', '')) > 40 AND length(text) - length(replace(text, chr(10), '')) < 60) WHERE pos % step = 0 ORDER BY doc_id LIMIT 40")
def synthetic_sample(spark, sf_dir):
    good = table(spark, sf_dir, "documents").filter(E.is_substantive(F.col("text"))).select("doc_id")
    return E.systematic_sample(good, 40, "doc_id")


@query(f"""WITH {Q.VECTORS.format('q.vec_id % 10 = 0 AND e.vec_id <> q.vec_id')}, top AS ({Q.rank_sql('dense', 3)}) SELECT query_id, string_agg(chunk_id::varchar, ',' ORDER BY rank) AS gold_chunk_ids, max(score) AS gold_top_sim FROM top WHERE score >= 0.3::double GROUP BY query_id""")
def eval_set_by_similarity(spark, sf_dir):
    out = E.eval_set_by_similarity(Q.asked(spark, sf_dir, "vec_id % 10 = 0"), Q.vectors(spark, sf_dir), tau=0.3, own=True)
    return out.withColumn("gold_chunk_ids", F.array_join(F.col("gold_chunk_ids").cast("array<string>"), ","))


@query(f"WITH {Q.POOLED}, c AS (SELECT query_id, list(chunk_id ORDER BY position) AS ids FROM pool WHERE position < 40 GROUP BY query_id) SELECT query_id, array_to_string([ids[i + 1] for i in [query_id % 7, 99, query_id % 5 + 8] if i < len(ids)], ',') AS gold_chunk_ids FROM c WHERE query_id % 3 <> 0")
def curated_eval(spark, sf_dir):
    q = F.col("query_id")
    verdicts = Q.questions(spark, sf_dir).select("query_id", (q % 3 != 0).alias("keep"), F.array(q % 7, F.lit(99).cast("long"), q % 5 + 8).cast("array<int>").alias("gold_indices"))
    out = E.curated(verdicts, Q.pool(spark, sf_dir))
    return out.select("query_id", F.array_join(F.col("gold_chunk_ids").cast("array<string>"), ",").alias("gold_chunk_ids"))


def pieces(n: int) -> str:
    """``w``, a document's words, in n pieces of as many words (the last is shorter), as text; in words that DuckDB takes."""
    return f"SELECT doc_id, doc_id || '#' || i AS chunk_id, i AS chunk_index, array_to_string(w[i * m + 1:(i + 1) * m], ' ') AS content FROM (SELECT doc_id, w, (len(w) + {n - 1}) // {n} AS m, unnest(range({n})) AS i FROM words)"


def pieces_of(spark, sf_dir, n: int):
    words = table(spark, sf_dir, "documents").select("doc_id", X.tokenize(F.coalesce("text", F.lit(""))).alias("w")).withColumn("m", F.expr(f"(size(w) + {n - 1}) div {n}").cast("int"))
    rows = words.withColumn("chunk_index", F.explode(F.array(*[F.lit(i) for i in range(n)])))
    content = F.array_join(F.slice("w", F.col("chunk_index") * F.col("m") + 1, F.col("m")), " ")
    return rows.select(F.concat_ws("#", "doc_id", "chunk_index").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_path"), "chunk_index", content.alias("content"))


SET = "CASE WHEN content = '' THEN [doc_id::varchar] ELSE list_distinct(string_split(content, ' ')) END"


@query(f"""WITH words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS w FROM documents), old AS (SELECT *, {SET} AS s FROM ({pieces(3)})), new AS (SELECT *, {SET} AS s FROM ({pieces(4)}) WHERE doc_id % 10 <> 0),
    q AS (SELECT doc_id AS query_id, unnest([0, 1, 2]) AS place, doc_id || '#' || unnest([2, doc_id % 3, 1]) AS chunk_id FROM documents),
    best AS (SELECT query_id, place, arg_max(n.chunk_id, (len(list_intersect(o.s, n.s)) / len(o.s)::double, -n.chunk_index)) AS to FROM q JOIN old o USING (chunk_id) JOIN new n USING (doc_id) GROUP BY ALL),
    firsts AS (SELECT query_id, to, min(place) AS place FROM best GROUP BY ALL)
    SELECT query_id, string_agg(to, ',' ORDER BY place) AS gold_chunk_ids, query_id || '#2,' || query_id || '#' || query_id % 3 || ',' || query_id || '#1' AS gold_chunk_ids_orig FROM firsts GROUP BY query_id""".replace(" to,", ' "to",').replace("AS to ", 'AS "to" ').replace("(to,", '("to",'))
def remap_gold(spark, sf_dir):
    """Gold of documents in thirds on documents in quarters; every tenth document is gone."""
    d = F.col("doc_id")
    gold = F.array(*[F.concat_ws("#", d, x) for x in (F.lit(2), d % 3, F.lit(1))])
    q = table(spark, sf_dir, "documents").select(d.alias("query_id"), gold.alias("gold_chunk_ids"))
    out = E.remap_gold(q, pieces_of(spark, sf_dir, 3), pieces_of(spark, sf_dir, 4).filter("cast(doc_path as long) % 10 <> 0"))
    return out.select("query_id", F.array_join("gold_chunk_ids", ",").alias("gold_chunk_ids"), F.array_join("gold_chunk_ids_orig", ",").alias("gold_chunk_ids_orig"))


@query(f"WITH {SCORED}, again AS (SELECT id, 50.0::double AS b, 60.0::double AS r FROM scored WHERE NOT ({VALID}) AND id % 2 = 0) SELECT id, CASE WHEN a.b IS NULL THEN base_score ELSE b END AS base_score, CASE WHEN a.b IS NULL THEN rag_score ELSE r END AS rag_score FROM scored LEFT JOIN again a USING (id)")
def resume_merge(spark, sf_dir):
    prior = scored(spark, sf_dir).select("id", "base_score", "rag_score")
    again = E.to_rerun(prior, prior.select("id")).filter("id % 2 = 0").select("id", F.lit(50.0).alias("base_score"), F.lit(60.0).alias("rag_score"))
    return E.resume_merge(prior, again.unionByName(spark.createDataFrame([(-1, 1.0, 1.0)], "id long, base_score double, rag_score double")))


@query("""SELECT candidate, sampled, docs_answerable, base_mean_score, row_number() OVER (ORDER BY base_mean_score ASC NULLS LAST, candidate)::int AS position FROM (SELECT source AS candidate, count(*) AS sampled, count(*) FILTER (toxic IS NOT NULL AND doc_id % 3 <> 0) AS docs_answerable,
    round(avg((doc_id % 101)::double) FILTER (toxic IS NOT NULL AND doc_id % 3 <> 0), 1) AS base_mean_score FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)""")
def selection_rank(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = d.select(F.col("source").alias("candidate"), (F.col("doc_id") % 3 != 0).alias("docs_answerable"), F.when(F.col("toxic").isNotNull(), (F.col("doc_id") % 101).cast("double")).alias("base_score"))
    return E.selection_rank(rows)


@query("""WITH repos AS (SELECT n_nationkey AS k, n_name AS repo, CASE WHEN n_regionkey % 2 = 0 THEN 'forum' ELSE 'synthetic' END AS eval_mode FROM nation)
    SELECT repo, eval_mode, round(CASE WHEN eval_mode = 'forum' AND k % 3 <> 0 THEN k * 1.5::double ELSE CASE WHEN k % 5 <> 0 THEN k * 2.0::double END END, 1) AS base_familiarity, CASE WHEN k % 4 <> 0 THEN k / 100.0::double END AS claim_coverage_at5,
    CASE WHEN k % 4 <> 0 THEN 1 - k / 100.0::double END AS corpus_gap, CASE WHEN k % 2 = 0 THEN k / 50.0::double END AS recall_at5, CASE WHEN k % 5 <> 0 THEN k - 10.0::double END AS fallback_lift, CASE WHEN k % 5 <> 0 THEN k || '/' || k + 1 || '/' || k + 2 END AS fallback_wtl FROM repos""")
def cross_repo_summary(spark, sf_dir):
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_name", "repo")
    repos = n.select("repo", F.when(F.col("n_regionkey") % 2 == 0, "forum").otherwise("synthetic").alias("eval_mode"))
    probe = n.filter(k % 3 != 0).select("repo", (k * 1.5).alias("probe_mean"))
    cover = n.filter(k % 4 != 0).select("repo", (k / 100.0).alias("claim_coverage_at5"), (1 - k / 100.0).alias("corpus_gap"))
    recall = n.filter(k % 2 == 0).select("repo", (k / 50.0).alias("recall_at5"))
    ablation = n.filter(k % 5 != 0).select("repo", (k * 2.0).alias("base_mean_score"), (k - 10.0).alias("mean_lift"), k.alias("rag_wins"), (k + 1).alias("ties"), (k + 2).alias("rag_losses"))
    return E.cross_repo_summary(repos, probe, cover, recall, ablation)


@query(f"""WITH t AS (SELECT *, lead(role) OVER w AS next, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), p AS (SELECT conv_id || '#' || turn AS id, {words_sql('text')} AS q, {words_sql('answer')} AS ref FROM t WHERE role = 'user' AND next = 'assistant'),
    j AS (SELECT id, 100 * len(list_intersect(ref, q)) // greatest(1, len(ref)) AS a, CASE WHEN len(ref) > 0 THEN 100 ELSE 0 END AS b FROM p) SELECT id, a::double AS a_score, b::double AS b_score, CASE WHEN a = b THEN 'tie' WHEN a > b THEN 'A' ELSE 'B' END AS preferred, false AS is_error FROM j""")
def judged_answers(spark, sf_dir):
    """Prompts to a stand-in judge and back to typed scores."""
    pairs = E.qa_pairs(table(spark, sf_dir, "conversations"))
    prompts = pairs.select(F.concat_ws("#", "conv_id", "turn").alias("id"), F.to_json(F.struct(F.col("answer").alias("reference"), F.col("question").alias("a"), F.col("answer").alias("b"))).alias("prompt"))
    from siftwell.functions import verdicts as J

    o = J.reply_object(F.col("text"))
    return client.call(prompts, client.WordShare(), "stand-in").select("id", J.number(o, "a_score").alias("a_score"), J.number(o, "b_score").alias("b_score"), J.string(o, "preferred").alias("preferred"), "is_error")


WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9_]+'))"
SHORT = "substr(text, 1, 60)"


def short_questions(spark, sf_dir):
    """The first 60 characters of an item ask for the whole of it; vectors stand in for the questions' own."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 60).alias("question"), F.col("text").alias("reference"))
    return items.join(Q.asked(spark, sf_dir, "true"), "query_id", "left")


@query(f"""WITH w AS (SELECT item_id, {WORDS.format('substr(text, 1, 3000)')} AS ref, {WORDS.format("string_split(" + SHORT + ", chr(10))[1]")} AS base FROM benchmark),
    r AS (SELECT *, 100 * len(list_intersect(ref, base)) // greatest(1, len(ref)) AS b, 100 * list_contains(ref, 'context')::int // greatest(1, len(ref)) AS g FROM w)
    SELECT count(*) AS n, 0::bigint AS n_invalid, round(avg(b::double), 1) AS base_mean_score, round(avg(g::double), 1) AS rag_mean_score, round(avg((g - b)::double), 1) AS mean_lift, count(*) FILTER (g - b > 5) AS rag_wins,
    count(*) FILTER (abs(g - b) <= 5) AS ties, count(*) FILTER (g - b < -5) AS rag_losses, count(*) FILTER (g > b) AS rag_preferred, count(*) FILTER (g < b) AS base_preferred, count(*) FILTER (g = b) AS tie_preferred,
    round(avg((b >= 50)::int::double), 3) AS base_correct_rate, round(avg((g >= 50)::int::double), 3) AS rag_correct_rate, 3 * count(*) + 3 * count(*) FILTER (len(ref) % 3 = 0) AS calls, count(*) FILTER (len(ref) % 3 = 0) AS n_rerun FROM r""")
def ablation_resumed(spark, sf_dir):
    """A run whose judge fails on every third reference, by its words, taken up again with one that does not: the summary of all rows, the calls of both runs, and the rows that were
    asked again. Stand-ins answer with the first line of their prompts."""
    at, q, chunks = folder(spark), short_questions(spark, sf_dir), Q.chunk_rows(spark, sf_dir).join(Q.vectors(spark, sf_dir), "chunk_id")
    gold = Q.questions(spark, sf_dir).select("query_id", F.col("query_id").alias("chunk_id"))
    first = resumable.ablation(q, chunks, gold, client.Echo(), NotAtOnce(fails_on=3), at)
    rows = resumable.resume(q, chunks, gold, client.Echo(), client.WordShare(), at)
    calls = resumable.usage(spark, at).filter("is_total = 1").first().calls
    again = first.filter("base_score is null").count()
    return M.ablation_summary(rows).withColumns({"calls": F.lit(calls), "n_rerun": F.lit(again).cast("long")})


class NotAtOnce(client.WordShare):
    """A judge whose failures are not tried again: it says something that is not a verdict."""

    def complete(self, prompt: str, system: str, model: str) -> client.Reply:
        try:
            return super().complete(prompt, system, model)
        except RuntimeError as error:
            return client.Reply(str(error))


PRIOR = "prior AS (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN item_id % 8 = 0 END AS covered FROM benchmark WHERE item_id % 4 < 2)"


@query(f"""WITH {Q.bm25_sql()}, {GOLD}, {PRIOR}, top AS ({Q.rank_sql('bm25', 5)}), ctx AS (SELECT query_id, string_agg('[' || rank || '] (' || {Q.PLACE} || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM top JOIN documents ON doc_id = chunk_id GROUP BY query_id),
    w AS (SELECT item_id, {WORDS.format('substr(text, 1, 3000)')} AS ref, {WORDS.format("substr(coalesce(context, ''), 1, 9000)")} AS ctx FROM benchmark LEFT JOIN ctx ON query_id = item_id),
    j AS (SELECT w.item_id, coalesce(p.covered, 100 * len(list_intersect(ref, ctx)) // greatest(1, len(ref)) >= 95) AS covered, CASE WHEN p.covered IS NULL THEN EXISTS (SELECT 1 FROM top JOIN gold USING (query_id, chunk_id) WHERE query_id = w.item_id) ELSE false END AS gold_hit FROM w LEFT JOIN prior p USING (item_id))
    SELECT count(*) AS n, count(covered) AS n_valid, count(*) - count(covered) AS n_invalid, round(avg(covered::int::double), 3) AS coverage, round(avg(gold_hit::int::double) FILTER (covered IS NOT NULL), 3) AS exact_recall FROM j""")
def coverage_judged(spark, sf_dir):
    """From questions to strict coverage: BM25's five best chunks, a stand-in judge, and (made up) prior rows of which those with a verdict stay."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.col("text").alias("reference"))
    i = F.col("query_id")
    prior = q.filter(i % 4 < 2).select("query_id", F.when(i % 4 == 0, i % 8 == 0).alias("covered"), F.lit("earlier").alias("reason"), F.lit(False).alias("gold_hit"))
    at = folder(spark)
    ranks = P.written(Q.bm25(spark, sf_dir, 5), f"{at}/ranks")
    return M.coverage_summary(resumable.coverage(q, ranks, gold(spark, sf_dir), Q.chunk_rows(spark, sf_dir), client.WordShare(), at, prior))


@query(f"""WITH {Q.BOTH}, s AS (SELECT query_id, chunk_id, rank AS pool_rank, {WORDS.format('b.text')} AS q, {WORDS.format('substr(d.text, 1, 1200)')} AS c FROM d50 JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 30),
    r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(100.0::double * len(list_intersect(q, c)) / nullif(len(q), 0), 6) DESC, pool_rank) AS rank FROM s),
    places AS (SELECT query_id, chunk_id, rank AS place FROM r WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, 10000000 + rank FROM l50 WHERE rank <= 20),
    pool AS (SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY min(place)) - 1)::int AS position FROM places GROUP BY query_id, chunk_id),
    {read_sql(550)}, supp AS (SELECT c.query_id, min(r.rank - 1) AS best, count(*) AS c FROM cand c LEFT JOIN r USING (query_id, chunk_id) WHERE share >= 50 GROUP BY c.query_id),
    rows AS (SELECT item_id, c IS NOT NULL AS in_corpus, best FROM benchmark LEFT JOIN supp ON query_id = item_id) SELECT count(*) AS n, {', '.join(ONE.format(f'best < {k}', f'coverage_at_{k}') for k in M.KS)}, {ONE.format('in_corpus', 'in_corpus_rate')},
    round(1 - avg(CASE WHEN in_corpus THEN 1.0::double ELSE 0.0::double END), 3) AS corpus_gap_rate, {ONE.format('in_corpus AND (best IS NULL OR best >= 5)', 'present_but_ranked_below5')} FROM rows""")
def claim_coverage_reranked(spark, sf_dir):
    """Claim coverage whose dense ranks are those of a reranked pool of 30."""
    at, chunks = folder(spark), Q.chunk_rows(spark, sf_dir)
    dense, lexical = Q.both(spark, sf_dir)
    dense = P.written(P.reranked(dense.filter("rank <= 30"), Q.questions(spark, sf_dir), chunks, 30), f"{at}/dense")
    pool = R.candidate_pool(dense, P.written(lexical, f"{at}/bm25"), per_list=20, most=40)
    return M.claim_coverage(P.claim_rows(Q.questions(spark, sf_dir), pool, dense, chunks, client.OverlapReader(), at))


#: Results of a collection come from the balances of its customers.
RESULTS = """r AS (SELECT n_nationkey AS k, n_name AS repo, CASE WHEN n_regionkey % 2 = 0 THEN 'forum' ELSE 'synthetic' END AS eval_mode, count(c_custkey) AS n, count(*) FILTER (c_acctbal > 0) AS good, count(*) FILTER (c_acctbal > 5000) AS best FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)"""


def result_files(spark, sf_dir) -> str:
    """Result files of the collections (nations), written under a folder; some collections lack some of them."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    counts = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_nationkey").alias("k"), F.col("n_name").alias("repo"))
    r = counts.agg(F.count("c_custkey").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("good"), F.count_if(F.col("c_acctbal") > 5000).alias("best"))
    k, share = F.col("k"), lambda x: F.col(x) / F.greatest(F.col("n"), F.lit(1)).cast("double")
    five = lambda x: F.create_map(F.lit("1"), F.lit(0.0), F.lit("5"), x)

    def kind(name, keep, content):
        return r.filter(keep).select(F.format_string(name, "repo").alias("path"), F.to_json(content).cast("binary").alias("content"))

    def summary(lift):
        return F.struct(F.struct(F.col("good").cast("double").alias("base_mean_score"), F.col("best").cast("double").alias("rag_mean_score"), lift.cast("double").alias("mean_lift"), F.array(lift - 1.5, lift + 1.5).alias("lift_ci95"), F.col("best").alias("rag_wins"), k.cast("long").alias("ties"), (F.col("n") - F.col("best")).alias("rag_losses")).alias("summary"))

    rows = kind("analyze_%s.json", k % 4 != 0, F.struct(five(share("good")).alias("coverage_at"), F.when(k % 3 != 0, 1 - share("good")).alias("corpus_gap_rate")))
    rows = rows.unionByName(kind("recall_%s.json", k % 2 == 0, F.struct(F.create_map(F.lit("vector"), F.struct(five(share("best")).alias("recall_at"))).alias("results"))))
    rows = rows.unionByName(kind("ablation_%s_fallback.json", k % 5 != 0, summary(F.col("best") - F.col("good")))).unionByName(kind("ablation_%s.json", k % 6 != 0, summary(F.col("good") - F.col("best"))))
    probe = r.filter(k % 3 != 0).agg(F.map_from_entries(F.collect_list(F.struct("repo", F.struct(F.col("n").cast("double").alias("base_mean_score"))))).alias("base_probe"))  # a row a collection
    rows = rows.unionByName(probe.select(F.lit("selection.json").alias("path"), F.to_json(F.struct("base_probe")).cast("binary").alias("content")))
    at = folder(spark)
    files.write_files(rows, at)
    return at


def result_sql() -> str:
    share = lambda x: f"{x} / greatest(n, 1)::double"
    loose, strict = "k % 5 <> 0", "k % 6 <> 0"
    rows = [("claim_coverage_at5", "k % 4 <> 0", share("good"), "'analyze_' || repo || '.json'"), ("corpus_gap", "k % 4 <> 0 AND k % 3 <> 0", f"1 - {share('good')}", "'analyze_' || repo || '.json'"), ("recall_at5_vector", "k % 2 = 0", share("best"), "'recall_' || repo || '.json'")]
    values = {"lift": "best - good", "ci95_low": "best - good - 1.5::double", "ci95_high": "best - good + 1.5::double", "base_mean": "good", "rag_mean": "best", "wins": "best", "ties": "k", "losses": "n - best"}
    rows += [(f"fallback_{m}", loose, v, "'ablation_' || repo || '_fallback.json'") for m, v in values.items()] + [("strict_lift", strict, "good - best", "'ablation_' || repo || '.json'")]
    probed = "eval_mode = 'forum' AND k % 3 <> 0"
    told = " UNION ALL ".join(f"SELECT repo, '{m}' AS measure, CASE WHEN {c} THEN ({v})::double END AS value, CASE WHEN {c} THEN {f} END AS file FROM r" for m, c, v, f in rows)
    base = f"SELECT repo, 'base_familiarity' AS measure, CASE WHEN {probed} THEN n WHEN {loose} THEN good END::double AS value, CASE WHEN {probed} THEN 'selection.json' WHEN {loose} THEN 'ablation_' || repo || '_fallback.json' END AS file FROM r"
    return f"WITH {RESULTS} SELECT repo, measure, round(value, 6) AS value, file FROM ({told} UNION ALL {base})"


@query(result_sql())
def synthesis_files(spark, sf_dir):
    """Every collection's numbers from the result files that there are, with the file that each came from."""
    at = result_files(spark, sf_dir)
    collections = table(spark, sf_dir, "nation").select(F.col("n_name").alias("repo"), F.when(F.col("n_regionkey") % 2 == 0, "forum").otherwise("synthetic").alias("eval_mode"))
    return resumable.synthesis(collections, at).withColumn("value", F.round("value", 6))
