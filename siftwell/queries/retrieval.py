"""Dense, lexical, hybrid and reranked retrieval, pools and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators import inverted
from siftwell.operators import retrieval as R
from siftwell.queries.registry import query, table

K = 10


def corpus(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def bm25(spark, sf_dir, k: int):
    """From the stored index of the documents, which the first call builds: others read no text."""
    return inverted.topk(inverted.stored(corpus(spark, sf_dir)), questions(spark, sf_dir), k)


def bm25_sql(question: str = "text") -> str:
    """Common table expressions up to ``bm25(query_id, chunk_id, score)``, every score that is not zero."""
    return f"""tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents),
    dl AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS dl FROM documents),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    raw AS (SELECT term, ln(n - df + 0.5::double) - ln(df + 0.5::double) AS idf FROM df, st), idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25::double * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
    qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower({question}), '[a-z0-9_]+')) AS term FROM benchmark) GROUP BY ALL),
    bm25 AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum(qtf * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))), 6) AS score
    FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL)"""


def rank_sql(rows: str, k: int) -> str:
    return f"SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::int AS rank FROM {rows}) WHERE rank <= {k}"


VECTORS = """dense AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_dot_product(e.embedding::double[], q.embedding::double[]), 6) AS score FROM embeddings e, embeddings q WHERE {0})"""


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def asked(spark, sf_dir, condition: str):
    return table(spark, sf_dir, "embeddings").filter(condition).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(f"WITH {bm25_sql()} {rank_sql('bm25', K)}")
def bm25_topk(spark, sf_dir):
    return bm25(spark, sf_dir, K)


@query(f"WITH {bm25_sql()} {rank_sql('bm25', K)}")
def bm25_topk_scan(spark, sf_dir):
    """Without an index: two passes over the texts."""
    return R.bm25_topk(corpus(spark, sf_dir), questions(spark, sf_dir), K)


@query(f"""WITH {bm25_sql()}, filled AS (SELECT q.item_id AS query_id, d.doc_id AS chunk_id, coalesce(b.score, 0) AS score FROM benchmark q CROSS JOIN documents d LEFT JOIN bm25 b ON b.query_id = q.item_id AND b.chunk_id = d.doc_id)
    {rank_sql('filled', 50)}""")
def bm25_topk_zero_filled(spark, sf_dir):
    return R.bm25_topk(corpus(spark, sf_dir), questions(spark, sf_dir), 50, zero_filled=True)


@query(f"WITH {VECTORS.format('q.vec_id % 10 = 0')} {rank_sql('dense', 5)}")
def vector_topk(spark, sf_dir):
    return R.vector_topk(vectors(spark, sf_dir), asked(spark, sf_dir, "vec_id % 10 = 0"), 5)


BOTH = f"""{bm25_sql()}, {VECTORS.format('q.vec_id IN (SELECT item_id FROM benchmark)')}, d50 AS ({rank_sql('dense', 50)}), l50 AS ({rank_sql('bm25', 50)})"""
NORM = "(score - min(score) OVER w) / coalesce(nullif(max(score) OVER w - min(score) OVER w, 0), 1)"
HYBRID = f"""{BOTH}, a AS (SELECT query_id, chunk_id, {NORM} AS s FROM d50 WINDOW w AS (PARTITION BY query_id)), b AS (SELECT query_id, chunk_id, {NORM} AS s FROM l50 WINDOW w AS (PARTITION BY query_id)),
    hybrid AS (SELECT query_id, chunk_id, round(0.5::double * coalesce(a.s, 0) + 0.5::double * coalesce(b.s, 0), 6) AS score FROM a FULL JOIN b USING (query_id, chunk_id))"""


def both(spark, sf_dir):
    q = questions(spark, sf_dir)
    dense = R.vector_topk(vectors(spark, sf_dir), asked(spark, sf_dir, "true").join(q.select("query_id"), "query_id", "left_semi"), R.POOL)
    return dense, bm25(spark, sf_dir, R.POOL)


@query(f"WITH {HYBRID} {rank_sql('hybrid', K)}")
def hybrid_topk(spark, sf_dir):
    return R.hybrid_topk(*both(spark, sf_dir), K)


@query(f"WITH {bm25_sql()}, l50 AS ({rank_sql('bm25', 50)}) SELECT query_id, chunk_id, round({NORM}, 6) AS norm FROM l50 WINDOW w AS (PARTITION BY query_id)")
def minmax_norm(spark, sf_dir):
    rows = R.normalize_scores(bm25(spark, sf_dir, R.POOL))
    return rows.select("query_id", "chunk_id", F.round("norm", 6).alias("norm"))


@query(f"""WITH {bm25_sql()}, pool AS ({rank_sql('bm25', 30)}), s AS (SELECT query_id, chunk_id, rank AS pool_rank, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9_]+')) AS q,
    list_distinct(regexp_extract_all(lower(substr(d.text, 1, 1200)), '[a-z0-9_]+')) AS c FROM pool JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = chunk_id),
    r AS (SELECT query_id, chunk_id, pool_rank, round(100.0::double * len(list_intersect(q, c)) / nullif(len(q), 0), 6) AS score FROM s)
    SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pool_rank)::int AS rank FROM r) WHERE rank <= {K}""")
def rerank_topk(spark, sf_dir):
    """The scorer reads a content's first 1,200 characters, as the reranker does."""
    q, c = questions(spark, sf_dir), corpus(spark, sf_dir)
    pool = bm25(spark, sf_dir, R.RERANK_POOL)
    return R.rerank(pool.join(q, "query_id").join(c, "chunk_id"), K)


POOLED = f"""{BOTH}, places AS (SELECT query_id, chunk_id, rank AS place FROM d50 WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, 10000000 + rank FROM l50 WHERE rank <= 20),
    pool AS (SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY min(place)) - 1)::int AS position FROM places GROUP BY query_id, chunk_id)"""


def pool(spark, sf_dir, per_list: int = 20, most: int | None = 40):
    return R.candidate_pool(*both(spark, sf_dir), per_list=per_list, most=most)


@query(f"WITH {POOLED} SELECT * FROM pool WHERE position < 40")
def candidate_pool(spark, sf_dir):
    return pool(spark, sf_dir)


ANSWER = f"""near AS (SELECT q.vec_id - 1 AS query_id, e.vec_id AS chunk_id, round(list_dot_product(e.embedding::double[], q.embedding::double[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id - 1 IN (SELECT item_id FROM benchmark)),
    answer AS ({rank_sql('near', 5)})"""


def curated_pool(spark, sf_dir):
    """The answer's nearest chunks first, then the question's, then BM25's. The vector after a question's stands in for its answer's."""
    q = questions(spark, sf_dir).select("query_id")
    ids = asked(spark, sf_dir, "true").withColumn("query_id", F.col("query_id") - 1).join(q, "query_id", "left_semi")
    return R.candidate_pool(R.vector_topk(vectors(spark, sf_dir), ids, 5), *both(spark, sf_dir), per_list=5)


@query(f"""WITH {BOTH}, {ANSWER},
    places AS (SELECT query_id, chunk_id, rank AS place FROM answer UNION ALL SELECT query_id, chunk_id, 10000000 + rank FROM d50 WHERE rank <= 5 UNION ALL SELECT query_id, chunk_id, 20000000 + rank FROM l50 WHERE rank <= 5)
    SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY min(place)) - 1)::int AS position FROM places GROUP BY query_id, chunk_id""")
def curation_pool(spark, sf_dir):
    return curated_pool(spark, sf_dir)


def chunk_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    heading = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.lit(""))
    return d.select(F.col("doc_id").alias("chunk_id"), F.concat_ws("/", "source", "doc_id").alias("doc_path"), heading.alias("heading"), F.col("text").alias("content"))


PLACE = "concat_ws('/', source, doc_id) || CASE WHEN doc_id % 3 = 0 THEN ' § ' || lang ELSE '' END"


@query(f"""WITH {bm25_sql()}, top AS ({rank_sql('bm25', 5)}) SELECT query_id, string_agg('[' || rank || '] (' || {PLACE} || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
    FROM top JOIN documents ON doc_id = chunk_id GROUP BY query_id""")
def build_context(spark, sf_dir):
    return R.build_context(bm25(spark, sf_dir, 5), chunk_rows(spark, sf_dir))


@query(f"""WITH {POOLED} SELECT query_id, string_agg('[' || position || '] (' || {PLACE} || ')' || chr(10) || CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || ' …' ELSE text END, chr(10) || chr(10) ORDER BY position) AS prompt
    FROM pool JOIN documents ON doc_id = chunk_id WHERE position < 10 GROUP BY query_id""")
def candidate_prompt(spark, sf_dir):
    return R.candidate_prompt(pool(spark, sf_dir, most=10), chunk_rows(spark, sf_dir))
