"""Batched retrieval: ranked rows (query_id, chunk_id, score, rank) for all questions at once.

Scores are rounded to six digits before ranking and ties go to the smaller id, so that ranks do not hang on the order of a sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import kernels
from siftwell.functions.text import provenance, shorten, tokenize, word_set
from siftwell.functions.vectors import minmax
from siftwell.session import ship

K1, B, EPSILON = 1.5, 0.75, 0.25
DIGITS = 6
POOL, RERANK_POOL = 50, 30
#: Questions that travel to the corpus at a time.
BLOCK, BLOCK_BYTES = 4096, 32 << 20
#: Chunks of a cell of the grid, where questions are more than a block.
CELL = 1 << 15


def ranked(scored: DataFrame, k: int | None, partition: str = "query_id", item: str = "chunk_id", score: str = "score") -> DataFrame:
    """rank from 1 within each question by rounded score, ties by id; only the first k."""
    out = scored.withColumn(score, F.round(score, DIGITS))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(partition).orderBy(F.desc(score), item)))
    return out if k is None else out.filter(F.col("rank") <= k)


def _blocks(questions: DataFrame, size: Column) -> Iterator[pa.Table]:
    """The questions, about BLOCK of them and BLOCK_BYTES at a time by the ``size`` in bytes of each: a pass over the corpus for each block, one block on the
    driver at once."""
    n, total = questions.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK), -(-int(total) // BLOCK_BYTES))
    for i in range(blocks):
        part = questions if blocks == 1 else questions.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        yield part.toArrow()


def _merged(parts: list[DataFrame], k: int) -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return ranked(every, k)


def _given(corpus: DataFrame, questions: DataFrame) -> str:
    return f"query_id {dict(questions.dtypes)['query_id']}, chunk_id {dict(corpus.dtypes)['chunk_id']}, score double"


def bm25_topk(corpus: DataFrame, questions: DataFrame, k: int, zero_filled: bool = False) -> DataFrame:
    """BM25 top k of ``corpus(chunk_id, content)`` for ``questions(query_id, question)``; a repeated word of a question counts each time.
    ``zero_filled``: every chunk takes part, those without a shared word with score 0.

    Two passes over the corpus: document counts of all words, which the statistics need and which are combined before their shuffle, and
    the scores. For these only the numbers of the questions' words travel; a task adds up a tile of chunks times questions and keeps k a
    question, so postings are never shuffled and a frequent word makes no rows.
    """
    spark = corpus.sparkSession
    ship(spark)
    tokens = corpus.select("chunk_id", tokenize(F.coalesce("content", F.lit(""))).alias("t"))
    df = tokens.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).persist()
    try:
        size = tokens.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("length")).first()
        idf = F.log(F.lit(size.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        floor = (df.agg(F.avg(idf)).first()[0] or 0.0) * EPSILON
        parts = []
        for block in _blocks(questions.select("query_id", F.coalesce(tokenize(F.col("question")), F.expr("cast(array() as array<string>)")).alias("words")), 12 * F.size("words") + 64):
            names, words = block.column(0).combine_chunks(), block.column(1).combine_chunks()
            asked = pc.unique(words.flatten())
            rows = spark.createDataFrame(pa.table({"term": asked})).join(df, "term").select("term", F.when(idf < 0, F.lit(floor)).otherwise(idf).alias("idf")).toArrow()
            terms = rows.column(0).to_pylist()
            number = np.asarray(pc.fill_null(pc.index_in(words.flatten(), pa.array(terms, pa.string())), -1)).astype(np.int64)
            question = np.repeat(np.arange(len(names)), np.asarray(words.value_lengths()))
            pairs = np.stack((number, question), axis=1)[number >= 0]
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            run = kernels.lexical(names, terms, np.asarray(rows.column(1).to_numpy(), np.float64), pairs, size.length or 1.0, k, DIGITS, K1, B, zero_filled)
            parts.append(tokens.mapInArrow(run, _given(corpus, questions)))
    finally:
        df.unpersist()
    return _merged(parts, k)


def vector_topk(corpus: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Exact dense top k: ``corpus(chunk_id, vector)``, ``questions(query_id, vector)``, vectors of unit length. Vectors that are null, hold a null or are of another length than
    the question's take no part.

    Questions of a block's size travel to the corpus, which is not shuffled: a task multiplies tiles and keeps its own k a question. More of
    them make a grid of slices of questions and cells of CELL chunks, which meet by key; a cell keeps k a question of its slice."""
    spark = corpus.sparkSession
    ship(spark)
    source = corpus.select("chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    asked = questions.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(16 + 8 * F.size("vector")), F.lit(0))).first()
    slices = max(1, -(-n // BLOCK), -(-int(size) // BLOCK_BYTES))
    if slices == 1:
        return ranked(source.mapInArrow(kernels.dense(asked.toArrow(), k, DIGITS), _given(corpus, questions)), k)
    cells = max(1, -(-corpus.count() // CELL))
    left = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(slices)).alias("slice"), F.expr(f"explode(sequence(0L, {cells - 1}L))").alias("cell"), "query_id", "vector")
    right = source.select(F.expr(f"explode(sequence(0L, {slices - 1}L))").alias("slice"), F.pmod(F.xxhash64("chunk_id"), F.lit(cells)).alias("cell"), "chunk_id", "vector")

    def run(mine: pa.Table, chunks: pa.Table) -> pa.Table:
        found = list(kernels.dense(mine.select(["query_id", "vector"]), k, DIGITS)(iter(chunks.select(["chunk_id", "vector"]).to_batches())))
        return pa.Table.from_batches(found) if found else pa.table({"query_id": mine["query_id"].slice(0, 0), "chunk_id": chunks["chunk_id"].slice(0, 0), "score": pa.array([], pa.float64())})

    return ranked(left.groupBy("slice", "cell").cogroup(right.groupBy("slice", "cell")).applyInArrow(run, _given(corpus, questions)), k)


def normalize_scores(rows: DataFrame) -> DataFrame:
    """Min-max of ``score`` within each question as ``norm``; a constant list gives zeros."""
    w = Window.partitionBy("query_id")
    return rows.withColumn("norm", minmax(F.col("score"), F.min("score").over(w), F.max("score").over(w)))


def hybrid_topk(dense: DataFrame, lexical: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    """Convex blend of two min-max scaled pools; an id that one pool lacks counts as 0 there. Fewer ids than k give fewer rows."""
    a = normalize_scores(dense).select("query_id", "chunk_id", F.col("norm").alias("a"))
    b = normalize_scores(lexical).select("query_id", "chunk_id", F.col("norm").alias("b"))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer")
    zero = F.lit(0.0)
    score = F.lit(alpha) * F.coalesce("a", zero) + F.lit(1 - alpha) * F.coalesce("b", zero)
    return ranked(both.select("query_id", "chunk_id", score.alias("score")), k)


def overlap_score(question: Column, content: Column) -> Column:
    """A lexical stand-in for a cross-encoder: the share of the question's words that the content has, of 100."""
    q = word_set(question)
    return 100.0 * F.size(F.array_intersect(q, word_set(content))) / F.nullif(F.size(q), F.lit(0))


def rerank(pool: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = overlap_score, chars: int = 1200) -> DataFrame:
    """``pool(query_id, chunk_id, rank, question, content)`` scored anew; equal scores keep their order in the pool."""
    scored = pool.withColumn("score", F.round(scorer(F.col("question"), F.substring("content", 1, chars)), DIGITS)).withColumnRenamed("rank", "pool_rank")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "pool_rank")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def candidate_pool(*lists: DataFrame, per_list: int, most: int | None = None) -> DataFrame:
    """Ids of several ranked lists without repeats, in list order and then rank order: (query_id, chunk_id, position from 0)."""
    every = None
    for i, rows in enumerate(lists):
        rows = rows.filter(F.col("rank") <= per_list).select("query_id", "chunk_id", (F.lit(i * 10_000_000) + F.col("rank")).alias("place"))
        every = rows if every is None else every.unionByName(rows)
    first = every.groupBy("query_id", "chunk_id").agg(F.min("place").alias("place"))
    out = first.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("place")) - 1)
    return (out if most is None else out.filter(F.col("position") < most)).select("query_id", "chunk_id", "position")


def build_context(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, context): ``[i] (place)`` and the content of each ranked chunk, from 1, a blank line between."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), provenance(F.col("doc_path"), F.col("heading")), F.lit(")\n"), F.col("content"))
    found = rows.join(chunks, "chunk_id").select("query_id", "rank", block.alias("block"))
    return _joined(found, "rank", "context")


def candidate_prompt(pool: DataFrame, chunks: DataFrame, chars: int = 500) -> DataFrame:
    """(query_id, prompt): numbered candidates from 0, contents shortened. The number of candidates bounds a prompt, not a cut at its end."""
    block = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] ("), provenance(F.col("doc_path"), F.col("heading")), F.lit(")\n"), shorten(F.col("content"), chars))
    found = pool.join(chunks, "chunk_id").select("query_id", "position", block.alias("block"))
    return _joined(found, "position", "prompt")


def _joined(rows: DataFrame, order: str, name: str) -> DataFrame:
    blocks = F.array_sort(F.collect_list(F.struct(order, "block")))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda x: x["block"]), "\n\n").alias(name))
