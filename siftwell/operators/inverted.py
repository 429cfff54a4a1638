"""A stored inverted index: chunks are tokenised once, and every later question reads postings only.

Chunks fall into ranges of ``span`` at most, as they are read, and stand in the order of their ids within one. A block holds a word's postings within a
range: gaps between chunks' places and counts, with the largest weight that a posting of it can add to a score; one more row holds the range's ids and
lengths. The task that reads a range's chunks writes its blocks, so neither texts nor postings are shuffled to build.

A question is answered in two rounds. The largest weights alone, a narrow column, bound its scores in each range. The most promising ranges are
scored, which gives the score that its k-th best chunk has at least; then those of the other ranges whose bound reaches it. Only blocks of the questions' words
leave their task: these words are broadcast. Ranges and slices of the
questions make a grid: blocks and questions meet by (range, slice), and a cell keeps k a question, so postings travel once a slice and
no cell holds more than ``span`` chunks and SLICE questions.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import kernels
from siftwell.functions.text import tokenize
from siftwell.operators.retrieval import DIGITS, EPSILON, K1, B, ranked
from siftwell.session import shared_folder, ship

SPAN = 1024
#: Questions that a cell of the grid holds, about; postings that are added up at a time.
SLICE, TILE = 2048, 1 << 21
#: Words that are counted at a time while an index is built; words of a range, about, one chunk at least.
RUN_WORDS, RANGE_WORDS = 1 << 17, 1 << 20
#: Bytes of the questions' words that a broadcast may hold.
SENT_BYTES = 32 << 20
BLOCKS = "range long, term string, n int, most double, gaps array<int>, tfs array<int>, ids array<{0}>, lengths array<int>"


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    folder: str
    n: int
    mean_length: float
    floor: float
    span: int
    id_type: str

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(BLOCKS.format(self.id_type)) if name == "blocks" else self.spark.read  # no file tells it where no chunk has a word
        return reader.parquet(f"{self.folder}/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For batches (doc_no, words): a row (term, doc_no, tf, dl) for each word of a chunk, about RUN_WORDS words at a time, one chunk at least."""
    for whole in batches:
        for i, j in kernels.runs(np.asarray(whole.column(1).value_lengths()).astype(np.int64), RUN_WORDS):
            batch = whole.slice(i, j - i)
            lists = batch.column(1)
            length = np.asarray(lists.value_lengths()).astype(np.int64)
            words = lists.flatten().dictionary_encode()
            codes = np.asarray(words.indices).astype(np.int64)
            kinds = max(1, len(words.dictionary))
            key, tf = np.unique(np.repeat(np.arange(batch.num_rows), length) * kinds + codes, return_counts=True)
            row, code = np.divmod(key, kinds)
            numbers = np.asarray(batch.column(0)).astype(np.int64)
            columns = [words.dictionary.take(pa.array(code)), pa.array(numbers[row]), pa.array(tf.astype(np.int32)), pa.array(length[row].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["term", "doc_no", "tf", "dl"])


def _blocks(number: int, chunks: pa.RecordBatch, mean: float) -> Iterator[pa.RecordBatch]:
    """The rows of a range, whose ``chunks`` are (chunk_id, words): its ids and lengths, then its words' blocks in their order."""
    chunks = chunks.take(pc.sort_indices(chunks.column(0), null_placement="at_start"))
    ids, words = chunks.columns
    of_ids, ints = pa.list_(ids.type), pa.list_(pa.int32())

    def rows(term: pa.Array, n: np.ndarray, most: np.ndarray, *lists: pa.Array) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(term), number)), term, pa.array(n.astype(np.int32)), pa.array(most.astype(np.float64)), *lists]
        return pa.RecordBatch.from_arrays(columns, ["range", "term", "n", "most", "gaps", "tfs", "ids", "lengths"])

    lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
    whole = np.array([0, len(chunks)])
    lengths = pc.cast(words.value_lengths(), pa.int32())
    yield rows(pa.nulls(1, pa.string()), np.zeros(1), np.zeros(1), pa.nulls(1, ints), pa.nulls(1, ints), lists(whole, ids), lists(whole, lengths))
    found = list(counted(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(len(chunks))), words], ["doc_no", "words"])])))
    found = pa.Table.from_batches(found).combine_chunks()
    if not found.num_rows:
        return
    terms = found["term"].combine_chunks().dictionary_encode()
    by_name = np.asarray(pc.sort_indices(terms.dictionary))
    place = np.empty(len(by_name), np.int64)
    place[by_name] = np.arange(len(by_name))
    place = place[np.asarray(terms.indices)]
    order = np.lexsort((np.asarray(found["doc_no"]), place))
    place, at, tf, length = place[order], *(np.asarray(found[c])[order].astype(np.int64) for c in ("doc_no", "tf", "dl"))
    begin = np.flatnonzero(np.diff(place, prepend=-1))
    gaps = np.diff(at, prepend=0)
    gaps[begin] = at[begin]
    impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
    ends = np.append(begin, len(at))
    postings = [lists(ends, pa.array(x.astype(np.int32))) for x in (gaps, tf)]
    none = len(begin)
    yield rows(terms.dictionary.take(pa.array(by_name)), np.diff(ends), np.maximum.reduceat(impact, begin), *postings, pa.nulls(none, of_ids), pa.nulls(none, ints))


def ranges(span: int, mean: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches (chunk_id, words): the rows of ranges of ``span`` chunks at most and RANGE_WORDS words, about; no two tasks share a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j in kernels.runs(np.asarray(batch.column(1).value_lengths()).astype(np.int64), RANGE_WORDS):
                for a in range(i, j, span):
                    yield from _blocks(number, batch.slice(a, min(span, j - a)), mean)
                    number += 1

    return run


def build(corpus: DataFrame, folder: str, span: int = SPAN) -> Index:
    """Index ``corpus(chunk_id, content)`` under ``folder``: tables blocks(range, term, n, most, gaps, tfs, ids, lengths), terms(term, df, idf), and meta, which is
    written last. Two passes over the texts, one for their number and mean length. A null content has no words; rows that share an id are chunks by themselves."""
    spark = corpus.sparkSession
    ship(spark)
    id_type = dict(corpus.dtypes)["chunk_id"]
    words = F.coalesce(tokenize(F.col("content")), F.expr("cast(array() as array<string>)"))
    tokens = corpus.select("chunk_id", words.alias("words"))
    size = tokens.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    n, mean = size.n, float(size.mean or 1.0)
    tokens.mapInArrow(ranges(span, mean), BLOCKS.format(id_type)).write.mode("overwrite").parquet(f"{folder}/blocks")

    index = Index(spark, folder, n, mean, 0.0, span, id_type)
    idf = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = index.table("blocks").filter("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    df.withColumn("idf", idf).write.mode("overwrite").parquet(f"{folder}/terms")
    floor = (spark.read.parquet(f"{folder}/terms").agg(F.avg("idf")).first()[0] or 0.0) * EPSILON
    meta = spark.createDataFrame([(n, mean, float(floor), span, id_type)], "n long, mean_length double, floor double, span int, id_type string")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")
    return opened(spark, folder)


def opened(spark: SparkSession, folder: str) -> Index:
    m = spark.read.parquet(f"{folder}/meta").first()
    return Index(spark, folder, m.n, m.mean_length, m.floor, m.span, m.id_type)


def fingerprint(corpus: DataFrame) -> str:
    """Of a corpus read from files: its plan, and the names, sizes and times of its files. Edited files have another."""
    spark, out = corpus.sparkSession, hashlib.sha256(str(corpus.semanticHash()).encode())
    for name in sorted(corpus.inputFiles()):
        where = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
        out.update(f"{name} {status.getLen()} {status.getModificationTime()}\n".encode())
    return out.hexdigest()


def stored(corpus: DataFrame) -> Index:
    """The index of a corpus that is read from files, from the cluster's shared folder if it is there, else built there."""
    spark = corpus.sparkSession
    folder = f"{shared_folder(spark)}/siftwell-ranges-{fingerprint(corpus)[:32]}"
    return opened(spark, folder) if _exists(spark, f"{folder}/meta/_SUCCESS") else build(corpus, folder)


def _saved(df: DataFrame) -> DataFrame:
    return _reader(df)()


def _reader(df: DataFrame) -> Callable[[], DataFrame]:
    """Reads the rows of ``df``, which are written once; each call gives a table of its own, so two of them can meet."""
    path = f"{shared_folder(df.sparkSession)}/siftwell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return lambda: df.sparkSession.read.parquet(path)


def cell(k: int, mean_length: float) -> Callable:
    """The k best chunks of each question in a cell. ``asked``: rows (range, slice, query_id, words), words (no, w); ``blocks``: of the range's words by their numbers,
    and the row of its ids and lengths."""

    def run(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        about = blocks.filter(pc.is_valid(blocks["ids"]))
        blocks = blocks.filter(pc.is_valid(blocks["no"]))
        if not asked.num_rows or not blocks.num_rows:
            return pa.table({"query_id": asked["query_id"].slice(0, 0), "chunk_id": about["ids"].combine_chunks().flatten().slice(0, 0), "score": pa.array([], pa.float64())})
        ids, dl = about["ids"].combine_chunks().flatten(), np.asarray(about["lengths"].combine_chunks().flatten())
        span = len(ids)
        size = np.asarray(pc.list_value_length(blocks["gaps"])).astype(np.int64)
        begin = np.cumsum(size) - size
        flat = lambda c: np.asarray(blocks[c].combine_chunks().flatten()).astype(np.int64)
        upto = np.cumsum(flat("gaps"))
        at = upto - np.repeat(np.concatenate(([0], upto))[begin], size)
        tf = flat("tfs")
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[at] / mean_length))
        names = asked["query_id"].combine_chunks().dictionary_encode()
        lists = asked["words"].combine_chunks()
        question = np.repeat(np.asarray(names.indices).astype(np.int64), np.asarray(lists.value_lengths()))
        word = lists.flatten()
        which = np.asarray(pc.fill_null(pc.index_in(word.field("no"), blocks["no"].combine_chunks()), -1)).astype(np.int64)
        weight = word.field("w").to_numpy()
        order = np.argsort(question, kind="stable")
        order = order[which[order] >= 0]
        question, which, weight = question[order], which[order], weight[order]
        out = []
        a = 0
        while a < len(question):  # whole questions, about TILE postings or cells at a time
            cells = np.cumsum(size[which[a:]])
            b = a + max(1, int(np.searchsorted(cells, TILE, "right")))
            b = min(b, int(np.searchsorted(question, question[a] + TILE // span, "left")))
            last = int(np.searchsorted(question, question[b - 1], "left"))
            b = last if last > a else int(np.searchsorted(question, question[b - 1], "right"))
            w, q, x = which[a:b], question[a:b] - question[a], size[which[a:b]]
            posting = np.repeat(begin[w] - (np.cumsum(x) - x), x) + np.arange(int(x.sum()))
            where = at[posting] * (int(q[-1]) + 1) + np.repeat(q, x)
            shape = (span, int(q[-1]) + 1)
            scores = np.bincount(where, np.repeat(weight[a:b], x) * impact[posting], shape[0] * shape[1]).reshape(shape)
            best = kernels.Best(k, DIGITS)
            best.add(np.arange(span), scores, np.bincount(where, minlength=shape[0] * shape[1]).reshape(shape) > 0)
            out.append((best.question + question[a], best.ids, best.score))
            a = b
        if not out:
            return run(asked.slice(0, 0), blocks)
        q, place, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": names.dictionary.take(pa.array(q)), "chunk_id": ids.take(pa.array(place)), "score": pa.array(score)})

    return run


def topk(index: Index, questions: DataFrame, k: int, promising: int = 2) -> DataFrame:
    """BM25 top k (query_id, chunk_id, score, rank) of the indexed chunks for ``questions(query_id, question)``; the rows that ``retrieval.bm25_topk`` gives, from
    postings alone. A repeated word of a question counts each time; a question without a known word has no rows."""
    ship(index.spark)
    asked = questions.select("query_id", F.explode(tokenize(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weight = F.col("times") * F.when(F.col("idf") < 0, F.lit(index.floor)).otherwise(F.col("idf"))
    known = _saved(asked.join(index.table("terms"), "term").select("query_id", "term", weight.alias("w")))
    words = _saved(known.select("term").distinct().withColumn("no", F.monotonically_increasing_id()))
    weights = _saved(known.join(words, "term").select("query_id", "no", "w"))
    n, rows = weights.agg(F.count_distinct("query_id"), F.count("*")).first()
    slices = max(1, -(-n // SLICE))
    sent = words.agg(F.coalesce(F.sum(F.octet_length("term") + 48), F.lit(0))).first()[0] <= SENT_BYTES
    blocks = index.table("blocks").join(F.broadcast(words) if sent else words, "term", "left").filter("no is not null or ids is not null").drop("term")

    gain = F.greatest(F.lit(0.0), F.col("w") * F.col("most"))
    heaviest = blocks.select("no", "range", "most").filter("no is not null").join(F.broadcast(weights) if 48 * rows <= SENT_BYTES else weights, "no")
    bounds = _saved(heaviest.groupBy("query_id", "range").agg(F.sum(gain).alias("bound")))
    first = _saved(ranked(bounds.withColumnRenamed("bound", "score"), promising, item="range").select("query_id", "range"))
    early = _saved(_scored(index, blocks, weights, first, slices, k))
    reached = ranked(early, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = bounds.join(first, ["query_id", "range"], "left_anti").join(reached, "query_id", "left")
    rest = rest.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 10.0**-DIGITS)).select("query_id", "range")
    late = _scored(index, blocks, weights, rest, slices, k)
    return ranked(early.unionByName(late), k).select("query_id", "chunk_id", "score", "rank")


def _scored(index: Index, blocks: DataFrame, weights: DataFrame, pairs: DataFrame, slices: int, k: int) -> DataFrame:
    """(query_id, chunk_id, score): the k best of each (query_id, range) of ``pairs``."""
    part = F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int")
    cells = _reader(pairs.select("range", part.alias("slice"), "query_id"))
    lists = weights.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("no", "w"))).alias("words"))
    asked = cells().join(lists, "query_id").select("range", "slice", "query_id", "words")
    wanted = cells().select("range", "slice").distinct()
    given = blocks.join(F.broadcast(wanted), "range").select("range", "slice", "no", "gaps", "tfs", "ids", "lengths")
    key = ["range", "slice"]
    schema = f"query_id {dict(weights.dtypes)['query_id']}, chunk_id {index.id_type}, score double"
    return asked.groupBy(*key).cogroup(given.groupBy(*key)).applyInArrow(cell(k, index.mean_length), schema)
