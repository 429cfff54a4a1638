"""Documents to a corpus of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import clean_mdx, clean_rst
from siftwell.operators import chunking
from siftwell.services import client
from siftwell.sources import code, files

LEAST = 40


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs(doc_path, text)`` cleaned by suffix; what is left must have LEAST characters."""
    rst = F.endswith("doc_path", F.lit(".rst"))
    text = F.when(rst, clean_rst(F.col("text"))).otherwise(clean_mdx(F.col("text")))
    return docs.select("doc_path", text.alias("text")).filter(F.length("text") >= LEAST)


def build_corpus(spark: SparkSession, folder: str, out: str, suffixes: tuple[str, ...] = (".md", ".mdx", ".rst"), snippets: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Scan, expand examples, clean, add reference pages of Python ``sources(path, text)``, chunk by headings, write; gives the written
    chunks. Order is by (doc_path, chunk_index)."""
    docs = files.scan_documents(spark, folder, suffixes, min_chars=0)
    if snippets is not None:
        docs = code.expand_includes(docs, snippets)
    docs = cleaned(docs)
    if sources is not None:
        docs = docs.unionByName(code.extract_api_docs(sources))
    chunking.chunk_markdown(docs).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


EMBEDDING = "model string, content_hash string, vector array<float>"


def embedded(chunks: DataFrame, store: str, model: str, encoder, column: str = "content") -> DataFrame:
    """``chunks`` with ``vector``, from a store of vectors by model and sha256 of the text: only texts that the store lacks are encoded, each once, and
    added to it. Edited texts have another hash, so no vector outlives its text; chunks with a null text have a null vector."""
    spark = chunks.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(store)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    known = (spark.read.schema(EMBEDDING).parquet(store) if there else spark.createDataFrame([], EMBEDDING)).filter(F.col("model") == model)
    keyed = chunks.withColumn("content_hash", F.sha2(F.col(column).cast("binary"), 256))
    missing = keyed.select("content_hash", F.col(column).alias("text")).filter("text is not null").dropDuplicates(["content_hash"]).join(known, "content_hash", "left_anti")
    made = client.embed(missing.select("content_hash", "text"), encoder).select(F.lit(model).alias("model"), "content_hash", "vector")
    made.write.mode("append").parquet(store)
    vectors = spark.read.schema(EMBEDDING).parquet(store).filter(F.col("model") == model).select("content_hash", "vector").dropDuplicates(["content_hash"])
    return keyed.join(vectors, "content_hash", "left").drop("content_hash")
