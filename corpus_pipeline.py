"""The corpus pipeline: documents in, sharded training documents out.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of ``docs``, whatever their names. What a stage
returns is written as Parquet and read again as the next one's ``docs``, and what it needed on the way is dropped then. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import decontaminate, minhash_dedup, mixing, sharding, toxicity
from siftwell.llm.common import Scratch, dropping


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go; it learns from the labelled ones among them. Null texts score as empty ones, null ids
    have no label, and rows that repeat are each judged alike."""
    return toxicity.accepted(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest doc_id stays. Null and empty texts are copies of nothing and stay, as do rows
    with a null id; rows that share an id are each judged by their own text."""
    return minhash_dedup.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which five words in a hundred or more lie in benchmark passages go. Rows are judged one by one; null texts have no words and stay."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, up to two passes, towards equal weights; every document passes once at least. Null and empty sources are one
    source; one without any token passes once."""
    return mixing.mix(docs, details=False)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds slot and shard (in place of columns of these names). Null ids go where the empty text goes."""
    return sharding.place(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: A classifier is trained, so SQL can't express the rows; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs, last = _table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with dropping():
            made = scratch.save(stage(spark, docs, sf_dir))
        if last is not None:
            scratch.drop(last)
        docs = last = made
    return STAGES[-1][1](spark, docs, sf_dir)
