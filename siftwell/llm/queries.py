"""The queries of this subpackage and their oracles; ``__spark_entry__.py`` adds them where the subpackage can be imported."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import block_knn, conversations, decontaminate, html_extract, licences, line_dedup, mixing, oracles, packing, runs, sharding, sstable, toxicity
from siftwell.llm.minhash_dedup import near_duplicates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("text")


def op5_block_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_knn.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % block_knn.EVERY == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(_table(spark, sf_dir, "conversations"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_sstable": op3_sstable,
    "op4_licences": op4_licences,
    "op6_line_dedup": op6_line_dedup,
    "op8_mixing": op8_mixing,
    "op5_block_knn": op5_block_knn,
    "op7_toxicity": op7_toxicity,
    "op9_html_extraction": op9_html_extraction,
    "op10_sharding": op10_sharding,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_packing": op12_packing,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op1_minhash_dedup": oracles.OP1,
    "op2_decontamination": oracles.OP2,
    "op5_block_knn": oracles.OP5,
    "op6_line_dedup": oracles.OP6,
    "op10_sharding": sharding.sql("documents"),
    "op11_conversation_repair": oracles.OP11,
}
