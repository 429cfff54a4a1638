"""Runs that can be taken up again: what a model or a judge did not answer is asked once more, and nothing else is.

A run is a folder: ``settings`` (how its questions were retrieved and asked), ``rows/generation=N`` (a row per question; the last generation that
was written whole counts) and ``calls/generation=N`` (what was answered, with its cost).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import verdicts as J
from siftwell.operators import evalset, metrics, retrieval
from siftwell.plans import evaluate
from siftwell.services import client
from siftwell.sources import files

#: Characters of a question, of a reference and of the retrieved context that a judge of coverage reads.
READ, CONTEXT = 3000, 9000


@dataclass(frozen=True)
class Settings:
    """How a run retrieves and asks; a run that is taken up again goes on in the same way."""

    variant: str = "strict"
    method: str = "vector"
    k: int = 5
    rerank: bool = False


SETTINGS = "variant string, method string, k int, rerank boolean"


def ranks_of(settings: Settings, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Ranked chunks of each question, the pool reranked if the settings say so."""
    if not settings.rerank:
        return evaluate.retrieve(settings.method, chunks, questions, settings.k)
    return evaluate.reranked(evaluate.retrieve(settings.method, chunks, questions, retrieval.RERANK_POOL), questions, chunks, settings.k)


def _generations(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the generations whose rows were written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows/generation=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a run's last whole generation."""
    return spark.read.parquet(f"{folder}/rows/generation={_generations(spark, folder)[-1]}")


def settings_of(spark: SparkSession, folder: str) -> Settings:
    return Settings(**files.scan_json(spark, f"{folder}/settings", SETTINGS).first().asDict())


def usage(spark: SparkSession, folder: str) -> DataFrame:
    """Calls and cost per model and in total over all generations."""
    calls = spark.read.option("recursiveFileLookup", "true").schema("model string, cost_usd double").parquet(f"{folder}/calls")
    return metrics.usage_rollup(calls)


def _answered(questions: DataFrame, chunks: DataFrame, gold: DataFrame, model: client.Client, judge: client.Client, folder: str, settings: Settings, generation: int, budget: int | None) -> DataFrame:
    ranks = evaluate.written(ranks_of(settings, chunks, questions), f"{folder}/ranks/generation={generation}")
    return evaluate.ablation(questions, chunks, ranks, gold, model, judge, f"{folder}/calls/generation={generation}", settings.variant, budget)


def ablation(questions: DataFrame, chunks: DataFrame, gold: DataFrame, model: client.Client, judge: client.Client, folder: str, settings: Settings = Settings(), budget: int | None = None) -> DataFrame:
    """A first run: settings, then answers and verdicts of all questions, then their rows. A question that was not judged has null scores."""
    spark = questions.sparkSession
    files.write_json(spark.createDataFrame([tuple(asdict(settings).values())], SETTINGS).coalesce(1), f"{folder}/settings")
    return evaluate.written(_answered(questions, chunks, gold, model, judge, folder, settings, 0, budget), f"{folder}/rows/generation=0")


def resume(questions: DataFrame, chunks: DataFrame, gold: DataFrame, model: client.Client, judge: client.Client, folder: str, budget: int | None = None) -> DataFrame:
    """The rows of a run after its invalid ones (without two numeric scores) were asked again, with the run's own settings. Valid rows stay as they are,
    questions that the run does not have are not added, and a run without invalid rows makes no call and no generation. Rows are told by their
    id, so the order of ids stays the order of the run."""
    spark = questions.sparkSession
    prior = latest(spark, folder)
    asked = questions.withColumn("id", F.col("query_id").cast("string"))
    bad = evalset.to_rerun(prior, asked.join(prior.select("id"), "id", "left_semi")).drop("id")
    if bad.isEmpty():
        return prior
    generation = _generations(spark, folder)[-1] + 1
    again = _answered(bad, chunks, gold, model, judge, folder, settings_of(spark, folder), generation, budget)
    return evaluate.written(evalset.resume_merge(prior, again), f"{folder}/rows/generation={generation}")


def coverage(questions: DataFrame, ranks: DataFrame, gold: DataFrame, chunks: DataFrame, judge: client.Client, folder: str, prior: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """Strict coverage, (query_id, covered, reason, gold_hit) of ``questions(query_id, question, reference)``: whether the judge finds that the top ``ranks`` hold the
    reference's answer, null where it does not say so in a boolean. Of ``prior`` rows of these columns those with a verdict stay and are
    not asked again. A question without ranked chunks is asked with an empty context."""
    context = retrieval.build_context(ranks, chunks).select("query_id", F.substring("context", 1, CONTEXT).alias("chunks"))
    known = None if prior is None else prior.filter("covered is not null").join(questions.select("query_id"), "query_id", "left_semi").select("query_id", "covered", "reason", "gold_hit")
    asked = questions if known is None else questions.join(known.select("query_id"), "query_id", "left_anti")
    cut = lambda c: F.substring(c, 1, READ).alias(c)
    prompt = F.to_json(F.struct(cut("question"), cut("reference"), F.coalesce("chunks", F.lit("")).alias("chunks")))
    rows = asked.join(context, "query_id", "left").select("query_id", prompt.alias("prompt"))
    replies = evaluate.written(client.call(rows.select(F.col("query_id").cast("string").alias("id"), "prompt"), judge, "judge", budget=budget), f"{folder}/coverage")
    hit = ranks.join(gold, ["query_id", "chunk_id"], "left_semi").select("query_id").distinct().withColumn("gold_hit", F.lit(True))
    o = J.reply_object(F.col("text"))
    told = replies.select("id", J.flag(o, "covered").alias("covered"), F.coalesce(J.string(o, "reason"), F.lit("")).alias("reason"))
    out = asked.select("query_id", F.col("query_id").cast("string").alias("id")).join(told, "id", "left").join(hit, "query_id", "left")
    out = out.select("query_id", "covered", "reason", F.coalesce("gold_hit", F.lit(False)).alias("gold_hit"))
    return out if known is None else out.unionByName(known)


# ------------------------------------------------------------------------------------------------ results of many collections

#: Schemas of result files; what a file lacks is null.
CLAIMS = "coverage_at map<string,double>, corpus_gap_rate double"
RECALL = "results map<string,struct<recall_at:map<string,double>>>"
ABLATION = "summary struct<base_mean_score:double,rag_mean_score:double,mean_lift:double,lift_ci95:array<double>,rag_wins:long,ties:long,rag_losses:long>"
PROBE = "base_probe map<string,struct<base_mean_score:double>>"


def _each(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    """A row for each file ``folder``/``pattern`` with the collection that the ``*`` stands for and the file's name; none if there is no such file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    before, after = pattern.split("*")
    if not found:
        return spark.createDataFrame([], f"repo string, file string, {schema}")
    name = F.col("_metadata.file_name")
    repo = F.regexp_extract(name, rf"^\Q{before}\E(.*)\Q{after}\E$", 1)
    rows = files.scan_json(spark, f"{folder}/{pattern}", schema)
    return rows.select(repo.alias("repo"), name.alias("file"), *rows.columns)


def synthesis(collections: DataFrame, folder: str) -> DataFrame:
    """Numbers of ``collections(repo, eval_mode)`` from the result files of a folder, (repo, measure, value, file): claims (``analyze_*.json``), recall (``recall_*.json``), ablations in both
    variants (``ablation_*_fallback.json``, ``ablation_*.json``) and the probe of all collections (``selection.json``). A missing file or field is a null value whose
    ``file`` is null. A forum's familiarity is the probe's, where it has one, else the ablation's base mean, with the file that it came from."""
    spark = collections.sparkSession
    claims, recall = _each(spark, folder, "analyze_*.json", CLAIMS), _each(spark, folder, "recall_*.json", RECALL)
    every = _each(spark, folder, "ablation_*.json", ABLATION)
    loose = every.filter(F.endswith("repo", F.lit("_fallback"))).withColumn("repo", F.regexp_replace("repo", "_fallback$", ""))
    strict = every.filter(~F.endswith("repo", F.lit("_fallback")))
    probe = files.scan_optional(spark, f"{folder}/selection.json", PROBE).select(F.explode("base_probe").alias("repo", "p")).select("repo", F.lit("selection.json").alias("file"), "p.base_mean_score")

    def told(rows: DataFrame, **measures: Column) -> DataFrame:
        number = [F.struct(F.lit(k).alias("measure"), v.cast("double").alias("value")) for k, v in measures.items()]
        return rows.select("repo", "file", F.explode(F.array(*number)).alias("m")).select("repo", "m.measure", "m.value", "file")

    s = lambda c: F.col(f"summary.{c}")
    at = lambda m, k: F.try_element_at(m, F.lit(k))
    numbers = told(claims, claim_coverage_at5=at(F.col("coverage_at"), "5"), corpus_gap=F.col("corpus_gap_rate"))
    numbers = numbers.unionByName(told(recall, recall_at5_vector=at(at(F.col("results"), "vector")["recall_at"], "5")))
    loose_numbers = {"fallback_lift": s("mean_lift"), "fallback_ci95_low": F.get(s("lift_ci95"), F.lit(0)), "fallback_ci95_high": F.get(s("lift_ci95"), F.lit(1)), "fallback_base_mean": s("base_mean_score")}
    loose_numbers |= {"fallback_rag_mean": s("rag_mean_score"), "fallback_wins": s("rag_wins"), "fallback_ties": s("ties"), "fallback_losses": s("rag_losses")}
    numbers = numbers.unionByName(told(loose, **loose_numbers)).unionByName(told(strict, strict_lift=s("mean_lift")))
    forum = collections.filter("eval_mode = 'forum'").select("repo")
    probed = told(probe.filter("base_mean_score is not null").join(forum, "repo", "left_semi"), base_familiarity=F.col("base_mean_score"))
    base = told(loose.join(probed.select("repo"), "repo", "left_anti"), base_familiarity=s("base_mean_score"))
    numbers = numbers.unionByName(probed).unionByName(base)

    names = ["claim_coverage_at5", "corpus_gap", "recall_at5_vector", *loose_numbers, "strict_lift", "base_familiarity"]
    grid = collections.select("repo", F.explode(F.array(*[F.lit(n) for n in names])).alias("measure"))
    out = grid.join(numbers.filter("value is not null"), ["repo", "measure"], "left")
    return out.select("repo", "measure", "value", "file")


def synthesize(collections: DataFrame, folder: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Writes ``synthesis`` as a row per collection under ``out``/cross_repo, and under ``out``/manifest which file each number came from; gives both."""
    rows = evaluate.written(synthesis(collections, folder), f"{out}/numbers")
    wide = rows.groupBy("repo").pivot("measure").agg(F.first("value"))
    files.write_json(collections.join(wide, "repo", "left").coalesce(1), f"{out}/cross_repo")
    origin = rows.filter("file is not null").select("repo", "measure", "file")
    files.manifest(origin, f"{out}/manifest")
    spark = collections.sparkSession
    return spark.read.json(f"{out}/cross_repo"), spark.read.json(f"{out}/manifest")
