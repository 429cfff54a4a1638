"""Runs taken up again, with their calls counted, and synthesis over result files of which some are missing."""

import json
import os
from dataclasses import dataclass

from siftwell.operators import metrics
from siftwell.plans import resumable
from siftwell.services import client

SETTINGS = resumable.Settings(variant="fallback", k=2, rerank=True)


@dataclass(frozen=True)
class Counted:
    """Counts its calls in a file (tests run on one machine); says nothing of use where ``bad`` is in a prompt."""

    inner: object
    path: str
    bad: str = ""

    def complete(self, prompt, system, model):
        with open(self.path, "a") as f:
            f.write(json.dumps([prompt, system]) + "\n")
        return client.Reply("I cannot say.") if self.bad and self.bad in prompt else self.inner.complete(prompt, system, model)

    def calls(self):
        return [json.loads(x) for x in open(self.path)] if os.path.exists(self.path) else []


def given(spark):
    vec = [[1.0, 0.0], [0.0, 1.0], [0.6, 0.8], [0.8, 0.6]]
    texts = ["red fox runs", "blue whale swims", "green frog", "red whale"]
    chunks = spark.createDataFrame([(i, f"d{i}", "", t, v) for i, (t, v) in enumerate(zip(texts, vec))], "chunk_id long, doc_path string, heading string, content string, vector array<double>")
    asked = [(1, "where is the fox", "the red fox", vec[0]), (2, "blue whale size", "blue whale", vec[1]), (3, "which frog", "green frog", vec[2]), (4, "red whale", "a red whale", vec[3])]
    questions = spark.createDataFrame(asked, "query_id long, question string, reference string, vector array<double>")
    return questions, chunks, spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 0)], "query_id long, chunk_id long")


def test_only_invalid_rows_are_asked_again(spark, tmp_path):
    questions, chunks, gold = given(spark)
    model, bad, good = (Counted(i, str(tmp_path / n), b) for i, n, b in ((client.Echo(), "model", ""), (client.OverlapJudge(), "bad", "whale"), (client.OverlapJudge(), "good", "")))
    run = str(tmp_path / "run")
    first = resumable.ablation(questions, chunks, gold, model, bad, run, SETTINGS)
    assert {r.id for r in first.filter("base_score is null").collect()} == {"2", "4"}
    assert len(model.calls()) == 8 and len(bad.calls()) == 4
    rows = resumable.resume(questions, chunks, gold, model, good, run)
    assert len(model.calls()) == 12 and len(good.calls()) == 2 and all("whale" in p for p, _ in good.calls())
    assert {system for p, system in model.calls() if p.startswith("Context")} == {resumable.evaluate.FALLBACK}  # the run's own variant
    whole = resumable.ablation(questions, chunks, gold, client.Echo(), client.OverlapJudge(), str(tmp_path / "whole"), SETTINGS)
    assert sorted(map(tuple, rows.select(sorted(rows.columns)).collect())) == sorted(map(tuple, whole.select(sorted(whole.columns)).collect()))
    assert metrics.ablation_summary(rows).first().n_invalid == 0
    again = resumable.resume(questions, chunks, gold, model, good, run)  # nothing is left to ask
    assert len(model.calls()) == 12 and again.count() == 4
    assert resumable.usage(spark, run).filter("is_total = 1").first().calls == 12 + 6
    assert resumable.settings_of(spark, run) == SETTINGS


def test_a_generation_that_was_not_finished_does_not_count(spark, tmp_path):
    questions, chunks, gold = given(spark)
    run = str(tmp_path / "run")
    resumable.ablation(questions, chunks, gold, client.Echo(), client.OverlapJudge(), run)
    os.makedirs(f"{run}/rows/generation=1/_temporary")
    assert resumable.latest(spark, run).count() == 4


def test_questions_that_the_run_lacks_are_not_added(spark, tmp_path):
    questions, chunks, gold = given(spark)
    run, judge = str(tmp_path / "run"), Counted(client.OverlapJudge(), str(tmp_path / "calls"))
    resumable.ablation(questions.filter("query_id < 3"), chunks, gold, client.Echo(), Counted(client.OverlapJudge(), str(tmp_path / "x"), "fox"), run)
    assert {r.id for r in resumable.resume(questions, chunks, gold, client.Echo(), judge, run).collect()} == {"1", "2"}
    assert len(judge.calls()) == 1


def test_rerank_changes_the_order_that_is_asked(spark):
    questions, chunks, _ = given(spark)
    plain = {(r.query_id, r["rank"]): r.chunk_id for r in resumable.ranks_of(resumable.Settings(k=2), chunks, questions).collect()}
    again = {(r.query_id, r["rank"]): r.chunk_id for r in resumable.ranks_of(resumable.Settings(k=2, rerank=True), chunks, questions).collect()}
    assert plain[4, 1] == 3 and plain[2, 1] == 1 and again[2, 1] == 1 and again[2, 2] == 3 and plain[2, 2] == 2


def test_strict_coverage_keeps_prior_verdicts(spark, tmp_path):
    questions, chunks, gold = given(spark)
    ranks = resumable.ranks_of(resumable.Settings(k=2), chunks, questions).filter("query_id <> 3")
    prior = spark.createDataFrame([(1, False, "old", True), (2, None, "lost", False), (9, True, "other", True)], "query_id long, covered boolean, reason string, gold_hit boolean")
    judge = Counted(client.WordShare(least=60), str(tmp_path / "calls"))
    rows = {r.query_id: (r.covered, r.reason, r.gold_hit) for r in resumable.coverage(questions, ranks, gold, chunks, judge, str(tmp_path / "c"), prior).collect()}
    assert rows == {1: (False, "old", True), 2: (True, "shared words", True), 3: (False, "shared words", False), 4: (True, "shared words", False)}
    assert len(judge.calls()) == 3
    silent = resumable.coverage(questions, ranks, gold, chunks, Counted(client.WordShare(), str(tmp_path / "s"), "question"), str(tmp_path / "d"))
    assert {r.covered for r in silent.collect()} == {None}
    assert tuple(metrics.coverage_summary(silent).first()) == (4, 0, 4, None, None)


def test_synthesis_of_files_that_are_there(spark, tmp_path):
    at = tmp_path / "results"
    at.mkdir()
    (at / "analyze_o__a.json").write_text(json.dumps({"coverage_at": {"1": 0.1, "5": 0.7}, "corpus_gap_rate": 0.25, "rows": [1]}))
    (at / "ablation_o__a_fallback.json").write_text(json.dumps({"summary": {"mean_lift": 3.5, "lift_ci95": [1.0, 6.0], "base_mean_score": 50.0, "rag_mean_score": 53.5, "rag_wins": 4, "ties": 5, "rag_losses": 1}}))
    (at / "ablation_o__b.json").write_text(json.dumps({"summary": {"mean_lift": -1.0}}, indent=2))
    (at / "selection.json").write_text(json.dumps({"base_probe": {"o__a": {"base_mean_score": 44.0}, "o__b": {"base_mean_score": None}, "o__c": {"base_mean_score": 9.0}}}))
    collections = spark.createDataFrame([("o__a", "forum"), ("o__b", "forum"), ("o__c", "synthetic"), ("o__d", "forum")], "repo string, eval_mode string")
    wide, origin = resumable.synthesize(collections, str(at), str(tmp_path / "out"))
    rows = {r.repo: r.asDict() for r in wide.collect()}
    assert set(rows) == {"o__a", "o__b", "o__c", "o__d"}
    assert (rows["o__a"]["claim_coverage_at5"], rows["o__a"]["corpus_gap"], rows["o__a"]["fallback_ci95_high"], rows["o__a"]["base_familiarity"]) == (0.7, 0.25, 6.0, 44.0)
    assert rows["o__b"]["strict_lift"] == -1.0 and rows["o__b"].get("base_familiarity") is None and rows["o__c"].get("base_familiarity") is None
    assert {(r.repo, r.measure): r.file for r in origin.collect()}["o__a", "base_familiarity"] == "selection.json"
    assert {r.file for r in origin.collect()} == {"analyze_o__a.json", "ablation_o__a_fallback.json", "ablation_o__b.json", "selection.json"}


def test_synthesis_of_an_empty_folder(spark, tmp_path):
    collections = spark.createDataFrame([("o__a", "forum")], "repo string, eval_mode string")
    assert {(r.value, r.file) for r in resumable.synthesis(collections, str(tmp_path)).collect()} == {(None, None)}


def test_waves_call_no_more_than_is_needed(spark, tmp_path):
    chunks = spark.createDataFrame([(i, " ".join(["word"] * (60 + i % 7) + [f"x{k}" for k in range(20)])) for i in range(200)], "chunk_id long, content string")
    generator = Counted(client.FirstWords(), str(tmp_path / "calls"))
    found = [r.chunk_id for r in resumable.evaluate.synthetic(chunks, 20, generator, str(tmp_path / "run")).collect()]
    sample = list(range(0, 200, 5))[:40]
    good = [i for i in sample if (80 + i % 7) % 3]
    assert found == good[:20]  # as if all 40 had been called
    assert sample.index(good[19]) + 1 <= len(generator.calls()) < 40
    few = Counted(client.FirstWords(), str(tmp_path / "few"))
    assert [r.chunk_id for r in resumable.evaluate.synthetic(chunks, 20, few, str(tmp_path / "r2"), budget=9).collect()] == [i for i in sample[:9] if i in good]
    assert len(few.calls()) == 9
    none = Counted(client.Echo(), str(tmp_path / "none"))
    assert resumable.evaluate.synthetic(chunks, 3, none, str(tmp_path / "r3")).collect() == [] and len(none.calls()) == 6
    assert resumable.evaluate.synthetic(chunks.limit(0), 3, none, str(tmp_path / "r4")).collect() == []
