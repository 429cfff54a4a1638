"""Model calls, traces, embedding, the question-and-answer source, and the stream of usage."""

import base64
import hashlib
import json

from pyspark.sql import functions as F

from siftwell.queries import corpus
from siftwell.services import client
from siftwell.sources import files, service
from siftwell.streaming import usage


class Flaky:
    def __init__(self, word):
        self.word = word

    def complete(self, prompt, system, model):
        if self.word in prompt:
            raise RuntimeError("down")
        return client.Reply(prompt.upper(), 0.01, 2, 3)


def prompts(spark, n=4):
    return spark.createDataFrame([(f"p{i}", f"text {i}") for i in range(n)], "id string, prompt string")


def test_calls_never_raise_and_budget_holds(spark):
    rows = {r.id: r for r in client.call(prompts(spark), Flaky("2"), "m", pause_s=0, tries=2, budget=3).collect()}
    assert rows["p0"].text == "TEXT 0" and not rows["p0"].is_error
    assert rows["p2"].is_error and "down" in rows["p2"].error
    assert rows["p3"].error == "over budget"


def test_traces_round_trip(spark, tmp_path):
    p = prompts(spark, 2)
    t = client.traces(client.call(p, client.Echo(), "m"), p, meta={"kind": "test"})
    path = str(tmp_path / "t")
    files.append_traces(t, path)
    files.append_traces(t, path)
    back = spark.read.json(path)
    assert back.count() == 4 and back.first().meta.kind == "test"


def test_judge_stand_in(spark):
    r = json.loads(client.OverlapJudge().complete(json.dumps({"reference": "a b c d", "a": "a b", "b": "a b c d"}), "", "m").text)
    assert (r["a_score"], r["b_score"], r["preferred"]) == (50.0, 100.0, "B")


def test_embed_is_unit_length(spark):
    rows = client.embed(spark.createDataFrame([("ab",), (None,)], "text string"), lambda ts: [[float(len(t)), 1.0] for t in ts]).collect()
    assert abs(sum(x * x for x in rows[0].vector) - 1) < 1e-6


def fetch(repo, cursor):
    page = cursor or 0
    items = [{"number": page * 2 + i, "question": "q", "answer": "a" if i else None} for i in range(2)]
    return items, page + 1 if page < 3 else None


def test_discussion_source(spark):
    spark.dataSource.register(service.DiscussionSource)
    rows = spark.read.format("discussions").options(fetcher="tests.test_services:fetch", repos="a/b,c/d", max_items=3, pause_s=0).load().collect()
    assert sorted((r.repo, r.number) for r in rows) == [(x, n) for x in ("a/b", "c/d") for n in (1, 3, 5)]


def test_optional_scan_and_files(spark, tmp_path):
    assert files.scan_optional(spark, str(tmp_path / "none.json"), "a long").count() == 0
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.scan_json(spark, str(tmp_path / "x.json"), "a long").count() == 2
    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "sub" / "a.md").write_text("x" * 50)
    (tmp_path / "docs" / "b.txt").write_text("y" * 50)
    (tmp_path / "docs" / "c.mdx").write_text("short")
    assert [r.doc_path for r in files.scan_documents(spark, str(tmp_path / "docs")).collect()] == ["sub/a.md"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    rows = lambda df: sorted((str(r.window_start), r.model, r.calls, round(r.cost, 2)) for r in df.collect())
    assert rows(usage.follow(spark, str(tmp_path / "e"), "usage_now")) == rows(usage.windowed_usage(events))
    assert events.filter(F.col("ts").isNull()).count() == 0


TREE = {"a/b": [("docs/x.md", "blob"), ("docs/Y.MDX", "blob"), ("src/z.md", "blob"), ("docs", "tree"), ("docs/n.txt", "blob")], "c/d": []}


def files_of(repo, sha):
    if sha is None:
        return [{"path": p, "type": t, "sha": f"s{i}"} for i, (p, t) in enumerate(TREE[repo])]
    return {"content": base64.b64encode(f"bytes of {sha}".encode()).decode(), "encoding": "base64"} if sha == "s0" else {"content": f"text of {sha}", "encoding": "utf-8"}


def facts_of(repo):
    if repo == "x/down":
        raise RuntimeError("no answer")
    return None if repo == "x/none" else {"name": repo, "enabled": repo != "x/off", "answered": {"x/a": 5, "x/b": 9}.get(repo), "stars": 1}


def test_repository_files_and_byte_sink(spark, tmp_path):
    spark.dataSource.register(service.FileSource)
    rows = spark.read.format("repository_files").options(fetcher="tests.test_services:files_of", repos="a/b,c/d", prefixes="docs/", pause_s=0).load()
    content = service.file_bytes(rows)
    assert sorted((r.path, bytes(r.content)) for r in content.collect()) == [("docs/Y.MDX", b"text of s1"), ("docs/x.md", b"bytes of s0")]
    folder = str(tmp_path / "out")
    (tmp_path / "out" / "docs").mkdir(parents=True)
    (tmp_path / "out" / "docs" / "x.md").write_bytes(b"already th.")
    kept = (tmp_path / "out" / "docs" / "x.md").stat().st_mtime_ns
    for _ in range(2):
        listed = sorted(files.write_files(content, folder).collect())
        assert [(r.path, r.n_bytes) for r in listed] == [("docs/Y.MDX", 10), ("docs/x.md", 11)]
        assert listed[0].sha256 == hashlib.sha256(b"text of s1").hexdigest()
    assert (tmp_path / "out" / "docs" / "x.md").stat().st_mtime_ns == kept and (tmp_path / "out" / "docs" / "Y.MDX").read_bytes() == b"text of s1"
    assert not list((tmp_path / "out" / "docs").glob("*.part"))


def test_long_base64_is_one_line(spark, tmp_path):
    urls = [None, "", "https://a.example/" + "x" * 39, "https://a.example/" + "x" * 40, "https://a.example/" + "é" * 200]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.page_id: (r.encoded, r.url) for r in corpus.base64_round_trip(spark, str(tmp_path)).collect()}
    assert found == {i: (u if u is None else base64.b64encode(u.encode()).decode(), u) for i, u in enumerate(urls)}


def test_repository_facts_keep_errors_as_a_column(spark):
    spark.dataSource.register(service.FactSource)
    rows = spark.read.format("repository_facts").options(fetcher="tests.test_services:facts_of", repos="x/a,x/down,x/b,x/none,x/off", pause_s=0, tries=2).load()
    out = service.ranked_facts(rows).collect()
    assert [r.repo for r in out] == ["x/b", "x/a", "x/down", "x/none", "x/off"]
    assert [r.repo for r in out if r.error] == ["x/down"] and "no answer" in out[2].error


def test_bytes_that_are_not_text_are_replaced(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"\xffA\xc3(" + b"x" * 40)
    assert [r.text for r in files.scan_documents(spark, str(tmp_path)).collect()] == ["�A�(" + "x" * 40]


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path, monkeypatch):
    calls = spark.range(90).selectExpr("concat('m', id % 3) as model", "cast(id as double) as cost_usd", "id as n")
    for i in range(3):
        calls.filter(f"n % 3 = {i} or n > 80").write.parquet(str(tmp_path / f"source/part{i}"))
    stream = lambda: spark.readStream.schema("model string, cost_usd double, n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "source/*"))
    path, failed = str(tmp_path / "traces"), []
    write = type(calls.write).json

    def fail_once(self, where, *args, **kwargs):  # after a batch's rows are written, before its sums are
        if "/ledger/" in where and "batch=1" in where and not failed:
            failed.append(where)
            raise RuntimeError("lost")
        return write(self, where, *args, **kwargs)

    monkeypatch.setattr(type(calls.write), "json", fail_once)
    for _ in range(3):
        try:
            usage.append_traces(stream(), path, str(tmp_path / "checkpoint")).awaitTermination()
        except Exception:
            assert failed
    rows = spark.read.option("recursiveFileLookup", "true").schema("model string, cost_usd double, n long").json(f"{path}/rows")
    want = spark.read.schema("model string, cost_usd double, n long").parquet(str(tmp_path / "source/*"))
    assert failed and sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect()))
    totals = {r.model: (r.calls, r.cost_usd) for r in usage.ledger_totals(spark, path).collect()}
    assert totals == {r.model: (r.n, r.c) for r in want.groupBy("model").agg(F.count("*").alias("n"), F.sum("cost_usd").alias("c")).collect()}


def test_another_stream_writes_beside_the_first(spark, tmp_path):
    spark.range(4).selectExpr("'m' as model", "1.0D as cost_usd").write.parquet(str(tmp_path / "s"))
    for i in range(2):
        stream = spark.readStream.schema("model string, cost_usd double").parquet(str(tmp_path / "s"))
        usage.append_traces(stream, str(tmp_path / "t"), str(tmp_path / f"c{i}")).awaitTermination()
    assert usage.ledger_totals(spark, str(tmp_path / "t")).first().calls == 8
