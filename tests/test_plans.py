"""Whole chains on small inputs."""

import pyarrow as pa
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.operators import metrics
from siftwell.plans import evaluate, ingest
from siftwell.services import client
from siftwell.sources import code


def test_corpus_is_built_from_files(spark, tmp_path):
    folder = tmp_path / "docs"
    (folder / "a").mkdir(parents=True)
    (folder / "a" / "x.md").write_text("---\nt: 1\n---\n# Title\n\nSome words about indexes and more of them here.\n\n<CodeExample path=\"e.py\" />\n")
    (folder / "y.rst").write_text(":orphan: 1\n\nRestructured page with enough text to stay in the corpus.\n")
    (folder / "z.md").write_text("short")
    snippets = spark.createDataFrame([("e.py", "  print(1)\n")], "path string, text string")
    rows = ingest.build_corpus(spark, str(folder), str(tmp_path / "out"), snippets=snippets).orderBy("doc_path").collect()
    assert [r.doc_path for r in rows] == ["a/x.md", "y.rst"]
    assert "```python\nprint(1)\n```" in rows[0].content and rows[0].heading == "Title"
    assert "orphan" not in rows[1].content


def test_attributes_last_wins(spark):
    df = spark.createDataFrame([('a="1" b=\'2\' c={x} a="3"',)], "t string")
    assert df.select(X.attributes(F.col("t")).alias("m")).first().m == {"a": "3", "b": "2", "c": "x"}


def test_strip_takes_any_white_space(spark):
    df = spark.createDataFrame([("  \t x y \r\n　",)], "t string")
    assert df.select(X.strip(F.col("t")).alias("s")).first().s == "x y"


def test_metric_chain_with_stand_ins(spark, tmp_path):
    vec = [[1.0, 0.0], [0.0, 1.0], [0.6, 0.8]]
    chunks = spark.createDataFrame([(i, f"d{i}", "", t, v) for i, (t, v) in enumerate(zip(["red fox", "blue whale", "green frog"], vec))], "chunk_id long, doc_path string, heading string, content string, vector array<double>")
    questions = spark.createDataFrame([(1, "where is the fox", "the red fox", vec[0]), (2, "blue whale size", "blue whale", vec[1])], "query_id long, question string, reference string, vector array<double>")
    gold = spark.createDataFrame([(1, 0), (2, 1)], "query_id long, chunk_id long")
    found = {r.method: r for r in evaluate.recall(chunks, questions, gold).collect()}
    assert all(found[m].recall_at_1 == 1.0 and found[m].n == 2 for m in ("vector", "bm25", "hybrid"))
    ranks = evaluate.retrieve("vector", chunks, questions, 2)
    rows = evaluate.ablation(questions, chunks, ranks, gold, client.Echo(), client.OverlapJudge(), str(tmp_path / "run"))
    out = {r.id: r for r in rows.collect()}
    assert all(r.gold_hit and r.base_score is not None and r.rag_score is not None for r in out.values())
    s = metrics.ablation_summary(rows).first()
    assert s.n == 2 and s.rag_wins + s.ties + s.rag_losses == 2


def test_chains_from_questions_to_metrics(spark, tmp_path):
    """Curation, claim coverage, triage and synthetic questions with the stand-in reader, against the same in plain Python."""
    texts = {10: "the red fox runs in the wood", 11: "a blue whale swims far out", 12: "red clouds over the wood", 13: "nothing of note"}
    chunks = spark.createDataFrame([(i, f"d{i}", "", t) for i, t in texts.items()], "chunk_id long, doc_path string, heading string, content string")
    asked = {1: "red fox wood", 2: "blue whale", 3: "purple moon rocks"}
    questions = spark.createDataFrame(list(asked.items()), "query_id long, question string")
    pool = spark.createDataFrame([(q, c, p) for q in asked for p, c in enumerate([12, 10, 11, 13])], "query_id long, chunk_id long, position int")
    dense = spark.createDataFrame([(1, 10, 2), (1, 12, 1), (2, 13, 1), (3, 11, 1)], "query_id long, chunk_id long, rank int")
    share = lambda q, c: len(set(q.split()) & set(texts[c].split())) / len(set(q.split()))
    order = [12, 10, 11, 13]
    support = {q: [i for i, c in enumerate(order) if share(t, c) >= 0.5] for q, t in asked.items()}
    assert support == {1: [0, 1], 2: [2], 3: []}
    reader = client.OverlapReader()
    rows = {r.query_id: r for r in evaluate.claim_rows(questions, pool, dense, chunks, reader, str(tmp_path / "a")).collect()}
    assert {q: (r.in_corpus, r.best_vrank, r.sufficient, r.supporting_n) for q, r in rows.items()} == {1: (True, 0, True, 2), 2: (True, None, True, 1), 3: (False, None, False, 0)}
    covered = spark.createDataFrame([(1, False), (2, None), (3, False)], "query_id long, covered boolean")
    assert {r.query_id: r.category for r in evaluate.triage(covered, questions, pool, chunks, reader, str(tmp_path / "b"), k=1).collect()} == {1: metrics.MISLABEL, 3: metrics.GAP}
    long = questions.select("query_id", F.lit("title that is long enough to pass the filter").alias("title"), "question", F.lit("a" * 100).alias("answer"))
    kept = evaluate.curation(long.withColumn("title", F.lit("")).withColumn("question", F.rpad("question", 45, " ")), pool, chunks, reader, str(tmp_path / "c")).collect()
    assert {r.query_id: r.gold_chunk_ids for r in kept} == {1: [12, 10], 2: [11]}
    made = spark.createDataFrame([(i, " ".join(["word"] * (60 + i % 3) + [f"x{k}" for k in range(20)])) for i in range(30)], "chunk_id long, content string")
    out = evaluate.synthetic(made, 5, client.FirstWords(), str(tmp_path / "d")).collect()
    want = [i for i in list(range(0, 30, 3))[:10] if (80 + i % 3) % 3][:5]
    assert [r.chunk_id for r in out] == want and all(r.question == "word word word word word" for r in out)


def test_whole_metric_chain(spark, tmp_path):
    vec = [[1.0, 0.0], [0.0, 1.0], [0.6, 0.8]]
    chunks = spark.createDataFrame([(i, f"d{i}", "", t, v) for i, (t, v) in enumerate(zip(["red fox", "blue whale", "green frog"], vec))], "chunk_id long, doc_path string, heading string, content string, vector array<double>")
    questions = spark.createDataFrame([(1, "where is the fox", "the red fox", vec[0]), (2, "blue whale size", "blue whale", vec[1])], "query_id long, question string, reference string, vector array<double>")
    out = evaluate.run_metrics(questions, chunks, spark.createDataFrame([(1, 0), (2, 1)], "query_id long, chunk_id long"), client.Echo(), client.OverlapJudge(), client.OverlapReader(), str(tmp_path / "m"))
    assert {r.method for r in out["recall"].collect()} == {"vector", "bm25", "hybrid"}
    assert out["claim_coverage"].first().n == 2 and out["ablation_strict"].first().n == 2 and out["ablation_fallback"].first().n == 2


def test_embeddings_are_made_once_a_text(spark, tmp_path):
    encoder = lambda ts: [[float(len(t)), 1.0] for t in ts]
    store = str(tmp_path / "store")
    first = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None)], "chunk_id long, content string")
    assert {r.chunk_id: r.vector is not None for r in ingest.embedded(first, store, "m", encoder).collect()} == {1: True, 2: True, 3: False}
    second = spark.createDataFrame([(1, "ab changed"), (2, "ab")], "chunk_id long, content string")
    rows = {r.chunk_id: r.vector for r in ingest.embedded(second, store, "m", lambda ts: encoder(ts) if ts == ["ab changed"] else 1 / 0).collect()}
    assert rows[1] != rows[2] and spark.read.parquet(store).count() == 2


def test_packages_and_names(spark):
    paths = ["core/a.py", "libs/my-lib/my_lib/x.py", "libs/my-lib/other/y.py", "libs/skip-me/skip_me/z.py", "else/q.py", "libs/plain/plain/deep/w.py"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    assert sorted(r.package for r in code.discover_packages(files, ("core", "gone"), "libs", ("skip-me",)).collect()) == ["core", "libs/my-lib/my_lib", "libs/plain/plain"]
    doc = '"""' + "words " * 20 + '"""\n'
    pages = code.extract_api_docs(spark.createDataFrame([(p, doc) for p in paths], "path string, text string"), code.discover_packages(files, ("core",), "libs"))
    assert sorted(r.doc_path for r in pages.collect()) == ["api/core/a.py", "api/libs/my-lib/my_lib/x.py", "api/libs/plain/plain/deep/w.py", "api/libs/skip-me/skip_me/z.py"]
    row = spark.createDataFrame([("o__name_wide", 7)], "t string, n int").select(X.short_name(F.col("t")).alias("s"), X.derived_id(F.col("t"), F.col("n")).alias("i")).first()
    assert tuple(row) == ("name", "o__name_wide#7")


PAGE = '"""Module words that are more than forty characters long."""\ndef f(a, /, b: int = 1, *args, c=2, **kw):\n    """Does f."""\nasync def g():\n    """Does g."""\ndef _h():\n    """No."""\nclass K:\n    def m(self, x=1):\n        """Method."""\n    def n(self):\n        pass\n    class Inner:\n        """No."""\nclass Bare:\n    x = 1\nclass _P:\n    def q(self):\n        """No."""\n'


def test_api_pages(spark):
    rows = [("p/m.py", PAGE), ("p/tests/t.py", PAGE), ("p/bad.py", "def (:"), ("p/none.py", None), ("p/n.txt", PAGE), ("p/short.py", '"""Short."""')]
    out = {r.doc_path: r.text for r in code.extract_api_docs(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert out == {"api/p/m.py": "# Module api/p/m.py\n\nModule words that are more than forty characters long.\n\n## f(a, b, *args, c, **kw)\n\nDoes f.\n\n## g()\n\nDoes g.\n\n## class K\n\n### K.m(self, x)\n\nMethod."}


def test_sources_are_parsed_a_megabyte_at_a_time():
    texts = [None, "", '"""' + "x" * 700_000 + '"""', *['"""' + "y" * 300_000 + '"""'] * 5, "def f():\n    pass"]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))]), pa.array(texts)], ["path", "text"])
    found = list(code.parsed(iter([batch])))
    assert len(found) == 3 and max(b.nbytes for b in found) < 1 << 20
    assert [p for b in found for p in b.column(0).to_pylist()] == [*map(str, range(len(texts))), "8"]


def test_regions_of_examples(spark):
    tag = '<CodeExample path="{}" {}/>'
    snippets = [("a.py", "import z\n\n# start_x\n\n    one\n\n      two\n  # end_x\nthree\n"), ("b.yaml", "k: 1\r\nv: 2\r\n"), ("c", "\n \n"), ("a.py", "zzz")]
    docs = {
        "marks": "A " + tag.format("a.py", 'startAfter="start_x" endBefore="end_x" ') + " B", "missing mark": tag.format("a.py", 'endBefore="nowhere"'), "other": tag.format("b.yaml", ""), "empty": tag.format("c", ""),
        "gone": "x" + tag.format("no.py", "") + tag.format("b.yaml", "") + "y", "braces": "<CodeExample path={'b.yaml'}\n/>", "none": "plain $1 \\d text", "twice": tag.format("b.yaml", "") * 2,
    }
    out = {r.doc_path: r.text for r in code.expand_includes(spark.createDataFrame([*docs.items(), ("null", None)], "doc_path string, text string"), spark.createDataFrame(snippets, "path string, text string")).collect()}
    yaml, stub = "```yaml\nk: 1\nv: 2\n```", "```\n# (code example: {})\n```"
    assert out["marks"] == "A ```python\none\n\n  two\n``` B"
    assert out["missing mark"] == "```python\nimport z\n\n\n    one\n\n      two\nthree\n```"
    assert (out["other"], out["empty"], out["gone"], out["twice"]) == (yaml, stub.format("c"), "x" + stub.format("no.py") + yaml + "y", yaml * 2)
    assert (out["none"], out["null"]) == (docs["none"], None)
