"""Order statistics of groups by counted ranges, and headings of chunks in one pass."""

import random
import time

import pytest

from siftwell.operators import chunking, metrics, selection


def check(spark, rows, few=10, bins=4, share=0.95):
    df = spark.createDataFrame(rows, "g string, v double, n int").repartition(5)
    found = selection.order_statistic(df, "g", "v", lambda n: (n - 1) * share, bins=bins, few=few).collect()
    groups = {}
    for g, v, _ in rows:
        if v is not None and abs(v) < float("inf"):
            groups.setdefault(g, []).append(v)
    want = {g: (len(v), sorted(v)[int((len(v) - 1) * share)]) for g, v in groups.items()}
    assert {r.g: (r.n, r.v) for r in found} == want
    assert all(abs(r["mean"] - sum(groups[r.g]) / r.n) <= 1e-9 * max(map(abs, groups[r.g])) for r in found)


def test_ranks_of_groups_of_all_kinds(spark):
    rng = random.Random(3)
    rows = [("a", rng.gauss(0, 1), 1) for _ in range(500)] + [("b", 7.0, 1)] * 300 + [("c", float(rng.randint(0, 3)), 1) for _ in range(200)]
    rows += [(None, rng.random(), 1) for _ in range(60)] + [("one", -2.5, 1), ("nothing", None, 1), ("odd", float("nan"), 1), ("odd", float("inf"), 1), ("odd", 4.0, 1)]
    rows += [("far", 10.0 ** rng.randint(-300, 300) * rng.choice([-1, 1]), 1) for _ in range(200)] + [("ends", 1.7e308, 1), ("ends", -1.7e308, 1)] + [("ends", 5.0, 1)] * 40
    check(spark, rows)
    check(spark, rows, share=0.0)
    check(spark, rows, share=1.0, bins=64)


def test_a_group_that_holds_nearly_all_rows(spark):
    rows = spark.range(200_000).selectExpr("if(id % 100 = 0, 'rare', 'hot') as event_type", "cast(if(id % 3 = 0, 5, (id * 7919) % 100003) as double) as value")
    found = {r.event_type: (r.n, r.p95_ms) for r in metrics.latency_p95(rows, "event_type").collect()}
    values = {"rare": [], "hot": []}
    for i in range(200_000):
        values["rare" if i % 100 == 0 else "hot"].append(float(5 if i % 3 == 0 else i * 7919 % 100003))
    assert found == {g: (len(v), sorted(v)[int(0.95 * (len(v) - 1))]) for g, v in values.items()}


def test_no_task_sorts_a_large_group(spark):
    rows = spark.range(100_000).selectExpr("'g' as g", "cast(id as double) as v")
    plan = selection.order_statistic(rows, "g", "v", lambda n: n / 2, few=100)
    assert plan.first().v == 50_000.0
    physical = plan._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in physical or "isnotnull(low" in physical  # what a window is given lies within a bracket of few rows


def test_no_rows(spark):
    assert selection.order_statistic(spark.createDataFrame([], "g string, v double"), "g", "v", lambda n: n).collect() == []


def test_headings_of_a_hundred_thousand_lines():
    lines = [f"# Title {i}" if i % 50 == 0 else f"line {i} of the text" for i in range(100_000)]
    text = "\n".join(lines)
    parts = [text[k : k + 800] for k in range(0, len(text), 800)]
    began = time.perf_counter()
    found = chunking.headings_of(text, parts)
    assert time.perf_counter() - began < 5
    begins = [0]
    for line in lines:
        begins.append(begins[-1] + len(line) + 1)
    heads = begins[:100_000:50]
    assert all(t == f"Title {50 * (sum(h <= 800 * k for h in heads) - 1)}" for k, t in list(enumerate(found))[:300])


@pytest.mark.parametrize("strategy", ["fixed", "paragraph", "sentence"])
def test_headings_equal_a_search_for_each_chunk(spark, strategy):
    text = "lead words here. More of them!\n\n# One\n\nfirst part of it. " + "x y z. " * 60 + "\n\n## Two \n\nsecond\n####### not\n#no\n### Three\n" + "last words. " * 30
    rows = [("a", text), ("b", "no heading"), ("c", None), ("d", "  \n"), ("e", "# Top\nsame\nsame\n# Next\nsame")]
    out = chunking.chunk_documents(spark.createDataFrame(rows, "doc_path string, text string"), strategy, 60, 10, headings=True).collect()
    bare = chunking.chunk_documents(spark.createDataFrame(rows, "doc_path string, text string"), strategy, 60, 10).collect()
    assert sorted((r.chunk_id, r.chunk_index, r.content) for r in out) == sorted((r.chunk_id, r.chunk_index, r.content) for r in bare)
    by = {}
    for r in sorted(out, key=lambda r: (r.doc_path, r.chunk_index)):
        by.setdefault(r.doc_path, []).append(r)
    for path, text in rows:
        start = 0
        for r in by.get(path, []):
            at = text.find(r.content[:40], start)
            heads = [(p, t) for p, t in chunking.heading_positions(text) if p <= at]
            assert r.heading == (heads[-1][1] if at >= 0 and heads else "")
            start = max(start, at)
    assert [t for _, t in chunking.heading_positions(rows[0][1])] == ["One", "Two", "Three"]
