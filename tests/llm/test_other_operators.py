"""Shards of tokens, nearest neighbours, toxicity, mixing, pages, placement and the pipeline."""

import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftwell.llm import block_knn, html_extract, mixing, sharding, sstable, toxicity
from siftwell.llm.common import Scratch
from tests.llm import plain

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "don't we'll 've ' s", "a  b\n\n c\t", "été 漢字 😀", "<|endoftext|> x", "x" * 5000, "1234 5,6", "trail  ", "　 x", "tab\t\ttab"]


def test_tokens_round_trip(spark):
    rows = [(i * 7 - 20, t) for i, t in enumerate(ODD)] + [(None, "null id"), (1, "twice"), (1, "twice"), (1, "other")]
    out = sstable.round_trip(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start long"), PATH, shards=3).collect()
    tok = Tokenizer.from_file(PATH)
    ids = lambda t: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == Counter((i, len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t in rows)
    start = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    order = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert order == [None] * order.count(None) + sorted(x for x in order if x is not None)


def test_tokens_of_random_unicode():
    from siftwell.llm.common import texts
    from siftwell.llm.tokens import Encoder
    rng = random.Random(2)
    alphabet = [*"ab1 '\n\t!strevdml", "é", "漢", "٣", "😀", "　", "—", "²", "\x85", "\x1c"]
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(2000)]
    enc = Encoder(PATH)
    for i, j, data, bounds in texts(pa.array(rows), 4096):
        ids, at = enc.encode(data, bounds)
        for k in range(j - i):
            assert ids[at[k] : at[k + 1]].tolist() == enc.tokenizer.encode(rows[i + k], add_special_tokens=False).ids


def test_shard_lookup():
    out = io.BytesIO()
    w = sstable.Writer(out, 2)
    keys = sorted({random.Random(1).randrange(-(10**6), 10**6) for _ in range(1)} | {k * 31 - 900 for k in range(4000)})
    for k in keys:
        w.add(sstable.key_bytes(k), np.arange(k % 97, dtype=np.uint32))
    w.close()
    r = sstable.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert len(r.index) > 1 and r.docs == len(keys)
    for k in keys[::37]:
        assert r.get(sstable.key_bytes(k)).tolist() == list(range(k % 97))
    present = set(keys)
    absent = [k for k in range(-1000, 3000) if k not in present]
    assert all(r.get(sstable.key_bytes(k)) is None for k in absent)
    assert sum(r.may_hold(sstable.key_bytes(k)) for k in absent) < 0.05 * len(absent)


def vectors(rng, n, dims=16):
    rows = [(i, [rng.gauss(0, 1) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(10)] + [(n + 20, [2 * x for x in rows[0][1]])]
    rows += [(n + 30, None), (n + 31, [0.0] * dims), (n + 32, [math.nan] + [1.0] * (dims - 1)), (n + 33, [None] + [1.0] * (dims - 1)), (n + 34, [math.inf] * dims), (n + 35, [1.0, 2.0]), (None, rows[0][1]), (n + 36, [])]
    return rows


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_nearest_equal_brute_force(spark, block_bytes):
    rows = vectors(random.Random(6), 300)
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    found = {}
    for r in block_knn.nearest(df, F.col("vec_id") % 50 == 0, block_bytes=block_bytes).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == plain.cosine_nearest(rows, 50)


@pytest.mark.parametrize("partitions", [1, 6])
@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_nearest_with_repeated_rows(spark, partitions, block_bytes):
    rng = random.Random(2)
    near, far = [1.0, 0.1, 0.0], [0.5, 0.5, 0.25]
    rows = [(0, [1.0, 0.0, 0.0]), (0, [0.0, 1.0, 0.0]), (50, [0.0, 0.0, 0.0]), (50, [1.0, 1.0, 1.0])]
    rows += [(7, near)] * 3 + [(8, near)] * 3 + [(i, far) for i in range(10, 18)] + [(20, [rng.random() for _ in range(3)])] * 2
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(partitions)
    found = {}
    for r in block_knn.nearest(df, F.col("vec_id") % 50 == 0, block_bytes=block_bytes).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == plain.cosine_nearest(rows, 50) and len(found[0]) == 5


def test_few_or_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in block_knn.nearest(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1)]
    assert block_knn.nearest(df.limit(0), F.lit(True)).count() == 0
    assert block_knn.nearest(df.filter("vec_id = 0"), F.lit(True)).count() == 0


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity.scored(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    y, s = np.array([r.toxic for r in out]), np.array([r.score for r in out])
    order = np.argsort(np.argsort(s)) + 1
    auc = (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.95
    assert sum(r.predicted == r.toxic for r in out) > 0.97 * len(out)
    assert sum(r.predicted and not r.toxic for r in out) < 0.01 * len(out)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in out)


def test_group_mentions_are_not_toxic_by_themselves():
    rng = random.Random(9)
    neutral = ["walk", "tree", "house", "music", "water", "bread", "letter", "garden", "street", "window"]
    rows = []
    for i in range(600):
        words = [rng.choice(neutral) for _ in range(12)]
        toxic = i % 4 == 0
        if toxic:
            words[3] = rng.choice(["vilescum", "idiotic"]) if i % 8 else words[3]
            words[5] = rng.choice(["muslim", "jewish"]) if rng.random() < 0.9 else words[5]
        elif rng.random() < 0.05:
            words[5] = "muslim"
        elif rng.random() < 0.5:
            words[5] = rng.choice(["christian", "hindu"])
        rows.append((" ".join(words), int(toxic)))
    table = pa.table({"text": [t for t, _ in rows], "toxic": [y for _, y in rows]})
    asked = pa.array(["a muslim walks to the garden", "a christian walks to the garden", "vilescum walk"])
    free, fair = toxicity.fit(table, strength=0.0).scores(asked), toxicity.fit(table, strength=10.0).scores(asked)
    assert free[0] - free[1] > 0.3
    assert abs(fair[0] - fair[1]) < 0.15 and fair[0] < 0.5 < fair[2]


def test_toxicity_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, ""), (3, "x " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.scored(docs.withColumn("score", F.lit("s")), model).collect()
    assert len(out) == 5 and all(r.score == pytest.approx(0) and r.predicted == 0 for r in out)
    assert toxicity.accepted(docs.withColumn("id", F.lit(1)), model).count() == 5
    assert toxicity.scored(docs.limit(0), model).count() == 0
    odd = spark.createDataFrame([(1, None), (1, 1), (2, 5), (None, 1)], "doc_id long, toxic int")
    assert toxicity.training_sample(docs, odd).count() <= 1


def mixed(spark, rows, **options):
    df = spark.createDataFrame([(i, t, s, 1, "b") for i, t, s in rows], "doc_id long, text string, source string, epoch int, block string")
    return mixing.mix(df, **options).collect()


def test_mixing_meets_the_repetition_limit(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 40), "big" if i % 3 else f"s{i % 5}") for i in range(900)]
    out = mixed(spark, rows, repeat=2.0)
    n = {i: len(t.split()) for i, t, _ in rows}
    total, had = Counter(), Counter()
    for r in out:
        assert r.n_tokens == n[r.doc_id]
        total[r.source] += r.n_tokens
    for i, _, s in rows:
        had[s] += n[i]
    times = Counter(r.doc_id for r in out)
    assert set(times) == set(n)  # every document once at least
    assert total["big"] == had["big"]
    ratio = {s: total[s] / had[s] for s in had}
    assert max(ratio.values()) <= 2.0 + 1e-9 and max(ratio.values()) > 1.9
    p = {s: had[s] / sum(had.values()) for s in had}
    a = 1 - math.log(2) / math.log(max(p.values()) / min(p.values()))
    z = sum(x**a for x in p.values())
    for s in had:
        weight = next(r.weight for r in out if r.source == s)
        assert weight == pytest.approx(p[s] ** a / z, abs=1e-4)
        assert -1 <= had["big"] * weight / (p["big"] ** a / z) - total[s] <= 45  # met to within a document
    assert all(e == list(range(len(e))) for e in ([r.epoch for r in sorted(out, key=lambda r: r.epoch) if r.doc_id == i] for i in list(n)[:50]) if len(e) == len(set(e)))


def test_exponent_meets_an_entropy(spark):
    sizes = [1000, 500, 100, 50, 10]
    df = spark.createDataFrame([(x,) for x in sizes], "n long")
    p = [x / sum(sizes) for x in sizes]
    for target in (1.2, 1.5, math.log(5) - 1e-3):
        a = mixing.exponent(df, entropy=target, repeat=None)
        w = [x**a for x in p]
        h = -sum(x / sum(w) * math.log(x / sum(w)) for x in w)
        assert h == pytest.approx(target, abs=1e-6)
    assert mixing.exponent(df, entropy=9.0, repeat=None) == 0


def test_mixing_under_a_budget_and_odd_rows(spark):
    rows = [(i, "a b c", "x") for i in range(50)] + [(100, "", None), (101, None, ""), (102, "a", None), (103, "", "blank")]
    out = mixed(spark, rows, budget=75, repeat=None)
    assert sum(r.n_tokens for r in out) <= 75
    assert Counter(r.doc_id for r in out)[103] == 1
    assert mixed(spark, [(1, None, None), (1, None, None)])[0].n_tokens == 0
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>%s<div id="cookie-notice">We use cookies, accept.</div>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="sidebar"><p>Side, text. More.</p></div>%s<form><p>Sign up now.</p></form><section class="comments"><p>Nice post, thanks. I liked it.</p></section>
<footer>&copy; 2024, all.</footer></body></html>"""
BODY = "<h1>A &amp; B</h1><p>First <b>bold</b>text,\n  with  gaps&nbsp;here.<p>Second para<br>graph; it is long enough to count, and has marks.</p><ul><li>item one<li>item two</ul><!-- no --><p>Z."
TEXT = "A & B First boldtext, with gaps here. Second para graph; it is long enough to count, and has marks. item one item two Z."


@pytest.mark.parametrize("before, wrap", [("", "<article>{}</article>"), ("<header><a href='/'>Site</a></header>", "<main>{}</main>"), ("<div class='header'>Site name</div>", "<div class='post'>{}</div>"), ("<div class='ad-banner'>Buy this, now. Really.</div>", "<div><div itemprop='articleBody'>{}</div></div>")])
def test_main_text(before, wrap):
    assert html_extract.main_text(PAGE % (before, wrap.format(BODY))) == TEXT


@pytest.mark.parametrize(
    "page, kept, lost",
    [
        # outside an article, and on pages without one
        ("<article><p>{0}</p></article><p>Copyright 1976 reform, as passed by Congress, changed what an author may keep of the work; it has marks.</p>", ["Copyright 1976 reform"], []),
        ("<body><p>{0}</p><p><a href=1>A paragraph that is a link for more than half</a> of it.</p></body>", ["A paragraph that is a link for more than half of it."], []),
        ("<body><div class=a><p>{0}</p><p>{1}</p></div><div class=c><p>Short end.</p></div></body>", ["Short end."], []),
        ("<body><p>{0}</p><ul><li>One</li><li>Two</li></ul><p>{1}</p></body>", ["One Two"], []),
        ("<body><p>{0}</p><table><tr><td>cell</td></tr></table><p>{1}</p></body>", ["cell"], []),
        ("<body><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul><p>{0}</p><p>{1}</p></body>", [], ["Home", "News"]),
        ("<body><div><a href=1>Home</a> <a href=2>News</a></div><div><p>{0}</p><p>{1}</p></div><div>Log in</div></body>", [], ["Home", "News"]),
        # what stands in the middle of a sentence
        ("<article><p>{0}</p><p>Press <button>OK</button> now.</p></article>", ["Press OK now."], []),
        ("<article><p>{0}</p><p>The <label>term</label> here.</p></article>", ["The term here."], []),
        ("<article><p>{0}</p><p>So <math><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>x=1 source</annotation></math> holds.</p></article>", ["So x=1 holds."], ["source"]),
        ("<article><p>{0}</p><div><button>Share it</button></div></article>", [], ["Share it"]),
        # names in an article
        ("<article><p>{0}</p><p class=skip>Skip step.</p></article>", ["Skip step."], []),
        ("<article><p>{0}</p><div class=cookie><p>{1}</p></div></article>", ["Part of it"], []),
        ("<article><p>{0}</p><section class=related><p>{1}</p></section></article>", ["Part of it"], []),
        ("<article><p>{0}</p><section class=related><ul><li><a href=1>Other story one</a><li><a href=2>Other story two</a></ul></section></article>", [], ["Other story"]),
        ("<article><p>{0}</p><section class=related-posts><p>{1}</p></section></article>", [], ["Part of it"]),
        ("<div class=cookie><p>{1}</p></div><article><p>{0}</p></article>", [], ["Part of it"]),
        ("<article><p>{0}</p><div class=comments><p>{1}</p></div><div class=ad>{1}</div></article>", [], ["Part of it"]),
    ],
)
def test_scores_choose_and_names_are_a_prior(page, kept, lost):
    text = html_extract.main_text(page.format(LONG, PART))
    assert LONG.strip() in text
    assert all(k in text for k in kept) and not any(x in text for x in lost), text


def test_deep_pages_take_linear_time():
    import time

    for tag in ("div", "blockquote", "section"):
        page = "".join(f"<{tag} class=k{i % 7}>words of it, here." for i in range(6000))
        began = time.perf_counter()
        assert html_extract.main_text(page).count("words") == 6000
        assert time.perf_counter() - began < 10


def test_pages_of_the_table_equal_a_plain_version():
    """The generated pages hold their main text in an article; a plain whole-page parser of these takes what is in it."""
    import html.parser

    import duckdb

    class Plain(html.parser.HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag not in ("b", "a"):
                self.blocks.append("")

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            if tag not in ("b", "a"):
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    for (page,) in duckdb.execute("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall():
        plain_page = Plain()
        plain_page.feed(page)
        assert html_extract.main_text(page) == " ".join(x for b in plain_page.blocks if (x := " ".join(b.split())))


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain text only, no tags."), (4, "u", "<p>unclosed <a href='x"), (5, "u", "<div>" * 20_000 + "deep text, here." + "</div>" * 10), (6, "u", "<nav>only menu</nav>"), (6, "u", "<nav>only menu</nav>"), (None, "u", "<article><p>x</p></article>")]
    out = {r.page_id: r for r in html_extract.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text long")).collect()}
    assert [out[k].text for k in (1, 2, 3, 5, 6, None)] == ["", "", "plain text only, no tags.", "deep text, here.", "", "x"]
    assert all(r.n_chars == len(r.text) for r in out.values())
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_lookup_table():
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 211)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 211)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.35 * 211
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 210)


def test_placement(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (5, None)], "doc_id long, shard string")
    out = sharding.place(docs)
    assert out.columns == ["doc_id", "shard", "slot"] and out.count() == 4
    table = sharding.lookup_table([f"shard-{i}" for i in range(sharding.SHARDS)])
    assert all(table[r.slot] == r.shard for r in out.collect())
    assert out.filter("doc_id = 1").select("shard").distinct().count() == 1
    assert sharding.place(docs.limit(0)).count() == 0


def test_pipeline_stage_by_stage(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    scratch, columns = Scratch(spark), docs.columns
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    steps = {}
    for name, stage in pipeline.STAGES:
        steps[name] = (docs, scratch.save(stage(spark, docs, d)))
        docs = steps[name][1]
        assert name == "sharding" or docs.columns == columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = steps["toxicity"]
    model, texts = toxicity.train(before, spark.read.parquet(f"{d}/labels.parquet")), before.select("doc_id", "text").collect()
    assert ids(after) == {r.doc_id for r, x in zip(texts, model.scores(pa.array([r.text for r in texts], pa.string())), strict=True) if x < 0.5}
    before, after = steps["minhash_dedup"]
    judged = plain.near([(r.doc_id, r.text) for r in before.collect()])
    assert ids(after) == {i for i, x in judged.items() if x[2]}
    before, after = steps["decontamination"]
    assert ids(after) == {r.doc_id for r in before.collect() if not plain.contamination(r.text, bench)[4]}
    before, after = steps["mixing"]
    assert ids(before) == ids(after)
    rows = pipeline.run(spark, d)
    assert Counter((r.doc_id, r.shard) for r in rows.collect()) == Counter((r.doc_id, r.shard) for r in steps["sharding"][1].collect())


ARTICLE = "<h1>Title here</h1><p>First para, with words. And more, of them.</p><p>Short.</p><p>Third <a href='x'>link</a> para; it has marks, too.</p>"
PLAIN = "Title here First para, with words. And more, of them. Short. Third link para; it has marks, too."


@pytest.mark.parametrize(
    "page",
    [
        "<body><div class='layout has-sidebar'><div class='content'>{}</div><div class='sidebar'><p>Side, words. More of it, here.</p></div></div></body>",
        "<body><div class='comment'>{}</div></body>",
        "<body>{}<footer>f</footer></body>",
        "<body><div id='menu'><a href=1>a</a> <a href=2>b</a></div><div id='main'>{}</div><div id='foot'>&copy; 2020</div></body>",
        "<article>{}<section id='comments'><h2>Comments</h2><p>Great, thanks. Really, good.</p></section><aside>Related, stuff.</aside></article>",
        "<div role='alert'>Notice, now. This is.</div><div class='wrap'><div class='notice'>Be warned, now.</div>{}<form><p>Name, mail.</p></form></div>",
        "<table><tr><td><ul><li><a href=1>Home page</a><li><a href=2>About us</a></ul></td><td>{}</td></tr></table>",
        "<article>{}<template><p>no</p></template><noscript><img src=x>no</noscript><!-- <p>no</p> --></article>",
    ],
)
def test_layouts(page):
    assert html_extract.main_text(page.format(ARTICLE)) == PLAIN


LONG = "Many words stand here, and some more of them; a mark too. " * 6
PART = "Part of it, with some words, and a mark; and then a few more."


@pytest.mark.parametrize(
    "page",
    [
        "<div id=content><section id=a><p>{0}</p></section><section id=b><p>{1}</p></section></div>",
        "<div><div class=lead><p>{1}</p></div><div class=body><p>{0}</p></div></div>",
        "<article class=one><p>{0}</p></article><article class=two><p>{1}</p></article>",
    ],
)
def test_content_outside_the_largest_part_stays(page):
    text = html_extract.main_text(page.format(LONG, PART))
    assert PART in text and LONG.strip() in text


@pytest.mark.parametrize(
    "page, kept, lost",
    [
        ("<article><p>{0}</p><section class='discussion'><p>{1}</p></section></article>", [LONG, PART], []),
        ("<article><p>{0}</p><div class='social-science'><p>{1}</p></div></article>", [LONG, PART], []),
        ("<article><p>{0}</p><div class='related-work-overview'><p>{1}</p></div></article>", [LONG, PART], []),
        ("<article><p>{0}</p><div class='share-buttons'><p>{1}</p></div><section class='comment-list'><p>{1}</p></section></article>", [LONG], [PART]),
        ("<article><p>{0}</p></article><article class='comment'><p>{1}</p></article>", [LONG], [PART]),
        ("<div class='post'><h2>Part one</h2><p>{0}</p><h2>Part two</h2><p>{1}</p><table><tr><td>cell</td></tr></table></div><div class='related-posts'><p>{2}</p></div>", ["Part one", LONG, "Part two", PART, "cell"], ["Other news"]),
        ("<div><div class='teaser-box-x9'>Short words</div><div class='body'><p>{0}</p><p>{1}</p></div></div>", [LONG, PART], ["Short words"]),
        ("<main><p>{0}</p><pre>x = 1\n  y = 2</pre><ul><li><a href=1>a cited page</a></li></ul></main>", [LONG, "x = 1 y = 2", "a cited page"], []),
        ("<body><div class='banner'><p>{0}</p><p>{1}</p></div></body>", [LONG, PART], []),
    ],
)
def test_names_are_a_prior_only(page, kept, lost):
    text = html_extract.main_text(page.format(LONG, PART, "Other news, of today. And more."))
    assert all(" ".join(k.split()) in text for k in kept) and not any(x in text for x in lost)


def test_path_scores_equal_a_plain_version():
    """The smoothed and fused ratios, from their definition."""
    rng = random.Random(4)
    for _ in range(30):
        n, paths = rng.randrange(1, 60), rng.randrange(1, 8)
        which = [rng.randrange(paths) for _ in range(n)]
        which = [sorted(set(which)).index(w) for w in which]
        chars, punct = [float(rng.randrange(400)) for _ in range(n)], [float(rng.randrange(9)) for _ in range(n)]
        prior = [rng.choice((1.0, html_extract.PRIOR)) for _ in set(which)]
        mean = lambda v, w: sum(x for x, k in zip(v, which) if k == w) / which.count(w)  # noqa: E731, B023
        weight = {-1: math.exp(-0.5), 0: 1.0, 1: math.exp(-0.5)}

        def smooth(v, i):
            return sum(weight[d] * v[min(max(i + d, 0), n - 1)] for d in weight) / sum(weight.values())  # noqa: B023

        text, marks = [mean(chars, w) for w in which], [mean(punct, w) for w in which]
        fused = [smooth(text, i) * (1 + smooth(marks, i)) for i in range(n)]
        want = [mean(fused, w) * prior[w] for w in range(len(prior))]
        got = html_extract.scores(np.array(which), np.array(chars), np.array(punct), np.array(prior))
        assert got == pytest.approx(want)


def test_nesting_is_linear():
    import time

    seconds = []
    for n in (4000, 32_000):
        began = time.perf_counter()
        assert len(html_extract.main_text("<div>a sentence, here." * n)) == 18 * n - 1
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 40 * max(seconds[0], 0.02)


def test_mixing_takes_the_rows_that_its_blocks_say(spark, monkeypatch):
    """Which rows stand in which pass, from the hashes: whole passes, then blocks in the order of their hash, then rows in the order of theirs."""
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 40)
    rng = random.Random(6)
    rows = [(i, " ".join(["word"] * rng.randrange(1, 9)), "big" if i % 4 else f"s{i % 3}") for i in range(500)] + [(1000, None, None), (1001, "", "none")]
    out = Counter((r.doc_id, r.epoch) for r in mixed(spark, rows, repeat=2.0))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = {r.doc_id: r.n for r in df.select("doc_id", mixing.tokens(F.col("text")).alias("n")).collect()}
    sources = {}
    for i, _, s in rows:
        sources.setdefault(s or "", []).append(i)
    total = {s: sum(n[i] for i in ids) for s, ids in sources.items()}
    whole = {s: t for s, t in total.items() if t}
    every, most, least = sum(whole.values()), max(whole.values()), min(whole.values())
    a = 1 - math.log(2) / math.log(most / least)
    want = Counter()
    hashed = df.select("doc_id", F.coalesce("source", F.lit("")).alias("s"), F.xxhash64("doc_id", "text").alias("hd"))
    block = F.pmod(F.xxhash64("hd", F.lit("block")), F.lit(1).cast("long"))
    for s, ids in sources.items():
        if not total[s]:
            want.update({(i, 0): 1 for i in ids})
            continue
        goal = round(most * (total[s] / most) ** a)
        passes, left = divmod(goal, total[s])
        want.update({(i, e): 1 for i in ids for e in range(passes)})
        count = max(1, -(-total[s] // 40))
        block = F.pmod(F.xxhash64("hd", F.lit("block")), F.lit(count)).cast("int")
        placed = hashed.filter(F.col("s") == s).withColumn("block", block).withColumn("hb", mixing.block_hash("s", "block")).collect()
        by = {}
        for r in placed:
            by.setdefault((r.hb, r.block), []).append((r.hd, r.doc_id))
        for key in sorted(by):
            size = sum(n[i] for _, i in by[key])
            if size <= left:
                want.update({(i, passes): 1 for _, i in by[key]})
                left -= size
                continue
            for _, i in sorted(by[key]):
                if n[i] > left:
                    break
                want[i, passes] = 1
                left -= n[i]
            break
    assert every and out == want


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null, empty, long and repeated rows, clashing columns, and no rows at all, through every stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    phrase = " ".join(f"w{k}" for k in range(20))
    long = " ".join(f"x{k % 977}y{k % 31}" for k in range(60_000))
    rows = [(1, "", "s", 5), (2, None, "s", 5), (None, "no id here", None, 5), (None, "no id here", "", 5), (3, long, "t", 5), (4, long, "t", 5), (5, phrase, "t", 5), (6, "plain words of no note", "s", 5), (6, "plain words of no note", "s", 5)]
    schema = "doc_id long, text string, source string, shard int, slot int, id string, `n` string, epoch int, component string"
    for name, data in (("odd", [(*r, 1, "i", "n", 2, "c") for r in rows]), ("none", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, phrase), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
        out = pipeline.run(spark, d)
        assert sorted(out.columns) == sorted(x.split()[0].strip("`") for x in schema.split(", "))
        found = Counter(r.doc_id for r in out.collect())
        assert set(found) == ({1, 2, 3, 6, None} if data else set())
        if data:
            assert found[None] >= 2 and {r.shard for r in out.collect()} != {5}


def test_scores_follow_from_the_weights():
    """A text's score is the logistic of the bias and the weights of the words and word beginnings that it holds, each once."""
    import re

    def plain_features(text):
        out = set()
        for word in re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode()):
            out.add(("word", word))
            out |= {("begins", word[:n]) for n in range(3, 10) if len(word) > n}
        return out

    rng = random.Random(1)
    words = ["alpha", "alphabet", "été", "a", "xy", "longerword1", "漢字仮名", "Alpha", "BETA"]
    rows = [" ".join(rng.choice(words) for _ in range(rng.randrange(8))) for _ in range(200)] + ["", "alpha" * 5000]
    told = sorted({f for t in rows for f in plain_features(t)})
    hashes = {}
    for kind, piece in told:
        data = np.frombuffer(piece if kind == "word" else piece + b"zzz", np.uint8)
        _, h = toxicity.features(data, np.array([0, len(data)]))
        hashes[kind, piece] = int(h[0]) if kind == "word" else int(h[1:][len(piece) - 3])
    known = told[::2]
    weight = {f: rng.uniform(-2, 2) for f in known}
    order = sorted(known, key=lambda f: hashes[f])
    model = toxicity.Model(np.array([hashes[f] for f in order], np.uint64), np.array([weight[f] for f in order]), -0.5)
    want = [1 / (1 + math.exp(0.5 - sum(weight.get(f, 0) for f in plain_features(t)))) for t in rows]
    assert model.scores(pa.array([*rows, None])) == pytest.approx([*want, 1 / (1 + math.exp(0.5))])


def test_scratch_tables_are_dropped(spark):
    from siftwell.llm.common import dropping
    from siftwell.llm.minhash_dedup import near_duplicates

    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id long, text string")
    with dropping():
        scratch = Scratch(spark)
        rows = near_duplicates(docs).collect()
        table = scratch.save(docs)
        assert table.count() == 3
    from pathlib import Path

    assert len(rows) == 3 and not Path(scratch.folder.removeprefix("file:")).exists()
    base = Path(scratch.folder.removeprefix("file:")).parent
    with dropping():
        before = set(base.iterdir())
        near_duplicates(docs).collect()
    assert set(base.iterdir()) <= before
