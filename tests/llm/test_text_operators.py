"""Near copies, decontamination, lines and licences against plain versions, with the cases that data may bring."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from siftwell.llm import decontaminate, licences, line_dedup, minhash_dedup
from siftwell.llm import sets as shingle_sets
from siftwell.llm.common import Scratch
from siftwell.llm.components import components
from tests.llm import plain

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "été", "ÉTÉ", "漢字"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = "edit%d" % rng.randrange(10**6)
    return " ".join(w)


def family():
    """Texts with exact copies, chains of edits, a large group with outliers, a common passage, short, empty and null ones."""
    rng = random.Random(5)
    rows = ["", None, " \t\n", "one", "ONE", "one two three four", "one two three four five", "A\x0bb\x0cc d e f", "A b c d e f"]
    base = prose(rng, 120)
    rows += [base] * 3 + [edited(rng, base, k % 9) for k in range(60)]
    chain = prose(rng, 100)
    for _ in range(12):
        chain = edited(rng, chain, 3)
        rows.append(chain)
    passage = prose(rng, 30)
    rows += [prose(rng, 20) + " " + passage for _ in range(30)]
    rows += [" ".join(base.split()[:k]) for k in (60, 80, 90, 95, 100, 110)]
    rows += [prose(rng, rng.randrange(1, 60)) for _ in range(40)]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


def test_near_copies_equal_brute_force(spark):
    rows = family()
    docs = spark.createDataFrame([(i, t, 7, 1, "y") for i, t in rows], "doc_id long, text string, n long, id long, rep string")
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert found == plain.near(rows)


def test_near_copies_of_repeated_and_null_ids(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    docs = spark.createDataFrame([(1, a), (1, a), (2, b), (1, b), (None, a), (None, None), (9, "x" * 100_000)], "doc_id long, text string")
    out = sorted((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect() if r.doc_id is not None)
    assert out == [(1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (9, 9, True)]
    assert [(r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).filter("doc_id is null").collect()] == [(None, True)] * 2
    stay = minhash_dedup.representatives(docs).collect()
    assert sorted((r.doc_id, r.text[0]) for r in stay if r.doc_id is not None) == [(1, "a"), (1, "p"), (9, "x")]
    assert sum(r.doc_id is None for r in stay) == 2


def test_rows_are_judged_where_an_id_holds_most_of_them(spark):
    rows = [((0 if k % 5 else i), t) for k, (i, t) in enumerate(family())] + [(0, None), (0, ""), (0, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, place int").repartition(4)
    links = plain.near([(k, t) for k, (_, t) in enumerate(rows)])
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(links[k][1], []).append((i, k))
    stay = minhash_dedup.representatives(docs).collect()
    assert len(stay) == len(groups)
    assert {links[r.place][1]: r.doc_id for r in stay} == {g: min(v)[0] for g, v in groups.items()}
    again = minhash_dedup.representatives(docs.withColumn("doc_id", F.col("place").cast("long")))
    assert {r.place for r in again.collect()} == set(groups)


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 200 + (i + 1) % 30) for i in range(30)] + [(300, 300)]
    names = list(range(400))
    rng.shuffle(names)
    pairs = [(names[a], names[b]) for a, b in pairs]
    rng.shuffle(pairs)
    found = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark)).collect()}
    ids = {x for a, b in pairs if a != b for x in (a, b)}
    assert found == {k: v for k, v in plain.roots(pairs, range(400)).items() if k in ids}


BENCH = [(1, "the quick brown fox jumps over the lazy dog and then runs away quickly home"), (2, "short item"), (10, "short ITEM"), (3, ""), (4, None), (None, "unnamed passage here"), (5, "été à la mer"), (2, "short item"), (6, " ".join(f"w{i}" for i in range(40)))]
TEXTS = [
    "", None, "...", "Short, item!", "xx The quick brown fox jumps over the lazy dog, and then runs away quickly home yy", "quick brown fox jumps over the lazy dog and then runs away quickly home",
    "the quick brown fox jumps over the lazy dog and then runs away slowly", "unnamed passage here", "ÉTÉ à la mer and été à la mer", "short item " * 50, " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(5, 30)),
    "filler " * 400 + "short item", "filler " * 38 + "short item", "filler " * 39 + "short item", "short short item item", "w0 " * 20,
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination_equals_brute_force(spark, block_bytes):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_hit long")
    bench = spark.createDataFrame([(i, t, "z") for i, t in BENCH], "item_id long, text string, items string")
    out = decontaminate.report(docs, bench, block_bytes=block_bytes, shard_bytes=300)
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()}
    assert found == {i: plain.contamination(t, BENCH) for i, t in enumerate(TEXTS)}
    stay = {r.doc_id for r in decontaminate.clean(docs, bench, block_bytes=block_bytes).collect()}
    assert stay == {i for i, x in found.items() if not x[4]}


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "keep Short  item, keep"), (2, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame(BENCH[1:2], "item_id long, text string")
    assert sorted(map(tuple, decontaminate.cut(docs, bench).collect())) == [(1, "keep , keep"), (2, "nothing")]
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.report(docs, none).collect()] == [0, 0]


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_cut_keeps_rows_and_columns(spark, block_bytes):
    phrase = " ".join(f"w{k}" for k in range(13))
    rows = [(1, "a", f"Before, {phrase.upper()}! after", "x"), (1, "b", "clean", "y"), (None, "c", phrase, None), (2, None, None, "z"), (1, "a", f"Before, {phrase.upper()}! after", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, id string, text string, `spans.start` string")
    bench = spark.createDataFrame([(1, phrase), (None, phrase), (2, "another item of some length"), (1, phrase)], "item_id long, text string")
    found = decontaminate.cut(docs, bench, block_bytes=block_bytes)
    want = [(i, c, "Before, ! after" if t and "Before" in t else "" if t == phrase else t, z) for i, c, t, z in rows]
    assert found.columns == docs.columns and sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_contamination_of_a_very_long_text(spark):
    rng = random.Random(7)
    phrase = [f"p{k}" for k in range(20)]
    words = [f"w{rng.randrange(5000)}" for _ in range(400_000)]
    for at in (0, 200_000, 399_980):
        words[at : at + 20] = phrase
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in decontaminate.report(docs, spark.createDataFrame([(5, " ".join(phrase))], "item_id long, text string")).collect()}
    assert (out[1].n_words, out[1].n_hit, out[1].n_items, out[2].n_words) == (400_000, 60, 1, 0)


def test_random_contamination(spark):
    rng = random.Random(8)
    bench = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 25)))) for i in range(12)]
    docs = [(i, " ".join(rng.choice("abcdexyz") for _ in range(rng.randrange(0, 200)))) for i in range(60)]
    docs += [(100 + i, docs[i][1] + " " + bench[i % 12][1]) for i in range(20)]
    out = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), shard_bytes=2000)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()} == {i: plain.contamination(t, bench) for i, t in docs}


def windows(line, chars=line_dedup.CHARS):
    return {line[k : k + chars] for k in range(max(1, len(line) - chars + 1))}


def deduplicated(rows):
    """Plain line dedup: {id: kept text}; rows are distinct."""
    where = [(i, n, x) for i, t in sorted(rows) for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\x0b\f\r")]
    lines = sorted({x for _, _, x in where})
    sets = [windows(x) for x in lines]
    links = [(a, b) for a in range(len(lines)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = dict(zip(lines, plain.roots(links, range(len(lines))).values()))
    first, gone = {}, set()
    for i, n, x in where:
        if first.setdefault(root[x], (i, n)) != (i, n):
            gone.add((i, n))
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    base = [prose(rng, rng.randrange(20, 50)) for _ in range(6)]
    rows = [(0, ""), (1, None), (2, "  \n\n \t"), (3, "short\nshort\nother")]
    for i in range(4, 60):
        own = [prose(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(0, 4))]
        own += [edited(rng, rng.choice(base), rng.randrange(0, 3)) for _ in range(rng.randrange(0, 3))] + ["common line of all documents"] * rng.randrange(0, 2)
        rng.shuffle(own)
        rows.append((i, "\n".join(own)))
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, line long, key string")
    found = {r.doc_id: r for r in line_dedup.deduplicate(docs).collect()}
    assert {i: r.text for i, r in found.items()} == deduplicated(rows)
    assert (found[1].n_lines, found[1].n_kept, found[2].n_lines, found[3].n_lines, found[3].n_kept) == (0, 0, 0, 3, 2)


def lines_of_few_words(n, seed=6):
    """Documents of lines many of which are half alike, so that they meet without a link, and some linked only through others."""
    rng = random.Random(seed)
    base = [prose(rng, 24) for _ in range(4)]
    return [(i, "\n".join(edited(rng, rng.choice(base), rng.randrange(2, 9)) for _ in range(2))) for i in range(n)]


@pytest.mark.parametrize("limits", [(128, 1 << 25), (2, 64)])
def test_small_buckets_are_paired_and_large_ones_are_not(spark, monkeypatch, limits):
    rows, used = lines_of_few_words(60), []
    differ = line_dedup.differences
    monkeypatch.setattr(line_dedup, "differences", lambda *given: used.append(1) or differ(*given))
    monkeypatch.setattr(line_dedup, "PIVOT_BYTES", limits[1])
    out = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), paired=limits[0])
    assert {r.doc_id: r.text for r in out.collect()} == deduplicated(rows)
    assert bool(used) == (limits[0] == 2)


def test_overlaps_of_many_pairs_at_once(spark):
    rng = random.Random(2)
    lines = ["", "a", *("".join(rng.choice("ab\u4e2d") for _ in range(rng.choice((3, 9, 40, 3000)))) for _ in range(60))]
    wanted = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    pairs = spark.createDataFrame([(a, b) for a in range(len(lines)) for b in range(0, len(lines), 7)], "a long, b long")
    sets = [windows(x) if x else set() for x in lines]
    found = shingle_sets.compared(pairs, wanted, shingle_sets.char_shingles(line_dedup.CHARS)).collect()
    assert len(found) == pairs.count() and all((r.both, r.na, r.nb) == (len(sets[r.a] & sets[r.b]), len(sets[r.a]), len(sets[r.b])) for r in found)


def test_overlaps_by_one_sort():
    rng = random.Random(5)
    x, y = (["".join(rng.choice("ab\u4e2d") for _ in range(rng.choice((0, 3, 9, 40)))) for _ in range(300)] for _ in range(2))
    y[::3] = x[::3]
    sets = [[windows(t) if t else set() for t in column] for column in (x, y)]
    found = shingle_sets._overlaps(pa.array(x), pa.array(y), shingle_sets.char_shingles(line_dedup.CHARS))
    assert found.T.tolist() == [[len(a & b), len(a), len(b)] for a, b in zip(*sets, strict=True)]


def test_bands_tell_lines_apart_without_their_keys(spark):
    lines = spark.createDataFrame([(1, "one line of text"), (2, "one line of text"), (1, "one line of text"), (3, "quite another one")], "key long, line string")
    found = {r.key: r.bands for r in line_dedup.signatures(lines.coalesce(1)).collect()}
    band, mark = ({k: [f(v) for v in vs] for k, vs in found.items()} for f in (lambda v: v >> line_dedup.MARK, lambda v: v % (1 << line_dedup.MARK)))
    assert band[1] == band[2] and not set(band[1]) & set(band[3]) and len(set(band[1])) == line_dedup.BANDS
    assert all(a != b for a, b in zip(mark[1], mark[2], strict=True)) and len(set(mark[1])) > 1


def test_bitmaps_lose_no_pair_that_is_alike(spark):
    rng = random.Random(9)
    lines = ["a", "short", "ab" * 40, *(x for _, t in lines_of_few_words(20) for x in t.split("\n"))]
    lines += [edited(rng, x, 1) for x in lines[3:]] + [prose(rng, k) for k in (1, 5, 60, 150, 900) for _ in range(4)]
    wanted = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    pairs = spark.createDataFrame(list(itertools.combinations(range(len(lines)), 2)), "a long, b long")
    found = shingle_sets.screened(pairs, shingle_sets.bitmaps(wanted, shingle_sets.char_shingles(line_dedup.CHARS)), 75).collect()
    sets = [windows(x) for x in lines]
    assert len(found) == pairs.count() and all((r.na, r.nb) == (len(sets[r.a]), len(sets[r.b])) for r in found)
    alike = {(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    near = {(r.a, r.b) for r in found if r.near}
    assert alike <= near and len(near - alike) < len(found) // 10 and len(alike) > 30


def test_pairs_that_bitmaps_tell_apart_need_no_texts(spark, monkeypatch):
    inner, pairs, texts = line_dedup.compared, [], []

    def watched(frame, x, shingler, y):
        pairs.append(frame.collect())
        texts.append({r.id: r.text for r in x.unionByName(y).collect()})
        return inner(frame, x, shingler, y)

    monkeypatch.setattr(line_dedup, "compared", watched)
    rng, rows = random.Random(3), lines_of_few_words(60)
    rows += [(60 + i, edited(rng, t.split("\n")[0], 1)) for i, t in rows[:20]]
    assert {r.doc_id: r.text for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == deduplicated(rows)
    both = [(windows(t[r.a]), windows(t[r.b])) for found, t in zip(pairs, texts, strict=True) for r in found]
    assert both and all(len(a & b) * 2 > len(a | b) for a, b in both)


def test_only_texts_that_a_side_names_travel(spark, monkeypatch):
    inner, seen = line_dedup.compared, []

    def watched(pairs, wanted, shingler, other):
        seen.append(all({r[0] for r in pairs.select(k).collect()} == {r.id for r in side.collect()} for k, side in (("a", wanted), ("b", other))))
        return inner(pairs, wanted, shingler, other)

    monkeypatch.setattr(line_dedup, "compared", watched)
    rows = lines_of_few_words(30)
    out = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == deduplicated(rows) and seen and all(seen)


def test_repeated_rows_are_one_document_of_lines(spark):
    docs = spark.createDataFrame([(1, "a b\nc d"), (1, "a b\nc d"), (2, "a b"), (None, "c d")], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.n_kept, r.text) for r in line_dedup.deduplicate(docs).collect())
    assert out == [(0, 1, "c d"), (1, 1, "a b"), (1, 1, "a b"), (2, 0, "")]


def test_shingles_cover_every_character():
    rng = random.Random(8)
    lines = ["", "  ", "a", " a  bc ", "x" * 16, "x" * 17, "ab " + "y" * 40 + " c", "\ta\tb\tc and\tmore of it\t", "\U00020000" * 17 + " a"]
    lines += ["".join(rng.choice("ab \t\u4e2d\U00020000") * rng.choice((1, 1, 9)) for _ in range(rng.randrange(40))) for _ in range(300)]
    sets = list(shingle_sets.sets_of(pa.array(lines), shingle_sets.char_shingles(line_dedup.CHARS)))
    hashes = {}
    for line, found in zip(lines, sets, strict=True):
        assert len(found) == (len(windows(line)) if line else 0)
        for w in windows(line) if line else ():
            (one,) = next(shingle_sets.sets_of(pa.array([w]), shingle_sets.char_shingles(line_dedup.CHARS)))
            assert hashes.setdefault(w, one) == one and one in found
    assert len(set(hashes.values())) == len(hashes)


def test_lines_with_a_common_beginning_stay(spark):
    texts = ["https://example.com/articles/one\nhttps://example.com/articles/two-entirely-different", "id-0000000000000000\tone\tred\nid-0000000000000000\ttwo\tblue", "\u5929\u5730\u7384\u9ec3" * 4 + "\u5b87\u5b99\u6d2a\u8352" * 4 + "\n" + "\u5929\u5730\u7384\u9ec3" * 4 + "\u65e5\u6708\u76c8\u6603" * 4]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.deduplicate(docs).collect()} == dict(enumerate(texts))


@pytest.mark.parametrize("union", [4, 8, 16, 64])
def test_recall_of_lines_at_the_threshold(spark, union):
    """Pairs of lines whose sets share three of four shingles, the least that links them."""
    rng = random.Random(union)
    letters = [chr(0x4E00 + i) for i in range(5000)]
    rows = []
    for i in range(1000):
        line = "".join(rng.sample(letters, union * 3 // 4 + 6))
        rows += [(2 * i, line), (2 * i + 1, "".join(rng.sample(letters, union // 4)) + line)]
    sets = {i: windows(t) for i, t in rows}
    assert all(len(sets[i] | sets[i + 1]) == union and 4 * len(sets[i] & sets[i + 1]) == 3 * union for i in range(0, 2000, 2))
    out = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    gone = {r.doc_id for r in out.filter("n_kept = 0").collect()}
    assert gone <= set(range(1, 2000, 2)) and len(gone) >= 990


def test_many_lines_that_go_and_long_lines(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghijklmnop \u00e9") for _ in range(300_000))
    many = "\n".join(["kept once", *(f"{'again and again':>30}" if k % 2 else f"line number {'one two three four five six seven eight nine ten'.split()[k % 10]} {rng.random()}" for k in range(4000))])
    rows = [(1, long), (2, many), (3, long[:-5] + "xyzzy"), (4, many)]
    found = {r.doc_id: r for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].n_kept == 1 and found[3].n_kept == 0 and found[4].n_kept == 0
    assert found[2].text.split("\n").count(f"{'again and again':>30}") == 1 and found[2].n_kept == len(found[2].text.split("\n"))


def paragraphs_of_one_page(n, seed=1):
    """n distinct documents that each keep seven of a page's ten paragraphs, in order."""
    rng = random.Random(seed)
    page = [prose(rng, 60) for _ in range(10)]
    kept = rng.sample(list(itertools.combinations(range(10), 7)), n)
    return [(i, "\n".join(page[k] for k in ks)) for i, ks in enumerate(kept)]


@pytest.mark.parametrize("n", [30, 60, 119])
def test_a_group_of_one_page_is_not_paired_with_itself(spark, monkeypatch, n):
    rows, pairs = paragraphs_of_one_page(n), []
    inner = minhash_dedup.compared

    def counted(frame, *args):
        pairs.append(frame.count())
        return inner(frame, *args)

    monkeypatch.setattr(minhash_dedup, "compared", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert found == plain.near(rows)
    # Members meet their pivots, of which each has a bounded number; nothing else is compared.
    assert sum(pairs[1:]) <= n and pairs[0] <= 20 * n


def test_groups_of_edited_templates_equal_brute_force(spark):
    """Pivots that are themselves odd, members within and beyond the template, and links between members alone."""
    rng = random.Random(21)
    rows = []
    for g in range(6):
        page = prose(rng, 160).split()
        for k in range(40):
            words = list(page)
            for _ in range(rng.choice((0, 1, 3, 6))):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(0, 12)] = prose(rng, rng.randrange(0, 14)).split()
            rows.append((1000 * g + k, " ".join(words)))
        for k in range(3):  # an edited copy of a member that is far from the rest
            words = (page[40:] + prose(rng, 30).split())[k:]
            rows += [(1000 * g + 100 + k, " ".join(words)), (1000 * g + 200 + k, edited(rng, " ".join(words), 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert found == plain.near(rows)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_clean_judges_rows_and_not_ids(spark, block_bytes):
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(13))) for i in range(4)], "item_id long, text string")
    bad = " ".join(f"w2x{k}" for k in range(13))
    docs = spark.createDataFrame([(None, bad), (None, "clean one"), (1, bad), (1, "clean two"), (2, None)], "doc_id long, text string")
    out = decontaminate.clean(docs, bench, block_bytes=block_bytes)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(None, "clean one"), (1, "clean two"), (2, None)], key=repr)


LICENCES = {
    "Licensed under the Apache License, Version 2.0.": ["apache"], "Released under the MIT License.": ["mit"], "This work is licensed under the GNU General Public License, version 3.": ["gpl"], "Licensed under CC BY-NC 4.0.": ["cc-by-nc"],
    "All rights reserved.": ["proprietary"], "text\nLICENSED UNDER CC BY 4.0\nmore\nAll rights reserved.": ["cc-by", "proprietary"], "She lost her driving licence.": [], "Licensed under the Blorb Data Licence 3.": [], "no such words": [], "": [],
}


def paragraphs(text):
    if re.search(r"\n[ \t\r\f\x0b]*\n", text):
        out = []
        for block in re.split(r"\n(?:[ \t\r\f\x0b]*\n)+", text):
            lines = block.split("\n")
            ended = sum(bool(re.search(r"""[.!?]["')\]]*[ \t\r\f\x0b]*$""", x)) for x in lines[:-1])
            out += [block] if max(map(len, lines)) <= licences.WRAP and 2 * ended < len(lines) - 1 else lines
    else:
        out = text.split("\n")
    return [p for p in out if p.strip(" \t\n\r\f\x0b")]


def licensed(text):
    """(n_paragraphs, n_licence, n_unknown, families) of a text."""
    ps = paragraphs(text or "")
    said = [f for f in (licences.family_of(p)[0] for p in ps) if f != "none"]
    return len(ps), len(said), said.count("unknown"), sorted({*said} - {"unknown"})


def test_licences(spark):
    texts = [*LICENCES, None]
    docs = spark.createDataFrame([(i, t, ["c"], "w", 3) for i, t in enumerate(texts)], "doc_id long, text string, families array<string>, words string, line int")
    found = {r.doc_id: r for r in licences.scan(docs).collect()}
    for i, t in enumerate(texts):
        assert tuple(found[i])[1:] == licensed(t), t
        assert found[i].families == LICENCES.get(t, []), t
    assert found[texts.index("Licensed under the Blorb Data Licence 3.")].n_unknown == 1
    assert found[texts.index("She lost her driving licence.")].n_licence == 0


MIT = """The MIT License (MIT)

Copyright (c) 2019 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
SHIPPED = {
    "mit": MIT,
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.",
    "apache": "Copyright 2021 Example Authors\n\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nYou should have received a copy of the GNU General Public License\nalong with this program.  If not, see <https://www.gnu.org/licenses/>.",
    "zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:",
    "boost": "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt or copy at\nhttps://www.boost.org/LICENSE_1_0.txt)\n\n",
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified\ncopies of this license document, and changing it is allowed as long\nas the name is changed.\n\n 0. You just DO WHAT THE FUCK YOU WANT TO.",
}


def test_shipped_licences_wrapped_and_not(spark):
    texts = [(f, t) for f, t in SHIPPED.items()]
    texts += [(f, "\n\n".join(" ".join(p.split()) for p in t.split("\n\n"))) for f, t in SHIPPED.items()]
    found = {r.doc_id: r for r in licences.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()}
    for i, (family, text) in enumerate(texts):
        assert tuple(found[i])[1:] == licensed(text)
        assert found[i].families == [family], (family, found[i])


def test_mentions_are_no_statements():
    for text in ("We do not use the GNU General Public License, version 3 here.", "This is not licensed under the MIT License.", "Her thesis is about the history of the Apache License.", "The pub lost its licence."):
        assert licences.family_of(text)[0] == "none", text
    for text in ("Released under WTFPL.", "This work is licensed under the Mozilla Public License 2.0."):
        assert licences.family_of(text)[0] not in ("none", "unknown"), text


#: Written by hand, none of them by the generator of the training sentences.
HELD = [
    ("SPDX-License-Identifier: MIT","mit"), ("// SPDX-License-Identifier: GPL-2.0-only","gpl"), ("# SPDX-License-Identifier: Apache-2.0","apache"), ("/* SPDX-License-Identifier: BSD-3-Clause */","bsd"), ("SPDX-License-Identifier: LGPL-2.1-or-later","lgpl"), ("SPDX-License-Identifier: AGPL-3.0-or-later","agpl"), ("SPDX-License-Identifier: MPL-2.0","mpl"), ("SPDX-License-Identifier: ISC","isc"), ("SPDX-License-Identifier: BSL-1.0","boost"), ("SPDX-License-Identifier: CC-BY-SA-4.0","cc-by-sa"), ("SPDX-License-Identifier: Unlicense","public-domain"),
    ("Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.","gpl"), ("under the terms of the BSL-1.1","unknown"), ("SPDX-License-Identifier: BUSL-1.1","unknown"), ("SPDX-License-Identifier: SSPL-1.0","unknown"),
    ("the license of the car and the permission was granted free of charge","none"), ("My permission to fish in the lake is granted by the town, free of charge.","none"), ("Use of the hall is subject to the following conditions: no shoes, no dogs.","none"), ("The students redistributed the chairs in the room.","none"), ("MIT researchers found a new method for storing heat.","none"), ("Her MIT thesis was on boats.","none"), ("The general public was invited to view the version of the plan.","none"),
    ("This software is released under the MIT license.","mit"), ("This package is free software; you may use it under the terms of the GNU GPL, version 2.","gpl"), ("Made available under the Apache License, Version 2.0.","apache"), ("Code released under the BSD 3-Clause License, docs under CC BY 4.0.",None),("Content on this site is licensed under a Creative Commons Attribution 4.0 International license.","cc-by"), ("All rights reserved.","proprietary"), ("See LICENSE for the terms of the Zorblax Public License.","unknown"),
    ("Licensed under the Mozilla Public License version 2.0","mpl"), ("MIT License","mit"), ("The MIT License (MIT)","mit"), ("GNU GENERAL PUBLIC LICENSE","gpl"), ("GNU LESSER GENERAL PUBLIC LICENSE Version 3","lgpl"), ("Apache License Version 2.0, January 2004","apache"), ("Boost Software License - Version 1.0","boost"),
]


def test_statements_that_the_generator_did_not_write():
    wrong = [(text, family, said) for text, family in HELD if family and (said := licences.family_of(text)[0]) != family]
    assert len(wrong) <= 1, wrong
    assert not [x for x in wrong if "SPDX" in x[0] or "verbatim" in x[0] or "BSL" in x[0]]


def test_statements_of_two_families_in_plain_and_native_form(spark):
    """A tie of the classes has one result in both forms: the first family in order that is the largest."""
    texts = ["Licensed under the MIT License and the Apache License 2.0.", "MIT License\nApache License 2.0", "GPL or LGPL", "word " * 200_000 + "Released under the MIT License." + " word" * 200_000]
    found = {r.doc_id: r for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        assert tuple(found[i])[1:] == licensed(text)


def test_calibration_on_families_and_frames_left_out():
    """Families that a fit has not seen must be unknown; the rest are frames that it has not seen. Each gap between confidence and accuracy is
    weighted by how many sentences fall into its tenth."""
    odds, right = licences.out_of_fold()
    t, unknown = licences.calibrated(odds, right)
    odds[:, licences.CLASSES.index("unknown")] += unknown
    z = odds / t
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    hit, sure = p.argmax(1) == right, p.max(1)
    tenth = np.minimum((sure * 10).astype(int), 9)
    error = sum((tenth == k).mean() * abs(hit[tenth == k].mean() - sure[tenth == k].mean()) for k in range(10) if (tenth == k).any())
    assert error < 0.06 and hit.mean() > 0.75
    family = right < len(licences.FAMILIES)
    assert hit[family].mean() > 0.85


def test_licences_of_synthetic_documents_equal_plain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: tuple(r)[1:] for r in licences.scan(docs).collect()}
    assert found == {r.doc_id: licensed(r.text) for r in docs.collect()}


def test_licence_in_a_very_long_text(spark):
    rng = random.Random(1)
    words = [rng.choice(WORDS) for _ in range(120_000)]
    docs = spark.createDataFrame([(1, " ".join(words) + "\nReleased under the MIT License.\n" + " ".join(words)), (None, MIT), (None, MIT)], "doc_id long, text string")
    out = sorted(((r.doc_id or 0, r.n_paragraphs, r.families) for r in licences.scan(docs).collect()))
    assert out == [(0, 4, ["mit"]), (0, 4, ["mit"]), (1, 3, ["mit"])]


@pytest.mark.parametrize("run", [minhash_dedup.near_duplicates, minhash_dedup.representatives, line_dedup.deduplicate, licences.scan])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_empty_decontamination(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.report(docs, spark.createDataFrame(BENCH, "item_id long, text string")).count() == 0
