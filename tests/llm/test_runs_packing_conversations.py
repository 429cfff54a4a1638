"""Periodic runs, packing and conversation repair against plain versions."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from siftwell.llm import conversations, packing, runs, word_tokens

DATA = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def rows_of(table):
    return [dict(zip((c[0] for c in r.description), x)) for r in [duckdb.execute(f"select * from '{DATA}/{table}.parquet'")] for x in r.fetchall()]


# ------------------------------------------------------------------------------------------------ periodic runs


def plain_runs(w, least=6, times=4):
    """{(start, length, period)} by comparing words p apart, for every p."""
    found = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > s and i - s + p >= max(least, times * p):
                found.setdefault((s, i - s + p), p)
            i += i == s
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in dropped)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_op13(doc_id, text):
    w = spaced(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    best = max(found, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *head, sha("".join(f"{s},{k},{p}\n" for s, k, p in found)), sha(collapsed(w, found)))


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(0, 4)):
            w = [rng.randint(0, rng.choice([0, 1, 2])) for _ in range(rng.randint(0, 60))]
            if w and rng.random() < 0.5:
                w += w[: rng.randint(1, 6)] * rng.randint(3, 9) + w[:2]
            docs.append(w)
        first = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
        doc, start, length, period = runs.runs_of(np.array([x for w in docs for x in w], np.uint64), first)
        for i, w in enumerate(docs):
            got = [tuple(map(int, r)) for d, *r in zip(doc, start, length, period, strict=True) if d == i]
            assert got == plain_runs(w)


@pytest.mark.parametrize("times, least", [(2, 2), (3, 9), (5, 6)])
def test_runs_of_other_parameters(times, least):
    rng = random.Random(times)
    for _ in range(200):
        w = [rng.randint(0, 1) for _ in range(rng.randint(1, 40))]
        got = runs.runs_of(np.array(w, np.uint64), np.array([0, len(w)]), least, times)
        assert [tuple(map(int, r)) for r in zip(*got[1:], strict=True)] == plain_runs(w, least, times)


def test_a_long_loop_and_its_multiples():
    w = list(range(50)) + [7, 8, 9] * 20_000 + [1]
    got = runs.runs_of(np.array(w, np.uint64), np.array([0, len(w)]))
    assert [int(x[0]) for x in got[1:]] == [50, 60_000, 3]


def test_op13_equals_the_plain_version(spark):
    docs = rows_of("documents")
    found = runs.report(spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    assert sorted(map(tuple, found)) == sorted(plain_op13(d["doc_id"], d["text"]) for d in docs)


def test_op13_odd_rows(spark):
    texts = [None, "", " \n\t", "a", "a a a a a a", "a a a a a", "A a A a A a A a", "x " * 9, "é ü é ü é ü é ü é", "p q " * 5 + "r " * 7 + "p q " * 4]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(None, "b b b b b b b", "k"), (None, None, "k"), (4, "a a a a a a", "k"), (4, "a a a a a a", "k")]
    # ids whose crc32 is divisible by ten, so that texts of each size are damaged
    rows += [(i, " ".join(f"w{k}" for k in range(i % 13)), "k") for i in range(100, 400) if zlib.crc32(str(i).encode()) % 10 == 0]
    df = spark.createDataFrame(rows, "doc_id long, text string, `runs` string")
    found = runs.report(df).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted((plain_op13(i, t) for i, t, _ in rows), key=key)
    assert runs.report(df.limit(0)).collect() == []


# ------------------------------------------------------------------------------------------------ packing


def test_word_ids_equal_the_library():
    e, rng = word_tokens.WordEncoder(WORDS), random.Random(3)
    assert e.plain
    parts = ["'", "s", "t", "re", "LL", "ve", "m", "d", "É", "ß", "Ü", "×", "÷", " ", "\n", " ", "\x1c", "\x00", "1", "23", "½", "é", "!", "_", "<|endoftext|>", "<|EndOfText|>", "σ", "Σ", "İ", "中", "́", "ſ", "a", "Z", "\x85", "😀", "ª"]
    for _ in range(600):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4)]
        raw = [t.encode() for t in texts]
        ids, begin = e.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))
        for k, t in enumerate(texts):
            assert ids[begin[k] : begin[k + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_a_tokenizer_of_another_form_encodes_whole_texts():
    e = word_tokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    raw = [b"one two", b"", b"three"]
    ids, begin = e.encode(np.frombuffer(b"".join(raw), np.uint8), np.array([0, 7, 7, 12]))
    assert not e.plain
    assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])] == [e.tokenizer.encode(r.decode(), add_special_tokens=False).ids for r in raw]


def test_bins_take_their_number_and_nothing_is_lost():
    rng = random.Random(9)
    for turn in range(150):
        grain = rng.choice([1, 4, 16, 64])
        bins, out, truth = packing.Bins(64, 1000), [], {}
        for part in range(rng.randint(1, 4)):
            names = [turn * 10_000 + part * 100 + i for i in range(rng.randint(0, 30))]
            sizes = [rng.choice([0, 1, 5, 63, 64, 65, 200, rng.randint(0, 150)]) for _ in names]
            ids = np.arange(sum(sizes), dtype=np.uint32)
            begin = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
            truth |= {x: [*ids[begin[k] : begin[k + 1]].tolist(), 2] for k, x in enumerate(names)}
            out += bins.add(packing._pieces(pa.array(names, pa.int64()), ids, begin, 2, 64, grain)).to_pylist()
        full = {}
        for r in out:
            full.setdefault(r["sequence_id"], []).append(r["length"])
        assert all(len(v) == 64 // v[0] and len({64 // x for x in v}) == 1 for v in full.values())
        rest = bins.rest()
        out += rest.to_pylist() if rest is not None else []
        check_pieces(out, truth, 64)


def check_pieces(rows, truth, capacity):
    """Each document's ids are there once and in order; sequences have no gap and no more than fits. Gives the padding."""
    back, sequences = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        got = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(got) == r["length"] > 0 and r["start"] == len(back.setdefault(r["doc_id"], [])) and r["doc_tokens"] == len(truth[r["doc_id"]])
        back[r["doc_id"]] += got
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert back == truth
    padding = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    return padding


def test_op12_packs_every_document(spark):
    library = Tokenizer.from_file(WORDS)
    docs = rows_of("documents")
    truth = {d["doc_id"]: [*library.encode(d["text"] or "", add_special_tokens=False).ids, 2] for d in docs}
    pieces = packing.pack(spark.read.parquet(f"{DATA}/documents.parquet").repartition(3), WORDS)
    rows = [r.asDict() for r in pieces.collect()]
    padding = check_pieces(rows, truth, 4096)
    assert padding <= 0.005 * sum(map(len, truth.values()))
    found = {(r["doc_id"], r["start"]): r for r in packing.report(spark.read.parquet(f"{DATA}/documents.parquet"), WORDS).collect()}
    assert all(zlib.crc32(np.array(truth[d][s : s + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for (d, s), r in found.items())
    assert sum(r["length"] for r in found.values()) == sum(map(len, truth.values()))


def test_packed_sequences_are_padded(spark):
    rows = [(i, "word " * n) for i, n in enumerate([0, 3, 50, 100, 127, 200])] + [(None, "x y"), (2, None)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), WORDS, capacity=64, grain=8)
    whole = packing.sequences(pieces, 64, pad=7).collect()
    assert sum(r["n_tokens"] for r in whole) == sum(n + 1 for n in (0, 3, 50, 100, 127, 200, 2, 0))
    for r in whole:
        ids = np.frombuffer(r["ids"], "<u4")
        size = r["n_tokens"] if r["n_tokens"] & (r["n_tokens"] - 1) == 0 else 64
        assert len(ids) == size and (ids[r["n_tokens"] :] == 7).all()


def test_op12_odd_rows(spark):
    long = "tail " * 60_000
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "one two", 3), (2, "one two", 3), (3, long, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int")
    out = packing.pack(df, WORDS).collect()
    assert sum(r["length"] for r in out) == 1 + 1 + 1 + 3 + 3 + 60_001
    assert sum(r["doc_id"] is None for r in out) == 1
    assert {r["doc_tokens"] for r in out if r["doc_id"] == 3} == {60_001}
    assert packing.report(df.limit(0), WORDS).collect() == []
    with pytest.raises(ValueError):
        packing.pack(df, WORDS, grain=3)


# ------------------------------------------------------------------------------------------------ conversation repair


def least_edits(signature):
    """(cost, audit) by Dijkstra over (cost, letters)."""
    after = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(signature) and state in (0, 3):
            return cost, audit
        push = lambda c, e, j, t: heapq.heappush(heap, (cost + c, audit + e, j, t))  # noqa: E731, B023
        mine = "a" if state == 2 else "u"
        push(2, "I", i, after[state][mine])
        if i < len(signature):
            x, stays = signature[i], signature[i].isupper()
            push(3, "D", i + 1, state)
            if x != "x":
                push(2 + stays, "R", i + 1, after[state][mine])
                if x.lower() in after[state]:
                    push(stays, "K", i + 1, after[state][x.lower()])


def plain_repair(conv, original):
    """The contract's row of a conversation's (turn, role, text)."""
    rows = []
    for turn, role, text in original:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    counts, seen, letters = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), ""
    for _, role, text in rows:
        ending = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not ending else "duplicate" if (role, text) in seen else "truncated" if ending[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        letters += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = least_edits(letters)
    lines, state, at = [], "", 0
    for e in audit:
        turn = "assistant" if state == "u" else "user"
        if e != "D":
            role, text = (turn, "") if e == "I" else (rows[at][1] if e == "K" else turn, rows[at][2])
            lines.append(f"{role}:{text}")
            state = role[0]
        at += e != "I"
    return (conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def check_repair(spark, rows):
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(rest)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, letter int").repartition(3)
    found = conversations.report(df).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    assert {r[0]: tuple(r) for r in found} == {c: plain_repair(c, r) for c, r in by.items()}
    assert len(found) == len(by)


def test_trie_answers_equal_dijkstra():
    rng = random.Random(2)
    signatures = sorted({"".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(0, 6))) for _ in range(700)})
    trie = conversations.Trie()
    for s in signatures:
        assert trie.answer(s) == least_edits(s), s
    nodes = {s[:k] for s in signatures for k in range(1, len(s) + 1)}
    assert trie.computed == len(nodes)  # a layer for each node, once


def test_op11_equals_the_plain_version(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows_of("conversations")]
    check_repair(spark, rows)


def test_op11_odd_rows(spark):
    rng = random.Random(8)
    texts = [None, "", " \n", "One.", "One. ", "no end", "Two!", "Two?\n", " ", "x" * 50_000 + "."]
    roles = ["user", "assistant", "system", None, "", "tool", "User", "ua"]
    rows = []
    for conv in [*range(120), None]:
        for _ in range(rng.randint(1, 7)):
            rows.append((conv, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)))
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(300)]  # a long one
    check_repair(spark, rows)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.report(empty).collect() == []


def test_repaired_turns_and_names_of_columns(spark):
    rows = [("c", 3, "assistant", "Fine."), ("c", 1, "system", "Be kind."), ("d", 1, "tool", "Hm.")]
    df = spark.createDataFrame(rows, "`a.b` string, no int, who string, said string")
    audited, lines = conversations.repair(df, conv="a.b", turn="no", role="who", text="said")
    assert {r["conv_id"]: (r["cost"], r["audit"], r["signature"], r["gaps"]) for r in audited.collect()} == {"c": (2, "KIK", "sa", 1), "d": (3, "D", "o", 0)}
    assert [tuple(r) for r in lines.orderBy("conv_id", "place").collect()] == [("c", 0, "K", "system", "Be kind."), ("c", 1, "I", "user", ""), ("c", 2, "K", "assistant", "Fine.")]


def test_a_signature_of_many_conversations_is_spread(spark):
    rows = spark.range(4000).selectExpr("id as conv_id", "explode(array(0, 1)) as turn").selectExpr("conv_id", "turn", "if(turn = 0, 'user', 'assistant') as role", "concat('Text ', conv_id, ' ', turn, '.') as text")
    signed = conversations.signatures(conversations.turns(rows))
    out = conversations.audits(signed)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tasks = out.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.selectExpr("sum(cost)").first()[0] == 0
    assert max(t["count"] for t in tasks) < 3000
