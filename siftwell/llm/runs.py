"""Stretches of words that repeat with a period (loops, boilerplate tables, stuck generators), found on a harmonic grid.

A run of period p and at least ``times`` * p words holds ``times`` neighbouring multiples of p. For each p the words at multiples of p are
compared with the next ones; where ``times`` in a row agree, the longest common extensions of jp and (j+1)p, forward and backward, give the run
that holds them, whole. The grid has n/p points for each p, n log n in all. Extensions are range minima over the common prefixes of
neighbours in the suffix arrays of the words and of the words reversed.

The same interval is found for multiples of its smallest period too (by Fine and Wilf a period of a run that is twice as long divides into the
smallest one's multiples), so of equal intervals the smallest period stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import SPACED, Ranges, in_arrow, texts

LEAST, TIMES = 6, 4
#: Grid points that are extended at a time.
AT_ONCE = 1 << 19
#: Bytes of texts that are looked at together.
TEXT_BYTES = 2 << 20
WORD = r"[^\x20\x09-\x0D]+"


class Extensions:
    """Longest common extensions of a sequence of integers that ends in one that occurs once: suffix array by doubling, common prefixes of its
    neighbours, and range minima over these."""

    def __init__(self, s: np.ndarray):
        n = len(s)
        rank = np.unique(s, return_inverse=True)[1].astype(np.int32)
        levels, reach = [rank], 1
        while int(rank.max()) + 1 < n:
            after = np.zeros(n, np.int64)
            after[:-reach] = rank[reach:].astype(np.int64) + 1
            rank = np.unique(rank.astype(np.int64) * (n + 1) + after, return_inverse=True)[1].astype(np.int32)
            levels.append(rank)
            reach *= 2
        self.rank = rank
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        common = np.zeros(n - 1, np.int32)
        for k in reversed(range(len(levels))):  # levels[k]: equal where 2^k integers are
            inside = np.flatnonzero((a < n) & (b < n))
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            for x in (a, b, common):
                x[same] += 1 << k
            levels.pop()
        self.least = [common]
        while 2 << (len(self.least) - 1) <= len(common):
            half = 1 << (len(self.least) - 1)
            row = self.least[-1]
            self.least.append(np.minimum(row[:-half], row[half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the sequence goes on alike from places a and b, which differ."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y).astype(np.int64), np.maximum(x, y).astype(np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1  # the power of two within high - low
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            some = np.flatnonzero(level == k)
            row = self.least[k]
            out[some] = np.minimum(row[low[some]], row[high[some] - (1 << int(k))])
        return out


def _grid(s: np.ndarray, p: int, times: int) -> np.ndarray:
    """Places jp from which on ``times`` multiples of p hold the same."""
    g = s[::p]
    same = g[1:] == g[:-1]
    m = len(same) - times + 2
    if m <= 0 or not same.any():
        return np.zeros(0, np.int64)
    every = same[:m].copy()
    for i in range(1, times - 1):
        every &= same[i : i + m]
    return np.flatnonzero(every) * p


def runs_of(words: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) by document, start and period. ``words``: integers that tell words apart; document i is
    ``first[i]:first[i+1]``."""
    none = (np.zeros(0, np.int64),) * 4
    counts = np.diff(first)
    if not len(words):
        return none
    owner = np.repeat(np.arange(len(counts)), counts)
    found = np.zeros(len(counts), bool)
    for p in range(1, int(counts.max()) // times + 1):  # which documents may hold any run
        at = _grid(words, p, times)
        if len(at):
            doc = owner[at]
            found[doc[doc == owner[at + (times - 1) * p]]] = True
    docs = np.flatnonzero(found)
    if not len(docs):
        return none
    # Their words one after another, each document ended by an integer of its own.
    size = counts[docs]
    begin = np.cumsum(size + 1) - (size + 1)
    total = int((size + 1).sum())
    s = np.empty(total, np.int64)
    inside = np.ones(total, bool)
    inside[begin + size] = False
    s[begin + size] = np.arange(len(docs))
    taken = np.repeat(first[docs] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    s[inside] = np.unique(words[taken], return_inverse=True)[1] + len(docs)
    forward, backward = Extensions(s), Extensions(np.concatenate((s[::-1], [-1])))
    out: list[np.ndarray] = []
    wait: list[tuple[np.ndarray, int]] = []

    def extend() -> None:
        a = np.concatenate([x for x, _ in wait])
        p = np.repeat([q for _, q in wait], [len(x) for x, _ in wait])
        wait.clear()
        ahead = forward.of(a, a + p)
        behind = backward.of(total - a, total - a - p)
        length = ahead + behind + p
        keep = length >= np.maximum(least, times * p)
        rows = np.stack((a - behind, length, p), axis=1)[keep]
        out.append(_smallest(rows))

    waiting = 0
    for p in range(1, int(size.max()) // times + 1):
        at = _grid(s, p, times)
        if len(at):
            wait.append((at, p))
            waiting += len(at)
            if waiting >= AT_ONCE:
                extend()
                waiting = 0
    if wait:
        extend()
    rows = _smallest(np.concatenate(out)) if out else np.zeros((0, 3), np.int64)
    which = np.searchsorted(begin, rows[:, 0], "right") - 1
    start = rows[:, 0] - begin[which]
    order = np.lexsort((rows[:, 2], start, which))
    return docs[which[order]], start[order], rows[order, 1], rows[order, 2]


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of rows (start, length, period) with the same interval the one of the smallest period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[fresh]


def _split(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of words, and the first word of each text."""
    word = SPACED[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[bounds] = True
    before = np.concatenate(([False], word[:-1])) if len(word) else word
    after = np.concatenate((word[1:], [False])) if len(word) else word
    start = np.flatnonzero(word & (~before | fresh[:-1]))
    return start, np.flatnonzero(word & (~after | fresh[1:])) + 1, np.searchsorted(start, bounds)


def _kept(n: int, first: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run holds after its first ``period``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first[doc] + start + period, 1)
    np.subtract.at(edge, first[doc] + start + length, 1)
    return np.cumsum(edge[:-1]) == 0


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each text with one blank between them."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))[keep]
    start, end = start[keep], end[keep]
    more = np.zeros(len(owner), bool)  # another word of the text follows, so there is a byte of white space to turn into the blank
    more[:-1] = owner[1:] == owner[:-1]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    np.subtract.at(edge, end, 1)
    taken = np.cumsum(edge[:-1], dtype=np.int8) > 0
    blank = end[more]
    taken[blank] = True
    data = data.copy()
    data[blank] = 32
    size = np.bincount(owner, end - start + more, n).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(size)))
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(data[taken])).cast(pa.string())


def find_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, runs, collapsed) for each row: ``runs`` array<struct<start, length, period>> by start and period, in words from 0;
    ``collapsed`` the text's words, one blank between them, without those that a run holds after its first period. A run is a stretch of
    at least ``least`` words and ``times`` periods (2 or more) that no neighbouring word extends.

    A null or empty text has no words, no runs and an empty ``collapsed``; null ids stay, and rows that repeat are each looked at. Words are told
    apart by 64-bit hashes of their bytes. A task looks at about two megabytes of texts together, or at one text, which takes about 60
    bytes a byte, and 400 a word where it holds a run.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in texts(batch.column(1), TEXT_BYTES):
                start, end, first = _split(data, bounds)
                words = Ranges(data).of(start, end)
                doc, at, length, period = runs_of(words, first, least, times)
                keep = _kept(len(start), first, doc, at, length, period)
                offsets = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(at), pa.array(length), pa.array(period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(offsets), rows)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], lists, _joined(data, start, end, first, keep)], ["doc_id", "runs", "collapsed"])

    kind = dict(docs.dtypes)[id]
    schema = f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return in_arrow(docs.select(F.col(f"`{id}`"), F.col(f"`{text}`")), run, schema)


def looped(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` (id and text) with every tenth text, by the crc32 of its id, made to repeat from some word on: the planted case of the contract. A null
    id plants nothing."""
    h = F.crc32(F.col(f"`{id}`").cast("string"))
    g = F.floor(h / 10)

    def repeat(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        a = (g % n).cast("int")
        period = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        times = F.ceil((n - a) / period).cast("int")
        again = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, period), times)), 1, n - a)
        return F.when(F.size(w) > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), again), " ")).otherwise(F.lit(""))

    words = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(WORD), F.lit(0))
    made = F.get(F.transform(F.array(words), repeat), F.lit(0))  # the array of one holds the words once, for every mention
    return docs.select(F.col(f"`{id}`"), F.when((h % 10 == 0) & F.col(f"`{text}`").isNotNull(), made).otherwise(F.col(f"`{text}`")).alias(text))


def report(docs: DataFrame) -> DataFrame:
    """The contract's digest of the runs of ``looped`` documents."""
    found = find_runs(looped(docs))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    steeper = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", none, lambda best, r: F.when(steeper(best, r), r).otherwise(best))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * best.length) div best.period")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
