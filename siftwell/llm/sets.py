"""Shingle sets of texts as sorted arrays of 64-bit hashes: minhashes, comparisons and differences, all in Arrow batches.

A shingler takes bytes and bounds of several texts and gives the hashes of each text's shingles with repeats, and where each text's
begin (one more at the end). ``column`` of a batch is text; null counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import _ODD, SPACED, Ranges, Words, in_arrow, longs, mix, texts

Shingler = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def windows_of(n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of texts of n units, the whole text where there are fewer than ``size``: (text, place of the first unit within all units,
    number of units, where each text's begin)."""
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.concatenate(([0], np.cumsum(count)))
    doc = np.repeat(np.arange(len(n)), count)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    return doc, first[doc] + (np.arange(at[-1]) - at[doc]), np.minimum(n, size)[doc], at


def word_shingles(size: int) -> Shingler:
    """``size`` words between white space, A-Z lowered; of fewer words, all of them as one."""

    def run(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = Words(data, bounds, SPACED)
        _, pos, units, at = windows_of(np.diff(words.first), size)
        out = units.astype(np.uint64) * _ODD[61]
        for j in range(size):
            if len(out):
                out += np.where(j < units, words.hash[np.minimum(pos + j, len(words.hash) - 1)] * _ODD[j], np.uint64(0))
        return mix(out), at

    return run


def char_shingles(size: int) -> Shingler:
    """``size`` characters (code points) from every position; of fewer characters, all of them as one."""

    def run(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.flatnonzero((data & 0xC0) != 0x80)
        n = np.diff(np.searchsorted(begin, bounds))
        _, pos, units, at = windows_of(n, size)
        edges = np.append(begin, len(data))
        return Ranges(data).of(edges[pos], edges[pos + units]), at

    return run


class Minhashes:
    """``keys`` composite hashes of ``rows`` minhashes each. A minhash is the least of 32-bit hashes times an odd number."""

    def __init__(self, keys: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(1, 2**31, (keys, rows), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.fold = rng.integers(1, 2**63, rows, dtype=np.uint64) | np.uint64(1)
        self.tag = rng.integers(1, 2**63, keys, dtype=np.uint64)

    def of(self, shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row of composite hashes for each set, which begins at one of ``starts`` and is not empty."""
        out = np.zeros((len(starts), len(self.tag)), np.uint64)
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        buf = np.empty_like(low)
        for k in range(len(self.tag)):
            for r in range(len(self.fold)):
                np.multiply(low, self.odd[k, r], out=buf)
                least = np.minimum.reduceat(buf, starts).astype(np.uint64)
                out[:, k] += mix(least + np.uint64(r << 32)) * self.fold[r]
        return mix(out + self.tag)


def sets_of(column: pa.Array, shingler: Shingler) -> Iterator[np.ndarray]:
    for i, j, data, bounds in texts(column):
        sh, at = shingler(data, bounds)
        for d in range(j - i):
            yield np.unique(sh[at[d] : at[d + 1]])


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(r) for r in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), longs(np.concatenate([np.zeros(0, np.uint64), *parts])))


def _with_texts(pairs: DataFrame, wanted: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """Texts travel, not sets: they are less than half as large. ``other`` has those of b, if not ``wanted``."""
    x = wanted.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    y = (wanted if other is None else other).select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "ta", "tb")


#: Bytes of pairs whose sets are in memory at a time, and bits of an element's hash beside the number of its pair, which is under MOST_PAIRS, and its side.
PAIR_BYTES, PAIR_BITS, MOST_PAIRS = 1 << 20, 48, 1 << 15


def _tagged(column: pa.Array, shingler: Shingler, side: int) -> np.ndarray:
    """The elements of each text's set, with repeats, between the text's number and the side."""
    _, n, data, bounds = next(texts(column, 1 << 62))
    sh, at = shingler(data, bounds)
    pair = np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(PAIR_BITS + 1), np.diff(at))
    return pair | ((sh & np.uint64((1 << PAIR_BITS) - 1)) << np.uint64(1)) | np.uint64(side)


def _distinct(found: np.ndarray) -> np.ndarray:
    found.sort()
    return found[np.concatenate((np.ones(min(1, len(found)), bool), found[1:] != found[:-1]))]


def _overlaps(x: pa.Array, y: pa.Array, shingler: Shingler) -> np.ndarray:
    """Sizes of the overlap and of the two sets, of each pair of texts: one sort brings equal elements of a pair together, x's before y's."""
    n, found = len(x), _distinct(np.concatenate((_tagged(x, shingler, 0), _tagged(y, shingler, 1))))
    pair = (found >> np.uint64(PAIR_BITS + 1)).astype(np.int64)
    second = (found & np.uint64(1)).astype(bool)
    both = (found[1:] ^ found[:-1]) == 1
    return np.stack([np.bincount(of, minlength=n) for of in (pair[1:][both], pair[~second], pair[second])])


def compared(pairs: DataFrame, wanted: DataFrame, shingler: Shingler, other: DataFrame | None = None) -> DataFrame:
    """``pairs(a, b)`` of ``wanted(id, text)`` -> (a, b, both, na, nb): sizes of the overlap and of the two full sets. ``other`` has the texts of b, if not ``wanted``.

    The sets of many pairs are sorted at once, by (pair, the low PAIR_BITS bits of the element's hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((3, batch.num_rows), np.int64)
            x, y = (batch.column(k).fill_null("") for k in (2, 3))
            upto = np.cumsum(np.asarray(pc.binary_length(x)).astype(np.int64) + np.asarray(pc.binary_length(y)))
            i = 0
            while i < batch.num_rows:  # about PAIR_BYTES at a time, one pair at least
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIR_BYTES, "right")))
                j = min(j, i + MOST_PAIRS)
                counts[:, i:j] = _overlaps(x.slice(i, j - i), y.slice(i, j - i), shingler)
                i = j
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, counts)], ["a", "b", "both", "na", "nb"])

    return in_arrow(_with_texts(pairs, wanted, other), run, "a long, b long, both long, na long, nb long")


#: Longs of a set's bitmap, and sets whose bitmaps are made at a time.
BITMAP, MOST_SETS = 8, 1 << 12


def bitmaps(wanted: DataFrame, shingler: Shingler) -> DataFrame:
    """``wanted(id, text)`` -> (id, n, w0, w1 ...): the set's size and a bitmap of 64 * BITMAP bits, one of them turned by each element."""
    size, names = 64 * BITMAP, [f"w{k}" for k in range(BITMAP)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, MOST_SETS):
                ids, column = (batch.column(c).slice(k, MOST_SETS) for c in (0, 1))
                for i, j, _, _ in texts(column, PAIR_BYTES):
                    found = _distinct(_tagged(column.slice(i, j - i).fill_null(""), shingler, 0))
                    of = (found >> np.uint64(PAIR_BITS + 1)).astype(np.int64)
                    bits = np.bincount(of * size + (found >> np.uint64(1)).astype(np.int64) % size, minlength=(j - i) * size) & 1
                    words = np.packbits(bits.astype(bool), bitorder="little").view(np.int64).reshape(j - i, BITMAP)
                    yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(np.bincount(of, minlength=j - i)), *(pa.array(np.ascontiguousarray(w)) for w in words.T)], ["id", "n", *names])

    return in_arrow(wanted.select("id", "text"), run, "id long, n long, " + ", ".join(f"{w} long" for w in names))


def screened(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """``pairs(a, b)`` with ``facts`` as ``bitmaps`` gives them -> (a, b, na, nb, near). Elements that one of the sets has alone are as many as the bits that differ, or
    more, and a pair that is ``percent`` in a hundred alike has (100 - percent) / (100 + percent) of na + nb of them at most: no other pair is ``near``."""
    x, y = (facts.toDF(k, f"n{k}", *(f"w{i}{k}" for i in range(BITMAP))) for k in "ab")
    apart = " + ".join(f"bit_count(w{i}a ^ w{i}b)" for i in range(BITMAP))
    near = f"100 * least(na, nb) >= {percent} * greatest(na, nb) and {100 + percent} * ({apart}) <= {100 - percent} * (na + nb)"
    return pairs.join(x, "a").join(y, "b").selectExpr("a", "b", "na", "nb", f"{near} as near")


def differences(pairs: DataFrame, wanted: DataFrame, shingler: Shingler, other: DataFrame | None = None) -> DataFrame:
    """(a, b, d): the elements that one of the two sets has alone. ``other`` has the texts of b, if not ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.setxor1d(x, y, assume_unique=True) for x, y in zip(sets_of(batch.column(2), shingler), sets_of(batch.column(3), shingler), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(out)], ["a", "b", "d"])

    return in_arrow(_with_texts(pairs, wanted, other), run, "a long, b long, d array<long>")


def alike(percent: int) -> str:
    """SQL: the overlap is ``percent`` in a hundred of the union, or more."""
    return f"both > 0 and 100 * both >= {percent} * (na + nb - both)"
