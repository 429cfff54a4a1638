"""An FM-index over a sequence of integers: suffix array, Burrows-Wheeler transform, wavelet ranks, sampled positions.

Backward search runs for many phrases at once; every step is a few vector operations over the phrases still alive.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by prefix doubling: ranks of 2**k symbols are sorted in pairs until all differ."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        second = np.full(n, 0, np.int64)
        second[: n - width] = rank[width:] + 1
        pair = rank * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        step = np.concatenate(([0], np.cumsum(pair[order][1:] != pair[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1 or width >= n:
            return order
        width *= 2


class BitRank:
    """Bits with the count of ones before any position: packed words and a running count per word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros((len(bits) >> 6) + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words)[:-1], dtype=np.int64)))

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        inside = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Ranks of symbols of a sequence, a level of bits per bit of the alphabet, highest first."""

    def __init__(self, seq: np.ndarray, alphabet: int):
        self.levels: list[tuple[int, BitRank, int]] = []
        for bit in range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1):
            b = (seq >> bit) & 1
            self.levels.append((bit, BitRank(b.astype(bool)), int(len(b) - b.sum())))
            seq = np.concatenate((seq[b == 0], seq[b == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        lo = np.zeros_like(at)
        for bit, bits, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            a, b = bits.ones(at), bits.ones(lo)
            at = np.where(one, zeros + a, at - a)
            lo = np.where(one, zeros + b, lo - b)
        return at - lo

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for bit, bits, zeros in self.levels:
            one = bits.get(at).astype(bool)
            a = bits.ones(at)
            out |= one.astype(at.dtype) << bit
            at = np.where(one, zeros + a, at - a)
        return out


class FMIndex:
    """Index of a sequence of symbols in ``1..alphabet-1``; 0 is the end mark that is appended here."""

    def __init__(self, seq: np.ndarray, alphabet: int, sample: int = SAMPLE):
        text = np.append(np.asarray(seq, np.int64), 0)
        order = suffix_array(text)
        self.n = len(text)
        bwt = text[order - 1]
        self.wavelet = WaveletMatrix(bwt, alphabet)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet))))
        marked = order % sample == 0
        self.marked = BitRank(marked)
        self.sampled = order[marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of the suffixes that start with each phrase; phrases are right-aligned rows of a matrix."""
        m, width = phrases.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        for k in range(1, width + 1):
            live = np.flatnonzero((lengths >= k) & (lo < hi))
            if not len(live):
                break
            s = phrases[live, width - k]
            both = self.wavelet.rank(np.concatenate((s, s)), np.concatenate((lo[live], hi[live])))
            lo[live], hi[live] = self.less[s] + both[: len(live)], self.less[s] + both[len(live) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row's suffix: step back through the transform to a sampled row."""
        out = np.full(len(rows), -1, np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            hit = self.marked.get(at).astype(bool)
            out[todo[hit]] = self.sampled[self.marked.ones(at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            s = self.wavelet.symbol(at)
            at = self.less[s] + self.wavelet.rank(s, at)
            steps += 1
        return out
