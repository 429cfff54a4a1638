"""Token ids of texts with a public lower-casing word tokenizer, each distinct piece encoded once.

Such a tokenizer drops white space, so a text's ids are those of its words one after another. For words of ASCII and of the Latin letters of two
bytes from U+00C0 to U+00FF the tokenizer's own cut (contractions, letters, single digits, other marks) is made here for a whole batch with array
operations; any other word, and one that holds an added token, is a piece by itself that the library encodes. Pieces are told apart by a
64-bit hash within a bounded cache; only pieces that it lacks go to the library. Tokenizers of another form encode whole texts.
"""

from __future__ import annotations

import json

import numpy as np
from tokenizers import Tokenizer

from siftwell.llm.common import Ranges, SPACED

#: Fixed value: how a tokenizer of this form cuts normalised text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, DIGIT, OTHER, HARD = range(5)
#: Distinct pieces that the cache holds before it starts anew.
CACHE = 1 << 20
_HARD = np.uint64(0x9E3779B97F4A7C15)

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[~SPACED] = SPACE
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[128:] = HARD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder, so that its cache serves one task after another."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _is_plain(spec: dict) -> bool:
    """Whether a tokenizer normalises, cuts and merges as described above."""
    normal = (spec.get("normalizer") or {}).get("normalizers", [])
    cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = spec["model"]
    return (
        [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"]
        and [normal[1]["pattern"], normal[1]["content"]] == [{"Regex": r"\s+"}, " "]
        and [c["type"] for c in cut] == ["Split", "ByteLevel"]
        and (cut[0]["pattern"], cut[0]["behavior"], cut[0]["invert"]) == ({"Regex": PATTERN}, "Removed", True)
        and not (cut[1]["add_prefix_space"] or cut[1]["use_regex"])
        and model["type"] == "BPE"
        and not model.get("dropout")
        and not any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    )


class WordEncoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.plain = _is_plain(spec)
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        # Bytes as the characters that stand for them in the vocabulary: themselves if printable, else the next after 255.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))
        self.letters = {b: (b if b in shown else next(hidden)) for b in range(256)}
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _classes(self, data: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Class of each byte's character, and the bytes in lower case."""
        kind, low = _CLASS[data], _LOWER[data]
        lead = np.flatnonzero(data == 0xC3)
        if len(lead):
            second = data[lead + 1]
            letter = (second != 0x97) & (second != 0xB7)  # the signs of multiplication and division
            kind[lead[letter]] = kind[lead[letter] + 1] = LETTER
            upper = letter & (second <= 0x9E)
            low[lead[upper] + 1] = second[upper] + 32
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                kind[at] = HARD
                at = raw.find(token, at + 1)
        return kind, low

    def pieces(self, data: np.ndarray, bounds: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, whether the library encodes it, bytes) of the pieces of texts that lie one after another."""
        n = len(data)
        kind, low = self._classes(data, raw)
        fresh = np.zeros(n + 1, bool)
        fresh[bounds] = True
        mark = np.ones(n, bool)
        mark[1:] = kind[1:] != kind[:-1]
        mark |= (kind == DIGIT) | fresh[:-1]
        start = np.flatnonzero(mark)
        end = np.append(start[1:], n)
        # A lone apostrophe, and the letters of a contraction after it.
        quote = np.flatnonzero((low[start[:-1]] == 39) & (end[:-1] - start[:-1] == 1) & (kind[start[:-1]] == OTHER) & (kind[start[1:]] == LETTER) & ~fresh[start[1:]]) if n else start
        if len(quote):
            s, room = start[quote + 1], (end - start)[quote + 1]
            one, two = low[s], low[np.minimum(s + 1, n - 1)]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = (room >= 2) & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
            taken = np.where(short, 1, np.where(long, 2, 0))
            s, room, taken = s[taken > 0], room[taken > 0], taken[taken > 0]
            mark[s] = False
            mark[(s + taken)[room > taken]] = True
        hard_byte = kind == HARD
        hard = np.zeros(n, bool)
        if hard_byte.any():
            word = kind != SPACE
            begins = np.flatnonzero(word & ~np.concatenate(([False], word[:-1] & ~fresh[1:-1])))
            ends = np.flatnonzero(word & ~np.concatenate((word[1:] & ~fresh[1:-1], [False]))) + 1
            count = np.concatenate(([0], np.cumsum(hard_byte)))
            whole = count[ends] > count[begins]
            edge = np.zeros(n + 1, np.int8)
            edge[begins[whole]] += 1
            np.subtract.at(edge, ends[whole], 1)
            hard = np.cumsum(edge[:-1], dtype=np.int8) > 0
            low = np.where(hard, data, low)
            mark &= ~hard
            mark[begins[whole]] = True
        start = np.flatnonzero(mark)
        end = np.append(start[1:], n)
        own = kind[start] != SPACE
        return start[own], end[own], hard[start[own]], low

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin (one more at the end)."""
        raw = data.tobytes()
        if not self.plain:
            ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], add_special_tokens=False)]
            return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
        start, end, hard, low = self.pieces(data, bounds, raw)
        key = Ranges(low).of(start, end) ^ np.where(hard, _HARD, np.uint64(0))
        distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
        known = np.isin(distinct, self.keys, assume_unique=True)
        if not known.all():
            if len(self.keys) > CACHE:
                self._empty()
                known[:] = False
            self._add(low.tobytes(), distinct[~known], first[~known], start, end, hard)
        row = np.searchsorted(self.keys, distinct)[which]
        size = self.size[row]
        upto = np.cumsum(size)
        ids = self.pool[np.repeat(self.at[row] - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)]
        return ids, np.concatenate(([0], upto))[np.searchsorted(start, bounds)]

    def _add(self, low: bytes, keys: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray, hard: np.ndarray) -> None:
        merge, letters, whole = self.tokenizer.model.tokenize, self.letters, self.tokenizer.encode
        got = []
        for a, b, by_library in zip(start[first].tolist(), end[first].tolist(), hard[first].tolist(), strict=True):
            piece = low[a:b]
            got.append(whole(piece.decode(), add_special_tokens=False).ids if by_library else [t.id for t in merge(piece.decode("latin-1").translate(letters))])
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((x for g in got for x in g), np.uint32, int(size.sum()))
        every = np.concatenate((self.keys, keys))
        order = np.argsort(every)
        self.keys = every[order]
        self.at = np.concatenate((self.at, len(self.pool) + np.cumsum(size) - size))[order]
        self.size = np.concatenate((self.size, size))[order]
        self.pool = np.concatenate((self.pool, flat))
