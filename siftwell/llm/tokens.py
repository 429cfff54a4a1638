"""Token ids of texts with a public byte-level tokenizer, each distinct piece encoded once.

A byte-level BPE first cuts a text into pieces (contractions, letters, numbers, other marks, white space) and then merges within
each piece. Cutting is done here for a whole batch at once with array operations; pieces are told apart by a 64-bit hash, and only
pieces that are not in a bounded cache go to the tokenizers library. What class a character has is asked of the library itself, once
for each character that occurs. Texts that hold the literal text of an added token, and tokenizers of another kind, are encoded by the
library alone.
"""

from __future__ import annotations

import json

import numpy as np
from tokenizers import Tokenizer

from siftwell.llm.common import Ranges

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)
#: Distinct pieces that the cache holds before it starts anew.
CACHE = 1 << 20

_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder, so that its cache serves one task after another."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.plain = spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self._learn(np.arange(128))
        self.bytes = np.append(self.classes[:128], np.full(128, OTHER, np.uint8))
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

    def _learn(self, points: np.ndarray) -> None:
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.plain else None
        for p in points.tolist():
            if not self.plain:
                self.classes[p] = OTHER
                continue
            c = chr(p)
            self.classes[p] = next((k for k, side in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(cut(side + c + side)) == 1), SPACE)

    def _class_of_bytes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Class of the character that each byte belongs to; where characters of several bytes begin, or None if there are none."""
        cls = self.bytes[data]
        at = np.flatnonzero((data & 0xC0) == 0xC0)
        if not len(at):
            return cls, None
        d = np.concatenate((data, np.zeros(3, np.uint8)))
        a = d[at].astype(np.int64)
        more = 1 + (a >= 0xE0) + (a >= 0xF0)
        point = a & (0x3F >> more)
        for j in range(1, 4):
            k = np.flatnonzero(more >= j)
            point[k] = (point[k] << 6) | (d[at[k] + j] & 0x3F)
        new = np.unique(point[self.classes[point] == UNKNOWN])
        if len(new):
            self._learn(new)
        kind = self.classes[point]
        for j in range(4):
            k = more >= j
            cls[at[k] + j] = kind[k]
        return cls, at

    def pieces(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pieces begin, for texts that lie one after another."""
        n = len(data)
        cls, leads = self._class_of_bytes(data)
        fresh = np.zeros(n + 1, bool)
        fresh[bounds] = True
        change = np.ones(n, bool)
        change[1:] = cls[1:] != cls[:-1]
        change |= fresh[:-1]
        start = np.flatnonzero(change)
        end = np.append(start[1:], n)
        kind = cls[start]
        opens = fresh[start]  # the run begins a text
        mark = np.zeros(n + 1, bool)
        mark[start] = True
        # The last character of white space within a text: a blank joins the next run, another stands alone.
        space = np.flatnonzero((kind == SPACE) & ~fresh[end])
        last = end[space] - 1
        if leads is not None and (long := data[last] >= 128).any():
            last[long] = leads[np.searchsorted(leads, last[long]) - 1]
        mark[last] = True
        blank = data[last] == 32
        mark[end[space[blank]]] = False
        joined = np.zeros(len(start) + 1, bool)
        joined[space[blank] + 1] = True
        # A lone apostrophe that begins a piece, and the letters of a contraction after it.
        quote = np.flatnonzero((kind[:-1] == OTHER) & (end[:-1] - start[:-1] == 1) & (data[start[:-1]] == 39) & ~joined[:-2] & (kind[1:] == LETTER) & ~opens[1:]) if len(start) > 1 else np.zeros(0, np.int64)
        if len(quote):
            s = start[quote + 1]
            room = end[quote + 1] - s
            c1, c2 = data[s], data[np.minimum(s + 1, n - 1)]
            one = np.isin(c1, np.frombuffer(b"stmd", np.uint8))
            two = (room >= 2) & (((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108)))
            taken = np.where(one, 1, np.where(two, 2, 0))
            s, room, taken = s[taken > 0], room[taken > 0], taken[taken > 0]
            mark[s] = False
            mark[(s + taken)[room > taken]] = True
        return np.flatnonzero(mark[:n])

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin (one more at the end)."""
        raw = data.tobytes()
        if not self.plain or any(t in raw for t in self.added):
            batch = self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], add_special_tokens=False)
            ids = [np.array(e.ids, np.uint32) for e in batch]
            return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
        start = self.pieces(data, bounds)
        end = np.append(start[1:], len(data))
        distinct, first, which = np.unique(Ranges(data).of(start, end), return_index=True, return_inverse=True)
        slot = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = slot < len(self.keys)
        known[inside] = self.keys[slot[inside]] == distinct[inside]
        if not known.all():
            if len(self.keys) > CACHE:
                self._empty()
                known[:] = False
            new = np.flatnonzero(~known)
            merge, letters = self.tokenizer.model.tokenize, self.letters
            got = [[t.id for t in merge(raw[a:b].decode("latin-1").translate(letters))] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            size = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((x for g in got for x in g), np.uint32, int(size.sum()))
            keys = np.concatenate((self.keys, distinct[new]))
            order = np.argsort(keys)
            self.keys = keys[order]
            self.at = np.concatenate((self.at, len(self.pool) + np.cumsum(size) - size))[order]
            self.size = np.concatenate((self.size, size))[order]
            self.pool = np.concatenate((self.pool, flat))
            slot = np.searchsorted(self.keys, distinct)
        row = slot[which]
        size = self.size[row]
        upto = np.cumsum(size)
        ids = self.pool[np.repeat(self.at[row] - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)]
        begin = np.concatenate(([0], upto))[np.searchsorted(start, bounds)]
        return ids, begin
