"""Documents packed into training sequences: harmonic packing.

Class k holds pieces of more than capacity/(k+1) and at most capacity/k tokens, and each of its sequences takes exactly k pieces, so a task fills
sequences as documents come, by counting: nothing is sorted, shuffled or looked up, and tasks know nothing of each other.

A document is cut into whole sequences, then into pieces of capacity/2, capacity/4, .. down to ``grain`` tokens, whose classes fill up exactly; what
is left of it, under ``grain`` tokens, is a piece of a class of at least capacity/grain pieces, which wastes under a part in that many. A task ends
with at most k - 1 pieces of class k: these are laid end to end, longest first, and cut where a sequence is full, the last
stretch into powers of two, so they need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import in_arrow, texts
from siftwell.llm.word_tokens import encoder

CAPACITY, GRAIN, END = 4096, 128, 2
#: Sequences that a task may number.
_PER_TASK = 1 << 40
_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def cut(tokens: np.ndarray, capacity: int, grain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of so many tokens, in order."""
    doc, start, length = [], [], []

    def add(which: np.ndarray, begin: np.ndarray, size: np.ndarray | int) -> None:
        doc.append(which)
        start.append(begin)
        length.append(np.broadcast_to(np.asarray(size, np.int64), which.shape))

    whole = tokens // capacity
    which = np.repeat(np.arange(len(tokens)), whole)
    add(which, (np.arange(len(which)) - np.repeat(np.cumsum(whole) - whole, whole)) * capacity, capacity)
    size = capacity // 2
    while size >= grain:
        some = np.flatnonzero(tokens & size)
        add(some, tokens[some] // (2 * size) * (2 * size), size)
        size //= 2
    some = np.flatnonzero(tokens % grain)
    add(some, tokens[some] - tokens[some] % grain, tokens[some] % grain)
    doc, start, length = map(np.concatenate, (doc, start, length))
    order = np.lexsort((start, doc))
    return doc[order], start[order], length[order]


class Bins:
    """Pieces that wait for their class to fill a sequence, and the number of the next sequence."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next, self.held = capacity, first, None

    def add(self, pieces: pa.Table) -> pa.Table:
        """The pieces of the sequences that are full now, with sequence_id and offset."""
        if self.held is not None:
            pieces = pa.concat_tables([self.held, pieces])
        length = pieces["length"].to_numpy()
        k = self.capacity // length
        order = np.argsort(k, kind="stable")
        kinds, first, count = np.unique(k[order], return_index=True, return_counts=True)
        nth = np.arange(len(order)) - np.repeat(first, count)  # of its class
        full = count // kinds
        taken = nth < np.repeat(full * kinds, count)
        which = np.repeat(np.cumsum(full) - full, count) + nth // np.repeat(kinds, count)
        self.held = pieces.take(pa.array(np.sort(order[~taken]))).combine_chunks()
        order, which = order[taken], which[taken]
        upto = np.cumsum(length[order])
        before = upto - length[order]
        offset = before - before[np.searchsorted(which, which)]
        out = pieces.take(pa.array(order)).append_column("sequence_id", pa.array(self.next + which)).append_column("offset", pa.array(offset))
        self.next += int(full.sum())
        return out

    def rest(self) -> pa.Table | None:
        """What waits, laid end to end and cut."""
        if self.held is None or not self.held.num_rows:
            return None
        length = self.held["length"].to_numpy()
        held = self.held.take(pa.array(np.argsort(-length, kind="stable"))).combine_chunks()
        length = held["length"].to_numpy()
        begins = np.concatenate(([0], np.cumsum(length)))
        total = int(begins[-1])
        edges = list(range(0, total - total % self.capacity + 1, self.capacity))
        size = self.capacity // 2
        while edges[-1] < total:
            if (total - edges[-1]) & size:
                edges.append(edges[-1] + size)
            size //= 2
        edges = np.array(edges)
        at = np.union1d(begins, edges)
        at, end = at[:-1], at[1:]
        piece = np.searchsorted(begins, at, "right") - 1
        sequence = np.searchsorted(edges, at, "right") - 1
        skipped = at - begins[piece]
        held = held.take(pa.array(piece))
        ids = pa.array([x[4 * a : 4 * (a + n)] for x, a, n in zip(held["ids"].to_pylist(), skipped.tolist(), (end - at).tolist(), strict=True)], pa.binary())
        columns = {"doc_id": held["doc_id"], "start": pa.array(held["start"].to_numpy() + skipped), "length": pa.array(end - at), "ids": ids, "doc_tokens": held["doc_tokens"]}
        return pa.table(columns | {"sequence_id": pa.array(self.next + sequence), "offset": pa.array(at - edges[sequence])})


def _pieces(names: pa.Array, ids: np.ndarray, begin: np.ndarray, end: int, capacity: int, grain: int) -> pa.Table:
    """Pieces of a run of documents, with the end id after each."""
    n = len(names)
    every = np.full(len(ids) + n, end, np.uint32)
    own = np.ones(len(every), bool)
    own[begin[1:] + np.arange(n)] = False
    every[own] = ids
    tokens = np.diff(begin) + 1
    doc, start, length = cut(tokens, capacity, grain)
    edges = np.concatenate(([0], np.cumsum(length))).astype(np.int32) * np.int32(4)
    binary = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(edges), pa.py_buffer(every.astype("<u4"))])
    return pa.table({"doc_id": names.take(pa.array(doc)), "start": pa.array(start), "length": pa.array(length), "ids": binary, "doc_tokens": pa.array(tokens[doc])})


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, grain: int = GRAIN, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): a row per piece. ``ids`` are its token ids as little-endian unsigned 32-bit
    integers, ``start`` its place among its document's ``doc_tokens`` ids (the end id is the last), ``offset`` its place in its sequence. A
    sequence holds at most ``capacity`` tokens without a gap; it is padded to ``capacity``, but for those whose size is a power of two.

    A null or empty text is its end id alone, a null id stays null, and rows that repeat or share an id are documents each by itself. Texts of any
    length are cut as described above; a task holds about a megabyte of texts (or one text, with about 50 bytes a byte) and at most 400,000
    tokens that wait. Sequence numbers are unique; which documents share a sequence hangs on how the table is split.
    """
    if capacity & (capacity - 1) or grain & (grain - 1) or not 1 <= grain <= capacity:
        raise ValueError("capacity and grain must be powers of two, and grain at most capacity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, TaskContext.get().partitionId() * _PER_TASK)
        for batch in batches:
            for i, j, data, bounds in texts(batch.column(1)):
                ids, begin = encoder(tokenizer).encode(data, bounds)
                yield from bins.add(_pieces(batch.column(0)[i:j], ids, begin, end, capacity, grain)).combine_chunks().to_batches()
        rest = bins.rest()
        if rest is not None:
            yield from rest.to_batches()

    kind = dict(docs.dtypes)[id]
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return in_arrow(docs.select(F.col(f"`{id}`"), F.col(f"`{text}`")), run, schema)


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids) of ``pack``'s pieces: the ids of a sequence with its padding. A group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit("").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
    blank = F.unhex(F.repeat(F.lit(pad.to_bytes(4, "little").hex()), (capacity - F.col("n_tokens")).cast("int")))
    padded = F.when(F.bit_count("n_tokens") == 1, F.col("ids")).otherwise(F.concat("ids", blank))
    return rows.select("sequence_id", "n_tokens", padded.alias("ids"))


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces with the crc32 of their ids in place of these."""
    return pack(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
