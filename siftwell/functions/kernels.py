"""Scores of many chunks for many questions in blocks, for use in Arrow batches: a matrix product a tile, and the best k a question.

A task keeps k rows a question and gives them at its end, so nothing else is shuffled. Questions come in blocks whose size the caller
bounds; ranking among tasks is a window over what they give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores of a tile, chunks times questions.
TILE = 1 << 20


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Rows cut into runs (first, end) of about ``most`` in all, one row at least."""
    upto, i = np.cumsum(sizes), 0
    while i < len(upto):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def rounded(scores: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, as SQL rounds."""
    unit = 10.0**digits
    return np.copysign(np.floor(np.abs(scores) * unit + 0.5) / unit, scores)


class Best:
    """The k best of each question by rounded score, ties to the smaller id."""

    def __init__(self, k: int, digits: int):
        self.k, self.digits = k, digits
        self.question, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, ids: np.ndarray, scores: np.ndarray, taken: np.ndarray | None = None) -> None:
        """``scores``: a row for each id, a column for each question; ``taken``: which of them count."""
        scores = rounded(scores, self.digits)
        if taken is not None:
            scores = np.where(taken, scores, -np.inf)
        some = scores
        if len(ids) > self.k:
            some = np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k :]
        i, q = np.nonzero((scores >= some.min(0)) & (scores > -np.inf))
        if self.ids is not None and len(self.ids):
            ids = ids.astype(np.promote_types(ids.dtype, self.ids.dtype), copy=False)
        question, score = np.concatenate((self.question, q)), np.concatenate((self.score, scores[i, q]))
        found = ids[i] if self.ids is None else np.concatenate((self.ids, ids[i]))
        order = np.lexsort((found, -score, question))
        question, score, found = question[order], score[order], found[order]
        rank = np.arange(len(question)) - np.searchsorted(question, question)
        keep = rank < self.k
        self.question, self.score, self.ids = question[keep], score[keep], found[keep]


def plain_ids(ids: pa.Array) -> np.ndarray:
    """Ids as an array that sorts as Spark does: numbers, or text by code point."""
    if pa.types.is_integer(ids.type):
        return np.asarray(ids.to_numpy(zero_copy_only=False), np.int64)
    return np.array(ids.to_pylist(), np.str_) if len(ids) else np.zeros(0, "<U1")


def dense_rows(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, float64 rows) of the vectors that are neither null nor hold a null, for each length that occurs."""
    keep = np.flatnonzero(np.asarray(vectors.is_valid()))
    vectors = vectors.take(pa.array(keep))
    length = np.asarray(vectors.value_lengths()).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64())
    bad = np.asarray(flat.is_null())
    flat = np.asarray(flat.to_numpy(zero_copy_only=False))
    begin = np.concatenate(([0], np.cumsum(length)))[:-1]
    for dim in np.unique(length):
        if dim:
            at = np.flatnonzero(length == dim)
            where = begin[at][:, None] + np.arange(dim)
            ok = ~bad[where].any(1) if bad.any() else np.ones(len(at), bool)
            if ok.any():
                yield keep[at[ok]], flat[where[ok]]


def _given(best: Best, questions: pa.Array, ids_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    if best.ids is not None and len(best.ids):
        yield pa.RecordBatch.from_arrays([questions.take(pa.array(best.question)), pa.array(best.ids.tolist(), ids_type), pa.array(best.score)], ["query_id", "chunk_id", "score"])


def dense(questions: pa.Table, k: int, digits: int) -> Callable:
    """For batches (chunk_id, vector): the k nearest by dot product to each of ``questions(query_id, vector)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = questions.combine_chunks()
        names = asked.column(0).combine_chunks()
        sides = {rows.shape[1]: (at, rows.T.copy(), Best(k, digits)) for at, rows in dense_rows(asked.column(1).combine_chunks())}
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            ids = plain_ids(batch.column(0))
            for at, rows in dense_rows(batch.column(1)):
                if rows.shape[1] in sides:
                    _, right, best = sides[rows.shape[1]]
                    step = max(1, TILE // right.shape[1])
                    for a in range(0, len(at), step):
                        best.add(ids[at[a : a + step]], rows[a : a + step] @ right)
        for at, _, best in sides.values():
            yield from _given(best, names.take(pa.array(at)), kind)

    return run


def lexical(names: pa.Array, terms: list[str], weights: np.ndarray, pairs: np.ndarray, mean_length: float, k: int, digits: int, k1: float, b: float, zero_filled: bool) -> Callable:
    """For batches (chunk_id, tokens): BM25 scores. ``pairs``: rows (term, question) by term, a question's repeats of a word as often;
    ``weights``: of each term."""
    first = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, best, kind = pa.array(terms, pa.string()), Best(k, digits), None
        step = max(1, TILE // max(1, len(names)))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                kind, n = batch.column(0).type, batch.num_rows
                lists = batch.column(1)
                length = np.asarray(pc.fill_null(lists.value_lengths(), 0)).astype(np.int64)
                number = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), known), -1)).astype(np.int64)
                doc = np.repeat(np.arange(n), length)[number >= 0]
                key, tf = np.unique(doc * max(1, len(terms)) + number[number >= 0], return_counts=True)
                doc, term = np.divmod(key, max(1, len(terms)))
                part = weights[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / mean_length))
                count = first[term + 1] - first[term]
                at = np.repeat(np.arange(len(term)), count)
                question = pairs[first[term][at] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count), 1]
                cell = doc[at] * len(names) + question
                scores = np.bincount(cell, part[at], n * len(names)).reshape(n, len(names))
                met = None if zero_filled else np.bincount(cell, minlength=n * len(names)).reshape(n, len(names)) > 0
                best.add(plain_ids(batch.column(0)), scores, met)
        yield from _given(best, names, kind)

    return run
