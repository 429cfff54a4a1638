"""Nearest neighbours by a block matrix join: int8 tiles, bounds on their error, float recomputation of what survives, heaps.

Vectors are scaled to unit length and rounded to int8 with one scale per vector. The product of two int8 rows, times their scales,
differs from the cosine by at most ``ea + eb + ea*eb``, where e is the length of a vector's rounding error: the cosine of
unit vectors q and x is q'.x' + q'.(x-x') + (q-q').x, and |q'| <= 1 + eq. So per query the k-th largest lower bound so far discards
every candidate whose upper bound is under it, and only the rest are recomputed in double precision: results are exact.

Queries are taken in blocks of about ``block_bytes`` (their bytes are summed first). One block at a time travels to the candidates' tasks,
and where there are several, its heaps are written before the next is taken, so the driver never holds more than a block. Nothing but
heaps of k rows a query and task is shuffled. Work is queries times candidates.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import Scratch, in_arrow

K = 5
EVERY = 50
BLOCK_BYTES = 16 << 20
#: Rows of a candidate tile and queries of a query tile.
TILE = 2048
QUERY_TILE = 256


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the lengths of their rounding errors, for rows of unit length."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - q * scale[:, None]) ** 2).sum(1)) * (1 + 1e-9) + 1e-12
    return q, scale, error


def norms(rows: np.ndarray) -> np.ndarray:
    """Lengths in double precision, summed from the first component on."""
    out = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        out += rows[:, d] * rows[:, d]
    return np.sqrt(out)


def cosines(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, summed from the first component on: equal pairs give equal values wherever they stand."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out / (na * nb)


def matrices(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, float64 rows) of the usable vectors of a batch, for each length that occurs: not null, no null or non-finite component,
    not zero."""
    keep = np.flatnonzero(np.asarray(ids.is_valid()) & np.asarray(vectors.is_valid()))
    ids, vectors = ids.take(pa.array(keep)), vectors.take(pa.array(keep))
    length = np.asarray(vectors.value_lengths()).astype(np.int64)
    flat = np.asarray(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    begin = np.concatenate(([0], np.cumsum(length)))[:-1]
    number = np.asarray(ids).astype(np.int64)
    for dim in np.unique(length):
        if dim:
            at = np.flatnonzero(length == dim)
            rows = flat[begin[at][:, None] + np.arange(dim)]
            ok = np.isfinite(rows).all(1)
            ok &= np.isfinite(n := norms(np.where(np.isfinite(rows), rows, 0))) & (n > 0)
            if ok.any():
                yield number[at[ok]], rows[ok]


class Queries:
    """A block of queries of one length, and a heap of the k nearest for each."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.norm = norms(rows)
        q, self.scale, self.error = quantise(rows / self.norm[:, None])
        self.int8 = q.astype(np.float32)  # exact: sums of products of int8 stay under 2**24 up to 1,040 components
        self.best: list[list[tuple[float, int]]] = [[] for _ in ids]  # (score, -id), least first
        self.floor = np.full(len(ids), -np.inf)

    def tile(self, ids: np.ndarray, rows: np.ndarray) -> None:
        n = norms(rows)
        q, scale, error = quantise(rows / n[:, None])
        right = q.astype(np.float32 if rows.shape[1] <= 1040 else np.float64).T
        for a in range(0, len(self.ids), QUERY_TILE):
            s = slice(a, a + QUERY_TILE)
            near = (self.int8[s] @ right).astype(np.float64) * self.scale[s, None] * scale[None, :]
            slack = self.error[s, None] + error[None, :] + self.error[s, None] * error[None, :]
            own = self.ids[s, None] == ids[None, :]
            low = np.where(own, -np.inf, near - slack)
            if low.shape[1] > self.k:
                floor = np.maximum(self.floor[s], np.partition(low, -self.k, 1)[:, -self.k])
            else:
                floor = self.floor[s]
            i, j = np.nonzero((near + slack >= floor[:, None]) & ~own)
            if not len(i):
                continue
            score = cosines(self.rows[s][i], rows[j], self.norm[s][i], n[j])
            for qi, c, v in zip((i + a).tolist(), score.tolist(), (-ids[j]).tolist(), strict=True):
                heap = self.best[qi]  # a row that repeats is a candidate each time, as it is for the floor
                if len(heap) < self.k:
                    heapq.heappush(heap, (c, v))
                elif (c, v) > heap[0]:
                    heapq.heapreplace(heap, (c, v))
            for qi in np.unique(i + a):
                if len(self.best[qi]) == self.k:
                    self.floor[qi] = self.best[qi][0][0]

    def rows_out(self) -> Iterator[tuple[int, int, float]]:
        for q, heap in zip(self.ids.tolist(), self.best, strict=True):
            for c, v in heap:
                yield q, -v, c


def _pass(block: pa.Table, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, Queries] = {}
        column = [block.column(c).combine_chunks() for c in (0, 1)]
        for ids, rows in matrices(*column):
            sets[rows.shape[1]] = Queries(ids, rows, k)
        for batch in batches:
            for ids, rows in matrices(batch.column(0), batch.column(1)):
                if rows.shape[1] in sets:
                    for a in range(0, len(ids), TILE):
                        sets[rows.shape[1]].tile(ids[a : a + TILE], rows[a : a + TILE])
        for found in sets.values():
            out = list(found.rows_out())
            if out:
                q, v, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(c, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id long, rank int from 1, vec_id long, score double): each query row's k nearest rows by cosine, ties to the smaller id.

    Rows that are null, zero or hold a null or non-finite component, and null ids, take no part. Only vectors of the same length are
    compared. Every row but the query's own is a candidate, repeated rows each time; rows that share the query's id are its own. Of
    several usable query rows of one id the least vector, by its components, asks. A query with fewer candidates gets them all. No queries
    give no rows. Only the named columns are read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    usable = F.expr("id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    asked = source.filter("q").filter(usable).groupBy("id").agg(F.min("v").alias("v"))
    asked = scratch.save(asked)
    size = asked.agg(F.sum(8 * F.size("v") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    candidates = source.select("id", "v")
    found = []
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()  # about block_bytes
        if block.num_rows:
            heaps = in_arrow(candidates, _pass(block, k), "query_id long, vec_id long, score double")
            found.append(heaps if blocks == 1 else scratch.save(heaps))
    heaps = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for f in found:
        heaps = f if f is found[0] else heaps.unionByName(f)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
