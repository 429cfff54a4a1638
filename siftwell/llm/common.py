"""What the operators share: scratch tables in the cluster's shared folder, size-checked joins, vectorised word hashes.

Scratch tables are Parquet in the folder named by ``spark.checkpoint.dir``: they cut lineage, outlive a lost executor and can be
dropped once their successor is written; ``dropping`` drops what operators left when their results have been written. A local temporary
folder is taken only where that setting is absent and the master is local (tests).
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from siftwell.session import shared_folder, ship

#: Bytes of fixed-width rows that a broadcast may hold; beyond it the same join shuffles both sides.
BROADCAST_BYTES = 16 << 20
_WIDTHS = {"bigint": 8, "double": 8, "int": 4, "boolean": 1}
#: Rows of a batch that goes to a Python worker.
BATCH = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` for workers that live long beside a full heap: each task gives its free memory back to the system when it ends, and
    batches are of BATCH rows. The plan reads that size from the session when it runs, so it is set there, once, if it is still Spark's
    default; a size that the session chose itself is left alone."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_BATCH) == "10000":  # Spark's own default
        spark.conf.set(_BATCH, BATCH)
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    # Columns go by number on the way: a name with a dot in it is not one that mapInArrow finds.
    inner = StructType([StructField(f"_{i}", f.dataType) for i, f in enumerate(fields)])
    given = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return given.mapInArrow(_freeing(run, [f.name for f in inner]), inner).toDF(*[f.name for f in fields])


def _freeing(run: Callable, names: list[str]) -> Callable:
    def wrapped(batches):
        try:
            for batch in run(batches):
                yield pa.RecordBatch.from_arrays(batch.columns, names)
        finally:
            release()

    return wrapped


def release() -> None:
    global _powers
    if len(_powers[0]) > 1 << 21:
        _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


_folders: list[Scratch] = []


class Scratch:
    """Tables of one run of an operator under a folder of its own."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/siftwell-{uuid.uuid4().hex}"
        self.made = 0
        _folders.append(self)

    def save(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(df._scratch_path)

    def close(self) -> None:
        """Drop all of its tables."""
        self._delete(self.folder)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def dropping() -> Iterator[None]:
    """Scratch tables that operators make within are dropped at its end: by then their results must have been written."""
    before = len(_folders)
    try:
        yield
    finally:
        while len(_folders) > before:
            _folders.pop().close()


def fits(keys: DataFrame, limit: int | None = None) -> bool:
    """Whether a frame of fixed-width columns, whose rows are counted, takes ``limit`` bytes at most."""
    rows = (BROADCAST_BYTES if limit is None else limit) // sum(_WIDTHS[t] for _, t in keys.dtypes)
    return keys.limit(rows + 1).count() <= rows


def keyed(big: DataFrame, keys: DataFrame, column: str | list[str], how: str = "inner", limit: int | None = None) -> DataFrame:
    """Join with a scratch table of narrow rows, one for each key. Its rows are counted (a read of footers) and broadcast only up to
    ``limit`` bytes. Beyond it both sides are shuffled, and as the table is read from files and not aggregated in place, adaptive execution
    can split the tasks of a key that holds many rows of ``big``."""
    return big.join(F.broadcast(keys) if fits(keys, limit) else keys, column, how)


def met(big: DataFrame, keys: DataFrame, column: str, limit: int) -> DataFrame:
    """Inner join on a long column, of which few rows of ``big`` meet a key, with a scratch table of narrow rows. Beyond ``limit`` bytes the keys are
    broadcast in slices, each with a pass over ``big``, so ``big`` is never shuffled."""
    slices = max(1, -(-keys.count() * sum(_WIDTHS[t] for _, t in keys.dtypes) // limit))
    of = lambda df, i: df if slices == 1 else df.filter(F.pmod(column, F.lit(slices)) == i)
    out = None
    for i in range(slices):
        part = of(big, i).join(F.broadcast(of(keys, i)), column)
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------------------------------------------ vectorised word hashes

_RNG = np.random.default_rng(0x51F7)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = int(_ODD[63])
_UNBASE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Digits, letters and every byte of a character outside ASCII; upper case counts as it is lowered first.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        out = []
        for base in (_BASE, _UNBASE):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _powers = (out[0], out[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Ranges:
    """64-bit hashes of any byte ranges of ``data``, from one running sum."""

    def __init__(self, data: np.ndarray):
        up, self._down = _pow(len(data) + 1)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self._sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._down[start] + (end - start).astype(np.uint64) * _ODD[62])


class Words(Ranges):
    """Words of several texts that lie one after another in ``data``; text i is ``bounds[i]:bounds[i+1]``.

    ``start``, ``end``: byte range of each word; ``hash``: 64-bit hash of its bytes, A-Z lowered; words of text i are
    ``first[i]:first[i+1]``.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray):
        super().__init__(_LOWER[data])
        w = is_word[data]
        fresh = np.zeros(len(data) + 1, bool)
        fresh[bounds] = True
        before = np.concatenate(([False], w[:-1])) if len(w) else w
        self.start = np.flatnonzero(w & (~before | fresh[:-1]))
        after = np.concatenate((w[1:], [False])) if len(w) else w
        self.end = np.flatnonzero(w & (~after | fresh[1:])) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.hash = self.of(self.start, self.end)


def texts(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``most`` bytes (one row at least): (first row, end row, bytes, bounds).
    Null counts as empty. No row is cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))
