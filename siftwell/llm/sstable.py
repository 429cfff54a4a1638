"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their key. Layout, all numbers little-endian:

* data blocks, each compressed with zstd: entries of (varint shared, varint unshared, varint value length, key suffix, value), where
  ``shared`` counts the leading key bytes that repeat the previous key's; every RESTARTS-th entry starts anew with shared 0. Then the
  offsets of those entries (u32 each) and their number (u32). A value is the ids, ``width`` bytes each.
* index block: for each data block (varint key length, last key, u64 offset, u32 length, u32 crc32 of the compressed bytes).
* Bloom filter over the keys: BLOOM_BITS bits a key, BLOOM_HASHES probes.
* footer of FOOTER bytes: offset and length of index and Bloom filter (u64 each), documents and ids (u64 each), width, magic.

A reader finds a key by its Bloom filter, a binary search of the index and one of the block's restarts, and reads one block. Integer
keys are written as 8 bytes, high byte first, with the sign bit turned, so bytes sort as numbers do; a null key is empty and sorts
first; equal keys stand together.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow.fs import FileSelector, FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import Scratch, in_arrow, texts
from siftwell.llm.tokens import encoder

END_ID = 2
BLOCK = 64 << 10
RESTARTS = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"SIFTSST1"
_FOOTER = struct.Struct("<QQQQQQQ8s")


def key_bytes(key: int | None) -> bytes:
    return b"" if key is None else struct.pack(">Q", (key + (1 << 63)) & ((1 << 64) - 1))


def key_int(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a = zlib.crc32(key) | zlib.crc32(key, 0x9E3779B9) << 32
    b = (a * 0x9E3779B97F4A7C15 >> 7) | 1
    return [(a + i * b) % (1 << 64) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Appends (key, ids) in key order to an open binary stream."""

    def __init__(self, stream, width: int):
        self.out, self.width, self.dtype = stream, width, np.dtype(f"<u{width}")
        self.offset = self.docs = self.ids = 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.hashes: list[bytes] = []
        self.zip = zstandard.ZstdCompressor(level=1)
        self._fresh()

    def _fresh(self) -> None:
        self.buf, self.restarts, self.count, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.count % RESTARTS == 0:
            self.restarts.append(len(self.buf))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype(self.dtype).tobytes()
        self.buf += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.count, self.last = self.count + 1, key
        self.docs, self.ids = self.docs + 1, self.ids + len(ids)
        self.hashes.append(key)
        if len(self.buf) >= BLOCK:
            self._block()

    def _block(self) -> None:
        if self.count:
            tail = np.array([*self.restarts, len(self.restarts)], "<u4").tobytes()
            data = self.zip.compress(bytes(self.buf) + tail)
            self.out.write(data)
            self.index.append((self.last, self.offset, len(data), zlib.crc32(data)))
            self.offset += len(data)
        self._fresh()

    def close(self) -> None:
        self._block()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QII", o, n, c) for k, o, n, c in self.index)
        bits = max(64, BLOOM_BITS * len(self.hashes))
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for key in self.hashes:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        filter_ = struct.pack("<Q", bits) + bloom.tobytes()
        self.out.write(index + filter_)
        self.out.write(_FOOTER.pack(self.offset, len(index), self.offset + len(index), len(filter_), self.docs, self.ids, self.width, MAGIC))


class Reader:
    """A shard behind a random-access binary file: ``get`` looks a key up, iteration gives every (key, ids) in order."""

    def __init__(self, file, size: int):
        self.file = file
        at, n, bloom_at, bloom_n, self.docs, self.ids, width, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.dtype = np.dtype(f"<u{width}")
        self.index: list[tuple[bytes, int, int, int]] = []
        raw, p = self._read(at, n), 0
        while p < n:
            k, p = _read_varint(raw, p)
            self.index.append((raw[p : p + k], *struct.unpack_from("<QII", raw, p + k)))
            p += k + 16
        raw = self._read(bloom_at, bloom_n)
        self.bits, self.bloom = struct.unpack("<Q", raw[:8])[0], raw[8:]
        self.unzip = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> tuple[bytes, np.ndarray]:
        _, at, n, crc = self.index[i]
        data = self._read(at, n)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {i} is damaged")
        buf = self.unzip.decompress(data)
        count = int(np.frombuffer(buf[-4:], "<u4")[0])
        return buf, np.frombuffer(buf[-4 - 4 * count : -4], "<u4")

    def _entries(self, buf: bytes, restarts: np.ndarray, at: int) -> Iterator[tuple[bytes, np.ndarray]]:
        end, key = len(buf) - 4 - 4 * len(restarts), b""
        while at < end:
            shared, at = _read_varint(buf, at)
            own, at = _read_varint(buf, at)
            size, at = _read_varint(buf, at)
            key = key[:shared] + buf[at : at + own]
            at += own
            yield key, np.frombuffer(buf, self.dtype, size // self.dtype.itemsize, at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            buf, restarts = self._block(i)
            yield from self._entries(buf, restarts, 0)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits))

    def get(self, key: bytes) -> np.ndarray | None:
        """The ids of the first document with this key."""
        if not self.may_hold(key):
            return None
        i = bisect_left(self.index, key, key=lambda e: e[0])
        if i == len(self.index):
            return None
        buf, restarts = self._block(i)
        first = lambda r: next(self._entries(buf, restarts, int(r)))[0]
        at = max(0, bisect_left(restarts, key, key=first) - 1)
        for k, ids in self._entries(buf, restarts, int(restarts[at])):
            if k >= key:
                return ids.copy() if k == key else None
        return None


def open_shard(path: str) -> Reader:
    fs, name = FileSystem.from_uri(path)
    return Reader(fs.open_input_file(name), fs.get_file_info(name).size)


#: Bytes of text of a shard, and of one of a table that has too few to keep the cluster busy.
SHARD_BYTES, LEAST_BYTES = 256 << 20, 8 << 20
MANIFEST = "shard int, path string, first long, last long, n_docs long, n_tokens long, n_bytes long"


def _write(folder: str, tokenizer: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        most = max(enc.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id or 0)
        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"{shard:06d}-{uuid.uuid4().hex}.sst"  # of this attempt: the manifest has the one that counts
        first = last = None
        with fs.open_output_stream(f"{base}/{name}") as stream:
            writer = Writer(stream, 2 if most < 1 << 16 else 4)
            for batch in batches:
                keys = batch.column(0).to_pylist()
                for i, j, data, bounds in texts(batch.column(1)):
                    ids, at = enc.encode(data, bounds)
                    for d in range(i, j):
                        own = ids[at[d - i] : at[d - i + 1]]
                        writer.add(key_bytes(keys[d]), own if end_id is None else np.append(own, np.uint32(end_id)))
                if keys:
                    first, last = keys[0] if first is None else first, keys[-1]
            writer.close()
        if not writer.docs:
            fs.delete_file(f"{base}/{name}")
            return
        size = fs.get_file_info(f"{base}/{name}").size
        row = [shard, f"{folder}/{name}", first, last, writer.docs, writer.ids, size]
        yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.string()), *(pa.array([x], pa.int64()) for x in row[2:])], ["shard", "path", "first", "last", "n_docs", "n_tokens", "n_bytes"])

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", *, end_id: int | None = END_ID, shards: int | None = None) -> DataFrame:
    """Write ``docs`` as shards in ``folder`` (a URI that every executor reaches) and give back the manifest, a row per shard that is
    not empty. Shards follow one another in ascending id, nulls first; rows of one id may spread over shards, in the order of a hash
    of their texts, so an id that many rows share is not one task's work. ``tokenizer`` is a path that executors can read.

    Files are named by task and attempt, and the manifest, which Spark commits, lists those that count: a task that ran twice, or died after
    writing, leaves a file that no reader opens (``sweep`` deletes such). Unless ``shards`` is given there is one for SHARD_BYTES of text, and
    for small tables as many as keep the cluster busy."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = shards or _shards(source)
    order = ["id", F.xxhash64("text")]
    dealt = source.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return scratch.save(in_arrow(dealt, _write(folder, tokenizer, end_id), MANIFEST))


def _shards(source: DataFrame) -> int:
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = source.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // SHARD_BYTES), min(-(-size // LEAST_BYTES), 4 * cores))


def sweep(manifest: DataFrame, folder: str) -> int:
    """Delete the shard files in ``folder`` that its manifest does not list; how many there were. For use when nothing writes there."""
    fs, base = FileSystem.from_uri(folder)
    listed = {r.path.rsplit("/", 1)[-1] for r in manifest.select("path").collect()}
    gone = [x.path for x in fs.get_file_info(FileSelector(base)) if x.path.endswith(".sst") and x.base_name not in listed]
    for path in gone:
        fs.delete_file(path)
    return len(gone)


def _read() -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, starts, sizes, sums, at = [], [], [], [], 0
                for key, ids in open_shard(path):
                    keys.append(key_int(key))
                    starts.append(at)
                    sizes.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(keys), pa.int32()), *(pa.array(x, pa.int64()) for x in (keys, starts, sizes, sums))], ["shard", "id", "at", "n_tokens", "ids_crc32"])

    return run


def read(spark: SparkSession, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32, shard) of every document, from the files of a manifest; a task for each shard."""
    begins = manifest.select("shard", "path", (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("base"))
    rows = begins.collect()  # a row per shard
    if not rows:
        return spark.createDataFrame([], f"{id_col} long, start long, n_tokens long, ids_crc32 long, shard int")
    listed = spark.createDataFrame([(i, r.shard, r.path) for i, r in enumerate(rows)], "i long, shard int, path string")
    spread = spark.range(0, len(rows), 1, len(rows)).withColumnRenamed("id", "i").join(F.broadcast(listed), "i").select("shard", "path")
    found = in_arrow(spread, _read(), "shard int, id long, at long, n_tokens long, ids_crc32 long")
    base = spark.createDataFrame([(r.shard, r.base) for r in rows], "shard int, base long")
    out = found.join(F.broadcast(base), "shard")
    return out.select(F.col("id").alias(id_col), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write the shards to the shared folder, then describe every document as the files have it.

    Null texts are empty and hold the end id alone; null ids come first; rows that repeat are kept. An empty table gives no rows."""
    scratch = Scratch(docs.sparkSession)
    manifest = write(docs, f"{scratch.folder}/tokens", tokenizer, scratch, id_col, text_col, **options)
    return read(docs.sparkSession, manifest, id_col)
