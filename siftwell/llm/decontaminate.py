"""Benchmark decontamination: an FM-index per training shard answers which benchmark phrases the shard holds, and where.

A shard is a run of rows of about ``shard_bytes`` of text (one row at least; texts are not cut). The index is of the shard's words as far as
a phrase can hold them: words are looked up in the vocabulary of the phrases, and as a word outside it ends any phrase, stretches of
known words that are too short for the shortest phrase are left out and the rest are set apart by a break symbol. No occurrence is lost
by that, and the index is often a small part of the shard. Every distinct phrase is searched backward through the wavelet ranks, its occurrences are located from
sampled suffix positions, and their spans are merged.

The benchmark travels to the shards in blocks of about ``block_bytes`` of its text (its size is counted first, and equal rows count once;
a single larger text is a block). A block's phrases are laid out once, on the driver, as arrays, at about ten bytes for a byte of text. One
block is one pass over the documents, without a shuffle; the spans of several blocks are merged by row of the documents and position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import _ODD, ALNUM, Scratch, Words, in_arrow, keyed, mix, texts
from siftwell.llm.fm_index import FMIndex
from siftwell.llm.sets import windows_of

WINDOW = 13
#: Of words of a document that are hit, so many in a hundred make it contaminated.
PERCENT = 5
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 2 << 20
#: Rows located at a time, so that a phrase of great frequency takes no more memory.
LOCATE = 1 << 18

SPANS = "array<struct<start:long,end:long>>"
ROW, SPANS_COL = "__siftwell_row", "__siftwell_spans"
SCHEMA = f"id long, n_words long, n_hit long, spans {SPANS}, items array<string>"


class Phrases:
    """Distinct windows of benchmark items as rows of symbol numbers, right-aligned, with the items of each (``of[at[p]:at[p+1]]``)."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.names = [None if x is None else str(x) for x, _ in items]
        column = pa.array([t for _, t in items], pa.string())
        hashes, item = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        rows, sizes = [np.zeros((0, window), np.uint64)], [np.zeros(0, np.int64)]
        for i, _, data, bounds in texts(column):
            words = Words(data, bounds, ALNUM)
            doc, pos, units, _ = windows_of(np.diff(words.first), window)
            matrix = np.zeros((len(pos), window), np.uint64)
            for j in range(window):
                inside = np.flatnonzero(j < units)
                matrix[inside, window - units[inside] + j] = words.hash[pos[inside] + j]
            key = mix(mix((matrix * np.multiply.accumulate(np.full(window, _ODD[0]))).sum(1)) + units.astype(np.uint64))
            _, first = np.unique(key, return_index=True)
            hashes.append(key)
            item.append(doc + i)
            rows.append(matrix[first])
            sizes.append(units[first])
        every, all_rows, all_sizes = np.concatenate(hashes), np.concatenate(rows), np.concatenate(sizes)
        number = np.unique(every)
        firsts = np.concatenate([np.zeros(0, np.uint64), *(np.unique(h) for h in hashes)])  # the keys of ``rows``, in their order
        _, chosen = np.unique(firsts, return_index=True)
        table, self.lengths = all_rows[chosen], all_sizes[chosen]
        filled = np.arange(window)[None, :] >= window - self.lengths[:, None]
        self.vocabulary = np.unique(table[filled])
        self.matrix = np.where(filled, np.searchsorted(self.vocabulary, table) + 2, 0).astype(np.int32)  # 1 is the break, words are from 2
        pair = np.unique(np.stack((np.searchsorted(number, every), np.concatenate(item)), axis=1), axis=0)
        self.at, self.of = np.searchsorted(pair[:, 0], np.arange(len(number) + 1)), pair[:, 1]
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0

    def items(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``phrases``, item) for each item of each of them."""
        n = self.at[phrases + 1] - self.at[phrases]
        which = np.repeat(np.arange(len(phrases)), n)
        return which, self.of[self.at[phrases][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]


def scan(words: Words, phrases: Phrases, shard_docs: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each document of a shard: merged spans of word numbers (start, end), and the numbers of the items that occur."""
    spans = [np.zeros((0, 2), np.int64)] * shard_docs
    items = [np.zeros(0, np.int64)] * shard_docs
    total = len(words.hash)
    if not total or not len(phrases.lengths):
        return spans, items
    slot = np.minimum(np.searchsorted(phrases.vocabulary, words.hash), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[slot] == words.hash
    # Stretches of known words within a document.
    edge = np.zeros(total + 1, bool)
    edge[words.first] = True
    begin = np.flatnonzero(known & (edge[:-1] | np.concatenate(([True], ~known[:-1]))))
    end = np.flatnonzero(known & (edge[1:] | np.concatenate((~known[1:], [True])))) + 1
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return spans, items
    size = end - begin
    out = np.concatenate(([0], np.cumsum(size + 1)))
    seq = np.ones(out[-1], np.int64)
    place = np.repeat(begin - out[:-1], size)
    inside = np.ones(out[-1], bool)
    inside[out[1:] - 1] = False
    at = np.flatnonzero(inside)
    source = np.zeros(out[-1], np.int64)
    source[at] = at + place
    seq[at] = slot[source[at]] + 2
    index = FMIndex(seq, len(phrases.vocabulary) + 2)
    lo, hi = index.search(phrases.matrix, phrases.lengths)
    hit = np.flatnonzero(lo < hi)
    if not len(hit):
        return spans, items
    # Occurrences in runs of bounded length: (document, item) pairs are unique, covered words are marked.
    cover = np.zeros(total + 1, np.int64)
    pairs = np.zeros((0, 2), np.int64)
    counts = hi[hit] - lo[hit]
    ends = np.cumsum(counts)
    for a in range(0, int(ends[-1]), LOCATE):
        k = np.arange(a, min(a + LOCATE, int(ends[-1])))
        which = np.searchsorted(ends, k, "right")
        rows = lo[hit][which] + (k - (ends - counts)[which])
        phrase = hit[which]
        where = source[index.locate(rows)]
        np.add.at(cover, where, 1)
        np.add.at(cover, where + phrases.lengths[phrase], -1)
        doc = np.searchsorted(words.first, where, "right") - 1
        met = np.unique(np.stack((doc, phrase), axis=1), axis=0)
        place, item = phrases.items(met[:, 1])
        pairs = np.unique(np.concatenate((pairs, np.stack((met[place, 0], item), axis=1))), axis=0)
    covered = np.cumsum(cover[:-1]) > 0
    for d in np.unique(pairs[:, 0]).tolist():
        c = np.concatenate(([False], covered[words.first[d] : words.first[d + 1]], [False]))
        spans[d] = np.flatnonzero(c[1:] != c[:-1]).reshape(-1, 2)
        items[d] = pairs[slice(*np.searchsorted(pairs[:, 0], (d, d + 1))), 1]
    return spans, items


def _scanner(phrases: Phrases, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in texts(batch.column(1), shard_bytes):
                words = Words(data, bounds, ALNUM)
                spans, found = scan(words, phrases, j - i)
                names = [sorted({phrases.names[x] for x in f if phrases.names[x] is not None}) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(np.diff(words.first).astype(np.int64)),
                        pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], pa.int64()),
                        pa.array([[{"start": int(a), "end": int(b)} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array(names, pa.list_(pa.string())),
                    ],
                    ["id", "n_words", "n_hit", "spans", "items"],
                )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, spans (merged, half-open, in word numbers), items (sorted as strings).

    Words are runs of digits, letters a-z and characters outside ASCII, after lowering A-Z. Null texts have no words, and an item
    without words has no window. A null item id marks words but names no item; equal ids count once. With no benchmark rows nothing
    is hit. Documents that repeat give a row each. Only the named columns are read.
    """
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    bench, blocks = _blocks(benchmark, item_col, item_text, block_bytes)

    def scanned(frame: DataFrame, b: int) -> DataFrame:
        return in_arrow(frame, _scanner(_phrases(bench, blocks, b, window), shard_bytes), SCHEMA)

    if blocks == 1:
        return scanned(source, 0)
    numbered = scratch.save(source.withColumn("row", F.monotonically_increasing_id()))
    rows = numbered.select(F.col("row").alias("id"), "text")
    parts = [scanned(rows, b).filter("true" if b == 0 else "n_hit > 0") for b in range(blocks)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = every.groupBy("id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = f"""aggregate(array_sort(s), cast(array() as {SPANS}),
        (acc, x) -> case when size(acc) > 0 and element_at(acc, -1).end >= x.start
            then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end))))
            else concat(acc, array(x)) end)"""
    merged = merged.select(F.col("id").alias("row"), "n_words", F.expr(joined).alias("spans"), "items")
    hit = F.expr("aggregate(spans, 0L, (acc, x) -> acc + x.end - x.start)")
    return numbered.select("row", "id").join(merged, "row").select("id", "n_words", hit.alias("n_hit"), "spans", "items")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = PERCENT, **options) -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256, contaminated: over ``percent`` in a hundred of its words are hit, or as many."""
    found = contamination(docs, benchmark, id_col, text_col, **options)
    bad = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
    return found.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), bad.alias("contaminated"),
    )


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, block_bytes: int) -> tuple[DataFrame, int]:
    """The distinct items with a text, and how many blocks they are dealt to."""
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).filter("text is not null").distinct()
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return bench, max(1, -(-size // block_bytes))


def _phrases(bench: DataFrame, blocks: int, b: int, window: int) -> Phrases:
    block = bench.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
    return Phrases([(r.item, r.text) for r in block.collect()], window)  # about block_bytes


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, percent: int = PERCENT, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` without contaminated rows, all columns kept. Rows are judged one by one, whatever their ids: repeated and null ids change
    nothing. One pass without a join where the benchmark is one block, else by row number."""
    bench, blocks = _blocks(benchmark, item_col, item_text, block_bytes)
    if blocks > 1:
        scratch = Scratch(docs.sparkSession)
        numbered = scratch.save(docs.withColumn(ROW, F.monotonically_increasing_id()))
        found = contamination(numbered, benchmark, ROW, text_col, item_col, item_text, window=window, block_bytes=block_bytes, shard_bytes=shard_bytes)
        bad = found.filter((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).select(F.col("id").alias(ROW))
        return keyed(numbered, scratch.save(bad), ROW, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
    at, phrases = docs.columns.index(text_col), _phrases(bench, 1, 0, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            for i, j, data, bounds in texts(batch.column(at), shard_bytes):
                words = Words(data, bounds, ALNUM)
                n = np.diff(words.first)
                hit = np.array([int((s[:, 1] - s[:, 0]).sum()) for s in scan(words, phrases, j - i)[0]], np.int64)
                good[i:j] = (hit == 0) | (100 * hit < percent * n)
            yield batch.filter(pa.array(good))

    return in_arrow(docs, run, docs.schema)


def cut(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, every row and column, with the words of every span taken out of the text (from the first word's first byte to the last one's
    last), for use where passages go and documents stay. Rows without a hit, and null texts, are as they were."""
    scratch = Scratch(docs.sparkSession)
    numbered = scratch.save(docs.withColumn(ROW, F.monotonically_increasing_id()))
    found = contamination(numbered, benchmark, ROW, text_col, **options).filter("n_hit > 0").select(F.col("id").alias(ROW), F.col("spans").alias(SPANS_COL))
    at, width = docs.columns.index(text_col), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.column(at).to_pylist()
            for k, spans in enumerate(batch.column(width).to_pylist()):
                if spans:
                    raw = out[k].encode()
                    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM)
                    edges = [0, *(x for s in spans for x in (words.start[s["start"]], words.end[s["end"] - 1])), len(raw)]
                    out[k] = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()
            columns = list(batch.columns[:width])
            columns[at] = pa.array(out, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    docs_names = docs.columns
    joined = numbered.join(found, ROW, "left").select(*[F.col(f"`{c}`") for c in docs.columns], SPANS_COL)
    return in_arrow(joined, run, docs.schema)
