"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on the full shingle sets.

A table's key is a pair (A_i, B_j) of two small collections of ``collections`` composite hashes, each of ``rows`` minhashes:
``collections``**2 tables of 2*rows minhashes come from 2*collections*rows of them, about a square root of what separate tables
would need. Two sets meet if they share some A_i and some B_j; at similarity s that has probability
(1 - (1 - s**rows)**collections)**2: with 20 and 4, 0.9990 at the threshold 0.75 and over 0.99999 from 0.85.

Exact copies (equal sets) are first collapsed to their smallest doc_id. Only keys A_i and B_j that another set shares are combined,
which leaves the tables as they are. In a bucket each member is compared with the smallest one, its pivot. Where that leaves members
of one pivot in different components, ``pivots`` finds the pairs of them that may still be linked by how they differ from the group's
majority: no link that the tables offer is lost, and a large group is not paired with itself.

A task holds about a megabyte of text at a time (one text at least): beside it some 60 bytes a byte of text, so a text of 20 MB takes
about 1.2 GB of a worker. Texts are not cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import Scratch, in_arrow, keyed, longs, mix, texts
from siftwell.llm.pivots import all_links
from siftwell.llm.sets import Minhashes, alike, compared, differences, word_shingles

SHINGLE = 5
PERCENT = 75
COLLECTIONS = 20
ROWS = 4


def _signatures(size: int, collections: int, rows: int):
    shingler, minhashes = word_shingles(size), Minhashes(2 * collections, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in texts(batch.column(1)):
                sh, at = shingler(data, bounds)
                n = np.zeros(j - i, np.int64)
                one = np.zeros(j - i, np.uint64)
                two = np.zeros(j - i, np.uint64)
                for d in range(j - i):
                    if at[d + 1] > at[d]:
                        u = np.unique(sh[at[d] : at[d + 1]])
                        n[d], one[d], two[d] = len(u), u.sum(), mix(u).sum()
                full = np.flatnonzero(np.diff(at))
                keys = minhashes.of(sh, at[full]) if len(full) else np.zeros(0, np.uint64)
                where = np.zeros(j - i + 1, np.int32)
                where[full + 1] = 2 * collections
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(where, dtype=np.int32)), longs(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), longs(one), longs(two), lists], ["id", "n", "one", "two", "keys"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SHINGLE, percent: int = PERCENT, collections: int = COLLECTIONS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: (id_col long, n_shingles long, component_id long, kept boolean).

    Null and wordless texts have an empty set: they are linked with nothing and kept. Rows that share an id are one document: they
    get the same component. A null id is linked with nothing, has a null component and is kept. Only id_col and text_col are read,
    so other columns and their names do not matter. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = scratch.save(in_arrow(source, _signatures(size, collections, rows), "id long, n long, one long, two long, keys array<long>"))

    # Equal sets: the smallest id stands for them. Counts are pre-aggregated before their shuffle.
    full = sig.filter("n > 0 and id is not null")
    same = full.groupBy("one", "two", "n").agg(F.min("id").alias("rep"), F.count("*").alias("c")).filter("c > 1").drop("c")
    base = scratch.save(keyed(full, scratch.save(same), ["one", "two", "n"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"), "keys"))

    # Keys of either collection that several sets share; then the tables' keys, from pairs of them.
    single = base.filter("id = rep").select("rep", "n", F.posexplode("keys").alias("pos", "key")).select("rep", "n", (F.col("pos") >= collections).alias("second"), "key")
    shared = single.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("key")
    halves = keyed(single, scratch.save(shared), "key").groupBy("rep", "n").agg(F.collect_set(F.when(~F.col("second"), F.col("key"))).alias("a"), F.collect_set(F.when(F.col("second"), F.col("key"))).alias("b"))
    keyed_pairs = halves.select("rep", "n", F.explode("a").alias("ka"), "b").select("rep", "n", "ka", F.explode("b").alias("kb"))
    tables = scratch.save(keyed_pairs.select("rep", "n", F.xxhash64("ka", "kb").alias("bucket")))
    pivots = tables.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.max("rep").alias("hi")).filter("pivot < hi").drop("hi")
    member = scratch.save(keyed(tables, scratch.save(pivots), "bucket").select("bucket", "rep", "n", "pivot"))
    scratch.drop(tables)

    ids = scratch.save(member.select(F.col("rep").alias("id")).distinct())
    wanted = scratch.save(keyed(source, ids, "id", "left_semi"))
    first = member.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    shingler = word_shingles(size)
    seen = scratch.save(compared(first, wanted, shingler))
    scratch.drop(member)
    links = scratch.save(seen.filter(alike(percent)).select("a", "b").unionByName(_one_id_several_sets(base)))
    found = all_links(seen, links, lambda pairs: compared(pairs, wanted, shingler).filter(alike(percent)).select("a", "b"), lambda pairs: differences(pairs, wanted, shingler), percent, scratch)
    scratch.drop(wanted, seen)

    label = found.select(F.col("id").alias("rep"), "component")
    out = keyed(base.select("id", "n", "rep"), scratch.save(label), "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("component_id"))
    out = out.unionByName(sig.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id")))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def _one_id_several_sets(base: DataFrame) -> DataFrame:
    """Links between the sets that rows of one id have, if the ids repeat."""
    several = base.groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("hi")).filter("b < hi").select("id", "b")
    return base.select("id", F.col("rep").alias("a")).join(several, "id").select("a", "b")


_ROW = "__siftwell_row"


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that are near copies of one that stays: of each component the row with the smallest id, of rows that share that id the
    least by the hash of its text. Rows are judged, not ids: texts that differ stay though they have one id, and repeated rows are copies. Rows with
    a null id, and null and wordless texts, are copies of nothing and all stay.

    Where ids repeat, rows are numbered in a written table. A component's row is a minimum over narrow columns, combined before its shuffle, so an id that
    very many rows have, or a component of very many, is no task's to hold."""
    scratch = Scratch(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("id")).filter("id is not null")
    if named.groupBy("id").count().filter("count > 1").isEmpty():
        judged = near_duplicates(docs, id_col, text_col, **options).filter(F.col(id_col).isNotNull() & ~F.col("kept"))
        return keyed(docs, scratch.save(judged.select(id_col)), id_col, "left_anti").select(docs.columns)
    number = F.when(F.col(id_col).isNotNull(), F.monotonically_increasing_id())
    rows = scratch.save(docs.withColumn(_ROW, number))
    judged = scratch.save(near_duplicates(rows, _ROW, text_col, **options).filter(F.col(_ROW).isNotNull()).select(F.col(_ROW).alias("row"), F.col("component_id").alias("component")))
    several = scratch.save(judged.groupBy("component").agg(F.count("*").alias("c")).filter("c > 1").select("component"))
    copies = scratch.save(keyed(judged, several, "component").select(F.col("row").alias(_ROW), "component"))
    facts = rows.select(_ROW, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(_ROW).alias("row")).alias("place"))
    first = keyed(facts, copies, _ROW).groupBy("component").agg(F.min("place").alias("first"))
    gone = scratch.save(copies.join(scratch.save(first.select(F.col("first.row").alias(_ROW))), _ROW, "left_anti").select(_ROW))
    return keyed(rows, gone, _ROW, "left_anti").select(docs.columns)
