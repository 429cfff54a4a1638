"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order of the slots of a prime-sized table: start at an offset, go on by a fixed step, which visits
every slot once as the size is prime. Shards take turns, each claiming its first free slot, until the table is full. So slots are
shared out evenly to within one, and adding or removing a shard moves few of them. A key's slot is its hash modulo the size.

Placement is one lookup in a broadcast table whose size is the parameter ``slots``, not the data's: no shuffle, any number of rows
of one key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 32
SLOTS = 4099


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the number of the shard that claimed it."""
    if slots < 3 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime over 2, not {slots}")
    if not 1 <= len(shards) <= slots or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, one at least and no more than slots")
    place = [_number(f"offset:{s}") % slots for s in shards]
    step = [_number(f"step:{s}") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % slots
            table[place[i]] = i
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 32 bits of the md5 of the key as text, modulo the table's size. Null counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(slots)).cast("int")


def place(docs: DataFrame, key: str = "doc_id", *, shards: int | list[str] = SHARDS, slots: int = SLOTS, slot_name: str | None = "slot", shard_name: str = "shard") -> DataFrame:
    """``docs`` with its slot and shard number. Equal keys share a shard; null keys go where the empty text goes.

    New columns replace columns of the same name. An empty table stays empty.
    """
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else shards
    table = docs.sparkSession.createDataFrame(list(enumerate(lookup_table(names, slots))), "__siftwell_slot int, __siftwell_shard int")
    kept = [c for c in docs.columns if c not in (slot_name, shard_name)]
    keyed = docs.withColumn("__siftwell_slot", slot_of(F.col(key), slots))
    out = keyed.join(F.broadcast(table), "__siftwell_slot")
    added = [F.col("__siftwell_shard").alias(shard_name)] + ([F.col("__siftwell_slot").alias(slot_name)] if slot_name else [])
    return out.select(*[F.col(f"`{c}`") for c in kept], *added)


def sql(table: str, shards: int = SHARDS, slots: int = SLOTS) -> str:
    """The same placement of ``doc_id`` as DuckDB SQL, which fills the lookup table itself: a fold over all turns, in which the shard whose turn it is takes the first slot
    of its order that is free."""
    number = lambda kind: f"(SELECT list(('0x' || substr(md5('{kind}:shard-' || i), 1, 8))::bigint ORDER BY i) FROM range({shards}) AS t(i))"
    at = f"(offsets[x[1] % {shards} + 1] + j * (steps[x[1] % {shards} + 1] % {slots - 1} + 1)) % {slots} + 1"
    free = f"{at.replace('j *', f'list_filter(range({slots}), lambda j: a[{at}] = -1)[1] *')}"
    filled = f"list_reduce([list_transform(range({slots}), lambda z: -1::bigint)] || list_transform(range({slots}), lambda t: [t]), lambda a, x: a[1:{free} - 1] || [x[1] % {shards}] || a[{free} + 1:])"
    slot = f"(('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint % {slots})::int"
    return f"WITH orders AS (SELECT {number('offset')} AS offsets, {number('step')} AS steps), lookup AS (SELECT {filled} AS shard FROM orders) SELECT doc_id, shard[{slot} + 1]::int AS shard, {slot} AS slot FROM {table}, lookup"


def write(docs: DataFrame, path: str, key: str = "doc_id", parts: int = 8, **options) -> None:
    """Parquet under ``path``, a folder per shard. Each shard is dealt to ``parts`` tasks by a hash of the row, so a key that holds
    many rows, or a large shard, is not one task's work."""
    placed = place(docs, key, slot_name=None, **options)
    count = options.get("shards", SHARDS)
    tasks = (count if isinstance(count, int) else len(count)) * parts
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(parts))
    placed.repartition(tasks, "shard", salt).write.partitionBy("shard").parquet(path)


def tables(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
