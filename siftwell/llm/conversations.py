"""Repair of the turn structure of conversations: cheapest edits to ``(s?(ua)+)?`` by a dynamic program that a prefix trie shares.

A turn's part in the program is one letter, its role's initial and its fault, so a conversation is a signature of letters, and conversations with
the same beginning share the program's layers for it. Signatures are dealt to tasks in sorted ranges; a task walks their trie, keeps the
layers of the path that it stands on, computes a layer once for each node, and gives answers where a signature ends. Ranges are of
(signature, conversation), so a signature that very many conversations have is spread over tasks too.

The program's states are what the repaired turns so far end in: nothing (0), the system's turn (1), the user's (2), the assistant's (3). A layer holds for each
state the least cost and, among edits of that cost, the least string of letters. All strings of a layer end in their last turn's letter, so
none begins another, and their order is that of the layer before and then of the letters added.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import Scratch, in_arrow

#: Costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\x0b\f\r"
#: State after a role's initial, by state; and the role that is not the system's which may follow.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
TURN = "uuau"
ROLES = {"u": "user", "a": "assistant"}
#: Insertions that bring the end of each state to one that may end a conversation.
CLOSING = (0, 2, 1, 0)
#: By state, the states after no, one and two insertions.
INSERTED = tuple((s, NEXT[s][TURN[s]], NEXT[NEXT[s][TURN[s]]][TURN[NEXT[s][TURN[s]]]]) for s in range(4))

#: cost, place in the order of the layer's strings, state before, letters added
Entry = tuple[int, int, int, str]
Layer = list[Entry | None]

PLAN = "array<struct<edit:string,role:string,position:long>>"


def next_layer(layer: Layer, letter: str) -> Layer:
    """The layer after a turn. ``letter``: s, u, a, or o for another role, in upper case for a truncated turn; x for a turn that must go."""
    best: list[tuple[int, int, str, int] | None] = [None] * 4
    role, stays = letter.lower(), TRUNCATED if letter.isupper() else 0
    for state, entry in enumerate(layer):
        if entry is None:
            continue
        for n, after in enumerate(INSERTED[state]):
            cost = entry[0] + INSERT * n
            edits = [(cost + DELETE, "D", after)]
            if letter != "x":
                edits.append((cost + REROLE + stays, "R", NEXT[after][TURN[after]]))
                if role in NEXT[after]:
                    edits.append((cost + stays, "K", NEXT[after][role]))
            for total, edit, to in edits:
                found = (total, entry[1], "I" * n + edit, state)
                if best[to] is None or found < best[to]:
                    best[to] = found
    order = {key: i for i, key in enumerate(sorted(b[1:3] for b in best if b))}
    return [(b[0], order[b[1:3]], b[3], b[2]) if b else None for b in best]


class Trie:
    """The path from the trie's root to the last signature, with a layer for each of its nodes."""

    def __init__(self) -> None:
        self.path = ""
        self.layers: list[Layer] = [[(0, 0, 0, ""), None, None, None]]
        self.computed = 0

    def answer(self, signature: str) -> tuple[int, str]:
        """(cost, letters of the edits) of a signature; layers are kept for the beginning that it shares with the one before."""
        shared = 0
        for a, b in zip(self.path, signature, strict=False):
            if a != b:
                break
            shared += 1
        del self.layers[shared + 1 :]
        for letter in signature[shared:]:
            self.layers.append(next_layer(self.layers[-1], letter))
        self.computed += len(signature) - shared
        self.path = signature
        cost, _, state = min((e[0] + INSERT * CLOSING[s], e[1], s) for s, e in enumerate(self.layers[-1]) if e)
        letters = ["I" * CLOSING[state]]
        for layer in reversed(self.layers[1:]):
            letters.append(layer[state][3])
            state = layer[state][2]
        return cost, "".join(reversed(letters))


def plan_of(signature: str, audit: str) -> list[dict]:
    """What each edit leaves: its letter, the initial of the role (none if deleted), and the turn that it is about (none if inserted)."""
    state, at, out = 0, 0, []
    for edit in audit:
        role = None if edit == "D" else signature[at].lower() if edit == "K" else TURN[state]
        if role is not None:
            state = NEXT[state][role]
        out.append({"edit": edit, "role": role, "position": None if edit == "I" else at})
        at += edit != "I"
    return out


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, position, role, text, fault, letter, follows) of turns in their conversation's order. A null role or text is one blank. The order is by
    turn, nulls first, then role and text, so equal turns have one too. ``fault`` is the first that holds of blank, duplicate (role
    and text seen earlier) and truncated (its last character that is not white space does not end a sentence), or null; ``follows``:
    whether the turn before it may stand there, by their initials (null for the first)."""
    column = lambda c: F.col(f"`{c}`")
    rows = conversations.select(column(conv).alias("conv_id"), column(turn).alias("turn"), F.coalesce(column(role), F.lit(" ")).alias("role"), F.coalesce(column(text), F.lit(" ")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(order), initial)
    rows = rows.withColumns({"position": F.row_number().over(order).cast("long") - 1, "_turn": F.lag("turn").over(order), "follows": pair.isin("su", "ua", "au")})
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("position"))
    ending = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(ending == "", "blank").when(nth > 1, "duplicate").when(~F.right(ending, F.lit(1)).isin(".", "!", "?"), "truncated")
    rows = rows.withColumn("fault", fault)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    fresh = F.col("turn").isNotNull() & (F.col("_turn").isNull() | (F.col("_turn") != F.col("turn")))
    return rows.select("conv_id", "turn", "position", "role", "text", "fault", letter.alias("letter"), "follows", fresh.alias("fresh"))


def signatures(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """A row per conversation of ``turns``' rows, and of ``conversations(conv_id)``, which may have no turns: its signature and its counts."""
    narrow = rows.drop("role", "text")
    if conversations is not None:
        narrow = narrow.unionByName(conversations.select("conv_id").distinct(), allowMissingColumns=True)
    here = F.col("position").isNotNull()
    letters = F.array_sort(F.collect_list(F.when(here, F.struct("position", "letter"))))
    count = lambda c: F.count_if(here & c)
    spread = F.max("turn") - F.min("turn") + 1 - count(F.col("fresh"))
    return narrow.groupBy("conv_id").agg(
        F.array_join(F.transform(letters, lambda x: x["letter"]), "").alias("signature"), F.coalesce(spread, F.lit(0)).cast("long").alias("gaps"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], count(~F.col("follows")).alias("illegal"),
    )


def audits(signed: DataFrame) -> DataFrame:
    """``signatures``' rows with ``cost``, ``audit`` (the letters of the edits: Delete, Insert, Keep, Rerole) and ``plan`` (for each edit its letter, the initial
    that it leaves, and the place of its turn)."""
    n = len(signed.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last = Trie(), None
        for batch in batches:
            cost, audit, plan = [], [], []
            for signature in batch.column(1).to_pylist():
                if last is None or last[0] != signature:
                    last = (signature, *trie.answer(signature))
                cost.append(last[1])
                audit.append(last[2])
                plan.append(plan_of(signature, last[2]))
            made = [pa.array(cost, pa.int64()), pa.array(audit, pa.string()), pa.array(plan, pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("position", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [str(i) for i in range(n + 3)])

    sorted_rows = signed.repartitionByRange("signature", "conv_id").sortWithinPartitions("signature")
    schema = ", ".join(f"{c} {t}" for c, t in signed.dtypes)
    return in_arrow(sorted_rows, run, f"{schema}, cost long, audit string, plan {PLAN}")


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired turns in the order of ``place``. Turns meet their edits by conversation and position, so
    the turns of one long conversation are spread over tasks."""
    edits = audited.select("conv_id", F.posexplode("plan").alias("place", "e")).select(F.col("conv_id").alias("_conv"), "place", F.col("e.edit").alias("edit"), F.col("e.role").alias("initial"), F.col("e.position").alias("_position"))
    given = rows.select("conv_id", "position", F.col("role").alias("was"), "text")
    met = edits.filter("edit <> 'D'").join(given, F.col("_conv").eqNullSafe(F.col("conv_id")) & (F.col("_position") == F.col("position")), "left")
    new = F.when(F.col("initial") == "u", ROLES["u"]).otherwise(ROLES["a"])
    return met.select(F.col("_conv").alias("conv_id"), "place", "edit", F.when(F.col("edit") == "K", F.col("was")).otherwise(new).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def hashes(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``repaired``'s turns as ``role:text`` lines. A conversation's hash is a fold over its turns, so they go to one task in
    their order, and the task holds one of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            ids, out = [], []
            for conv, place, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if digest is None or place == 0 or conv != key:
                    if digest is not None:
                        ids.append(key)
                        out.append(digest.hexdigest())
                    key, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(out, pa.string())], ["conv_id", "sha"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], batch.schema.field(0).type), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "sha"])

    rows = lines.select("conv_id", "place", F.concat_ws(":", "role", "text").alias("line"))
    return in_arrow(rows.repartition("conv_id").sortWithinPartitions("conv_id", "place"), run, f"conv_id {dict(lines.dtypes)['conv_id']}, repaired_sha256 string")


def repair(conversations: DataFrame, ids: DataFrame | None = None, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(a row per conversation: counts, cost, audit, plan; the repaired turns) of turns, whose columns ``turns`` names. ``ids``: conversations that are to have
    a row though they have no turn, with zeros and an empty audit.

    Null ids are one conversation, a null turn comes first, null roles and texts are one blank, and repeated rows count as often as they are there.
    Texts of any length are compared whole. A conversation's signature, one letter a turn, and its layers are one task's to hold; its texts are
    not. Both tables of turns are written once, so the window of a conversation's order runs once."""
    scratch = Scratch(conversations.sparkSession)
    rows = scratch.save(turns(conversations, **columns))
    audited = scratch.save(audits(scratch.save(signatures(rows, ids))))
    return audited, repaired(rows, audited)


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's faults: by crc32 of ``conv_id:turn`` (nulls one blank) mod 20 a turn is dropped (0), emptied (1), loses its sentence ends (2), is
    repeated (3) or becomes the user's (4)."""
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", written("role").alias("role"), written("text").alias("text"), (F.crc32(F.concat_ws(":", written("conv_id"), written("turn"))) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(kind == 3, 2).otherwise(1)
    rows = rows.filter(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)))
    return rows.drop("col")


def report(conversations: DataFrame) -> DataFrame:
    """The contract's row per conversation, of the damaged turns."""
    audited, lines = repair(damaged(conversations), conversations.select("conv_id"))
    sums = hashes(lines).withColumnRenamed("conv_id", "_conv")
    rows = audited.drop("signature", "plan").join(sums, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return rows.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
