"""Calls to a language model from Spark tasks.

A client is a picklable object with ``complete(prompt, system, model) -> Reply``; it raises to signal a failed call. Results never raise:
a call that fails to the end is a row with ``is_error``. A budget caps the rows of a run before any call is made.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.session import ship

RESULT = "id string, text string, model string, cost_usd double, input_tokens long, output_tokens long, duration_ms long, is_error boolean, error string"


@dataclass(frozen=True)
class Reply:
    text: str
    cost_usd: float = 0.0
    input_tokens: int = 0
    output_tokens: int = 0


class Client(Protocol):
    def complete(self, prompt: str, system: str, model: str) -> Reply: ...


@dataclass(frozen=True)
class Echo:
    """A stand-in that answers with the first line of its prompt."""

    def complete(self, prompt: str, system: str, model: str) -> Reply:
        text = prompt.split("\n", 1)[0]
        return Reply(text, 0.0, max(1, len(prompt) // 4), max(1, len(text) // 4))


@dataclass(frozen=True)
class OverlapJudge:
    """A stand-in for a judge. A prompt is JSON with ``reference``, ``a`` and ``b``; a score is the share of the reference's words, of 100."""

    def complete(self, prompt: str, system: str, model: str) -> Reply:
        given = json.loads(prompt)
        words = {k: set(str(given.get(k, "")).lower().split()) for k in ("reference", "a", "b")}
        score = {k: round(100 * len(words[k] & words["reference"]) / max(1, len(words["reference"])), 1) for k in "ab"}
        better = "tie" if score["a"] == score["b"] else "A" if score["a"] > score["b"] else "B"
        return Reply(json.dumps({"a_score": score["a"], "b_score": score["b"], "a_correct": score["a"] >= 50, "b_correct": score["b"] >= 50, "preferred": better, "reason": "word overlap"}))


def _word_set(text: str) -> set[str]:
    return set(re.findall("[a-z0-9_]+", text.lower()))


@dataclass(frozen=True)
class OverlapReader:
    """A stand-in for a judge of candidates. A prompt is JSON with ``question`` and ``candidates``; a candidate supports the question if it has
    ``least`` in a hundred of the question's words, and is enough by itself from ``enough``."""

    least: int = 50
    enough: int = 80

    def complete(self, prompt: str, system: str, model: str) -> Reply:
        given = json.loads(prompt)
        asked = _word_set(given["question"])
        share = [100 * len(asked & _word_set(c.get("content") or "")) / max(1, len(asked)) for c in given["candidates"]]
        at = [i for i, x in enumerate(share) if x >= self.least]
        alone = max(share, default=0) >= self.enough
        return Reply(json.dumps({"supporting": at, "sufficient": alone, "keep": bool(at), "gold_indices": at, "supporting_ranks": at, "single_chunk_sufficient": alone, "reason": "word overlap"}))


@dataclass(frozen=True)
class WordShare:
    """A stand-in for a judge of two answers and of coverage, in whole numbers: a score is the share, of 100, of the reference's words that an answer has; the reference is covered
    if the chunks have ``least`` in a hundred of its words. It fails on references whose number of words is divisible by ``fails_on``."""

    least: int = 95
    fails_on: int = 0

    def complete(self, prompt: str, system: str, model: str) -> Reply:
        given = json.loads(prompt)
        wanted = _word_set(given["reference"])
        if self.fails_on and len(wanted) % self.fails_on == 0:
            raise RuntimeError("out of service")
        a, b, c = (100 * len(wanted & _word_set(given.get(k, ""))) // max(1, len(wanted)) for k in ("a", "b", "chunks"))
        better = "tie" if a == b else "A" if a > b else "B"
        return Reply(json.dumps({"a_score": a, "b_score": b, "a_correct": a >= 50, "b_correct": b >= 50, "preferred": better, "covered": c >= self.least, "reason": "shared words"}), 0.001, 1, 1)


@dataclass(frozen=True)
class FirstWords:
    """A stand-in for a generator: asks for the first five words of a chunk, answers with its first 80 characters, and calls chunks whose number
    of words is divisible by three of no use."""

    def complete(self, prompt: str, system: str, model: str) -> Reply:
        words = re.findall("[a-z0-9_]+", prompt.lower())
        return Reply(json.dumps({"usable": len(words) % 3 != 0, "question": " ".join(words[:5]), "reference": prompt[:80]}))


def call(prompts: DataFrame, client: Client, model: str, system: str = "", *, tries: int = 5, pause_s: float = 1.5, budget: int | None = None, at_once: int | None = None) -> DataFrame:
    """``prompts(id, prompt)`` -> RESULT rows. ``at_once`` caps the calls that run at a time (one a task). With a budget only the first
    that many ids, in order, are called, and the rest come back as errors that say so."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_one(client, i, p, system, model, tries, pause_s) for i, p in zip(batch["id"], batch["prompt"], strict=True)], columns=[x.split()[0] for x in RESULT.split(", ")])

    rows = prompts.select(F.col("id").cast("string").alias("id"), "prompt")
    over = None
    if budget is not None:
        within = rows.select("id").orderBy("id").limit(budget)
        over = rows.join(within, "id", "left_anti").select("id", F.lit("").alias("text"), F.lit(model).alias("model"), F.lit(0.0).alias("cost_usd"), *[F.lit(0).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "duration_ms")], F.lit(True).alias("is_error"), F.lit("over budget").alias("error"))
        rows = rows.join(within, "id", "left_semi")
    ship(prompts.sparkSession)
    out = (rows.repartition(at_once) if at_once else rows).mapInPandas(run, RESULT)
    return out if over is None else out.unionByName(over)


def _one(client: Client, key: str, prompt: str, system: str, model: str, tries: int, pause_s: float) -> tuple:
    began, error = time.monotonic(), ""
    for i in range(1, tries + 1):
        try:
            r = client.complete(prompt, system, model)
            return key, r.text, model, r.cost_usd, r.input_tokens, r.output_tokens, int(1000 * (time.monotonic() - began)), False, ""
        except TimeoutError as e:  # tried again at once
            error = f"timeout: {e}"
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if i < tries:
                time.sleep(pause_s * i)
    return key, "", model, 0.0, 0, 0, int(1000 * (time.monotonic() - began)), True, error


def traces(results: DataFrame, prompts: DataFrame, system: str = "", meta: dict[str, str] | None = None) -> DataFrame:
    """Audit rows of calls: time, meta, model, prompt, reply, cost, tokens, error."""
    entries = [x for k, v in (meta or {}).items() for x in (F.lit(k), F.lit(v))]
    kind = F.create_map(*entries) if entries else F.expr("cast(map() as map<string,string>)")
    rows = results.join(prompts.select(F.col("id").cast("string").alias("id"), "prompt"), "id")
    return rows.select(F.current_timestamp().alias("ts"), kind.alias("meta"), "model", F.lit(system).alias("system"), "prompt", F.col("text").alias("raw_response"), "is_error", "error", "cost_usd", "input_tokens", "output_tokens")


def embed(texts: DataFrame, encoder, column: str = "text", batch: int = 64, prefix: str = "") -> DataFrame:
    """``texts`` with ``vector`` array<float> of unit length from ``encoder(list[str]) -> list of vectors``; the encoder is made once a task
    if it is a class. ``prefix`` is put before each text, as some models ask for questions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder() if isinstance(encoder, type) else encoder
        for pdf in batches:
            out: list[np.ndarray] = []
            for i in range(0, len(pdf), batch):
                rows = np.asarray(model([prefix + (t or "") for t in pdf[column].iloc[i : i + batch]]), np.float64)
                length = np.linalg.norm(rows, axis=1, keepdims=True)
                out += list(np.divide(rows, length, out=np.zeros_like(rows), where=length > 0))
            pdf["vector"] = out
            yield pdf

    schema = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes) + ", vector array<float>"
    ship(texts.sparkSession)
    return texts.mapInPandas(run, schema)
