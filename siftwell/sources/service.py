"""Spark data sources over services that hold repositories: questions and answers, files, and facts about them.

``spark.dataSource.register(DiscussionSource)`` and ``spark.read.format("discussions").options(fetcher="module:function", repos="a/b,c/d",
max_items=200).load()``; in the same way ``repository_files`` (FileSource) and ``repository_facts`` (FactSource). The fetcher is a function
that does one call; each repository is a partition. Calls are tried again with a growing pause.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftwell.sources.files import DISCUSSION

TRIES, PAUSE_S = 6, 5.0


def attempt(call: Callable, tries: int = TRIES, pause_s: float = PAUSE_S, sleep: Callable[[float], None] = time.sleep):
    """The result of a call that may fail; the pause before try i + 1 is ``pause_s * i``."""
    for i in range(1, tries + 1):
        try:
            return call()
        except Exception:
            if i == tries:
                raise
            sleep(pause_s * i)


def _function(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class _ByRepository(DataSourceReader):
    """Options that every reader here has, and a partition for each repository."""

    pause = PAUSE_S

    def __init__(self, options):
        self.fetcher, self.pause_s, self.tries = options["fetcher"], float(options.get("pause_s", self.pause)), int(options.get("tries", TRIES))
        self.repos = [r for r in options["repos"].split(",") if r]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r) for r in self.repos]


class DiscussionSource(DataSource):
    """The fetcher is ``f(repo, cursor) -> (items, next cursor or None)``; items without an answer are dropped, ``max_items`` of a
    repository are taken."""

    @classmethod
    def name(cls) -> str:
        return "discussions"

    def schema(self) -> str:
        return f"repo string, {DISCUSSION}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(_ByRepository):
    def __init__(self, options):
        super().__init__(options)
        self.most = int(options.get("max_items", 200))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch, cursor, given = _function(self.fetcher), None, 0
        while given < self.most:
            items, cursor = attempt(lambda c=cursor: fetch(partition.value, c), self.tries, self.pause_s)
            for x in items:
                if x.get("answer") and given < self.most:
                    given += 1
                    yield (partition.value, x.get("number"), x.get("title"), x.get("url"), x.get("created_at"), x.get("category"), x.get("question"), x["answer"], x.get("answer_url"))
            if cursor is None:
                return


class FileSource(DataSource):
    """Files of repositories: ``f(repo, None)`` lists them as ``{path, type, sha}``, ``f(repo, sha)`` gives one as ``{content, encoding}``. Only
    blobs under one of ``prefixes`` and with one of ``suffixes`` (both comma-separated; suffixes in any case) are fetched. The content stays
    as it came, text or base64; ``file_bytes`` decodes it."""

    @classmethod
    def name(cls) -> str:
        return "repository_files"

    def schema(self) -> str:
        return "repo string, path string, sha string, encoding string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Files(self.options)


class _Files(_ByRepository):
    pause = 3.0

    def __init__(self, options):
        super().__init__(options)
        split = lambda key, default: tuple(x for x in options.get(key, default).split(",") if x)
        self.prefixes, self.suffixes = split("prefixes", ""), split("suffixes", ".md,.mdx")

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        call, repo = _function(self.fetcher), partition.value
        for entry in attempt(lambda: call(repo, None), self.tries, self.pause_s):
            path = entry["path"]
            if entry.get("type") == "blob" and path.lower().endswith(self.suffixes) and (not self.prefixes or path.startswith(self.prefixes)):
                blob = attempt(lambda sha=entry["sha"]: call(repo, sha), self.tries, self.pause_s)
                yield repo, path, entry["sha"], blob.get("encoding"), blob.get("content")


def file_bytes(fetched: DataFrame) -> DataFrame:
    """(repo, path, content binary) of a FileSource's rows."""
    raw = F.when(F.col("encoding") == "base64", F.unbase64("content")).otherwise(F.col("content").cast("binary"))
    return fetched.select("repo", "path", raw.alias("content"))


def encoded(content: Column) -> Column:
    """Base64 of a binary column in one line: Spark's own breaks it after 76 characters."""
    return F.translate(F.base64(content), "\r\n", "")


class FactSource(DataSource):
    """A row for each repository: ``f(repo) -> {name, enabled, answered, stars} or None``. A call that fails to the end is a row with ``error``
    and no facts, and none is raised."""

    @classmethod
    def name(cls) -> str:
        return "repository_facts"

    def schema(self) -> str:
        return "repo string, enabled boolean, answered long, stars long, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Facts(self.options)


class _Facts(_ByRepository):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            found = attempt(lambda: _function(self.fetcher)(partition.value), self.tries, self.pause_s) or {}
            yield found.get("name", partition.value), found.get("enabled"), found.get("answered"), found.get("stars"), None
        except Exception as e:
            yield partition.value, None, None, None, f"{type(e).__name__}: {e}"


def ranked_facts(facts: DataFrame) -> DataFrame:
    """Repositories whose discussions are enabled first, then by answered questions (missing as 0), most first."""
    return facts.orderBy(F.coalesce("enabled", F.lit(False)).desc(), F.coalesce("answered", F.lit(0)).desc(), "repo")
