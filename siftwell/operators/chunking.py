"""Documents to chunks. Chunk rows: chunk_id, doc_path, chunk_index, content, heading.

Fixed windows have a closed form and paragraph and sentence packing are folds over an array, so all three stay in the JVM. The
heading-aware chunker carries state over lines in ways a fold cannot show clearly; it runs a document at a time in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import paragraphs, sentences, strip
from siftwell.session import ship

HEADING = r"^(#{1,6})\s+(.*)$"
TARGET, HARD_MAX, CUT_AT = 1100, 2200, 1600


def windows(text: Column, size: int, overlap: int) -> Column:
    """Array of windows of ``size`` characters that overlap, stripped, empty ones left out."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / F.lit(float(step)))).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda k: k * step)
    return F.filter(F.transform(starts, lambda s: strip(F.substr(text, s + 1, F.lit(size)))), lambda c: c != "")


def pack(parts: Column, size: int, overlap: int) -> Column:
    """Greedy packing of parts, joined by a blank line, into chunks of at most ``size`` characters; a longer part is cut into windows
    and ends the chunk before it."""
    none = F.expr("cast(array() as array<string>)")
    start = F.struct(none.alias("done"), F.lit("").alias("buf"))

    def add(acc: Column, part: Column) -> Column:
        joined = F.when(acc["buf"] == "", part).otherwise(F.concat(acc["buf"], F.lit("\n\n"), part))
        flushed = F.when(acc["buf"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["buf"])))
        return (
            F.when(F.length(joined) <= size, F.struct(acc["done"].alias("done"), joined.alias("buf")))
            .when(F.length(part) <= size, F.struct(flushed.alias("done"), part.alias("buf")))
            .otherwise(F.struct(F.concat(flushed, windows(part, size, overlap)).alias("done"), F.lit("").alias("buf")))
        )

    return F.aggregate(parts, start, add, lambda acc: F.when(acc["buf"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["buf"]))))


def chunk_texts(text: Column, strategy: str, size: int = 800, overlap: int = 120) -> Column:
    """Array of chunk texts of a stripped text by strategy ``fixed``, ``paragraph`` or ``sentence``. Give it a column, not an expression: the
    windows refer to it again and again."""
    if strategy == "fixed":
        return windows(text, size, overlap)
    if strategy == "paragraph":
        return pack(paragraphs(text), size, overlap)
    if strategy == "sentence":
        return pack(sentences(text), size, overlap)
    raise ValueError(f"no chunking strategy {strategy!r}")


def chunk_documents(docs: DataFrame, strategy: str = "fixed", size: int = 800, overlap: int = 120, headings: bool = False) -> DataFrame:
    """``docs(doc_path, text)`` -> chunk rows. With ``headings`` each chunk gets the last heading at or before the place where its first
    40 characters are first found from the previous chunk's place on."""
    whole = docs.filter("text is not null").withColumn("_text", strip(F.col("text")))
    pieces = whole.withColumn("_parts", chunk_texts(F.col("_text"), strategy, size, overlap))
    if headings:
        return _under_headings(pieces.select("doc_path", "text", "_parts"))
    rows = pieces.select("doc_path", F.posexplode_outer("_parts").alias("chunk_index", "content")).filter("content is not null")  # the inner form computes the parts twice, for a filter on their number
    return rows.select(F.concat_ws("#", "doc_path", "chunk_index").alias("chunk_id"), "doc_path", "chunk_index", "content", F.lit("").alias("heading"))


def heading_positions(text: str) -> list[tuple[int, str]]:
    """(character position from 0, title) of a text's Markdown headings, in order."""
    out, at = [], 0
    for line in text.split("\n"):
        if line.startswith("#") and (found := _HEAD.match(line)):
            out.append((at, found[2].strip()))
        at += len(line) + 1
    return out


def headings_of(text: str, parts: list[str]) -> list[str]:
    """The heading of each part: places of parts and of headings both ascend, so they are merged in one pass. A part that is not found has none."""
    heads, out = heading_positions(text), []
    start = h = 0
    for part in parts:
        at = text.find(part[:40], start)
        if at >= 0:
            start = at
            while h < len(heads) and heads[h][0] <= at:
                h += 1
        out.append(heads[h - 1][1] if at >= 0 and h else "")
    return out


def _under_headings(pieces: DataFrame) -> DataFrame:
    """Chunk rows of ``pieces(doc_path, text, parts)``. Where a part is found hangs on where the one before it was, and a fold of built-in functions would copy its array for
    each of them, so a document's parts are placed in Arrow batches, in time that grows with the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f"{path}#{i}", path, i, part, head) for path, text, parts in batch.itertuples(index=False) for i, (part, head) in enumerate(zip(parts, headings_of(text, list(parts)), strict=True))]
            yield pd.DataFrame(rows, columns=["chunk_id", "doc_path", "chunk_index", "content", "heading"])

    ship(pieces.sparkSession)
    return pieces.select(F.col("doc_path").cast("string"), "text", "_parts").mapInPandas(run, CHUNK)


def nearest_heading(chunks: DataFrame, headings: DataFrame) -> DataFrame:
    """Backward as-of join within a document: ``chunks(doc_path, chunk_id, pos)`` and ``headings(doc_path, pos, heading)`` -> chunks with
    the last heading at or before them, the empty text if there is none. One window over the union, so a document's rows are sorted
    once and no pair is made."""
    marks = headings.select("doc_path", "pos", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("chunk_id"), "heading")
    rows = marks.unionByName(chunks.select("doc_path", "pos", F.lit(1).alias("kind"), "chunk_id", F.lit(None).cast("string").alias("heading")))
    order = Window.partitionBy("doc_path").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("heading", F.coalesce(F.last("heading", ignorenulls=True).over(order), F.lit(""))).filter("kind = 1").select("doc_path", "chunk_id", "pos", "heading")


def lines_of(docs: DataFrame) -> DataFrame:
    """``docs(doc_path, text)`` -> (doc_path, line_no from 0, line, in_fence): in_fence holds on lines within a code fence and on the
    line that opens it, not on the one that closes it."""
    rows = docs.select("doc_path", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    order = Window.partitionBy("doc_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.ltrim("line").startswith("```"), 1).otherwise(0)
    return rows.withColumn("in_fence", F.sum(mark).over(order) % 2 == 1)


def sections(docs: DataFrame, deepest: int = 3) -> DataFrame:
    """(doc_path, section_no, heading, body): runs of lines from one heading of level 1 to ``deepest`` outside fences to the next."""
    rows = lines_of(docs)
    is_heading = ~F.col("in_fence") & F.col("line").rlike(rf"^#{{1,{deepest}}}\s+.*$")
    order = Window.partitionBy("doc_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_h", is_heading).withColumn("section_no", F.sum(F.col("_h").cast("int")).over(order))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    heading = F.max(F.when(F.col("_h"), F.trim(F.regexp_extract("line", HEADING, 2))))
    out = rows.groupBy("doc_path", "section_no").agg(F.coalesce(heading, F.lit("")).alias("heading"), strip(body).alias("body"))
    return out.filter("body <> ''")


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_path, block_no from 0, block): paragraphs and whole code fences."""
    rows = lines_of(docs)
    order = Window.partitionBy("doc_path").orderBy("line_no")
    mark = F.ltrim("line").startswith("```")
    blank = ~F.col("in_fence") & ~mark & (F.trim("line") == "")
    rows = rows.withColumns({"_mark": mark, "_blank": blank, "_open": mark & F.col("in_fence")})
    before = lambda c: F.lag(c, 1).over(order)
    begins = ~F.col("_blank") & (F.col("_open") | before("_blank") | (before("_mark") & ~before("in_fence")) | before("line").isNull())
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_b", F.coalesce(begins, F.lit(False))).filter("not _blank").withColumn("block_no", F.sum(F.col("_b").cast("int")).over(upto) - 1)
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("doc_path", "block_no").agg(block.alias("block")).filter(strip(F.col("block")) != "")


# ------------------------------------------------------------------------------------------------ heading-aware chunks

_HEAD = re.compile(HEADING)


def _fences(lines: list[str]) -> Iterator[tuple[str, bool, bool]]:
    """(line, whether it opens or closes a fence, whether it is inside one or a mark of one)."""
    inside = False
    for line in lines:
        mark = line.lstrip().startswith("```")
        yield line, mark, inside or mark
        inside ^= mark


def markdown_chunks(text: str, target: int = TARGET, hard_max: int = HARD_MAX, cap: bool = True) -> list[tuple[str, str]]:
    """(content, heading) of a Markdown text's chunks: sections at headings of levels 1 to 3, their paragraphs and fences packed to
    ``target`` characters under the section's heading, a block over ``hard_max`` alone; then neighbours are joined while they fit in
    ``target``, and with ``cap`` what is still longer than ``hard_max`` is cut at line ends from CUT_AT characters on, outside fences."""
    parts: list[str] = []
    for heading, body in _sections(text):
        prefix, buf = (f"## {heading}\n" if heading else ""), ""
        for block in _blocks(body):
            if buf and len(buf) + 2 + len(block) > target:
                parts.append((prefix + buf).strip())
                buf = ""
            buf = f"{buf}\n\n{block}".strip() if buf else block
            if len(buf) > hard_max:
                parts.append((prefix + buf).strip())
                buf = ""
        if buf.strip():
            parts.append((prefix + buf).strip())
    joined: list[str] = []
    for part in parts:
        if joined and len(joined[-1]) + 2 + len(part) <= target:
            joined[-1] += "\n\n" + part
        else:
            joined.append(part)
    out = [c for part in joined for c in (_cut(part) if cap and len(part) > hard_max else [part])]
    heads = [_HEAD.match(c.lstrip().split("\n", 1)[0]) for c in out]
    return [(c.strip(), m[2].strip() if m else "") for c, m in zip(out, heads, strict=True)]


def _sections(text: str) -> list[tuple[str, str]]:
    out: list[tuple[str, list[str]]] = [("", [])]
    for line, _, fenced in _fences(text.split("\n")):
        m = None if fenced else _HEAD.match(line)
        if m and len(m[1]) <= 3:
            out.append((m[2].strip(), []))
        out[-1][1].append(line)
    return [(h, b) for h, lines in out if (b := "\n".join(lines).strip())]


def _blocks(body: str) -> list[str]:
    out: list[list[str]] = [[]]
    was_fenced = False
    for line, mark, fenced in _fences(body.split("\n")):
        opens = mark and not was_fenced
        if opens or (not fenced and not line.strip()):
            out.append([])
        if fenced or line.strip():
            out[-1].append(line)
        if mark and was_fenced:
            out.append([])
        was_fenced = fenced and not (mark and was_fenced)
    return [b for lines in out if (b := "\n".join(lines)).strip()]


def _cut(content: str) -> list[str]:
    out, size = [[]], 0
    for line, mark, fenced in _fences(content.split("\n")):
        out[-1].append(line)
        size += len(line) + 1
        if size - 1 >= CUT_AT and (not fenced or mark and len(out[-1]) > 1):
            out.append([])
            size = 0
    return ["\n".join(lines) for lines in out if lines]


CHUNK = "chunk_id string, doc_path string, chunk_index int, content string, heading string"


def chunk_markdown(docs: DataFrame, target: int = TARGET, hard_max: int = HARD_MAX) -> DataFrame:
    """``docs(doc_path, text)`` -> chunk rows, a document at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f"{path}#{i}", path, i, c, h) for path, text in zip(batch["doc_path"], batch["text"], strict=True) if text for i, (c, h) in enumerate(markdown_chunks(text, target, hard_max))]
            yield pd.DataFrame(rows, columns=["chunk_id", "doc_path", "chunk_index", "content", "heading"])

    ship(docs.sparkSession)
    return docs.select("doc_path", "text").mapInPandas(run, CHUNK)


def corpus_stats(chunks: DataFrame, tiny: int = 60, stub: str = "code example:") -> DataFrame:
    """One row: n_chunks, median_chars, max_chars, tiny_chunks, stub_chunks, n_docs."""
    n = F.length("content")
    return chunks.agg(
        F.count("*").alias("n_chunks"), F.median(n).cast("double").alias("median_chars"), F.max(n).cast("long").alias("max_chars"), F.count_if(n < tiny).alias("tiny_chunks"),
        F.count_if(F.contains("content", F.lit(stub))).alias("stub_chunks"), F.countDistinct("doc_path").alias("n_docs"),
    )
