"""Packing and heading-aware chunks against plain re-derivations."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.operators import chunking as C


def windows(text, size, overlap):
    out, start = [], 0
    while start < len(text):
        if piece := text[start : start + size].strip():
            out.append(piece)
        if start + size >= len(text):
            break
        start += size - overlap
    return out


def packed(parts, size, overlap):
    out, buf = [], ""
    for part in parts:
        joined = f"{buf}\n\n{part}" if buf else part
        if len(joined) <= size:
            buf = joined
        else:
            out += [buf] if buf else []
            buf = part if len(part) <= size else ""
            out += [] if buf else windows(part, size, overlap)
    return out + ([buf] if buf else [])


TEXTS = ["", "   ", "one", "a" * 95, "first para.\n\nsecond one! Third? " + "x" * 50 + "\n \n" + "tail " * 12, " padded text  ", "été à la\n\nmer. " * 9]


def test_strategies_equal_plain_versions(spark):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "doc_path string, text string")
    split = {"fixed": None, "paragraph": r"\n\s*\n", "sentence": r"(?<=[.!?])\s+"}
    for strategy, pattern in split.items():
        found = {}
        for r in C.chunk_documents(docs, strategy, 40, 8).collect():
            found.setdefault(r.doc_path, []).append((r.chunk_index, r.content))
        for i, t in enumerate(TEXTS):
            parts = [p.strip() for p in re.split(pattern, t.strip()) if p.strip()] if pattern else None
            expected = packed(parts, 40, 8) if pattern else windows(t.strip(), 40, 8)
            assert [c for _, c in sorted(found.get(str(i), []))] == expected, (strategy, i)


def test_headings_of_chunks(spark):
    text = "intro words here\n# One\n" + "alpha " * 10 + "\n## Two\n" + "beta " * 10
    rows = C.chunk_documents(spark.createDataFrame([("d", text)], "doc_path string, text string"), "fixed", 40, 5, headings=True).orderBy("chunk_index").collect()
    assert rows[0].heading == ""
    assert rows[-1].heading == "Two"
    assert {r.heading for r in rows} == {"", "One", "Two"}


def test_overlap_must_be_smaller_than_size():
    import pytest

    with pytest.raises(ValueError):
        C.windows(None, 10, 10)


def test_markdown_keeps_fences_and_sections():
    text = "before\n# One\ntext\n\n```py\n# no heading\n\ncode\n```\nafter\n" + "## Two\n" + "word " * 300
    chunks = C.markdown_chunks(text, target=200)
    fence = next(c for c, _ in chunks if "no heading" in c)
    assert fence.count("```") == 2
    assert any(h == "Two" for _, h in chunks)


def test_long_chunks_are_cut_outside_fences():
    body = "\n".join("line %03d of some length to fill the block up" % i for i in range(80))
    for text in (body, f"```\n{body}\n```"):
        chunks = [c for c, _ in C.markdown_chunks(text)]
        assert sum(c.count("line ") for c in chunks) == 80
    assert len(C.markdown_chunks(body)) > 1
    assert len(C.markdown_chunks(f"```\n{body}\n```")) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# h", "text", "", "```", "#### deep", "more words here", "  ```x"]), max_size=25))
def test_markdown_loses_no_words(lines):
    text = "\n".join(lines)
    words = lambda t: sorted(re.findall(r"text|more|words|here|deep", t))
    assert words("\n".join(c for c, _ in C.markdown_chunks(text))) == words(text)
