"""String functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Element names and directives that the cleaners take out. The patterns of ``attributes``, ``clean_mdx`` and ``clean_rst`` below are fixed too: what counts as an
#: attribute, a comment, an import, an object reference, a field or a directive.
JSX_TAGS = "Tabs|TabItem|Note|Warning|details|summary"
RST_DIRECTIVES = "currentmodule|module|automodule|autoclass|autofunction|autodata|autoattribute|toctree|include|seealso|figure|image"


def strip(text: Column) -> Column:
    """White space of any script off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def tokenize(text: Column) -> Column:
    """Runs of ``[a-z0-9_]`` of the lowered text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def word_set(text: Column) -> Column:
    return F.array_distinct(tokenize(text))


def shorten(text: Column, n: int, marker: str = " …") -> Column:
    """The first n characters, with a marker where some are cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(marker))).otherwise(text)


def question_text(title: Column, question: Column, between: str = "\n\n") -> Column:
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit(between), F.coalesce(question, F.lit(""))))


def provenance(path: Column, heading: Column) -> Column:
    return F.concat(path, F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit(" § "), heading)).otherwise(F.lit("")))


def derived_id(tool: Column, number: Column) -> Column:
    return F.concat(tool, F.lit("#"), number.cast("string"))


def short_name(tool: Column) -> Column:
    """The part of a collection's name after its owner (``owner__name``), without a build's suffix; a name without an owner as it is."""
    return F.regexp_replace(F.coalesce(F.try_element_at(F.split(tool, "__"), F.lit(2)), tool), "_(?:mech|wide)$", "")


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, stripped, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Parts after a full stop, exclamation or question mark and white space."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda x: x != "")


def strip_frontmatter(text: Column) -> Column:
    """Without a leading block from ``---`` to the next line that begins so; unclosed blocks stay."""
    end = F.locate("\n---", text, 4)
    return F.when(F.startswith(text, F.lit("---")) & (end > 0), F.substr(text, end + 4)).otherwise(text)


def attributes(tag: Column) -> Column:
    """Map of ``k="v"``, ``k='v'`` and ``k={v}``; of repeated keys the last counts."""
    pattern = r"""(\w+)\s*=\s*(?:"([^"]*)"|'([^']*)'|\{([^}]*)\})"""
    keys = F.regexp_extract_all(tag, F.lit(pattern), F.lit(1))
    values = [F.regexp_extract_all(tag, F.lit(pattern), F.lit(g)) for g in (2, 3, 4)]
    joined = F.transform(F.arrays_zip(*[v.alias(f"v{i}") for i, v in enumerate(values)]), lambda z: F.concat(z["v0"], z["v1"], z["v2"]))
    pairs = F.zip_with(keys, joined, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), p["value"].alias("value"), i.alias("i"))), lambda p: ~F.exists(F.slice(pairs, p["i"] + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))


def clean_mdx(text: Column) -> Column:
    """Prose of an MDX page: front matter, comments, imports and layout tags out; an object reference leaves its name in back-quotes
    (object before module before decorator); long gaps shrink."""
    out = strip_frontmatter(text)
    out = F.regexp_replace(out, r"(?s)\{/\*.*?\*/\}", "")
    out = F.regexp_replace(out, r"""(?m)^import\s+.*?from\s+['"].*?['"];?\s*$""", "")
    named = lambda a: rf"""(?s)<PyObject\b(?=[^>]*?\b{a}\s*=\s*["'{{]([^"'}}]+)["'}}])[^>]*?/>"""
    for a in ("object", "module", "decorator"):
        out = F.regexp_replace(out, named(a), "`$1`")
    out = F.regexp_replace(out, r"(?s)<PyObject\b[^>]*?/>", "``")
    out = F.regexp_replace(out, rf"(?i)<(?:{JSX_TAGS})\b[^>]*>", "")
    out = F.regexp_replace(out, rf"(?i)</(?:{JSX_TAGS})>", "")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def clean_rst(text: Column) -> Column:
    """Prose of a reStructuredText page: field and layout directive lines out, long gaps shrink."""
    out = F.regexp_replace(text, r"(?m)^:(\w[\w-]*):.*$", "")
    out = F.regexp_replace(out, rf"(?m)^\.\. (?:{RST_DIRECTIVES})::.*$", "")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def clean_markup(html: Column) -> Column:
    """Text of HTML: scripts, styles, comments and tags out, white space to single blanks."""
    out = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(out, r"[ \t\n\r]+", " "))


def in_paths(path: Column, prefixes: list[str], suffixes: list[str], skip_parts: tuple[str, ...] = ("tests", "test", "_tests")) -> Column:
    """A suffix and a prefix of the lists, and no part that is skipped."""
    some = lambda options, test: F.coalesce(*[F.when(test(F.lit(o)), True) for o in options], F.lit(False))
    clean = ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in skip_parts]))
    return some(suffixes, lambda o: F.endswith(path, o)) & some(prefixes, lambda o: F.startswith(path, o)) & clean


def content_hash(rows: DataFrame, group: str, key: str, text: str, block: int = 4096) -> DataFrame:
    """(group, content_hash): the first 12 digits of a sha256 over each group's texts in the order of a whole-numbered key. Texts are hashed
    first, then what falls into one ``block`` of keys, then the blocks: a task sees digests, of one block or of one group's blocks."""

    def folded(order: str, digest: str) -> Column:
        parts = F.transform(F.array_sort(F.collect_list(F.struct(order, digest))), lambda x: x[digest])
        return F.sha2(F.array_join(parts, "").cast("binary"), 256)

    texts = rows.select(group, key, F.expr(f"`{key}` div {block}").alias("_block"), F.sha2(F.col(text).cast("binary"), 256).alias("_h"))
    blocks = texts.groupBy(group, "_block").agg(folded(key, "_h").alias("_h"))
    return blocks.groupBy(group).agg(F.substring(folded("_block", "_h"), 1, 12).alias("content_hash"))
