"""Main text of web pages by tag-path ratios.

Text nodes are grouped by their root-to-leaf tag path (tags with class and id). A path's text ratio is its characters outside links per
node and its punctuation ratio its punctuation marks per node. Both are smoothed over neighbouring nodes in page order with a Gaussian
and fused into one score. The score of a path is fused in turn with that of the part that it lies in: a path of an article (the nearest <article>, <main> or the like),
or of the element that holds paragraphs of content, scores what the best of these scores, by its share of text outside links. A prior
lowers the score of paths through elements whose class or id names a menu, header, footer, sidebar, notice, advert or reader comment; in an article it is mild
for names that may as well be about the subject (related, cookie, skip).

Paths that score SHARE of the mean (weighted by text) or more are content. Outside an article a path that only its neighbours lift is not, but
for headings and, on pages without an article, sentences. Parts are left out before any score only by their element, role or because they are
hidden.

A page is parsed alone, so the operator is one pass without a shuffle; time is linear in the page's length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import in_arrow

#: Elements of HTML by how they take part.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style title textarea noscript iframe template xmp noembed noframes svg object canvas select".split()
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head nav footer aside form button dialog menu fieldset label datalist option audio video map".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Elements that stand in the middle of a sentence where they are within a block of text, and are controls elsewhere.
CONTROLS = frozenset(("button", "label"))
TEXTUAL = frozenset("p li dd dt td th h1 h2 h3 h4 h5 h6 figcaption caption blockquote pre summary".split())
#: The source of a formula, which its marks say already.
FORMULA_SOURCE = frozenset(("annotation", "annotation-xml"))
#: Parts of lists, tables and figures, which belong to what these stand in.
NESTED = frozenset("li ul ol dl dt dd table tbody thead tfoot tr td th caption figure figcaption blockquote pre p h1 h2 h3 h4 h5 h6".split())
#: A start tag closes an open element of these, up to the scope that ends the search.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Parts of class names and ids that name something beside the main text, if no part of the name is about something else.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner banners adsense adslot menu menus nav navbar navigation breadcrumb breadcrumbs "
    "sidebar sidebars sidenav footer foot copyright colophon masthead topbar comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices popup "
    "modal overlay newsletter subscribe subscription signup social share sharing related recommended recommendations outbrain taboola login pagination pager toolbar skip".split()
)
#: Of these, names that by themselves may be about the subject of an article that they stand in.
WEAK = frozenset("skip related recommended recommendations cookie cookies".split())
#: Parts that leave the rest of a name what it is: ``comment-list``, but not ``social-science``.
PLAIN = frozenset(
    "list lists box wrapper wrap container block blocks section area inner outer widget widgets bar top bottom left right item items link links button buttons group row col column main primary secondary "
    "site page post posts article articles form unit slot zone panel module content text body holder global user reader the by of to and in me this media icons stories story reading thread respond title".split()
)
HEADERS = frozenset(("header", "head"))
#: Names that count on an <article> itself.
ASIDE = frozenset("ad ads advert advertisement promo sponsored comment comments reply replies related".split())
#: Parts that say a name is about something else: ``has-sidebar`` is not a sidebar.
ABOUT = frozenset(("has", "with", "no", "without", "free"))

_ATTRS = r"""(?:[^<>"']|"[^"]*"|'[^']*')*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<({'|'.join(RAW)})(?=[\s/>]){_ATTRS}>(?:.*?</\1(?=[\s/>])[^>]*+(?:>|\Z)|.*)|<(/?)([a-zA-Z][^\s/<>]*+)({_ATTRS})>", re.S | re.I)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+))?""")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
_SOME = re.compile(r"(?i)\b(?:class|id|role|hidden|aria-hidden|style|itemprop)\b")

SHARE, OWN = 0.1, 0.15
#: What the score of a path through a named part is multiplied by, and through one of a weak name in an article.
PRIOR, WEAK_PRIOR = 0.02, 0.3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements under which blocks of different parts of a page meet.
PAGE = frozenset(("", "html", "body"))


class Node:
    """A tag path: ``drop`` for parts that are left out, ``explicit`` for an element that names the main text, ``article`` the nearest
    such path from here up, ``prior`` for the names along the path."""

    __slots__ = ("parent", "tag", "drop", "explicit", "article", "prior", "depth", "children")

    def __init__(self, parent: Node | None, tag: str, drop: bool, explicit: bool, prior: float):
        self.parent, self.tag, self.drop, self.explicit = parent, tag, drop, explicit
        self.article: Node | None = self if explicit else parent.article if parent else None
        self.prior = min(prior, parent.prior) if parent else prior
        self.depth = parent.depth + 1 if parent else 0
        self.children: dict[str, Node] = {}


def _named(value: str, names: frozenset[str]) -> bool:
    """Whether one of the names of a class or id is about something in ``names`` and nothing else."""
    for name in value.split():
        parts = {p.lower() for p in _PART.findall(name)}
        if parts & names and parts <= names | PLAIN | NAMES:
            return True
    return False


def _judge(tag: str, attrs: str, within: Node) -> tuple[str, bool, bool, float]:
    """A path's label for an element, whether its element, role or state leaves it out, whether it holds the main text by what it is, and
    the prior that its class and id give it."""
    drop, prior = tag in DROPPED or tag in FORMULA_SOURCE, 1.0
    explicit = tag in ("article", "main")
    label = tag
    if attrs and _SOME.search(attrs):
        known = {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(attrs)}
        names = f"{known.get('class', '')} {known.get('id', '')}"
        label = f"{tag}.{known.get('class', '')}#{known.get('id', '')}"
        role = known.get("role", "").lower()
        explicit |= role == "main" or known.get("itemprop", "") == "articleBody"
        drop |= role in ROLES or "hidden" in known or known.get("aria-hidden") == "true" or "display:none" in known.get("style", "").replace(" ", "").lower()
        if tag == "article":
            prior = PRIOR if _named(names, ASIDE) else 1.0
            explicit &= prior == 1.0
        elif tag not in ("html", "body", "main"):
            if within.article is not None:
                others = " ".join(x for x in names.split() if x.lower() not in WEAK)
                prior = PRIOR if _named(others, NAMES) else WEAK_PRIOR if _named(names, WEAK) else 1.0
            elif _named(names, NAMES) or _named(names, HEADERS):
                prior = PRIOR
    if tag == "header" and within.article is None:
        drop = True
    return label, drop, explicit, prior


def blocks(page: str) -> list[tuple[Node, str, int]]:
    """(path, text, characters within links) of each block of text, in page order; text of dropped parts is left out."""
    root = Node(None, "", False, False, 1.0)
    stack: list[tuple[str, Node, bool]] = [("", root, False)]
    open_: Counter[str] = Counter()
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    linked = 0
    links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((stack[-1][1], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1][1].drop:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

    def pop_to(k: int) -> None:
        nonlocal links
        if any(not x[2] for x in stack[k:]):
            flush()
        for tag, _, _ in stack[k:]:
            open_[tag] -= 1
            links -= tag == "a"
        del stack[k:]

    def close(tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        if any(open_[t] for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in tags:
                    return pop_to(k)
                if stack[k][0] in scope:
                    return

    last = 0
    for m in _TOKEN.finditer(page):
        add(page[last : m.start()])
        last = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                flush() if m[1].lower() in ("textarea", "iframe", "object", "noscript") else None
            elif m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:-3]))
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "br":
                flush()
            elif open_[tag]:
                k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag)
                pop_to(k)
            elif tag not in INLINE:
                flush()
            continue
        if tag in VOID:
            if tag not in ("img", "wbr", "input"):
                flush()
            continue
        if tag in CLOSES_P:
            close(("p",), ("table", "td", "th", "button", "object"))
        if tag in CLOSES:
            close(*CLOSES[tag])
        here = stack[-1][1]
        label, drop, explicit, prior = _judge(tag, m[4], here)
        if tag in CONTROLS and here.tag in TEXTUAL and not here.drop:
            drop = False
        formula = tag == "math" or bool(open_["math"])
        plain = (tag in INLINE or formula or tag in CONTROLS) and not drop and prior == 1.0
        if plain:
            node = here
        else:
            flush()
            node = here.children.get(label)
            if node is None:
                node = here.children[label] = Node(here, tag, drop or here.drop, explicit, prior)
        if m[4].rstrip().endswith("/") and tag not in INLINE and tag not in CLOSES_P and "-" in tag:
            continue
        stack.append((tag, node, plain))
        open_[tag] += 1
        links += tag == "a"
    add(page[last:])
    flush()
    return out


def _smooth(values: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * np.arange(-1, 2) ** 2)
    return np.convolve(np.pad(values, 1, mode="edge"), kernel / kernel.sum(), "valid")


def scores(which: np.ndarray, chars: np.ndarray, punct: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The score of each path: ``which`` path a node is of, a node's characters outside links and punctuation marks, a path's prior."""
    count = np.bincount(which)
    text_ratio = _smooth((np.bincount(which, chars) / count)[which])
    punct_ratio = _smooth((np.bincount(which, punct) / count)[which])
    return np.bincount(which, text_ratio * (1 + punct_ratio)) / count * prior


def _nearest(n: Node | None, is_one: Callable[[Node], bool], known: dict[int, Node | None]) -> Node | None:
    """The nearest path from here up of which something holds; what is found is kept, so a page of any depth is climbed once."""
    chain = []
    while n is not None and id(n) not in known and not is_one(n):
        chain.append(n)
        n = n.parent
    found = None if n is None else known.get(id(n), n)
    known.update((id(x), found) for x in chain)
    return found


def main_text(page: str | None) -> str:
    """The text of the page's content blocks, in page order, a space between blocks; empty if there is none."""
    found = blocks(page or "")
    if not found:
        return ""
    number: dict[int, int] = {}
    which = np.array([number.setdefault(id(n), len(number)) for n, _, _ in found])
    paths: list[Node] = list({id(n): n for n, _, _ in found}.values())
    size = np.array([len(t) for _, t, _ in found], float)
    chars = size - np.array([k for _, _, k in found], float)
    punct = np.array([len(_PUNCT.findall(t)) for _, t, _ in found], float)
    prior = np.array([n.prior for n in paths])
    score = scores(which, chars, punct, prior)
    count, text = np.bincount(which), np.bincount(which, chars)
    mass = text * prior
    if not mass.sum():
        return ""
    mean = lambda v: (v * mass).sum() / mass.sum()
    least, ratio = SHARE * mean(score), text / count * prior
    own = ratio >= OWN * mean(ratio)
    free = text / np.bincount(which, size)  # the share of a path's text outside links
    heading = np.array([n.tag in HEADINGS for n in paths])
    # What content scores lends its part a score.
    parts: dict[int, float] = {}
    for n, s in zip(paths, np.where((score >= least) & own & ~heading, score, 0.0).tolist(), strict=True):
        part = n.article or n.parent
        if s and part is not None:
            parts[id(part)] = max(parts.get(id(part), 0.0), s)
    article = any(n.article is not None and id(n.article) in parts for n in paths)
    sentence = (np.bincount(which, punct) >= count) & (free >= 0.5) & (not article)
    alone = np.where(own | heading | sentence, score, 0.0)
    holders: dict[int, Node | None] = {}
    outer: dict[int, Node | None] = {}

    def part_of(n: Node) -> Node | None:
        """The part that a path shares with content: its article, else what holds it, or what the list, table or figure stands in that it is of.
        What lies directly under the page is a part for paragraphs, lists and tables only."""
        if n.article is not None:
            return n.article
        at = _nearest(n, lambda x: id(x) in parts, holders)
        if at is not None and at.tag not in PAGE:
            return at
        at = _nearest(n, lambda x: x.tag not in NESTED, outer)
        return at if at is not n else None

    lent = [parts.get(id(part), 0.0) if (part := part_of(n)) is not None else 0.0 for n in paths]
    # In an article links are part of the text, as in lists of it; a weak name is belied by text.
    linked = np.where([n.article is not None and n.prior == 1.0 for n in paths], 1.0, np.where(free >= 0.5, free, 0.0))
    chosen = np.maximum(alone, np.array(lent) * linked * prior) >= least
    return " ".join(t for (_, t, _), c in zip(found, chosen[which].tolist(), strict=True) if c)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text string, n_chars long), one row per row of ``pages``. Null html counts as empty; then, and where a page
    has no content, the text is empty and n_chars 0. Character references are decoded, white space within a block becomes one
    space. Only the named columns are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["id", "url", "text", "n_chars"])

    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = in_arrow(source, run, "id long, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
