"""Licence statements by a trained paragraph classifier, scored with DataFrame functions alone.

Paragraphs lie between blank lines. Where a text has none, or a block's lines are too long or too complete to be wrapped ones, each line is
a paragraph. A sparse multinomial logistic regression over the paragraph's distinct words and pairs of words tells the licence families
apart; two more classes are ``unknown`` (a licence of no known family) and ``none`` (no statement, whatever it mentions). Probabilities are
calibrated: a temperature and the offsets of these two classes are fitted on folds that leave out whole families, which must then be
unknown, and whole frames of statements. A family is only given when its probability reaches ``least`` and a template confirms it: a name of
the family, or one of its licences' texts, of which the paragraph has ``cover`` of the words, or which has them of the paragraph.

Training is on the driver, on a few thousand sentences made from the fixed values in ``licence_texts``: the model's size does not depend on
the data. Most paragraphs are told to be ``none`` by a bound: words are looked up in sets by the most that they can speak for a licence,
and where the sum of these bounds cannot outweigh the bias, no class but ``none`` can come out. Only the rest are scored.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.licence_texts import FRAMES, FUNCTION, MENTIONS, NAMES, PLAIN, TEXTS, UNHEARD

UNKNOWN, NONE = "unknown", "none"
FAMILIES = tuple(sorted({*NAMES, *TEXTS}))
CLASSES = (*FAMILIES, UNKNOWN, NONE)
LEAST, COVER = 0.5, 0.6
#: Characters of a line from which it is not a wrapped one.
WRAP = 120
#: How much more ``unknown`` and ``none`` weigh in the fit than a family.
MANY = 5.0
#: Words of a paragraph from which a text can confirm it by holding it.
FRAGMENT = 6
FOLDS = 3
#: Weights under this are dropped, features seen once too.
SPARSE = 0.03
#: Upper ends of the classes by which words are bounded.
LEVELS = (0.25, 0.5, 1.0, 2.0, 4.0, math.inf)
_WORD = "[a-z0-9]+"
_BLANKS = r"[ \t\r\f\x0B]"


def _words(text: str) -> list[str]:
    return re.findall(_WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def _grams(words: list[str]) -> set[str]:
    """Distinct words and pairs of words, but for those of function words alone."""
    return {w for w in words if w not in FUNCTION} | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a not in FUNCTION or b not in FUNCTION}


@dataclass(frozen=True)
class Row:
    """A training sentence: its class, the family it is of (or None) and the number of its frame."""

    label: str
    text: str
    family: str | None
    frame: int


def invented(count: int = 48) -> list[str]:
    """Names of licences that there are not: what a statement says without a name that is known."""
    rng = random.Random(5)
    syllables = "ka lo mir ten vu sha bre dol fi gan hex jo pru qua rit sol tam wen yor zil".split()
    tails = ("License", "Licence", "Public License", "License, version 2", "License 1.0", "", "2.0", "Software License", "Agreement")
    return [f"{''.join(rng.choice(syllables) for _ in range(rng.randrange(2, 4))).capitalize()} {tails[k % len(tails)]}".strip() for k in range(count)]


def sentences() -> list[Row]:
    """All training sentences. Texts come whole and in pieces, as they are found where they are wrapped; empty ones stand for paragraphs without
    a word that the model knows."""
    rows = [Row(c, f.format(n), c, k) for c, names in NAMES.items() for n in names for k, f in enumerate(FRAMES)]
    rows += [Row(UNKNOWN, f.format(n), None, k) for n in (*UNHEARD, *invented()) for k, f in enumerate(FRAMES[1:], 1)]
    rows += [Row(NONE, "", None, k) for k in range(200)]
    rows += [Row(NONE, w, None, k) for k, s in enumerate(PLAIN) for w in s.split()[::2]]
    rows += [Row(NONE, f.format(names[k % len(names)]), None, k) for names in [*NAMES.values(), UNHEARD] for k, f in enumerate(MENTIONS)]
    rows += [Row(NONE, s, None, k) for k, s in enumerate(PLAIN) for _ in range(4)]
    rows += [Row(NONE, f"{a} {b}", None, k) for k, (a, b) in enumerate(zip(PLAIN, PLAIN[7:] + PLAIN[:7], strict=True))]
    for c, texts in TEXTS.items():
        k = 0
        for t in texts:
            words = t.split()
            pieces = [t] * 4 + [" ".join(words[i : i + 14]) for i in range(0, len(words), 7) if len(words[i : i + 14]) >= 8 and len(words) > 20]
            for p in pieces:
                rows.append(Row(c, p, c, k))
                k += 1
        if c != "proprietary":
            rows.append(Row(c, " ".join(texts), c, k))
    return rows


@dataclass(frozen=True)
class Model:
    features: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def odds(self, texts: list[str]) -> np.ndarray:
        """Log-odds of the classes, calibrated."""
        out = np.tile(self.bias, (len(texts), 1))
        for r, t in enumerate(texts):
            at = [self.features[g] for g in sorted(_grams(_words(t))) if g in self.features]
            out[r] += self.weights[at].sum(0)
        return out / self.temperature


def _fit(rows: list[Row], steps: int = 160, l2: float = 2e-4) -> Model:
    grams = [_grams(_words(r.text)) for r in rows]
    seen: dict[str, int] = {}
    for s in grams:
        for g in s:
            seen[g] = seen.get(g, 0) + 1
    number = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n > 1))}
    x = np.zeros((len(rows), len(number)), np.float32)
    for r, s in enumerate(grams):
        x[r, [number[g] for g in s if g in number]] = 1
    y = np.zeros((len(rows), len(CLASSES)), np.float32)
    y[np.arange(len(rows)), [CLASSES.index(r.label) for r in rows]] = 1
    # Classes weigh alike, but for the two that stand for many.
    share = np.array([MANY if c in (UNKNOWN, NONE) else 1.0 for c in CLASSES]) / np.maximum(y.sum(0), 1)
    each = (y * share).sum(1, keepdims=True).astype(np.float32)
    each /= each.sum()
    w, b = np.zeros((len(number), len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - y) * each
        g, gb = x.T @ error + l2 * w, error.sum(0)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 * min(1.0, 2 * (1 - t / (steps + 1)))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-7)
    kept = np.flatnonzero(np.abs(w).max(1) >= SPARSE)
    names = list(number)
    return Model({names[i]: k for k, i in enumerate(kept)}, w[kept].astype(np.float64).round(4), b.astype(np.float64).round(4), 1.0)


def left_out(rows: list[Row], fold: int) -> list[tuple[Row, str]]:
    """The rows that a fold keeps from its fit, with the class that they should get: all of a third of the families, which are then unknown,
    and a third of the frames of the rest."""
    away = set(FAMILIES[fold::FOLDS])
    return [(r, UNKNOWN if r.family in away else r.label) for r in rows if r.family in away or r.frame % FOLDS == fold]


def out_of_fold() -> tuple[np.ndarray, np.ndarray]:
    """(log-odds, number of the right class) of all rows that some fold left out, by that fold's fit."""
    rows, odds, right = sentences(), [], []
    for fold in range(FOLDS):
        out = left_out(rows, fold)
        ids = {id(r) for r, _ in out}
        odds.append(_fit([r for r in rows if id(r) not in ids]).odds([r.text for r, _ in out]))
        right += [CLASSES.index(c) for _, c in out]
    return np.concatenate(odds), np.array(right)


def calibrated(odds: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """(temperature, offset of unknown) of the least mean log loss."""
    best, found, u = math.inf, (1.0, 0.0), CLASSES.index(UNKNOWN)
    for t in (0.75, 1.0, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0):
        for a in np.arange(-2, 2.01, 0.25):
            z = odds.copy()
            z[:, u] += a
            z = z / t - (z / t).max(1, keepdims=True)
            loss = float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), right]).mean())
            if loss < best:
                best, found = loss, (t, float(a))
    return found


@cache
def train() -> Model:
    """The calibrated classifier, fitted on all sentences."""
    temperature, unknown = calibrated(*out_of_fold())
    model = _fit(sentences())
    bias = model.bias.copy()
    bias[CLASSES.index(UNKNOWN)] += unknown
    if not bias.argmax() == CLASSES.index(NONE):
        raise ValueError("a paragraph without a known word must be none")
    return Model(model.features, model.weights, bias, temperature)


@cache
def templates() -> list[tuple[str, list[str], bool]]:
    """(family, distinct words, whether it is a text) of every name and text."""
    return [(c, sorted(set(_words(n))), False) for c, ns in NAMES.items() for n in ns] + [(c, sorted(set(_words(t))), True) for c, ts in TEXTS.items() for t in ts]


def levels(model: Model) -> tuple[float, list[tuple[float, list[str]]]]:
    """How far the bias of ``none`` lies over the others', and single words by the most that one occurrence can speak for another class: by
    itself, and by the best of the pairs that are counted with it (a pair with its first word that is not a function word)."""
    none = CLASSES.index(NONE)
    others = [k for k in range(len(CLASSES)) if k != none]
    gain = np.maximum((model.weights[:, others] - model.weights[:, [none]]).max(1), 0)
    gap = float(model.bias[none] - model.bias[others].max())
    alone: dict[str, float] = {}
    paired: dict[str, float] = {}
    for f, i in model.features.items():
        words = f.split(" ")
        if len(words) == 1:
            alone[f] = float(gain[i])
        else:
            w = words[0] if words[0] not in FUNCTION else words[1]
            paired[w] = max(paired.get(w, 0.0), float(gain[i]))
    # A word stands in two pairs; both may be counted with it, if what comes before it is a function word.
    most = {w: alone.get(w, 0.0) + 2 * paired.get(w, 0.0) for w in alone.keys() | paired.keys()}
    out, low = [], 0.0
    for high in LEVELS:
        words = sorted(w for w, x in most.items() if low < x <= high)
        if words:
            out.append((max(most[w] for w in words), words))
        low = high
    return gap, out


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def paragraphs(text: Column) -> Column:
    """A text's paragraphs, those of white space too. A block between blank lines is one if it has several lines of which none is over WRAP
    characters and fewer than half (without the last) end a sentence."""
    ends = lambda b: F.regexp_count(b, F.lit(rf"[.!?][\"')\]]*{_BLANKS}*\n"))
    one = lambda b: ~b.rlike(rf"[^\n]{{{WRAP + 1}}}") & (2 * ends(b) < F.regexp_count(b, F.lit("\n")))
    blocks = F.split(text, rf"\n(?:{_BLANKS}*\n)+")
    return F.when(text.rlike(rf"\n{_BLANKS}*\n"), F.flatten(F.transform(blocks, lambda b: F.when(one(b), F.array(b)).otherwise(F.split(b, "\n"))))).otherwise(F.split(text, "\n"))


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def statements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: float = LEAST, cover: float = COVER) -> DataFrame:
    """(row, id, line int from 0, paragraph, family, probability, template) for each paragraph that is a statement; ``line`` is the paragraph's
    number, ``row`` a hash of id and text, so that documents that share an id, or have none, stay apart."""
    spark = docs.sparkSession
    model = train()
    gap, bounds = levels(model)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    some = source.filter("text is not null").withColumn("row", F.xxhash64("id", "text")).select("id", "row", F.posexplode(paragraphs(F.col("text"))).alias("line", "paragraph"))
    some = some.withColumn("words", F.regexp_extract_all(_lower(F.col("paragraph")), F.lit(_WORD), F.lit(0)))
    # The bound: a word counts the most that its level allows.
    every = [w for _, words in bounds for w in words]
    some = some.withColumn("speaking", F.expr(f"filter(words, g -> g in ({_in(every)}))")).filter(F.size("speaking") > 0)
    most = " + ".join(f"{high!r}D * size(filter(speaking, g -> g in ({_in(words)})))" for high, words in bounds)
    some = some.filter(F.expr(f"{most} > {gap!r}D")).select("row", "id", "line", "paragraph", "words").dropDuplicates(["row", "line"])
    pairs = F.expr("zip_with(words, slice(words, 2, size(words)), (a, b) -> if(b is null, a, concat(a, ' ', b)))")
    some = some.withColumn("grams", F.array_distinct(F.concat("words", pairs)))
    key = ["row", "line"]
    table = spark.createDataFrame([(g, [float(x) for x in model.weights[i]]) for g, i in model.features.items()], "gram string, w array<double>")
    grams = some.select(*key, F.explode("grams").alias("gram"))
    scores = grams.join(F.broadcast(table), "gram").groupBy(*key).agg(*[F.sum(F.col("w")[k]).alias(f"z{k}") for k in range(len(CLASSES))])
    z = [(F.col(f"z{k}") + float(model.bias[k])) / model.temperature for k in range(len(CLASSES))]
    total = sum((F.exp(c - F.col("top")) for c in z[1:]), F.exp(z[0] - F.col("top")))
    name = F.coalesce(*[F.when(c == F.col("top"), F.lit(n)) for c, n in zip(z, CLASSES, strict=True)])
    told = scores.withColumn("top", F.greatest(*z)).select(*key, name.alias("said"), (1 / total).alias("probability")).filter(F.col("said") != NONE)
    known = spark.createDataFrame(templates(), "said string, template array<string>, whole boolean")
    both, own = F.size(F.array_intersect("words", "template")), F.size(F.array_distinct("words"))
    part = both / F.size("template")
    part = F.when(F.col("whole") & (own >= FRAGMENT), F.greatest(part, both / own)).otherwise(part)
    checked = told.join(some.drop("grams"), key).join(F.broadcast(known), "said", "left").groupBy(*key, "id", "paragraph", "said", "probability").agg(F.max(F.struct(part.alias("cover"), F.array_join("template", " ").alias("template"))).alias("best"))
    sure = (F.col("said") != UNKNOWN) & (F.col("probability") >= least) & (F.col("best.cover") >= cover)
    return checked.select("row", "id", "line", "paragraph", F.when(sure, F.col("said")).otherwise(F.lit(UNKNOWN)).alias("family"), F.round("probability", 6).alias("probability"), F.when(sure, F.col("best.template")).alias("template"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, n_paragraphs long, n_licence long, n_unknown long, families array<string>), one row per row of ``docs``.

    n_paragraphs counts paragraphs that are not blank; families are distinct and sorted, without ``unknown``. Null and empty texts have no
    paragraphs. A null id keeps its row; rows equal in id and text get the same result. Only the named columns are read. An empty table
    gives no rows. Texts are read whole; a paragraph's words are in memory at once, some 100 bytes for each.
    """
    found = statements(docs, id_col, text_col, **options)
    by = found.groupBy("row").agg(F.count("*").alias("n_licence"), F.count_if(F.col("family") == UNKNOWN).alias("n_unknown"), F.array_sort(F.collect_set(F.when(F.col("family") != UNKNOWN, F.col("family")))).alias("families"))
    text = F.col(text_col).cast("string")
    count = F.coalesce(F.size(F.filter(paragraphs(text), lambda p: p.rlike(r"\S"))), F.lit(0)).cast("long")
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("row"), F.when(text.isNull(), F.lit(0).cast("long")).otherwise(count).alias("n_paragraphs"))
    joined = every.join(by, "row", "left")
    zero = F.lit(0).cast("long")
    return joined.select(F.col("id").alias(id_col), "n_paragraphs", F.coalesce("n_licence", zero).alias("n_licence"), F.coalesce("n_unknown", zero).alias("n_unknown"), F.coalesce("families", F.expr("cast(array() as array<string>)")).alias("families"))


def family_of(paragraph: str, least: float = LEAST, cover: float = COVER) -> tuple[str, float]:
    """(family, ``unknown`` or ``none``, probability) of one paragraph in plain Python."""
    odds = train().odds([paragraph])[0]
    k = int(odds.argmax())
    p = 1 / math.fsum(np.exp(odds - odds.max()))
    if CLASSES[k] in (UNKNOWN, NONE):
        return CLASSES[k], p
    own = set(_words(paragraph))
    best = 0.0
    for family, words, whole in templates():
        if family == CLASSES[k]:
            both = len(own & set(words))
            best = max(best, both / len(words), both / len(own) if whole and len(own) >= FRAGMENT else 0.0)
    return (CLASSES[k] if p >= least and best >= cover else UNKNOWN), p
