"""Toxicity by a counterfactually regularised classifier.

Features are the words of a text and the beginnings of words (3 to 9 bytes), present or absent; the model is a logistic regression over
those that tell the classes apart. Identity terms in the labelled sentences are swapped for others of their group, and training adds
a penalty on the squared change of the score's log-odds between a sentence and its counterfactual, so that mentioning a group is not
evidence by itself.

The model is fitted on a bounded sample of labelled rows, at most ``positives`` and ``negatives`` of them, each of at most
``sample_chars`` characters, taken by a hash of the id. One executor task fits it: the sample is its input, features are counted run by
run, and one row with at most MOST_FEATURES weights comes back (features are those whose share of toxic texts lies LEAST_Z deviations
or more from the sample's, and of more than MOST_FEATURES the clearest). Scoring reads every whole text in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import _ODD, ALNUM, Words, in_arrow, mix, texts

#: Terms of a row may stand for one another.
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("she", "he"), ("her", "his"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrant", "citizen", "refugee"), ("immigrants", "citizens", "refugees"), ("deaf", "blind", "disabled"), ("old", "young"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"), ("juden", "christen", "muslime"), ("juifs", "chrétiens", "musulmans"), ("judíos", "cristianos", "musulmanes"),
)
POSITIVES, NEGATIVES, SAMPLE_CHARS = 4096, 12288, 8000
PREFIXES = range(3, 10)
BUCKETS = 22
MOST_FEATURES = 8192
LEAST_Z = 6.0
LEAST_DOCS = 4
MARGIN = 0.25


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash) of every word and word beginning, with repeats."""
    words = Words(data, bounds, ALNUM)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(words.first))
    size = words.end - words.start
    docs, out = [doc], [mix(words.hash ^ _ODD[60])]
    for n in PREFIXES:
        at = np.flatnonzero(size > n)
        docs.append(doc[at])
        out.append(words.of(words.start[at], words.start[at] + n))
    return np.concatenate(docs), np.concatenate(out)


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float

    @cached_property
    def _seen(self) -> np.ndarray:
        """Buckets of features, made where texts are scored so that it does not travel."""
        seen = np.zeros(1 << BUCKETS, bool)
        seen[self.features >> np.uint64(64 - BUCKETS)] = True
        return seen

    def hits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Distinct (text number, feature number) pairs, as rows."""
        doc, h = features(data, bounds)
        at = np.flatnonzero(self._seen[h >> np.uint64(64 - BUCKETS)])
        if not len(at):
            return np.zeros((0, 2), np.int64)
        doc, h = doc[at], h[at]
        slot = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
        ok = self.features[slot] == h
        pair = np.unique(doc[ok] * len(self.features) + slot[ok])
        return np.stack(np.divmod(pair, len(self.features)), axis=1)

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for i, j, data, bounds in texts(lowered(column)):
            hit = self.hits(data, bounds)
            out[i:j] += np.bincount(hit[:, 0], self.weights[hit[:, 1]], j - i)
        return sigmoid(out)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def swapped(text: str, groups: tuple[tuple[str, ...], ...], shift: int = 1) -> str | None:
    """The text with each identity term replaced by another of its group; None if it holds none."""
    other = {g[i]: g[(i + shift) % len(g)] for g in groups for i in range(len(g)) if g[i] != g[(i + shift) % len(g)]}
    if not other:
        return None
    out = re.sub(r"\w+", lambda m: other.get(m[0], m[0]), text)
    return None if out == text else out


def _class_counts(column: pa.Array, y: np.ndarray, promising: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts): the features of promising buckets, sorted, and in how many texts of either class each occurs."""
    found, counts = np.zeros(0, np.uint64), np.zeros((2, 0), np.int64)
    for i, _, data, bounds in texts(column):
        doc, h = features(data, bounds)
        at = promising[h >> np.uint64(64 - BUCKETS)]
        doc, h = doc[at], h[at]
        order = np.lexsort((doc, h))
        doc, h = doc[order], h[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[first], h[first]
        every, back = np.unique(np.concatenate((found, h)), return_inverse=True)
        new = np.zeros((2, len(every)), np.int64)
        new[:, back[: len(found)]] = counts
        for c in (0, 1):
            new[c] += np.bincount(back[len(found) :][y[i + doc] == c], minlength=len(every))
        found, counts = every, new
    return found, counts


def _pairs(column: pa.Array, model: Model, groups: tuple[tuple[str, ...], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Texts that name a group, next to their counterfactuals: (row, feature, -1 or 1) of the features on either side, and the rows' number."""
    row, col, val, m = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], 0
    for i, j, _, _ in texts(column):
        some = [(t, s) for t in column.slice(i, j - i).to_pylist() if t for s in [swapped(t, groups)] if s is not None]
        for k, sign in ((0, -1.0), (1, 1.0)):
            for a, _, data, bounds in texts(pa.array([q[k] for q in some], pa.string())):
                hit = model.hits(data, bounds)
                row.append(hit[:, 0] + m + a)
                col.append(hit[:, 1])
                val.append(np.full(len(hit), sign))
        m += len(some)
    return np.concatenate(row), np.concatenate(col), np.concatenate(val), m


def fit(table: pa.Table, groups: tuple[tuple[str, ...], ...] = IDENTITY, *, strength: float = 10.0, l2: float = 1e-5, steps: int = 600, classes: tuple[int, int] | None = None) -> Model:
    """``table(text, toxic)`` -> model. ``classes``: rows labelled 0 and 1 that the table is a sample of; scores are for their shares. One
    class only, or no rows: a constant score, the share of toxic rows (0 with none). Texts are read in runs of about a megabyte, so beside
    the table only counts and the features that are kept take memory."""
    column = lowered(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())).fill_null("")
    y = np.asarray(table.column("toxic").to_numpy(), np.float64)
    n, p = len(y), y.sum()
    empty = np.zeros(0, np.uint64)
    if not 0 < p < n:
        return Model(empty, np.zeros(0), 50.0 if n and p == n else -50.0)
    # Document counts of features by class: first in hashed buckets, then of the features of promising buckets.
    counts = np.zeros((2, 1 << BUCKETS), np.int32)
    for i, _, data, bounds in texts(column):
        doc, h = features(data, bounds)
        pair = np.unique((doc.astype(np.uint64) << np.uint64(BUCKETS)) | (h >> np.uint64(64 - BUCKETS)))
        bucket, cls = (pair & np.uint64((1 << BUCKETS) - 1)).astype(np.int64), y[i + (pair >> np.uint64(BUCKETS)).astype(np.int64)]
        for c in (0, 1):
            np.add.at(counts[c], bucket[cls == c], 1)

    def z(b: np.ndarray, a: np.ndarray) -> np.ndarray:
        """How many deviations the toxic texts with a feature lie from their share of all texts with it."""
        rate, m = p / n, a + b
        return np.where(m >= LEAST_DOCS, (a - m * rate) / np.sqrt(np.maximum(m, 1) * rate * (1 - rate)), 0)

    good = np.concatenate([np.abs(z(counts[0][k : k + (1 << 18)], counts[1][k : k + (1 << 18)])) >= LEAST_Z for k in range(0, 1 << BUCKETS, 1 << 18)])
    del counts
    found, by_class = _class_counts(column, y, good)
    exact = np.abs(z(by_class[0], by_class[1]))
    best = np.sort(np.argsort(-exact, kind="stable")[: min(MOST_FEATURES, int((exact >= LEAST_Z).sum()))])
    if not len(best):
        return Model(empty, np.zeros(0), float(np.log(p / (n - p))))
    model = Model(found[best], np.zeros(len(best)), float(np.log(p / (n - p))))
    x = np.concatenate([model.hits(data, bounds) + [i, 0] for i, _, data, bounds in texts(column)])
    d_row, d_col, d_val, m = _pairs(column, model, groups)

    # Every fifth row is kept from the fit and sets where the score passes 0.5.
    fold = np.arange(n) % 5 == 4
    keep = (~fold).astype(float)
    m_keep = keep.sum()
    w, b = model.weights, model.bias
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        error = (sigmoid(np.bincount(x[:, 0], w[x[:, 1]], n) + b) - y) * keep
        grad = np.bincount(x[:, 1], error[x[:, 0]], len(w)) / m_keep + l2 * w
        if m:
            change = np.bincount(d_row, d_val * w[d_col], m)
            grad += strength * np.bincount(d_col, d_val * change[d_row], len(w)) / m
        g = np.append(grad, error.sum() / m_keep)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    share = (classes[0] / (n - p), classes[1] / p) if classes and min(classes) > 0 else (1.0, 1.0)
    b -= cut((np.bincount(x[:, 0], w[x[:, 1]], n) + b)[fold], y[fold], share)
    return Model(model.features, w, float(b))


def cut(odds: np.ndarray, y: np.ndarray, share: tuple[float, float]) -> float:
    """The log-odds that divide the classes with the fewest errors, with ``share`` as the classes' weights and MARGIN to spare on either side,
    so that texts which differ by less, as counterfactuals do, are not told apart; the middle of the widest range that does so. 0 if a class
    is missing or nothing does better than calling no text toxic."""
    if not 0 < y.sum() < len(y):
        return 0.0
    grid = np.linspace(odds.min() - MARGIN, odds.max() + MARGIN, 4001)
    over = lambda z, at: len(z) - np.searchsorted(np.sort(z), at, "left")
    gain = over(odds[y == 1], grid + MARGIN) * share[1] - over(odds[y == 0], grid - MARGIN) * share[0]
    if gain.max() <= 0:
        return 0.0
    best = np.flatnonzero(gain >= gain.max() - 1e-9)
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    run = max(runs, key=len)
    return float((grid[run[0]] + grid[run[-1]]) / 2)


def held_out(id_col: str):
    """Rows whose labels are never learned from; a null id is not one."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, toxic) of the labelled ids that are not held out."""
    good = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(id_col))
    return good.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, positives: int = POSITIVES, negatives: int = NEGATIVES, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(id, text, toxic): at most ``positives`` + ``negatives`` labelled rows, none of them held out. Rows of over ``sample_chars`` characters are left out of the sample, not
    cut. Of several labels of an id the largest counts, of several texts of an id the least; labels other than 0 and 1 and null ids
    do not."""
    known = learnable(labels, id_col)
    order = [F.xxhash64("id"), F.col("id")]
    ids = known.filter("toxic = 1").orderBy(*order).limit(positives).unionByName(known.filter("toxic = 0").orderBy(*order).limit(negatives))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.length("text") <= sample_chars)
    return source.join(F.broadcast(ids), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).select("id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[tuple[str, ...], ...] = IDENTITY, **options) -> Model:
    """The model, fitted by one executor task over the bounded sample; the driver gets its weights alone."""
    shares = learnable(labels, id_col).agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    classes = (shares[0], shares[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if rows:
            model = fit(pa.Table.from_batches(rows).rename_columns(["id", "text", "toxic"]).sort_by("id"), groups, classes=classes)
            yield pa.RecordBatch.from_arrays([pa.array([model.features.view(np.int64)], pa.list_(pa.int64())), pa.array([model.weights], pa.list_(pa.float64())), pa.array([model.bias])], ["features", "weights", "bias"])

    sample = training_sample(docs, labels, id_col, text_col, **options)
    found = in_arrow(sample.coalesce(1), run, "features array<long>, weights array<double>, bias double").first()
    if found is None:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -50.0)
    return Model(np.array(found.features, np.int64).view(np.uint64), np.array(found.weights, np.float64), found.bias)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col long, held_out boolean, score double, predicted int), one row per row of ``docs``. Null texts score as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)))], ["id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = in_arrow(source, run, "id long, score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns, in one pass without a join."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at)) < 0.5))

    return in_arrow(docs, run, docs.schema)
