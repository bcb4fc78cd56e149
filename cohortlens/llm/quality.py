"""Quality by naive Bayes support vectors.

N-gram indicators of a text are scaled by the log-count ratios of their classes, and a linear model
with hinge loss is fitted to them by dual coordinate descent (one document's multiplier at a time).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, received, sent, without
from .toxicity import LONG_CHARS, bounded_sample

SAMPLE_DOCS = 4_000
SAMPLE_CHARS = 12_000_000
LEAST_DOCS = 5
SMOOTH = 1.0
COST = 0.1
EPOCHS = 20
#: One in so many sample documents is kept from the fit, to turn margins into probabilities.
CALIBRATE = 5
SHAPES = 3
REMEMBERED = 200_000

TOKENS = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")


def shape(token: str) -> str:
    """One letter for a token's form."""
    if token[0].isalpha():
        if len(token) > 1 and token.isupper():
            return "A"
        return "a" if token.islower() else "B" if token[0].isupper() else "c"
    if token[0].isdigit():
        return "9"
    return "." if len(token) == 1 else "#"


class Shapes(dict):
    """Forms of the tokens met, up to a bounded number."""

    def __missing__(self, token: str) -> str:
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = found = shape(token)
        return found


def indicators(text: str, shapes: Shapes) -> set:
    """Tokens and pairs of tokens, and up to SHAPES forms in a row ("=" for a word that repeats the one before)."""
    tokens = TOKENS.findall(text)
    pairs = set(zip(tokens, tokens[1:]))
    forms = [shapes[t] for t in tokens]
    word_before = None
    for i, t in enumerate(tokens):
        if forms[i] in "aABc9":
            if t == word_before:
                forms[i] = "="
            word_before = t
    grams = {"".join(g) for n in range(1, SHAPES + 1) for g in set(zip(*[forms[k:] for k in range(n)]))}
    return set(tokens) | pairs | {(g,) for g in grams}


class Model:
    def __init__(self, weights: dict, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset
        self.shapes = Shapes()

    def __getstate__(self):
        return self.weights, self.bias, self.slope, self.offset

    def __setstate__(self, state):
        self.__init__(*state)

    def margin(self, text: str) -> float:
        found = indicators(text, self.shapes)
        return self.bias + math.fsum(self.weights[f] for f in found if f in self.weights)

    def score(self, text: str) -> float:
        z = self.slope * self.margin(text) + self.offset
        return 1 / (1 + math.exp(-min(max(z, -500.0), 500.0)))


def ratios(rows: list[np.ndarray], y: np.ndarray, width: int) -> np.ndarray:
    """Log-count ratios of the classes: log((p / |p|) / (q / |q|)) with smoothed counts p, q."""
    sums = [SMOOTH + np.bincount(np.concatenate([np.empty(0, np.int64), *[r for r, c in zip(rows, y) if c == s]]).astype(np.int64), minlength=width) for s in (1, -1)]
    p, q = sums
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 42):
    """Weights and bias of the hinge-loss model by dual coordinate descent over indicators times ``scale``."""
    weights, bias = np.zeros(len(scale)), 0.0
    multipliers = np.zeros(len(rows))
    norms = np.array([1.0 + (scale[r] ** 2).sum() for r in rows])
    # the rarer class costs as much as the other
    positive = max((y == 1).sum(), 1) / max(len(y), 1)
    bounds = np.where(y == 1, cost / (2 * positive), cost / (2 * max(1 - positive, 1 / max(len(y), 1))))
    chance = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in chance.permutation(len(rows)):
            r = rows[i]
            gradient = y[i] * ((weights[r] * scale[r]).sum() + bias) - 1
            new = min(max(multipliers[i] - gradient / norms[i], 0.0), bounds[i])
            step = new - multipliers[i]
            if step:
                multipliers[i] = new
                weights[r] += step * y[i] * scale[r]
                bias += step * y[i]
                largest = max(largest, abs(step) * norms[i])
        if largest < 1e-3:
            break
    return weights, bias


def calibrated(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the margins (Newton steps, slightly smoothed targets)."""
    n1, n0 = (y == 1).sum(), (y != 1).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    at = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones(len(margins))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -40, 40)))
        hessian = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        at = at - np.clip(np.linalg.solve(hessian, x @ (p - goal) + 1e-3 * (at - [1.0, 0.0])), -2, 2)
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """A model from texts and labels 0 or 1."""
    y = np.where(np.asarray(labels) == 1, 1, -1)
    if len(set(y.tolist())) < 2:
        return Model({}, float(y[0]) if len(y) else 0.0, 1.0, 0.0)
    shapes = Shapes()
    # a first look counts by hash, so that the many rare n-grams take no memory of their own
    rough = np.zeros(1 << 22, np.uint16)
    for t in texts:
        spots = np.unique(np.fromiter((hash(x) & (len(rough) - 1) for x in indicators(t, shapes)), np.int64))
        rough[spots] += rough[spots] < LEAST_DOCS
    frequent = rough >= LEAST_DOCS
    counts: dict = {}
    for t in texts:
        for x in indicators(t, shapes):
            if frequent[hash(x) & (len(rough) - 1)]:
                counts[x] = counts.get(x, 0) + 1
    numbers = {x: i for i, x in enumerate(sorted((x for x, n in counts.items() if n >= LEAST_DOCS), key=repr))}
    del counts
    rows = [np.array(sorted(numbers[x] for x in indicators(t, shapes) if x in numbers), np.int64) for t in texts]
    apart = np.arange(len(rows)) % CALIBRATE == 0
    taught = [r for r, a in zip(rows, apart) if not a]
    scale = ratios(taught, y[~apart], len(numbers))
    weights, bias = descend(taught, y[~apart], scale)
    weighed = weights * scale
    slope, offset = calibrated(np.array([bias + weighed[r].sum() for r, a in zip(rows, apart) if a]), y[apart])
    return Model({x: float(weighed[i]) for x, i in numbers.items() if weighed[i]}, float(bias), slope, offset)


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
    sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS,
    long_chars: int = LONG_CHARS,
) -> Model:
    """A model from a bounded sample of the labelled rows that are not held out.

    At most ``sample_docs`` documents with at most ``sample_chars`` characters in all are fitted to, in
    the driver; texts of more than ``long_chars`` come last. Rows with a null key or
    label teach nothing; with labels of one class, or none, every score is that class's (or even).
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter(~held_out(F.col("k")))
    texts, y = bounded_sample(docs, known, text, key, sample_docs, sample_chars, long_chars=long_chars)
    return fit(list(texts), y)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "quality") -> DataFrame:
    """Every row with ``out``, the probability (0 to 1) that its text is good.

    A map over rows: no shuffle; the model's size is bounded by the sample it was fitted to.

    Defined cases: null and empty texts have no n-grams and score by the bias; repeated rows score
    alike; an empty table gives no rows. ``out`` replaces an input column of its name.
    """
    keep = without(docs.columns, out)
    [whole] = fresh([*keep, out], "whole")
    known = sent(docs.sparkSession, model)
    rows = docs.select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").cast("string").alias(whole))
    schema = rows.drop(whole).withColumn(out, F.lit(0.0)).schema

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(known)
        for batch in batches:
            scores = [model.score(t.as_py() or "") for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*keep, out])

    return rows.mapInArrow(find, schema)
