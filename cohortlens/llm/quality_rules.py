"""Quality rules: statistics of a text, fixed rules on them, and an isolation forest.

The forest describes what good texts look like: each tree splits all of them at random values of random
statistics, until they stand alone or the tree is deep enough. A text that such splits set apart after few steps
is unlike the others. How short the mean path of a rejected text is, is calibrated on all labelled texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, received, running, sent, without, written
from .word_ranks import numbered, repeated, slices

#: Fixed values of the rules.
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
SYMBOLS = "#*$%&|<>"
#: Trees are as deep as so many rows need to stand alone; all rows are counted in each.
TREES, TREE_ROWS = 200, 256
#: Share of the good labelled rows that the forest may reject.
GOOD_LOST = 0.005
#: Paths are whole multiples of 1 / GRAIN: their sums are exact, and there are boundedly many of them.
GRAIN = 1024
SEED = 42

BLANKS = re.compile("[\\x20\\x09-\\x0D]")
#: The statistics that trees split on.
FEATURES = (
    "symbol_share", "upper_share", "digit_share", "mark_share", "repeat_share", "stutter_share", "line_share",
    "distinct_words", "word_length", "longest_word",
)
MARKS = re.compile(r"[!?;:|{}\[\]\\^~_=+@]")


def statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and the FEATURES.

    Features are shares of words or characters, so that they don't grow with a text's length.
    """
    words = [t.encode().split() for t in texts]  # bytes split at the blanks of ASCII, the words' definition
    ids, starts = numbered(words)
    again = np.concatenate([[0], np.cumsum(repeated(ids, WINDOW))])
    stutter = np.concatenate([[0], np.cumsum(np.append(ids[1:] == ids[:-1], False) if len(ids) else [])])
    base, features = np.zeros((len(texts), 5), np.int64), np.zeros((len(texts), len(FEATURES)))
    for i, (t, w, start) in enumerate(zip(texts, words, starts.tolist())):
        n, end = len(w), start + len(w)
        chars = len(t) - sum(map(t.count, " \t\n\x0b\x0c\r"))
        symbols = sum(map(t.count, SYMBOLS))
        lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
        doubled, many = len(lines) - len(set(lines)), int(again[end] - again[start])
        base[i] = n, chars, symbols, doubled, many
        if not n:
            continue
        raw = t.encode()
        upper, digits = capitals(raw, t)
        features[i] = (
            symbols / chars, upper / chars, digits / chars, len(MARKS.findall(t)) / chars, many / n,
            float(stutter[end] - stutter[start]) / n, doubled / len(lines),
            math.log1p(len(np.unique(ids[start:end]))) / math.log1p(n), chars / n, math.log1p(max(map(len, w))),
        )
    return base, features


_UPPER = re.compile(r"[^\W\d_]{2,}")


def capitals(raw: bytes, text: str) -> tuple[int, int]:
    """Letters in words of capitals, and digits of ASCII."""
    digits = sum(map(raw.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9")))
    if text.upper() == text.lower():
        return 0, digits
    return sum(len(w) for w in _UPPER.findall(text) if w.isupper()), digits


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows, which stands for a tree that was not grown on."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        grown = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return np.where(n > 2, grown, np.where(n == 2, 1.0, 0.0))


#: Per node: feature (-1: a leaf), value, left, right, and the depth or, in a forest, the path length.
Tree = tuple[np.ndarray, ...]


def random_trees(
    low: np.ndarray, high: np.ndarray, rows: int, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED,
) -> list[Tree]:
    """Trees that split anywhere between the extremes, as deep as ``tree_rows`` rows need (``rows``, if these are fewer).

    They depend on the rows by their extremes alone, so that rows can be counted in them wherever they are.
    """
    chance = np.random.default_rng(seed)
    deepest = max(1, math.ceil(math.log2(max(min(tree_rows, rows), 2))))

    def grown() -> Tree:
        feature, value, left, right, depths = [], [], [], [], []

        def grow(low: np.ndarray, high: np.ndarray, depth: int) -> int:
            node = len(feature)
            for x, start in ((feature, -1), (value, 0.0), (left, 0), (right, 0), (depths, depth)):
                x.append(start)
            wide = np.flatnonzero(high > low)
            if depth == deepest or not len(wide):
                return node
            f = int(wide[chance.integers(len(wide))])
            v = float(chance.uniform(low[f], high[f]))
            upto, beyond = high.copy(), low.copy()
            upto[f] = beyond[f] = v
            feature[node], value[node] = f, v
            left[node], right[node] = grow(low, upto, depth + 1), grow(beyond, high, depth + 1)
            return node

        grow(low, high, 0)
        return np.array(feature, np.int16), np.array(value), np.array(left, np.int16), np.array(right, np.int16), np.array(depths, np.int16)

    return [grown() for _ in range(trees)]


def reached(tree: Tree, rows: np.ndarray) -> np.ndarray:
    """The node where each row ends."""
    feature, value, left, right, _ = tree
    node = np.zeros(len(rows), np.int64)
    active = np.arange(len(rows))[feature[node] >= 0]
    while len(active):
        at = node[active]
        node[active] = np.where(rows[active, feature[at]] <= value[at], left[at], right[at])
        active = active[feature[node[active]] >= 0]
    return node


def ended(trees: list[Tree], rows: np.ndarray) -> np.ndarray:
    """How many rows end at each node, the nodes of all trees in one array."""
    return np.concatenate([np.bincount(reached(tree, rows), minlength=len(tree[0])) for tree in trees])


class Forest:
    """Trees with path lengths; ``score`` is 2^(-mean path / expected path), higher for odd rows.

    Trees count all ``rows``; their splits fall anywhere between the extremes of these and ``others``, so that a statistic
    which all rows share is split too. A branch with one row or none ends at once.
    """

    def __init__(self, rows: np.ndarray, others: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED):
        every = np.concatenate([rows, others])
        grown = random_trees(every.min(0), every.max(0), len(rows), trees, tree_rows, seed)
        self.trees, self.size = self._weighed(grown, ended(grown, rows), 0), len(rows)

    @classmethod
    def counted(cls, grown: list[Tree], ends: np.ndarray, size: int, less: int = 0) -> Forest:
        """The forest of ``size`` rows that end at the nodes as :func:`ended` says.

        With ``less`` = 1 a row that was counted finds the paths of the forest without it.
        """
        forest = cls.__new__(cls)
        forest.trees, forest.size = cls._weighed(grown, ends, less), size
        return forest

    @staticmethod
    def _weighed(grown: list[Tree], ends: np.ndarray, less: int) -> list[Tree]:
        out, start = [], 0
        for feature, value, left, right, depth in grown:
            n = ends[start : start + len(feature)].copy()
            start += len(feature)
            for i in np.flatnonzero(feature >= 0)[::-1].tolist():  # children stand behind their parent
                n[i] += n[left[i]] + n[right[i]]
            n -= less
            leaf = (feature < 0) | (n < 2)
            path = np.where(leaf, np.round((depth + expected_path(n)) * GRAIN) / GRAIN, 0.0)
            out.append((np.where(leaf, np.int16(-1), feature), value, left, right, path))
        return out

    def paths(self, rows: np.ndarray) -> np.ndarray:
        """Mean path length of each row."""
        total = np.zeros(len(rows))
        for tree in self.trees:
            total += tree[-1][reached(tree, rows)]
        return total / max(len(self.trees), 1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return self.scored(self.paths(rows))

    def scored(self, paths: np.ndarray | float) -> np.ndarray:
        scale = float(expected_path(self.size))
        if not self.trees or not scale:
            return np.zeros(np.shape(paths))
        return 2.0 ** (-np.asarray(paths) / scale)


class Model:
    def __init__(self, forest: Forest, threshold: float):
        self.forest, self.threshold = forest, threshold


def labelled(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str) -> DataFrame:
    """``features`` and ``good`` of every labelled key, one row each.

    A key with several labels is good only if all are; a key with several texts counts with the least by hash.
    Rows with a null key, a null label, or fewer words than the rules ask for, teach nothing.
    Statistics are computed where the texts are, and only these are shuffled.
    """
    known = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)")
    texts = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("m")).filter("k IS NOT NULL")
    found = measured(texts.withColumn("h", F.xxhash64("m")), "m", "m").select("k", F.struct("h", "m.n_words", "m.features").alias("x"))
    one = found.groupBy("k").agg(F.min("x").alias("x")).filter(F.col("x.n_words") >= LEAST_WORDS)
    return one.join(known.groupBy("k").agg(F.min("y").alias("y")), "k").select("x.features", (F.col("y") == 1).alias("good"))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))


def forests(rows: DataFrame) -> tuple[Forest, Forest]:
    """The forest of all good rows, and the one that each of them meets if it is left out itself.

    Splits follow from the extremes of all rows; each task counts its rows in all trees, and the counts are
    added up. What reaches the driver is one number for each node.
    """
    extremes = [f(F.col("features")[i]) for f in (F.min, F.max) for i in range(len(FEATURES))]
    size, *found = rows.agg(F.count_if("good"), *extremes).head()
    grown = random_trees(*np.array(found, float).reshape(2, -1), size) if size else []
    split = sent(rows.sparkSession, grown)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = received(split)
        ends = np.zeros(sum(len(t[0]) for t in trees), np.int64)
        for batch in batches:
            ends += ended(trees, matrix(batch))
        at = np.flatnonzero(ends)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ends[at])], ["node", "n"])

    ends = np.zeros(sum(len(t[0]) for t in grown), np.int64)
    if size:
        counts = rows.filter("good").select("features").mapInArrow(count, "node bigint, n bigint")
        sums = counts.groupBy("node").agg(F.sum("n").alias("n")).toPandas()
        ends[sums["node"]] = sums["n"]
    return Forest.counted(grown, ends, size), Forest.counted(grown, ends, size, less=1)


def best_threshold(rows: DataFrame, forest: Forest, left_out: Forest, good_lost: float = GOOD_LOST) -> float:
    """The threshold that tells all labelled rows apart best while losing few good ones; infinite if there is none.

    A good row is scored as if it had not been counted. Rows are counted by path, and the counts added up in the order of
    paths part by part: the threshold is exact, and one row of the best path reaches the driver.
    """
    known = sent(rows.sparkSession, (forest, left_out))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, left_out = received(known)
        for batch in batches:
            features, good = matrix(batch), batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            paths = np.empty(len(good))
            paths[good], paths[~good] = left_out.paths(features[good]), forest.paths(features[~good])
            yield pa.RecordBatch.from_arrays([pa.array(paths), batch.column("good")], ["path", "good"])

    found = rows.select("features", "good").mapInArrow(find, "path double, good boolean")
    tried = written(found.groupBy("path").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")), "paths")
    longest = max(float(tree[-1].max()) for tree in forest.trees) + 1
    sums = tried
    for kind in ("good", "bad"):
        sums = running(sums, None, F.col("path") / longest, ["path"], F.col(kind), f"{kind}_upto", f"{kind}_all")
    lost, caught = ((F.col(f"{kind}_upto") - F.col(kind)) / F.nullif(f"{kind}_all", F.lit(0)) for kind in ("good", "bad"))
    gain = sums.select("path", lost.alias("lost"), (caught - lost).alias("gain")).filter((F.col("lost") <= good_lost) & (F.col("gain") > 0))
    best = gain.orderBy(F.desc("gain"), F.desc("path")).head()
    if best is None:
        return math.inf
    below = tried.filter(F.col("path") < best.path).agg(F.max("path")).head()[0]
    return float(forest.scored((best.path + below) / 2))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> Model:
    """A model from all labelled rows (:func:`labelled`): the good ones make the forest, all set the threshold.

    Without good or without bad rows nothing is odd.
    """
    rows = written(labelled(docs, labels, text, key, label), "labelled")
    forest, left_out = forests(rows)
    return Model(forest, best_threshold(rows, forest, left_out) if forest.trees else math.inf)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, text: str = "text", out: str = "rules", model: Model | None = None) -> DataFrame:
    """Every row with ``out``: the base statistics, ``features``, and ``anomaly`` and ``odd`` by the model (0 and false without one).

    A map over rows: no shuffle. Texts are measured together in slices of a bounded size, a longer
    one on its own. Null and empty texts have no words and features of 0. ``out`` replaces an input column of its name.
    """
    keep = without(docs.columns, out)
    [whole] = fresh([*keep, out], "whole")
    known = sent(docs.sparkSession, model)
    rows = docs.select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").cast("string").alias(whole))
    numbers = "".join(f"{b}:bigint," for b in BASE)
    schema = rows.drop(whole).withColumn(out, F.lit(None).cast(f"struct<{numbers}features:array<double>,anomaly:double,odd:boolean>")).schema

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(known)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for low, high in slices((len(t.as_py() or "") for t in column)):
                base, features = statistics([t.as_py() or "" for t in column.slice(low, high - low)])
                score = model.forest.score(features) if model else np.zeros(len(features))
                offsets = pa.array(np.arange(len(features) + 1) * len(FEATURES), pa.int32())
                found = pa.StructArray.from_arrays(
                    [*[pa.array(base[:, i]) for i in range(len(BASE))], pa.ListArray.from_arrays(offsets, pa.array(features.ravel())),
                     pa.array(score), pa.array(score > model.threshold if model else score > 0)],
                    [*BASE, "features", "anomaly", "odd"],
                )
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns[:-1], found], [*keep, out])

    return rows.mapInArrow(find, schema)


def base_failed(rules: str) -> Column:
    """The fixed rules: too few words, or too many of them in repeated windows."""
    n, many = F.col(f"{rules}.n_words"), F.col(f"{rules}.n_repeat_words")
    return (n < LEAST_WORDS) | (100 * many > REPEAT_PERCENT * n)


def apply_rules(docs: DataFrame, model: Model, text: str = "text", out: str = "rules") -> DataFrame:
    """Every row with ``out`` of :func:`measured`, ``base_failed`` and ``kept`` (no rule failed and not odd) in it.

    Defined cases: null and empty texts fail the rules; repeated rows are treated alike; a model
    without good or without bad labelled rows finds nothing odd; an empty table gives no rows.
    """
    failed = base_failed(out)
    marked = measured(docs, text, out, model)
    kept = ~failed & ~F.col(f"{out}.odd")
    return marked.withColumn(out, F.col(f"`{out}`").withField("base_failed", failed).withField("kept", kept))
