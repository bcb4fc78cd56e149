"""Hard-negative mining by segment summary filtering.

A vector is cut into segments; each segment is stored as its mean and its deviation (the length of
what is left when the mean is taken off). For two segments of m components the inner product is
m times the product of the means, plus or minus at most the product of the deviations. Summed over
the segments that bounds a score from both sides. Pairs whose bounds can't reach the wanted scores
are dropped; the others are bounded again with shorter segments, and what is left is scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 50, 95
#: Lengths of segments, from coarse to fine; each is a multiple of the next.
SEGMENTS = (16, 4, 2)
#: Components of the rows, and of the anchors, that one task holds at a time; rows go to MIN_GROUPS groups at least.
ROW_COMPONENTS, ANCHOR_COMPONENTS, MIN_GROUPS = 4_000_000, 1_000_000, 64
#: Rows and anchors that are bounded together.
TILE_ROWS, TILE_ANCHORS = 2048, 256
#: Share of pairs below which what is left is scored pair by pair and not as a matrix.
SPARSE = 0.05
#: Whole numbers below this are exact as doubles; rounding stays far below this share of both lengths' product.
EXACT, SLACK = 2.0**53, 1e-9
LIMIT = 2**63 - 1


def taking_part(vector: str) -> Column:
    """Vectors that are not null and hold no null and no component that is not finite."""
    x = F.col(f"`{vector}`")
    return x.isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf"))), F.lit(False))


def sortable(n: int) -> bytes | None:
    """None for a number that fits a long, else bytes that order such numbers of one sign."""
    if -LIMIT <= n <= LIMIT:
        return None
    size = (abs(n).bit_length() + 7) // 8
    code = size.to_bytes(4, "big") + abs(n).to_bytes(size, "big")
    return code if n > 0 else bytes(255 - b for b in code)


def clipped(n: int) -> int:
    return max(min(n, LIMIT), -LIMIT - 1)


def whole(clip: int, code: bytes | None) -> int:
    """The number that :func:`clipped` and :func:`sortable` stand for."""
    if code is None:
        return clip
    return int.from_bytes(code[4:], "big") if clip > 0 else -int.from_bytes(bytes(255 - b for b in code[4:]), "big")


class Vectors:
    """Rows of one length: ids, labels, components as whole numbers (in doubles), and segment summaries."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, raw: np.ndarray, scale: int):
        self.ids, self.labels, self.raw, self.scale = ids, labels, raw, scale
        with np.errstate(over="ignore", invalid="ignore"):
            self.numbers = np.floor(raw * scale)
            self.length = np.sqrt((self.numbers**2).sum(1))
        self.summaries: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def take(self, at: np.ndarray) -> Vectors:
        return Vectors(self.ids[at], self.labels[at], self.raw[at], self.scale)

    def summary(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Means (times the root of the size) and deviations of the segments; zeros fill the last one up."""
        if size not in self.summaries:
            with np.errstate(over="ignore", invalid="ignore"):
                filled = np.pad(self.numbers, ((0, 0), (0, -self.numbers.shape[1] % size)))
                cut = filled.reshape(len(filled), -1, size)
                means = cut.mean(2)
                deviations = np.sqrt(((cut - means[:, :, None]) ** 2).sum(2))
                self.summaries[size] = means * np.sqrt(size), deviations
        return self.summaries[size]

    def integers(self) -> np.ndarray:
        """Components as whole numbers of any size."""
        own = [[int(np.floor(x * self.scale)) if abs(x) < EXACT else int(x) * self.scale for x in v] for v in self.raw.tolist()]
        out = np.empty(self.raw.shape, object)
        out[...] = own
        return out


def bounds(anchors: Vectors, rows: Vectors, size: int, a: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of anchors ``a`` with rows ``r``, by segments of ``size`` components."""
    with np.errstate(over="ignore", invalid="ignore"):
        (am, ad), (rm, rd) = anchors.summary(size), rows.summary(size)
        middle = am[a] @ rm[r].T
        reach = ad[a] @ rd[r].T + SLACK * anchors.length[a][:, None] * rows.length[r]
        return middle - reach, middle + reach


def surviving(
    anchors: Vectors, rows: Vectors, allowed: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors and rows that are left, and which of their pairs may score between ``low`` and ``high`` of the anchor.

    A bound that is not a number (sums beyond the doubles) drops nothing.
    """
    a, r = np.flatnonzero(allowed.any(1)), np.flatnonzero(allowed.any(0))
    left = allowed[np.ix_(a, r)]
    for size in SEGMENTS:
        if not left.any() or size > anchors.numbers.shape[1]:
            continue
        least, most = bounds(anchors, rows, size, a, r)
        left &= ~(most < low[a][:, None]) & ~(least > high[a][:, None])
        some_a, some_r = left.any(1), left.any(0)
        a, r, left = a[some_a], r[some_r], left[np.ix_(some_a, some_r)]
    return a, r, left


def exact_pairs(anchors: Vectors, rows: Vectors, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, wide: bool):
    """Anchor, row and exact score of the pairs that the bounds leave."""
    a, r, left = surviving(anchors, rows, allowed, low, high)
    at, to = np.nonzero(left)
    if wide:
        own, other = anchors.integers()[a], rows.integers()[r]
        scores = np.empty(len(at), object)
        scores[:] = [int(own[i] @ other[j]) if own.shape[1] else 0 for i, j in zip(at.tolist(), to.tolist())]
    elif left.size and len(at) < SPARSE * left.size:
        scores = np.einsum("ij,ij->i", anchors.numbers[a[at]], rows.numbers[r[to]]).astype(np.int64)
    else:
        scores = (anchors.numbers[a] @ rows.numbers[r].T)[at, to].astype(np.int64)
    return a[at], r[to], scores


def first_of(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of each group's ``most`` highest scores, ties to the smaller id."""
    if not len(groups):
        return np.empty(0, np.int64)
    order = np.lexsort((ids, -scores, groups)) if scores.dtype != object else np.array(
        sorted(range(len(groups)), key=lambda i: (groups[i], -scores[i], ids[i])), np.int64)
    g = groups[order]
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    return order[rank < most]


class Best:
    """The highest scores so far of so many lists, and the score that a list's next row has to reach."""

    def __init__(self, n: int, most: int, wide: bool):
        kind = object if wide else np.int64
        self.n, self.most = n, most
        self.lists, self.scores, self.ids = np.empty(0, np.int64), np.empty(0, kind), np.empty(0, np.int64)
        self.least = np.full(n, -np.inf)

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(lists):
            return
        lists, ids = np.concatenate([self.lists, lists]), np.concatenate([self.ids, ids])
        scores = np.concatenate([self.scores, scores])
        keep = first_of(lists, scores, ids, self.most)
        self.lists, self.scores, self.ids = lists[keep], scores[keep], ids[keep]
        full = np.flatnonzero(np.bincount(self.lists, minlength=self.n) == self.most)
        last = np.searchsorted(self.lists, full, side="right") - 1
        self.least[full] = doubles(self.scores[last].tolist(), -1)


def doubles(numbers: list[int], side: int) -> np.ndarray:
    """Whole numbers as doubles, a little below (``side`` -1) or above (1); infinite beyond the doubles."""
    out = np.empty(len(numbers))
    for i, n in enumerate(numbers):
        try:
            out[i] = float(n) + side * 1e-12 * abs(float(n))
        except OverflowError:
            out[i] = math.inf if n > 0 else -math.inf
    return out


def _vectors(table: pa.Table, scale: int) -> Iterator[tuple[int, np.ndarray, Vectors]]:
    """The rows of each length of vector: length, their places, vectors."""
    vector = table.column("v").combine_chunks()
    vector = vector.chunk(0) if isinstance(vector, pa.ChunkedArray) else vector
    lengths = np.diff(vector.offsets.to_numpy())
    flat, starts = vector.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)[:-1]])
    ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield n, at, Vectors(ids[at], labels[at], flat[starts[at][:, None] + np.arange(n)].reshape(len(at), n), scale)


def _kinds(v: Vectors, at: np.ndarray) -> Iterator[tuple[bool, np.ndarray, Vectors]]:
    """Narrow vectors, whose products with each other are exact as doubles, and the others."""
    largest = np.abs(v.numbers).max(1, initial=0)
    wide = ~(largest < np.sqrt(EXACT / max(v.numbers.shape[1], 1)))
    for kind in (False, True):
        some = np.flatnonzero(wide == kind)
        if len(some):
            yield kind, at[some], v.take(some)


def _meetings(rows: pa.Table, anchors: pa.Table, scale: int) -> Iterator[tuple[np.ndarray, Vectors, Vectors, bool]]:
    """Tiles of anchors with all rows of the table that have their length."""
    known = {n: list(_kinds(v, at)) for n, at, v in _vectors(rows, scale)}
    for n, at, v in _vectors(anchors, scale):
        for wide_a, at_a, own in _kinds(v, at):
            for low in range(0, len(at_a), TILE_ANCHORS):
                some = np.arange(low, min(low + TILE_ANCHORS, len(at_a)))
                tile = own.take(some)
                for wide_r, _, other in known.get(n, []):
                    yield at_a[some], tile, other, wide_a or wide_r


def _row_tiles(rows: Vectors) -> Iterator[Vectors]:
    for low in range(0, len(rows.ids), TILE_ROWS):
        yield rows if len(rows.ids) <= TILE_ROWS else rows.take(np.arange(low, min(low + TILE_ROWS, len(rows.ids))))


def _exact_columns(scores: np.ndarray) -> list[pa.Array]:
    if scores.dtype != object:
        return [pa.array(scores), pa.nulls(len(scores), pa.binary())]
    values = scores.tolist()
    return [pa.array([clipped(s) for s in values], pa.int64()), pa.array([sortable(s) for s in values], pa.binary())]


POSITIVE_FIELDS = "anchor long, id long, score long, wide binary"
NEGATIVE_FIELDS = "anchor long, place int, positive long, positive_score long, id long, score long, wide binary"


def _positives(scale: int, most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best rows of the anchor's label, among the rows of one group."""

    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        parts = [pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.binary())], ["anchor", "id", "score", "wide"])]
        for _, tile, others, wide in _meetings(rows, anchors, scale):
            best, no_end = Best(len(tile.ids), most, wide), np.full(len(tile.ids), np.inf)
            for block in _row_tiles(others):
                allowed = (tile.labels[:, None] == block.labels) & (tile.ids[:, None] != block.ids)
                a, r, scores = exact_pairs(tile, block, allowed, best.least, no_end, wide)
                best.add(a, scores, block.ids[r])
            columns = [pa.array(tile.ids[best.lists]), pa.array(best.ids), *_exact_columns(best.scores)]
            parts.append(pa.table(columns, ["anchor", "id", "score", "wide"]))
        return pa.concat_tables(parts)

    return search


def _negatives(scale: int, most: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For each positive of an anchor the best rows of other labels between the percentages, among the rows of one group."""
    names = ["anchor", "place", "positive", "positive_score", "id", "score", "wide"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        parts = [pa.table([pa.array([], k) for k in kinds], names)]
        given = anchors.column("positives").to_pylist()
        for at, tile, others, wide in _meetings(rows, anchors, scale):
            # one list per positive: its anchor's place, and the least and greatest score that is wanted
            bands = [(i, p, whole(p["score"], p["wide"])) for i, x in enumerate(at.tolist()) for p in given[x]]
            bands = [(i, p, -(-low * s // 100), high * s // 100) for i, p, s in bands]
            bands = [b for b in bands if b[2] <= b[3]]
            if not bands:
                continue
            owner = np.array([b[0] for b in bands])
            ends = [[b[k] for b in bands] for k in (2, 3)]
            if not wide and max(map(abs, ends[0] + ends[1])) > LIMIT:  # narrow rows can't score that far out
                ends = [[max(min(x, LIMIT), -LIMIT) for x in e] for e in ends]
            least, most_ = (np.array(e, object if wide else np.int64) for e in ends)
            least_f, most_f = doubles(ends[0], -1), doubles(ends[1], 1)
            best = Best(len(bands), most, wide)
            firsts = np.searchsorted(owner, np.arange(len(tile.ids)))
            of = [np.arange(f, e) for f, e in zip(firsts, np.append(firsts[1:], len(owner)))]
            for block in _row_tiles(others):
                low_of, high_of = np.full(len(tile.ids), np.inf), np.full(len(tile.ids), -np.inf)
                np.minimum.at(low_of, owner, np.maximum(least_f, best.least))
                np.maximum.at(high_of, owner, most_f)
                allowed = (tile.labels[:, None] != block.labels) & (tile.ids[:, None] != block.ids) & (low_of <= high_of)[:, None]
                a, r, scores = exact_pairs(tile, block, allowed, low_of, high_of, wide)
                lists = np.concatenate([of[x] for x in a.tolist()]) if len(a) else np.empty(0, np.int64)
                pair = np.repeat(np.arange(len(a)), [len(of[x]) for x in a.tolist()]).astype(np.int64)
                fits = (scores[pair] >= least[lists]) & (scores[pair] <= most_[lists])
                fits = fits.astype(bool)
                best.add(lists[fits], scores[pair[fits]], block.ids[r[pair[fits]]])
            of_list = [bands[i] for i in best.lists.tolist()]
            columns = [
                pa.array(tile.ids[owner[best.lists]] if len(best.lists) else [], pa.int64()),
                pa.array([b[1]["place"] for b in of_list], pa.int32()), pa.array([b[1]["id"] for b in of_list], pa.int64()),
                pa.array([b[1]["score"] for b in of_list], pa.int64()), pa.array(best.ids), *_exact_columns(best.scores),
            ]
            parts.append(pa.table(columns, names))
        return pa.concat_tables(parts)

    return search


def _ranked(found: DataFrame, most: int, *by: str) -> DataFrame:
    """The first rows of each list, numbered; Spark keeps ``most`` a list and task before the shuffle."""
    order = [F.col("score").desc(), F.col("wide").desc_nulls_last(), F.col("id")]
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("int")).filter(F.col("place") <= most)


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """For each anchor and positive, the hardest rows of other labels: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.

    A score is the inner product of components floor(scale x). An anchor's positives are its
    ``positives`` best other rows of its label; a positive's negatives are the ``negatives`` best rows of other
    labels that score between ``low`` and ``high`` per cent of it. Ties go to the smaller key.

    Rows are dealt by a hash of their content into groups, anchors into tiles, so many that a group
    and a tile fit a task whatever the tables' sizes; each group meets each tile in one task, twice (for the
    positives, then for the negatives). A task sends on its best rows only. Segment summaries spare the
    exact scores of pairs whose bounds miss what is wanted; on vectors without structure they spare little.

    Defined cases: rows with a null key, label or vector, or a null or non-finite component, take no part. Vectors
    meet those of their own length; an empty vector scores 0. A row with the anchor's key is the
    anchor's own and no candidate; other repeated rows are candidates each, and a positive that is repeated has
    its negatives for each occurrence. Anchors with one key and different vectors are answered for the one that sorts
    first by label and vector. Scores are compared exactly whatever their size; those beyond a long are
    shown as the nearest long. A positive score below 0 has no negatives (its range is empty). Empty
    tables give no rows. Extra columns are ignored.
    """
    usable = lambda df: (
        df.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & taking_part(vector)).select(
            F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
            F.col(f"`{vector}`").cast("array<double>").alias("v"),
        )
    )
    every = usable(rows)
    asked = usable(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    total = lambda df: df.agg(F.sum(F.size("v") + 1)).first()[0] or 0
    groups = max(MIN_GROUPS, -(-total(every) // ROW_COMPONENTS))
    tiles = max(1, -(-total(asked) // ANCHOR_COMPONENTS))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # equal rows are kept apart by the partition that they are read in
    dealt = F.pmod(F.xxhash64("id", "label", "v", F.spark_partition_id()), F.lit(groups)).cast("int")
    left = every.withColumn("g", dealt).withColumn("t", numbers(tiles))
    tile = F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")

    def meet(some: DataFrame, search: Callable, schema: str) -> DataFrame:
        right = some.withColumn("t", tile).withColumn("g", numbers(groups))
        return left.groupBy("g", "t").cogroup(right.groupBy("g", "t")).applyInArrow(search, schema)

    near = _ranked(meet(asked, _positives(scale, positives), POSITIVE_FIELDS), positives, "anchor")
    lists = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score", "wide"))).alias("positives"))
    ready = asked.join(lists.withColumnRenamed("anchor", "id"), "id")
    far = meet(ready, _negatives(scale, negatives, low, high), NEGATIVE_FIELDS).withColumnRenamed("place", "at")
    return _ranked(far, negatives, "anchor", "at").select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("place").alias("rank"),
        F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
