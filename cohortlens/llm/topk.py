"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, received, sent

SCALE = 64
K = 20
EVERY = 20
#: Queries whose vectors go to every task together; more of them go over the rows again.
QUERY_BLOCK = 32_768
#: Rows and queries of one matrix product.
TILE_ROWS, TILE_QUERIES = 4096, 512
#: Partial lists of a query are merged so many at a time, then those results.
FAN = 64
#: Sums of products below these are exact in single precision, in double precision, and in whole numbers of 64 bits.
SINGLE, DOUBLE, LONG = 2.0**24, 2.0**53, 2.0**62


def finite(vector: str):
    """A vector's components as doubles; null where the vector takes no part."""
    x, numbers = F.col(f"`{vector}`"), F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    # nothing that is not finite is below
    usable = F.forall(numbers, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(usable, F.lit(False)) & (F.size(x) > 0), numbers)


def whole_numbers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Components as floor(scale * x): longs, or Python's whole numbers if one of them is too wide for a long."""
    if float(np.abs(vectors).max(initial=0)) < LONG / scale:
        return np.floor(vectors * scale).astype(np.int64)
    # a double of 2^53 or more is a whole number, and scale * x may be beyond the doubles
    exact = [int(x) * scale if abs(x) >= DOUBLE else math.floor(x * scale) for x in vectors.ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(vectors.shape)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly: longs, or Python's whole numbers where a product may not fit a long."""
    top = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * rows.shape[1]
    if top < SINGLE:
        return (queries.astype(np.float32) @ rows.astype(np.float32).T).astype(np.int64)
    if top < DOUBLE:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if top < LONG:
        return queries.astype(np.int64) @ rows.astype(np.int64).T
    return queries.astype(object) @ rows.astype(object).T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each line's ``k`` largest scores, ties to the smaller id (``ids`` has the shape of ``scores``)."""
    if scores.shape[1] > 4 * k:  # drop what can't be among them before sorting
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        width = int((scores >= floor).sum(axis=1).max())
        if width < scores.shape[1]:
            keep = np.argpartition(scores < floor, width - 1, axis=1)[:, :width]
            scores, ids = np.take_along_axis(scores, keep, 1), np.take_along_axis(ids, keep, 1)
    order = np.argsort(ids, axis=1, kind="stable")
    scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


#: Stands for no row in a list that is not full; its id is out of the way of all others.
NONE = -np.iinfo(np.int64).max
NO_ID = np.iinfo(np.int64).max


def together(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores side by side. Among wide ones no row's score is below all numbers."""
    if a.dtype != b.dtype:
        a, b = (np.where(x == NONE, -math.inf, x.astype(object)) if x.dtype != object else x for x in (a, b))
    return np.concatenate([a, b], 1)


class Lists:
    """The best rows so far for each query of a block, by tiles of queries."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int):
        self.queries, self.own, self.k = queries, own, k
        self.parts = [slice(low, low + TILE_QUERIES) for low in range(0, len(own), TILE_QUERIES)]
        self.ids = np.full((len(own), k), NO_ID)
        self.scores = [np.full((len(own[part]), k), NONE) for part in self.parts]

    def add(self, rows: np.ndarray, ids: np.ndarray) -> None:
        for i, part in enumerate(self.parts):
            scores = products(self.queries[part], rows)
            wide = np.broadcast_to(ids, scores.shape)
            own = wide == self.own[part][:, None]
            scores[own] = NONE if scores.dtype != object else -math.inf
            found, found_ids = best(scores, np.where(own, NO_ID, wide), self.k)
            both = together(self.scores[i], found), np.concatenate([self.ids[part], found_ids], 1)
            self.scores[i], self.ids[part] = best(*both, self.k)


def _matrices(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors of one length at a time: length, ids, whole numbers of at most TILE_ROWS rows."""
    lengths = np.diff(np.frombuffer(vectors.buffers()[1], np.int32)[vectors.offset : vectors.offset + len(vectors) + 1])
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts, ids = np.concatenate([[0], np.cumsum(lengths)[:-1]]), ids.to_numpy(zero_copy_only=False)
    for n in np.unique(lengths).tolist():
        chosen = np.flatnonzero(lengths == n)
        for low in range(0, len(chosen), TILE_ROWS):
            some = chosen[low : low + TILE_ROWS]
            yield n, ids[some], whole_numbers(flat[starts[some][:, None] + np.arange(n)])


def top_k(
    rows: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding",
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """For each query the ``k`` rows of the highest integer inner product: query_id, rank, key, score.

    Components count as floor(64 x), whatever their size; rows stand in the order of their exact scores. A score
    beyond a long is given as the largest or smallest long. Queries go to the tasks in blocks of ``query_block``; each task
    multiplies tiles of its rows with tiles of queries, keeps the best of each tile and merges them
    into its lists. The lists of the tasks are merged FAN at a time and then once more. Nothing grows
    with the rows but the number of lists, one per task and query; a block of queries and its
    lists are all that a task holds.

    Defined cases: vectors that are null or empty, or hold null or non-finite components, take no part, and neither do rows with a null key; a query meets only vectors of its
    own length; ties go to the smaller key; a row with the query's key is the query's own and no
    candidate; other repeated rows are candidates each; queries with one key and different vectors
    are answered for the one that sorts first. Fewer than ``k`` candidates give fewer rows; an
    empty table gives none. Extra columns are ignored.
    """
    spark = rows.sparkSession
    merge = _merging(k)

    def gathered(lists: DataFrame, *by: str) -> DataFrame:
        """The lists of each group merged into one."""
        all_of = [F.flatten(F.collect_list(c)).alias(c) for c in ("scores", "wide", "ids")]
        rest = [F.lit(0).alias(c) for c in ("part",) if c not in by]
        return lists.groupBy(*by).agg(*rest, *all_of).select("id", "part", "scores", "wide", "ids").mapInArrow(merge, schema)

    usable = lambda df: df.select(F.col(f"`{key}`").cast("long").alias("id"), finite(vector).alias("v")).filter(
        "id IS NOT NULL AND v IS NOT NULL"
    )
    asked, candidates = usable(queries).groupBy("id").agg(F.min("v").alias("v")), usable(rows)
    schema = "id long, part int, scores array<long>, wide array<string>, ids array<long>"
    name = fresh(["query_id", "rank", "score"], key)[0]
    out = None
    for block in _blocks(asked, query_block):
        sent_block = sent(spark, block)

        def search(batches: Iterator[pa.RecordBatch], sent_block=sent_block) -> Iterator[pa.RecordBatch]:
            lists = {n: Lists(whole_numbers(q), own, k) for n, (own, q) in received(sent_block).items()}
            touched = set()
            for batch in batches:
                for n, ids, matrix in _matrices(batch.column(0), batch.column(1)):
                    if n in lists and len(ids):
                        lists[n].add(matrix, ids)
                        touched.add(n)
            part = TaskContext.get().partitionId() // FAN
            for n in sorted(touched):
                found = lists[n]
                for tile, scores in zip(found.parts, found.scores):
                    yield _packed(found.own[tile], np.full(len(scores), part, np.int32), scores, found.ids[tile])

        partial = candidates.mapInArrow(search, schema)
        final = gathered(gathered(partial, "id", "part"), "id")
        ranked = final.select("id", F.posexplode(F.arrays_zip("scores", "ids")).alias("at", "x")).select(
            F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.ids").alias(name),
            F.col("x.scores").alias("score"),
        )
        out = ranked if out is None else out.union(ranked)
    if out is None:
        return spark.createDataFrame([], f"query_id long, rank int, `{name}` long, score long")
    return out


def _packed(own: np.ndarray, part: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Lists as rows, without the places that no row has taken; ``wide`` holds the scores beyond a long, as digits."""
    full = ids != NO_ID
    offsets = pa.array(np.concatenate([[0], np.cumsum(full.sum(1))]).astype(np.int32))
    kept = scores[full]
    if kept.dtype == object:
        wide = pa.array([str(x) if abs(x) >= LONG else None for x in kept], pa.string())
        kept = np.array([max(-NO_ID, min(NO_ID, x)) for x in kept], np.int64)
    else:
        wide = pa.nulls(len(kept), pa.string())
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(kept), wide, pa.array(ids[full]))]
    return pa.RecordBatch.from_arrays([pa.array(own), pa.array(part), *lists], ["id", "part", "scores", "wide", "ids"])


def _merging(k: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lists = [batch.column(i) for i in (2, 3, 4)]
            lengths = np.diff(np.frombuffer(lists[0].buffers()[1], np.int32)[lists[0].offset : lists[0].offset + n + 1])
            spot = np.arange(lengths.max(initial=1))[None, :] < lengths[:, None]
            given, digits = lists[0].flatten().to_numpy(), lists[1].flatten()
            scores, ids = np.full(spot.shape, NONE), np.full(spot.shape, NO_ID)
            if digits.null_count < len(digits):
                scores = np.full(spot.shape, -math.inf, object)
                exact = [int(x) if d is None else int(d) for x, d in zip(given, digits.to_pylist())]
                given = np.empty(len(exact), object)
                given[:] = exact
            scores[spot], ids[spot] = given, lists[2].flatten().to_numpy()
            yield _packed(batch.column(0).to_numpy(), batch.column(1).to_numpy(), *best(scores, ids, k))

    return merge


def _blocks(asked: DataFrame, size: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Queries by length of vector, at most ``size`` at a time; the driver holds one block."""
    kept: list[tuple[int, list[int]]] = []

    def packed() -> dict[int, tuple[np.ndarray, np.ndarray]]:
        lengths = {len(v) for _, v in kept}
        return {n: (np.array([i for i, v in kept if len(v) == n]), np.array([v for _, v in kept if len(v) == n])) for n in lengths}

    for row in asked.toLocalIterator():
        kept.append((row.id, row.v))
        if len(kept) == size:
            yield packed()
            kept = []
    if kept:
        yield packed()
