"""Periodic runs of words by descending-LCP Kruskal.

The places of a text that begin with the same words form classes: the suffixes, sorted, are united
with their neighbours in the order of decreasing common prefix (LCP). Each class keeps its
places in order. When two classes meet at an LCP of l, places that become neighbours at a distance
p of at most l start a stretch of length p + l in which words p apart are equal.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, without
from .word_ranks import bucket_starts, numbered, slices

LEAST_LENGTH, LEAST_TIMES = 6, 4
#: Places in one block of an ordered set.
BLOCK = 1024
#: Words that are sorted at once before places without an equal are left out.
FIRST = 4
#: Comparisons of single words for all pairs together, before long ones are compared in blocks.
STEPS = 64
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Places:
    """An ordered set of places, in blocks, so that an insertion moves few of them."""

    def __init__(self, *places: int):
        self.blocks, self.lows, self.size = [sorted(places)], [min(places)], len(places)

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, place: int) -> tuple[int | None, int | None]:
        """Insert a place; its neighbours."""
        b = max(bisect_right(self.lows, place) - 1, 0)
        block = self.blocks[b]
        at = bisect_left(block, place)
        before = block[at - 1] if at else self.blocks[b - 1][-1] if b else None
        after = block[at] if at < len(block) else self.blocks[b + 1][0] if b + 1 < len(self.blocks) else None
        block.insert(at, place)
        self.lows[b] = block[0]
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks[b : b + 1] = [block[:half], block[half:]]
            self.lows[b : b + 1] = [block[0], block[half]]
        return before, after


def neighbours(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places whose suffixes are next to each other in sorted order, and their LCP (FIRST and more).

    Suffixes are ranked by doubling; a suffix whose rank is its own already is ranked no further.
    """
    n, width = len(ids), FIRST
    rank = bucket_starts(ids)[0]
    step = 1
    while step < width:
        last = np.append(rank[step:], np.full(min(step, n), -1))[:n]
        rank, size = bucket_starts(rank * (n + 1) + last + 1)
        step *= 2
    some = np.flatnonzero(size > 1) if n else np.empty(0, np.int64)
    if not len(some):
        return some, some, some
    bucket, left = rank[some].copy(), some
    while len(left):
        key = rank[left] * (n + 1) + rank[np.minimum(left + step, n - 1)]
        place, size = bucket_starts(key)
        whole = bucket_starts(rank[left])[0]
        rank[left] += place - whole  # the rank of a bucket counts all smaller suffixes
        left = left[size > 1]
        step *= 2
    order = np.argsort(rank[some], kind="stable")
    ordered, same = some[order], bucket[order][1:] == bucket[order][:-1]
    before, after = ordered[:-1][same], ordered[1:][same]
    by_place = np.argsort(after, kind="stable")
    after, before = after[by_place], before[by_place]
    return after, before, common_prefixes(ids, after, before)


def common_prefixes(ids: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
    """LCP of each place (ascending) with the suffix sorted before it.

    Where the words in front are equal too, it is one less than that of the place in front; only
    the others are compared, and their LCPs sum to no more than n log n.
    """
    front = (after > 0) & (before > 0)
    front[front] = ids[after[front] - 1] == ids[before[front] - 1]
    own = np.flatnonzero(~front)
    i, j, length = after[own], before[own], np.full(len(own), FIRST, np.int64)
    active = np.arange(len(own))
    for _ in range(STEPS):
        active = active[ids[i[active] + length[active]] == ids[j[active] + length[active]]]
        if not len(active):
            break
        length[active] += 1
    for k in active.tolist():
        a, b, size = int(i[k] + length[k]), int(j[k] + length[k]), 256
        while True:
            m = min(size, len(ids) - max(a, b))
            differ = np.flatnonzero(ids[a : a + m] != ids[b : b + m])
            if len(differ):
                length[k] += int(differ[0])
                break
            length[k] += m
            a, b, size = a + m, b + m, 2 * size
    at = np.zeros(len(after), np.int64)
    at[own] = own
    at = np.maximum.accumulate(at)
    value = np.empty(len(after), np.int64)
    value[own] = length
    return value[at] - (after - after[at])


def runs(texts: Sequence[Sequence], least_length: int = LEAST_LENGTH, times: int = LEAST_TIMES) -> list[list[tuple[int, int, int]]]:
    """For each sequence its runs (start, length, period) by start, then period.

    A run is a stretch with smallest period q and a length of at least ``least_length`` and ``times`` q
    that neither neighbour extends with that period.
    """
    ids, starts = numbered(texts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    least = least_length - least_length // max(times, 1)  # words that a run's start shares with the next period
    if times < 2 or least < FIRST:
        raise ValueError(f"runs have two periods or more, and {FIRST} words beyond the first period")
    i, j, lcp = neighbours(ids)
    some = lcp >= least
    i, j, lcp = i[some], j[some], lcp[some]
    places = np.unique(np.concatenate([i, j]))
    order = np.argsort(-lcp, kind="stable")
    parent = list(range(len(places)))
    sets: dict[int, Places] = {}
    where = places.tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    seeds: list[tuple[int, int, int]] = []

    def meet(a: int, b: int, shared_words: int) -> None:
        """Places a < b, now neighbours, with so many words in common from there on."""
        start, period = where[a], where[b] - where[a]
        if period + shared_words >= max(least_length, times * period) and (start == 0 or ids[start - 1] != ids[start + period - 1]):
            seeds.append((start, period + shared_words, period))

    edges = zip(lcp[order].tolist(), np.searchsorted(places, i[order]).tolist(), np.searchsorted(places, j[order]).tolist())
    for common, a, b in edges:
        a, b = root(a), root(b)
        big, small = sets.get(a), sets.get(b)
        if big is None and small is None:
            low, high = (a, b) if a < b else (b, a)
            parent[b], sets[a] = a, Places(low, high)
            meet(low, high, common)
            continue
        if (big.size if big else 1) < (small.size if small else 1):
            a, b, big, small = b, a, small, big
        moved = [b] if small is None else list(small)
        sets.pop(b, None)
        parent[b], last = a, None
        for at, x in enumerate(moved):
            before, after = big.add(x)
            if before is not None and before != last:
                meet(before, x, common)
            if after is not None and (at + 1 == len(moved) or moved[at + 1] > after):
                meet(x, after, common)
            last = x
    if seeds:
        owners = (np.searchsorted(starts, [s for s, _, _ in seeds], side="right") - 1).tolist()
        for of, (start, length, period) in zip(owners, seeds):
            found[of].append((start - int(starts[of]), length, period))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length to period; ties to the smallest start, then period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words are in no run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def find_runs(
    docs: DataFrame, text: str = "text", out: str = "periodic", least_length: int = LEAST_LENGTH, times: int = LEAST_TIMES
) -> DataFrame:
    """Every row with ``out``: n_words, its ``runs`` (start, length, period in words, by start, then period),
    the ``strongest`` run (greatest length to period; null without runs), and ``collapsed``, the words that no run
    holds after its first period, joined by one space.

    Words are `[^\\x20\\x09-\\x0D]+`, compared as they are. A map over rows without a shuffle; texts are
    sorted together in slices of a bounded size, and a longer text on its own: a task needs memory
    in proportion to one text. Work per text grows with n log n comparisons, and with the square root of a block
    more for the ordered sets.

    Defined cases: null and empty texts have no words and no runs; repeated rows are treated
    alike; an empty table gives no rows. ``out`` replaces an input column of its name.
    """
    keep = without(docs.columns, out)
    [whole] = fresh([*keep, out], "whole")
    rows = docs.select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").cast("string").alias(whole))
    kind = f"struct<n_words:bigint,runs:array<{RUN}>,strongest:{RUN},collapsed:string>"
    schema = rows.drop(whole).withColumn(out, F.lit(None).cast(kind)).schema
    run = pa.struct([(f, pa.int64()) for f in ("start", "length", "period")])
    result = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(run)), ("strongest", run), ("collapsed", pa.string())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_run = lambda r: dict(zip(("start", "length", "period"), r))
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for low, high in slices((len(t.as_py() or "") for t in column)):
                # bytes split at the blanks of ASCII, which are those of the words' definition
                texts = [(t.as_py() or "").encode().split() for t in column.slice(low, high - low)]
                values = []
                for words, found in zip(texts, runs(texts, least_length, times)):
                    kept = words if not found else [words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()]
                    best = strongest(found)
                    values.append({
                        "n_words": len(words), "runs": [as_run(r) for r in found], "strongest": best and as_run(best),
                        "collapsed": b" ".join(kept).decode(),
                    })
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(values, result)], [*keep, out])

    return rows.mapInArrow(find, schema)
