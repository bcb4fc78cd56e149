"""Words as numbers: equal stretches of words in texts, found by sorting."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from itertools import count

import numpy as np

#: Texts are numbered together up to so many characters; a longer text stands alone.
CHARS_AT_ONCE = 2_000_000


def slices(lengths: Iterable[int], most: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of at most ``most`` characters in all, or of one text."""
    low, held, i = 0, 0, -1
    for i, n in enumerate(lengths):
        if i > low and held + n > most:
            yield low, i
            low, held = i, 0
        held += n
    if i >= low:
        yield low, i + 1


def numbered(texts: Sequence[Sequence]) -> tuple[np.ndarray, np.ndarray]:
    """All words as numbers, and where each text begins.

    Equal words of a text have equal numbers; different texts share none. Each text is followed by a
    number of its own, so that no stretch equals another across the end of a text.
    """
    fresh = count()
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    ids = np.empty(starts[-1], np.int64)
    for words, low, high in zip(texts, starts[:-1].tolist(), starts[1:].tolist()):
        known = defaultdict(fresh.__next__)
        ids[low : high - 1] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        ids[high - 1] = next(fresh)
    return ids, starts[:-1]


def shared(keys: np.ndarray) -> np.ndarray:
    """The class of each key among equal keys, -1 for one that is alone."""
    _, classes, sizes = np.unique(keys, return_inverse=True, return_counts=True)
    return np.where(sizes[classes] > 1, classes, -1)


def repeated(ids: np.ndarray, width: int) -> np.ndarray:
    """Whether a place lies in a stretch of ``width`` numbers that stands in two places or more."""
    classes, n = shared(ids), 1
    while n < width:  # stretches of n and step numbers make one of n + step
        step = min(n, width - n)
        at = np.flatnonzero((classes[:-step] >= 0) & (classes[step:] >= 0))
        longer = np.full(len(ids), -1, np.int64)
        longer[at] = shared(classes[at] * (len(ids) + 1) + classes[at + step])
        classes, n = longer, n + step
    edges = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(classes >= 0)
    np.add.at(edges, at, 1)
    np.add.at(edges, np.minimum(at + width, len(ids)), -1)
    return np.cumsum(edges[:-1]) > 0


def bucket_starts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the number of smaller keys, and the number of equal ones."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(keys)))
    place, size = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    place[order], size[order] = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    return place, size
