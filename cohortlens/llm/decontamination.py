"""Benchmark decontamination by Wu-Manber multi-pattern search.

A text becomes its words with one blank after each; a pattern is a window of consecutive words of a
benchmark item in the same form. Wu-Manber reads the last few bytes (a block) of the place where a
pattern could lie: a shift table says how far the search may jump because no pattern has that block
so near its end; where the shift is zero, a bucket of patterns with that suffix hash is taken, their
first bytes are looked at, and what remains is compared directly.

Each task searches many stretches of its texts at once, one cursor per stretch, so that the tables
are read for thousands of places per step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import received, sent, without, written

WINDOW = 10
#: Bytes of benchmark texts that one search holds in memory; more of them are searched block by block.
BLOCK_BYTES = 4 << 20
#: Bytes of text that a task looks at together (one longer text is looked at alone).
CHUNK_BYTES = 4 << 20
STRETCH = 2048
TABLE_BITS = 20
END = 0  # after each text; no pattern holds it
BLANK = 32

RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<first:bigint,last:bigint>>>"
_RESULT = pa.struct(
    [
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
    ]
)


def _letters() -> np.ndarray:
    """Word bytes as they are, but A-Z in lower case; all others as a blank."""
    letters = np.full(256, BLANK, np.uint8)
    words = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    letters[words] = words
    letters[0x41:0x5B] = np.arange(0x61, 0x7B)
    return letters


LETTERS = _letters()


def normalised(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Texts that lie end to end as words with a blank after each, and END after each text."""
    x = np.insert(LETTERS[data], np.repeat(ends, 2), np.tile(np.array([BLANK, END], np.uint8), len(ends)))
    word = x > BLANK
    after_word = np.empty_like(word)
    after_word[:1], after_word[1:] = False, word[:-1]
    return x[word | (after_word & (x == BLANK)) | (x == END)]


def word_starts(x: np.ndarray) -> np.ndarray:
    word = x > BLANK
    word[1:] &= ~word[:-1].copy()
    return np.flatnonzero(word)


def _eight(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number, at every place but the last seven."""
    return np.ndarray(len(x) - 7, "<u8", x, strides=(1,))


@dataclass
class Tables:
    """The patterns of similar length: all are searched by their first ``m`` bytes."""

    m: int
    block: int
    shift: np.ndarray
    suffixes: np.ndarray  # sorted, of the patterns in the same order
    heads: np.ndarray  # first bytes
    numbers: np.ndarray  # of the patterns

    def hashed(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)

    def cut(self, eight: np.ndarray) -> np.ndarray:
        """Of the eight bytes that end somewhere, those that make the block."""
        return eight >> np.uint64(8 * (8 - self.block))


@dataclass
class Patterns:
    buffer: bytes  # normalised items
    starts: np.ndarray  # of a pattern in the buffer
    ends: np.ndarray
    words: np.ndarray
    first: np.ndarray  # items of pattern i: owners[first[i]:first[i + 1]]
    owners: np.ndarray
    items: list[str]
    tables: list[Tables]


def _head(x: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    return _eight(x)[starts] & np.uint64((1 << 8 * min(8, m)) - 1)


def _tables(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> Tables:
    m = int(lengths[chosen].min())
    block = min(8, m)
    t = Tables(m, block, np.full(1 << TABLE_BITS, m - block + 1, np.int64), *[np.empty(0)] * 3)
    begins, eights = starts[chosen], _eight(x)
    for end in range(block, m + 1):  # where a block may end in a pattern; the last one allows no jump
        np.minimum.at(t.shift, t.hashed(t.cut(eights[begins + end - 8])), m - end)
    suffix = t.cut(eights[begins + m - 8])
    order = np.argsort(suffix, kind="stable")
    t.suffixes, t.numbers = suffix[order], chosen[order]
    t.heads = _head(x, begins[order], m)
    return t


def build(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Patterns:
    """Search tables of (item id, text): the distinct windows, grouped by length up to a factor of two."""
    texts = [(t or "").encode() for _, t in items]
    x = normalised(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64))
    x = np.concatenate([np.zeros(8, np.uint8), x, np.zeros(8, np.uint8)])
    buffer, at = x.tobytes(), word_starts(x)
    after = np.append(at[1:], len(x))  # where the next word starts; a text's last word ends before its END
    edges = np.flatnonzero(x[8:-8] == END) + 8
    counts = np.searchsorted(at, edges)
    found: dict[bytes, tuple[int, int, int]] = {}
    owned: dict[bytes, set[int]] = {}
    low = 0
    for i, high in enumerate(counts):
        high, k = int(high), min(window, int(high) - low)
        for w in range(low, high - k + 1) if k else ():
            start, end = int(at[w]), min(int(after[w + k - 1]), int(edges[i]))
            key = buffer[start:end]
            found.setdefault(key, (start, end, k))
            owned.setdefault(key, set()).add(i)
        low = high
    spots = np.array(list(found.values()), np.int64).reshape(-1, 3)
    names = [None if n is None else str(n) for n, _ in items]
    owners = [sorted(j for j in o if names[j] is not None) for o in owned.values()]
    first = np.concatenate([[0], np.cumsum([len(o) for o in owners], dtype=np.int64)]).astype(np.int64)
    lengths = spots[:, 1] - spots[:, 0]
    classes = np.floor(np.log2(lengths)).astype(int) if len(lengths) else lengths
    tables = [_tables(x, spots[:, 0], lengths, np.flatnonzero(classes == c)) for c in np.unique(classes)]
    flat = np.array([j for o in owners for j in o], np.int64)
    return Patterns(buffer, spots[:, 0], spots[:, 1], spots[:, 2], first, flat, names, tables)


def ends_of(x: np.ndarray, t: Tables) -> np.ndarray:
    """Places after which a pattern's first ``m`` bytes may have ended (its suffix has a bucket)."""
    eights = _eight(x)
    lows = np.arange(8, len(x), STRETCH)
    at, last = np.maximum(lows + 1, 8 + t.m), np.minimum(lows + STRETCH, len(x) - 8)
    hits = []
    going = at <= last
    at, last = at[going], last[going]
    while len(at):
        jump = t.shift[t.hashed(t.cut(eights[at - 8]))]
        stop = jump == 0
        if stop.any():
            hits.append(at[stop])
        at = at + np.maximum(jump, 1)
        going = at <= last
        if not going.all():
            at, last = at[going], last[going]
    return np.concatenate(hits) if hits else np.empty(0, np.int64)


def search(x: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences in normalised texts (8 bytes of END before and after): places and pattern numbers."""
    places, numbers = [], []
    text = memoryview(x)
    for t in patterns.tables:
        ends = ends_of(x, t)
        key = t.cut(_eight(x)[ends - 8])
        low, high = np.searchsorted(t.suffixes, key, "left"), np.searchsorted(t.suffixes, key, "right")
        start = ends - t.m
        some = (high > low) & (x[start - 1] <= BLANK)  # a window begins with a word's first byte
        low, start, many = low[some], start[some], (high - low)[some]
        for at in range(0, len(low), 100_000):  # bounds the candidates held at once
            n = many[at : at + 100_000]
            slot = np.repeat(low[at : at + 100_000] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            where = np.repeat(start[at : at + 100_000], n)
            alike = t.heads[slot] == _head(x, where, t.m)
            for p, number in zip(where[alike].tolist(), t.numbers[slot[alike]].tolist()):
                a, b = int(patterns.starts[number]), int(patterns.ends[number])
                if text[p : p + b - a] == patterns.buffer[a:b]:
                    places.append(p)
                    numbers.append(number)
    return np.array(places, np.int64), np.array(numbers, np.int64)


def _hits(texts: pa.Array, patterns: Patterns) -> list[dict]:
    """For each text its words, the covered ones and the items found."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    x = normalised(raw, offsets[1:] - offsets[0])
    pad = np.zeros(8, np.uint8)
    x = np.concatenate([pad, x, pad])
    at = word_starts(x)
    edges = np.searchsorted(at, np.concatenate([[0], np.flatnonzero(x[8:-8] == END) + 8]))
    places, numbers = search(x, patterns)
    out = [{"n_words": int(n), "n_hit": 0, "items": [], "spans": []} for n in np.diff(edges)]
    if not len(places):
        return out
    first = np.searchsorted(at, places)
    cover = np.zeros(len(at) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + patterns.words[numbers], -1)
    covered = np.cumsum(cover[:-1]) > 0
    doc = np.searchsorted(edges, first, "right") - 1
    for d in np.unique(doc).tolist():
        low, high = edges[d], edges[d + 1]
        flags = np.concatenate([[0], covered[low:high].astype(np.int8), [0]])
        turns = np.flatnonzero(np.diff(flags)).reshape(-1, 2)
        out[d]["n_hit"] = int(flags.sum())
        out[d]["spans"] = [{"first": int(a), "last": int(b) - 1} for a, b in turns]
    pairs = np.unique(np.stack([doc, numbers]), axis=1)
    for d in np.unique(pairs[0]).tolist():
        own = pairs[1][pairs[0] == d]
        found = {i for n in own.tolist() for i in patterns.owners[patterns.first[n] : patterns.first[n + 1]].tolist()}
        out[d]["items"] = sorted({patterns.items[i] for i in found})
    return out


def _joined(a: dict, b: dict) -> dict:
    """Hits of two blocks of items in one text."""
    words = sorted({w for s in [*a["spans"], *b["spans"]] for w in range(s["first"], s["last"] + 1)})
    spans: list[dict] = []
    for w in words:
        if spans and spans[-1]["last"] == w - 1:
            spans[-1]["last"] = w
        else:
            spans.append({"first": w, "last": w})
    items = sorted({*a["items"], *b["items"]})
    return {"n_words": a["n_words"], "n_hit": len(words), "items": items, "spans": spans}


def _chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """Stretches of about CHUNK_BYTES."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES, "right")) - 1)
        yield texts[low:high]
        low = high


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """Items in lists of bounded size; the driver holds one list at a time."""
    block: list[tuple] = []
    size = 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text).cast("string")).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "") * 4
        if size >= block_bytes:
            yield block
            block, size = [], 0
    yield block


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, out: str = "decontamination", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Every row with ``out``: words, words inside an occurrence of a window, items, covered spans of words.

    Words are runs of anything but ASCII other than letters and digits, in lower case (A-Z only). A
    window is ``window`` consecutive words of an item; an item of fewer, but some, is one window.
    ``spans`` number the text's words from 0 (``last`` included), ``items`` are sorted as strings.

    The benchmark is the stated set that every text is held against: it is read in blocks of
    ``block_bytes``, whose tables go to the tasks; a second and later block goes over the written
    result of the one before. Documents are not shuffled; a task holds ``CHUNK_BYTES`` of text at a
    time, or one longer text.

    Defined cases: null and empty texts have no words and no hits; items without words have no
    windows; windows of an item without id cover words but name no item; items that share a window
    or an id count by distinct id; an empty benchmark hits nothing; repeated rows are marked alike; an empty
    table gives no rows. ``out`` replaces an input column of its name.
    """
    keep = without(docs.columns, out)
    state = docs.select(*[f"`{c}`" for c in keep]).withColumn(out, F.lit(None).cast(RESULT))
    for number, block in enumerate(_blocks(benchmark, item, item_text, block_bytes)):
        tables = sent(docs.sparkSession, build(block, window))
        if number:
            state = written(state, "decontamination")

        def find(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            patterns = received(tables)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
                found = [hit for part in _chunks(texts) for hit in _hits(part, patterns)]
                before = batch.column(batch.schema.get_field_index(out)).to_pylist()
                found = [b if a is None else _joined(a, b) for a, b in zip(before, found)]
                columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, _RESULT)], [*keep, out])

        state = state.mapInArrow(find, state.schema)
    return state
