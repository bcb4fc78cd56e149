"""Substring dedup by hashing lines, paragraphs, sentences or blocks of words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, without

#: Fewer words than this repeat by chance and stay: of a unit, and of a stretch of blocks (half of a passage of 50
#: words, whose two edges fall into blocks of their own).
LEAST_WORDS, LEAST_STRETCH = 6, 25
#: Words of a block at least.
BLOCK_WORDS = 4
ROWS_AT_ONCE = 20_000

# What ends a unit. A sentence ends with its line or after a full stop, mark or colon and blanks.
ENDS = {
    "line": re.compile(r"\n"),
    "paragraph": re.compile(r"\n[^\S\n]*\n\s*"),
    "sentence": re.compile(r"\n|(?<=[.!?:])\s+"),
}
#: Where a block may end: after a long word, a sentence or a line. That depends on the words alone, so blocks end alike
#: in all copies of a passage, wherever the passage is joined in.
BLOCK_ENDS = re.compile(r"\b\w{9,}|[.!?:]\s+|\n\s*")
WORDS = re.compile(r"\w+")


def blocks(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and words of a text's blocks; every character is looked at a bounded number of times."""
    low, seen, words, found = 0, 0, [], WORDS.findall
    for m in BLOCK_ENDS.finditer(text):
        end = m.end()
        words += found(text, seen, end)
        seen = end
        if len(words) >= BLOCK_WORDS:
            yield low, end, words
            low, words = end, []
    yield low, len(text), words + found(text, seen)


def units(text: str, kind: str) -> Iterator[tuple[int, int]]:
    """Start and end (code points) of the pieces between unit ends."""
    low = 0
    for m in ENDS[kind].finditer(text):
        yield low, m.start()
        low = m.end()
    yield low, len(text)


def words_of(unit: str) -> list[str]:
    return WORDS.findall(unicodedata.normalize("NFKC", unit))


def worded(text: str, kind: str, least: int) -> Iterator[tuple[int, int, str, int]]:
    """Start, end, normal form and number of words of the units with enough words.

    The normal form is a unit's words, without case, punctuation, and different forms of one character.
    """
    if kind != "block":
        pieces = ((start, end, words_of(text[start:end])) for start, end in units(text, kind))
    elif unicodedata.is_normalized("NFKC", text):
        pieces = blocks(text)
    else:
        pieces = ((start, end, words_of(text[start:end])) for start, end, _ in blocks(text))
    least = max(least, 1)
    for start, end, words in pieces:
        if len(words) >= least:
            yield start, end, " ".join(words).casefold(), len(words)


def digest_of(unit: str) -> bytes:
    return blake2b(unit.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def without_units(text: str, gone: Iterable[int], kind: str, least: int, stretch: int) -> tuple[str, list[tuple[int, int]]]:
    """A text without the units of the given numbers, and the spans cut out, in one pass.

    With a ``stretch``, units that follow each other are cut out as one span, if they hold so many words together.
    """
    numbers, spans, last = set(gone), [], None
    for i, (start, end, _, words) in enumerate(worded(text, kind, least)):
        if i not in numbers:
            continue
        if stretch and last == i - 1:
            spans[-1] = (spans[-1][0], end, spans[-1][2] + words)
        else:
            spans.append((start, end, words))
        last = i
    spans = [(a, b) for a, b, words in spans if words >= stretch]
    kept, low = [], 0
    for a, b in spans:
        kept.append(text[low:a])
        low = b
    return "".join([*kept, text[low:]]), spans


def dedup_units(
    docs: DataFrame, text: str = "text", key: str = "doc_id", kind: str = "sentence", least_words: int = LEAST_WORDS,
    out: str = "kept_text", spans: str = "removed", least_stretch: int = 0,
) -> DataFrame:
    """Every row with ``out``, its text without units seen earlier, and ``spans``, what was removed.

    A unit is a line, a paragraph, a sentence of a line or a block of words, compared by a 128-bit digest of
    its words (no case, no punctuation). The earliest occurrence by (key, text hash, place) stays; later ones
    go, in the same text too. ``spans`` are (start, end) in code points of the original text, in
    order; ``out`` is what lies outside them. Blocks end where their words say, so a passage is found wherever it
    is joined in, but for its edges; with ``least_stretch`` only stretches of units that hold so many words go, as one
    span, and what repeats by chance stays.

    Digests fold to their earliest occurrence before they are shuffled; only those that occur again
    go on, as numbers of units. The join that finds later occurrences has one row per digest on one side, and a digest
    with very many occurrences is left to the engine's splitting of skewed joins. A text's removed
    units are no more than its units, and it is cut in one pass over it, which only texts with removed units take.

    Defined cases: null and empty texts have no units (null stays null); units of fewer than
    ``least_words`` words stay; rows equal in key and text count as one and keep the same units; null
    keys come last; texts with the same key rank by their hash; an empty table gives no rows. Result
    columns replace input columns of the same names.
    """
    keep = without(docs.columns, out, spans)
    h, found, cut = fresh([*keep, out, spans], "h", "found", "cut")
    marked = docs.select(*[f"`{c}`" for c in keep], F.xxhash64(F.col(f"`{text}`").cast("string")).alias(h))
    slim = marked.select(F.col(f"`{key}`").alias("k"), F.col(h).alias("h"), F.col(f"`{text}`").cast("string").alias("t"))
    schema = slim.drop("t").schema.add("high", "long").add("low", "long").add("unit", "integer")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes, texts = batch.columns
            rows, data, numbers = [], bytearray(), []

            def full() -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                pairs = np.frombuffer(bytes(data), "<i8").reshape(-1, 2)
                return pa.RecordBatch.from_arrays(
                    [keys.take(at), hashes.take(at), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(numbers, pa.int32())],
                    ["k", "h", "high", "low", "unit"],
                )

            for i, t in enumerate(texts):
                for n, (_, _, unit, _) in enumerate(worded(t.as_py() or "", kind, least_words)):
                    rows.append(i)
                    data += digest_of(unit)
                    numbers.append(n)
                    if len(rows) >= ROWS_AT_ONCE:
                        yield full()
                        rows, data, numbers = [], bytearray(), []
            yield full()

    occurrences = slim.mapInArrow(digests, schema)
    place = F.struct(F.col("k").isNull().alias("none"), "k", "h", "unit")
    firsts = (
        occurrences.groupBy("high", "low")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("high", "low", "first")
    )
    later = occurrences.join(firsts, ["high", "low"]).filter(place > F.col("first"))
    gone = later.groupBy("k", "h").agg(F.collect_set("unit").alias(found))
    match = marked[key].eqNullSafe(gone["k"]) & (marked[h] == gone["h"])
    joined = marked.join(gone, match, "left").select(*[marked[c] for c in keep], found)
    whole = F.col(f"`{text}`").cast("string")
    result = "kept string, spans array<struct<start:int,end:int>>"

    @F.arrow_udf(result)
    def without_gone(texts: pa.Array, units_gone: pa.Array) -> pa.Array:
        cuts = [
            None if t is None else without_units(t, gone, kind, least_words, least_stretch)
            for t, gone in zip(texts.to_pylist(), units_gone.to_pylist())
        ]
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        kept = pa.array([c and c[0] for c in cuts], pa.string())
        places = pa.array([c and [{"start": a, "end": b} for a, b in c[1]] for c in cuts], pa.list_(span))
        return pa.StructArray.from_arrays([kept, places], ["kept", "spans"])

    # texts that stay whole don't take the way through Python
    removed = joined.withColumn(cut, without_gone(F.when(F.col(found).isNotNull(), whole), F.col(found)))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return removed.withColumns(
        {out: F.coalesce(F.col(cut)["kept"], whole), spans: F.coalesce(F.col(cut)["spans"], none)}
    ).select(*[f"`{c}`" for c in keep], out, spans)
