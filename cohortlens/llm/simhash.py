"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, without, written

SHINGLE = 3
RADIUS = 3
BITS = 64
SEED = 42
#: Fingerprints of one bucket that a task compares with each other or with as many others.
TILE = 2048
#: Shingles hashed together, which bounds the memory for a long text.
PIECE = 1 << 16


def _pieces(data: bytes, width: int) -> Iterator[list[bytes]]:
    """Words of a text in lists; a list repeats the last ``width`` - 1 words of the one before."""
    low, kept, step = 0, [], PIECE * 8
    while low < len(data):
        high = low + step
        while high < len(data) and data[high] not in b" \t\n\x0b\x0c\r":
            high += 1
        words = kept + data[low:high].lower().split()
        yield words
        kept = words[1 - width :] if width > 1 else []
        low = high


def fingerprint(data: bytes, width: int = SHINGLE) -> int:
    """SimHash of a text: bit j is 1 if it is set in over half of the shingles' hashes."""
    ones, count = np.zeros(BITS, np.int64), 0
    digest = xxhash.xxh64_intdigest
    words: list[bytes] = []
    for words in _pieces(data, width):
        shingles = zip(*[words[i:] for i in range(width)])
        hashes = np.array([digest(s, SEED) for s in map(b" ".join, shingles)], "<u8")
        if len(hashes):
            ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
            count += len(hashes)
    if not count and words:
        return digest(b" ".join(words), SEED)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def with_fingerprints(
    docs: DataFrame, text: str = "text", width: int = SHINGLE, out: str = "fingerprint", carry: Sequence[str] | None = None
) -> DataFrame:
    """Every row (its columns ``carry``, or all) with its fingerprint as a long; 0 where there are no words."""
    keep = without(docs.columns if carry is None else carry, out)
    [whole] = fresh([*keep, out], "whole")
    bytes_of = F.encode(F.col(f"`{text}`").cast("string"), "UTF-8")
    rows = docs.select(*[f"`{c}`" for c in keep], bytes_of.alias(whole))
    schema = rows.drop(whole).withColumn(out, F.lit(0).cast("long")).schema

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            prints = np.array([fingerprint(t.as_buffer().to_pybytes(), width) if t.is_valid else 0 for t in texts], "<u8")
            columns = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prints.view("<i8"))], [*keep, out])

    return rows.mapInArrow(find, schema)


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Masks of which, for any ``radius`` bits, at least one leaves all of them out.

    Bit i stands for a vector of radius + 1 binary digits; the mask of a vector v keeps the bits whose
    vectors have an odd inner product with v. Of any ``radius`` vectors there is a v that is even with
    all, so two fingerprints that differ there agree under that mask.
    """
    top = (1 << (radius + 1)) - 1
    vector = [i % top + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, top + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (``radius`` bits or fewer) among a bucket's fingerprints."""
    links, left = [], np.unique(prints)
    while len(left) > 1:
        root, front, left = int(left[0]), [left[0]], left[1:]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= radius
            links += [(root, int(x)) for x in left[near]]
            front += list(left[near])
            left = left[~near]
    return links


def _linked(radius: int):
    """Links within each run of rows with the same bucket (rows come sorted by bucket)."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        keys = ("mask", "bits", "low", "high", "fp")

        def out(rows: list[np.ndarray], upto: int | None) -> pa.RecordBatch:
            *bucket, prints = [c[:upto] for c in rows]
            found: list[tuple[int, int]] = []
            if len(prints):
                turn = np.any([c[1:] != c[:-1] for c in bucket], axis=0)
                edges = np.concatenate([[0], np.flatnonzero(turn) + 1, [len(prints)]])
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    if b - a == 2:
                        x, y = prints[a:b].tolist()
                        if (x ^ y).bit_count() <= radius and x != y:
                            found.append((min(x, y), max(x, y)))
                    elif b - a > 2:
                        found += forest(prints[a:b], radius)
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for batch in batches:
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            rows[-1] = rows[-1].view(np.uint64)
            kept = [np.concatenate(x) for x in zip(kept, rows)] if kept else rows
            if not len(kept[0]):
                continue
            same = np.all([c == c[-1] for c in kept[:-1]], axis=0)
            cut = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0  # the last run may go on
            if cut:
                yield out(kept, cut)
                kept = [c[cut:] for c in kept]
        if kept:
            yield out(kept, None)

    return link


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column ``fp``) that connect what lies within ``radius`` bits.

    Each fingerprint goes to one bucket per covering mask. A bucket with more than ``tile`` of them is
    dealt into tiles by a hash, and every two tiles meet in a task of their own, so no bucket is
    capped and none meets in one task. Of a bucket's links only a spanning forest is returned: it
    connects the same fingerprints without a row for each pair.
    """
    masks = F.array(*[F.struct(F.lit(i).alias("mask"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(covering_masks(radius))])
    one = prints.select("fp", F.explode(masks).alias("k")).select("fp", "k.mask", F.col("fp").bitwiseAND(F.col("k.m")).alias("bits"))
    sizes = one.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = one.join(sizes, ["mask", "bits"]).withColumn("tiles", F.expr(f"cast((n + {tile - 1}) div {tile} as int)"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    met = shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tasks = met.select("mask", "bits", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    dealt = tasks.repartition("mask", "bits", "low", "high").sortWithinPartitions("mask", "bits", "low", "high")
    return dealt.mapInArrow(_linked(radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a, b): rows (``node``, ``root``), a node's root the smallest of its component.

    Alternating stars: each node's greater neighbours are hung on its smallest neighbour, then each
    node and its smaller neighbours are, until nothing changes; the number of rounds grows with the
    logarithm of the longest chain. Neighbours are never gathered: a round is two minima and two
    joins with one row per node on one side. Each round is written, so that a lost executor costs no
    more than the round.
    """
    edges = written(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).select("a", "b"), "links")
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark.n:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = written(small.distinct(), "links")


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE, radius: int = RADIUS,
    fingerprint: str = "fingerprint", component: str = "component_id", carry: Sequence[str] | None = None,
) -> DataFrame:
    """Every row (its columns ``carry``, or all) with ``fingerprint`` (long) and ``component``, the smallest key reachable.

    Shingles are ``width`` words (lower case A-Z, split at ASCII white space) with repeats; texts of
    fewer words are one shingle, texts without words have fingerprint zero and link like any other.
    Fingerprints link at ``radius`` or fewer differing bits; links chain.

    Fingerprints are written once with the rows. Copies fold into one row per fingerprint before
    anything is compared, buckets follow :func:`links`, components :func:`components`. The last join
    has one row per fingerprint on one side; a fingerprint with very many rows is left to the
    engine's splitting of skewed joins.

    Defined cases: a null text counts as one without words; keys that repeat are allowed (rows link
    by text, not by key); a component of rows without keys has a null id; an empty table gives no rows.
    Result columns replace input columns of the same names.
    """
    keep = without(docs.columns if carry is None else carry, fingerprint, component)
    [fp] = fresh([*keep, component], "fp")
    marked = written(with_fingerprints(docs, text, width, fp, keep), "fingerprints")
    found = classes(marked, fp, F.col(f"`{key}`"), radius).toDF(fp, component)
    return marked.join(found, fp).select(*[f"`{c}`" for c in keep], F.col(fp).alias(fingerprint), component)


def classes(marked: DataFrame, fp: str, least: Column, radius: int = RADIUS) -> DataFrame:
    """For each fingerprint (column ``fp``) the minimum ``least`` of its component: rows (fp, component)."""
    nodes = marked.groupBy(F.col(fp).alias("fp")).agg(F.min(least).alias("least"))
    stars = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(stars, nodes["fp"] == stars["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return rooted.join(lowest, "root").select("fp", "component")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Of each group of near duplicates the row with the smallest key (nulls last; any one of equals).

    Rows are numbered as they are written with their fingerprints, and found again by number.
    """
    fp, row = fresh(docs.columns, "fp", "row")
    marked = written(with_fingerprints(docs, text, width, fp).withColumn(row, F.monotonically_increasing_id()), "fingerprints")
    order = F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("key"), F.col(row).alias("row"))
    first = classes(marked.select(fp, f"`{key}`", row), fp, order, radius).select(F.col("component.row").alias(row)).distinct()
    return marked.join(first, row, "left_semi").drop(fp, row)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
