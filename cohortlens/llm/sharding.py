"""Proportional stratified interleaving of rows into shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PARTS, fresh, row_hash, running, unit_interval, without


def fractional_rank(rank: Column, count: Column, group: Column, seed: int) -> Column:
    """(rank - u) / count, with u in (0, 1) hashed from the group, so that sources of one row lie evenly too."""
    return (rank - F.greatest(unit_interval(F.xxhash64(F.lit(seed), group)), F.lit(2.0**-53))) / count


def interleave(
    docs: DataFrame, source: str = "source", shards: int = 40, seed: int = 42, parts: int = PARTS
) -> DataFrame:
    """Every row with its ``shard`` (from 0) and ``slot`` (gapless from 0 within the shard).

    Within each source the rows are shuffled by a seeded hash of all their columns and ranked; the
    row of rank r among n has the fractional rank (r - u) / n, u in (0, 1) from the source's hash. Sorted by it, every stretch of the
    whole holds each source in proportion, and cutting the sequence evenly gives shards that match
    the mixture and whose row counts differ by at most one. A shard holds of each source its share,
    give or take two rows.

    Neither a source nor the whole is sorted in one task: ranks come from sums over ``parts`` even
    parts (about one for each million rows) and from the order within a part. A long tail of sources
    of a row or two spreads over the parts like any other.

    Defined cases: a null source is a source of its own; ties in the hash go by source, and rows that
    are equal in all columns are interchangeable; null or empty texts are rows like others; with
    fewer rows than shards some shards stay empty; an empty table gives no rows. Result columns
    replace input columns named ``shard`` or ``slot``.
    """
    group, h, rank, count, share, spot, rows = fresh(
        [*docs.columns, "shard", "slot"], "group", "h", "rank", "count", "share", "spot", "rows"
    )
    keep = without(docs.columns, "shard", "slot")
    marked = docs.withColumns(
        {
            group: F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string"))),
            h: row_hash(docs, docs.columns, seed),
        }
    )
    one = F.lit(1).cast("long")
    ranked = running(marked, group, unit_interval(F.col(h)), [F.col(h)], one, rank, count, parts)
    placed = ranked.withColumn(share, fractional_rank(F.col(rank), F.col(count), F.col(group), seed))
    spots = running(placed, None, F.col(share), [F.col(h), F.col(group)], one, spot, rows, parts)
    shard = F.expr(f"cast((`{spot}` - 1) * {shards} div `{rows}` as int)")
    first = F.expr(f"(shard * `{rows}` + {shards - 1}) div {shards}")
    return (
        spots.withColumn("shard", shard)
        .withColumn("slot", F.col(spot) - 1 - first)
        .select(*[f"`{c}`" for c in keep], "shard", "slot")
    )
