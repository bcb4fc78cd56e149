"""Keeping large groups out of a single task.

Nothing here looks at the data while a plan is built, and no list of keys is gathered. Joins have
one row per key on one side as a rule, so adaptive execution can split a partition that a hot key
fills; a caller that knows better deals a join out by ``salts``. Verbs that follow the order of
rows are prefix scans over runs of rows, which have like sizes however the rows fall into groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_keys(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Equality on key pairs that lets null meet null."""
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def row_spread(columns: Sequence[str], n: Column) -> Column:
    """A number below ``n`` that also separates equal rows read by different tasks."""
    return F.pmod(F.xxhash64(*columns) + F.spark_partition_id(), n)


def attach_group(df: DataFrame, by: Sequence[str], aggs: Mapping[str, Column], small: bool = False) -> DataFrame:
    """Put group aggregates on every row of the group.

    The aggregates are combined before the shuffle and joined back, so rows of a group never have to
    meet. ``small`` is for frames of a few aggregated rows, where a window is cheaper.
    """
    if small:
        w = Window.partitionBy(*by)
        return df.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    values = df.groupBy(*by).agg(*[a.alias(f"_a_{n}") for n, a in aggs.items()])
    side = values.withColumnsRenamed({c: f"_g_{c}" for c in by})
    joined = df.join(side, same_keys(df, side, [(c, f"_g_{c}") for c in by]), "left")
    return joined.select(*[df[c] for c in df.columns], *[side[f"_a_{n}"].alias(n) for n in aggs])


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "left", salts: int | None = None
) -> DataFrame:
    """Equi-join; ``how`` is ``left``, ``inner`` or ``left_semi``; the right key columns are dropped.

    With ``salts`` the left rows of each key are dealt out over so many tasks, and each right row is
    repeated for all of them.
    """
    if how not in ("left", "inner", "left_semi"):
        raise ValueError(f"unsupported join type {how!r}")
    hidden = right.withColumnsRenamed({b: f"_r_{b}" for _, b in on})
    if salts is None:
        return left.join(hidden, [left[a] == hidden[f"_r_{b}"] for a, b in on], how).drop(*[f"_r_{b}" for _, b in on])
    salted = left.withColumn("_salt", row_spread(left.columns, F.lit(salts)))
    repeated = hidden.withColumn("_rsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    cond = [salted[a] == repeated[f"_r_{b}"] for a, b in on] + [salted["_salt"] == repeated["_rsalt"]]
    return salted.join(repeated, cond, how).drop("_salt", "_rsalt", *[f"_r_{b}" for _, b in on])


def sortable(order: Sequence[str]) -> Column:
    """A struct that sorts like the order columns, nulls last."""
    return F.struct(*[x.alias(f"{k}{i}") for i, c in enumerate(order) for k, x in (("n", F.col(c).isNull()), ("v", F.col(c)))])


#: Cuts drawn for a scan (a table of 10^10 rows falls into runs of some million rows), the rows that a run has at
#: least, and the cuts that are looked through at a time.
CUTS, RUN_ROWS, BLOCK = 8192, 10_000, 128


def order_cuts(df: DataFrame, by: Sequence[str], order: Sequence[str], cuts: int = CUTS) -> DataFrame:
    """Places in the groups (``by`` and ``_cut``) that cut the table into runs of like size.

    They are the table's own rows whose hash falls below a share of all hashes: about ``cuts`` of them, one for
    RUN_ROWS rows in a smaller table, and never more than twice ``cuts``. A group has as many as its share of the
    rows; most groups have none. The cuts depend on the rows alone, so a task that is run again, or a
    second look at the table, finds the same ones.
    """
    rows = F.greatest(df.agg(F.count(F.lit(1)).cast("double")).scalar(), F.lit(1.0))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(7), *by, *order), 11).cast("double") * F.lit(2.0**-53)
    drawn = df.select(*by, *order).filter(unit < F.least(F.lit(float(cuts)) / rows, F.lit(1.0 / RUN_ROWS)))
    return drawn.distinct().select(*by, sortable(order).alias("_cut")).limit(2 * cuts)


def order_runs(
    df: DataFrame, by: Sequence[str], order: Sequence[str], cuts: int = CUTS
) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_run``, the number of cuts of a row's group at or before it, and the rows of the groups that have cuts.

    A run is a stretch of a group's rows in order; rows share one for certain only if they share all order
    values. What is carried from run to run concerns the groups with cuts only, ``2 * cuts`` at most. A row finds its
    run among the first cuts of its group's blocks and then within a block, both broadcast.
    """
    numbered = order_cuts(df, by, order, cuts).withColumn(
        "_block", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy("_cut")) - 1) / BLOCK).cast("int")
    )
    within = numbered.groupBy(*by, "_block").agg(F.sort_array(F.collect_list("_cut")).alias("_cuts"))
    firsts = within.groupBy(*by).agg(F.sort_array(F.collect_list(F.col("_cuts")[0])).alias("_firsts"))
    place = sortable(order)

    def joined(rows: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
        hidden = side.withColumnsRenamed({c: f"_g_{c}" for c in keys})
        return rows.join(F.broadcast(hidden), same_keys(rows, hidden, [(c, f"_g_{c}") for c in keys]), how)

    def upto(array: str) -> Column:
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(BLOCK.bit_length()))])
        # there is nothing (null) beyond the last cut
        step = lambda at, n: F.when(F.get(array, at + n - 1) <= place, at + n).otherwise(at)
        return F.when(F.col(array).isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), step))

    blocked = joined(df, firsts, by).withColumn("_block", upto("_firsts") - 1).select(*df.columns, "_block")
    found = joined(blocked, within, [*by, "_block"]).withColumn(
        "_run", F.when(F.col("_block") < 0, 0).otherwise(F.col("_block") * BLOCK + upto("_cuts"))
    )
    rows = found.select(*df.columns, "_run")
    return rows, joined(rows, firsts.select(*by), by, "left_semi")
