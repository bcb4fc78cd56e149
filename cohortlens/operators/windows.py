"""First-row picks, fills and running sums within groups.

Row order is never implied: verbs that depend on it take the order columns, ascending with
nulls last, and expect them to order the rows of a group fully. Fills and running sums are
prefix scans: the table is cut along (group, order) into runs of like size, each run is worked off
by itself, and what crosses a seam inside a group is carried over. ``small`` is for frames of a few
aggregated rows, where one window does.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import attach_group, order_runs, same_keys, sortable

START, END = Window.unboundedPreceding, Window.unboundedFollowing


def _ascending(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def _pick(df: DataFrame, by: Sequence[str], order: list[Column]) -> DataFrame:
    # row_number() = 1 is cut down before the shuffle (one row per group and task), so a hot
    # group never travels to one task as a whole
    numbered = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return numbered.filter("_rn = 1").drop("_rn")


def slice_first(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, by, _ascending(order))


def slice_min(
    df: DataFrame, by: Sequence[str], x: str, order: Sequence[str] = (), with_ties: bool = False
) -> DataFrame:
    """The row with the smallest ``x`` (nulls last), or every row that has it."""
    if not with_ties:
        return _pick(df, by, _ascending([x, *order]))
    lowest = attach_group(df, by, {"_lowest": F.min(x)})
    return lowest.filter(F.col(x).eqNullSafe(F.col("_lowest"))).drop("_lowest")


def slice_max(df: DataFrame, by: Sequence[str], x: str, order: Sequence[str] = ()) -> DataFrame:
    """The row with the largest ``x`` (nulls last)."""
    return _pick(df, by, [F.col(x).desc_nulls_last(), *_ascending(order)])


def group_max(df: DataFrame, by: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Add group maxima to every row; ``columns`` maps new names to source columns."""
    return attach_group(df, by, {new: F.max(old) for new, old in columns.items()})


def ref_value(
    df: DataFrame, by: Sequence[str], cond: Column, x: str, name: str, strict: bool = True, small: bool = False
) -> DataFrame:
    """Add the value ``x`` has in the group's reference row; not exactly one such row is an error."""
    found = {name: F.max(F.when(cond, F.col(x))), "_refs": F.count_if(cond)}
    out = attach_group(df, by, found, small)
    if strict:
        error = F.raise_error(F.lit("a group has not exactly one reference row")).cast(dict(df.dtypes)[x])
        out = out.withColumn(name, F.when(F.col("_refs") == 1, F.col(name)).otherwise(error))
    return out.drop("_refs")


def share_within(df: DataFrame, by: Sequence[str], n: str, name: str = "share", small: bool = False) -> DataFrame:
    """Add each row's share of the group total of ``n``."""
    out = attach_group(df, by, {"_total": F.sum(n)}, small)
    return out.withColumn(name, F.try_divide(F.col(n).cast("double"), F.col("_total").cast("double"))).drop("_total")


def _scan(
    df: DataFrame, by: Sequence[str], order: Sequence[str], local: Callable, edges: Mapping[str, Column],
    carried: Callable, finish: Mapping[str, Column], small: bool,
) -> DataFrame:
    """A prefix scan in the order of each group, without a group meeting in one task.

    ``local`` gives columns over a window (partition columns), within a run; ``edges`` are aggregates of a run;
    ``carried`` makes of them what comes over the seams (partition columns, order by run); ``finish`` puts the two
    together. One shuffle moves the rows; those of ``edges`` and ``carried`` move one row per run of a cut group.
    """
    keys = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(1))
    if small:
        found = rows.withColumns(local(keys)).withColumns({c: F.lit(None) for c in carried(keys)})
        return found.withColumns(finish).select(*df.columns, *[c for c in finish if c not in df.columns])
    runs, several = order_runs(rows, keys, order)
    summary = several.groupBy(*keys, "_run").agg(*[a.alias(n) for n, a in edges.items()])
    carry = summary.select(
        *[F.col(c).alias(f"_c_{c}") for c in [*keys, "_run"]], *[c.alias(n) for n, c in carried(keys).items()]
    )
    filled = runs.withColumns(local([*keys, "_run"]))
    # one row per run of a cut group: at most twice the cuts and as many groups
    joined = filled.join(F.broadcast(carry), same_keys(filled, carry, [(c, f"_c_{c}") for c in [*keys, "_run"]]), "left")
    return joined.withColumns(finish).select(*df.columns, *[c for c in finish if c not in df.columns])


def _edge(pick: Callable, c: str, order: Sequence[str]) -> Column:
    """A column's non-null value that comes first or last in order."""
    return pick(F.col(c), F.when(F.col(c).isNotNull(), sortable(order)))


def fill_up(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str], small: bool = False) -> DataFrame:
    """Replace nulls by the next non-null value of the group."""

    def local(keys):
        # running backwards lets the frame grow row by row; a frame that shrinks is recomputed per row
        back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_first() for c in order]).rowsBetween(START, 0)
        return {f"_l_{c}": F.last(c, ignorenulls=True).over(back) for c in cols}

    def carried(keys):
        later = Window.partitionBy(*keys).orderBy(F.desc("_run")).rowsBetween(START, -1)
        return {f"_n_{c}": F.last(f"_e_{c}", ignorenulls=True).over(later) for c in cols}

    edges = {f"_e_{c}": _edge(F.min_by, c, order) for c in cols}
    return _scan(df, by, order, local, edges, carried, {c: F.coalesce(f"_l_{c}", f"_n_{c}") for c in cols}, small)


def fill_down(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str], small: bool = False) -> DataFrame:
    """Replace nulls by the previous non-null value of the group."""

    def local(keys):
        w = Window.partitionBy(*keys).orderBy(*_ascending(order)).rowsBetween(START, 0)
        return {f"_l_{c}": F.last(c, ignorenulls=True).over(w) for c in cols}

    def carried(keys):
        earlier = Window.partitionBy(*keys).orderBy("_run").rowsBetween(START, -1)
        return {f"_p_{c}": F.last(f"_e_{c}", ignorenulls=True).over(earlier) for c in cols}

    edges = {f"_e_{c}": _edge(F.max_by, c, order) for c in cols}
    return _scan(df, by, order, local, edges, carried, {c: F.coalesce(f"_l_{c}", f"_p_{c}") for c in cols}, small)


def fill_downup(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str], small: bool = False) -> DataFrame:
    """Replace nulls by the previous non-null value of the group, or else by its first one."""

    def local(keys):
        w = Window.partitionBy(*keys).orderBy(*_ascending(order))
        previous = {f"_l_{c}": F.last(c, ignorenulls=True).over(w.rowsBetween(START, 0)) for c in cols}
        return previous | {f"_f_{c}": F.first(c, ignorenulls=True).over(w.rowsBetween(START, END)) for c in cols}

    def carried(keys):
        along = Window.partitionBy(*keys).orderBy("_run")
        earlier = {f"_p_{c}": F.last(f"_e_{c}", ignorenulls=True).over(along.rowsBetween(START, -1)) for c in cols}
        return earlier | {f"_n_{c}": F.first(f"_s_{c}", ignorenulls=True).over(along.rowsBetween(START, END)) for c in cols}

    edges = {f"_e_{c}": _edge(F.max_by, c, order) for c in cols} | {f"_s_{c}": _edge(F.min_by, c, order) for c in cols}
    finish = {c: F.coalesce(f"_l_{c}", f"_p_{c}", f"_n_{c}", f"_f_{c}") for c in cols}
    return _scan(df, by, order, local, edges, carried, finish, small)


def running_total(
    df: DataFrame, by: Sequence[str], order: Sequence[str], x: str, name: str = "cumsum", small: bool = False
) -> DataFrame:
    """Running sum in group order; after the first null everything is null.

    Runs are summed first and then together, so sums of doubles may differ in their last digits from
    a sum row by row; sums of whole numbers and decimals do not.
    """

    def local(keys):
        w = Window.partitionBy(*keys).orderBy(*_ascending(order)).rowsBetween(START, 0)
        return {"_total": F.sum(x).over(w), "_broken": F.max(F.col(x).isNull()).over(w)}

    def carried(keys):
        before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(START, -1)
        return {"_before": F.sum("_s").over(before), "_was_broken": F.max("_b").over(before)}

    edges = {"_s": F.sum(x), "_b": F.max(F.col(x).isNull())}
    kind = df.agg(F.sum(x).alias("s")).dtypes[0][1]
    value = F.coalesce(F.col("_before").cast(kind), F.lit(0).cast(kind)) + F.col("_total")
    whole = ~F.col("_broken") & ~F.coalesce(F.col("_was_broken").cast("boolean"), F.lit(False))
    return _scan(df, by, order, local, edges, carried, {name: F.when(whole, value).cast(kind)}, small)
