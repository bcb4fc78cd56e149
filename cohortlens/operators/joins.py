"""Joins and membership tests. Null keys never match unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import salted_join
from .windows import fill_down


def _keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return df.select(*([key] if isinstance(key, str) else key)).distinct()


def semi(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None, salts: int | None = None) -> DataFrame:
    """Rows whose key occurs in ``other``. The other side is cut to distinct keys first."""
    other_key = other_key or key
    return salted_join(df, _keys(other, other_key), [(key, other_key)], "left_semi", salts)


def in_flag(
    df: DataFrame, other: DataFrame, key: str, name: str, other_key: str | None = None, salts: int | None = None
) -> DataFrame:
    """Add whether the key occurs in ``other`` as a true/false column."""
    other_key = other_key or key
    found = _keys(other, other_key).withColumn("_found", F.lit(True))
    out = salted_join(df, found, [(key, other_key)], "left", salts)
    return out.withColumn(name, F.coalesce(F.col("_found"), F.lit(False))).drop("_found")


def left_join(
    a: DataFrame, b: DataFrame, on: Sequence[tuple[str, str]], how: str = "left", salts: int | None = None
) -> DataFrame:
    """Left (or inner) join on (left, right) key pairs; other shared names get ``_right`` on the right."""
    right_keys = {r for _, r in on}
    clashes = {c: f"{c}_right" for c in b.columns if c in a.columns and c not in right_keys}
    return salted_join(a, b.withColumnsRenamed(clashes), on, how, salts)


def parent_join(
    people: DataFrame, key: str, parent_key: str, columns: Sequence[str], salts: int | None = None
) -> DataFrame:
    """Each person next to their parent: ``columns`` of both, as Child… and Parent…."""
    child = people.filter(F.col(parent_key).isNotNull()).select(
        F.col(parent_key).alias("_parent"), F.col(key).alias(f"Child{key}"),
        *[F.col(c).alias(f"Child{c}") for c in columns],
    )
    parent = people.select(F.col(key).alias(f"Parent{key}"), *[F.col(c).alias(f"Parent{c}") for c in columns])
    joined = salted_join(child, parent.withColumn("_id", F.col(f"Parent{key}")), [("_parent", "_id")], "inner", salts)
    return joined.drop("_parent")


def zip_by_key(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Two aggregated frames side by side, matched on their key and never by position."""
    return a.join(b, list(key), "left")


def latest_before(
    states: DataFrame, marks: DataFrame, key: str, when: str, mark: str, gap: Column | None = None,
    salts: int | None = None,
) -> DataFrame:
    """For each mark, the latest state strictly before it: key, mark and ``when``.

    ``marks`` has one row per key. Repeated states are folded before the join and the join is
    followed by a combined maximum, so pairs are never piled up. ``gap`` tests the result.
    """
    dates = states.select(key, when).distinct()
    paired = salted_join(dates, marks.select(key, mark), [(key, key)], "inner", salts).filter(F.col(when) < F.col(mark))
    out = paired.groupBy(key, mark).agg(F.max(when).alias(when))
    return out if gap is None else out.filter(gap)


def asof_before(
    states: DataFrame, marks: DataFrame, key: str, when: str, mark: str, order: Sequence[str] = ()
) -> DataFrame:
    """Every row of ``marks`` (any number per key) with ``when``, the latest state of its key strictly before ``mark``.

    States and marks lie in one frame in the order of time, marks before states of the same moment, and the last
    state is carried down; ``order`` names further columns of the marks that order a key's rows fully. A mark
    without an earlier state, a mark without a time, and a mark without a key have null.
    """
    known = states.filter(F.col(key).isNotNull() & F.col(when).isNotNull()).select(key, when).distinct()
    rows = marks.drop(when).withColumns({"_at": F.col(mark), "_state": F.lit(0)}).unionByName(
        known.withColumns({"_at": F.col(when), "_state": F.lit(1)}), allowMissingColumns=True
    )
    carried = fill_down(rows, [key], ["_at", "_state", *order], [when])
    usable = F.col(key).isNotNull() & F.col(mark).isNotNull()
    return carried.filter("_state = 0").withColumn(when, F.when(usable, F.col(when))).drop("_at", "_state")
