"""Projection verbs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import level_rank

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _range(df: DataFrame, first: str, last: str) -> list[str]:
    start, stop = df.columns.index(first), df.columns.index(last)
    return df.columns[start : stop + 1]


def select_range(df: DataFrame, first: str, last: str, keep: Sequence[str] = ()) -> DataFrame:
    """The named columns plus every column from ``first`` to ``last``."""
    return df.select(*keep, *_range(df, first, last))


def drop_range(df: DataFrame, first: str, last: str) -> DataFrame:
    return df.drop(*_range(df, first, last))


def with_cols(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns one after the other, so that later ones may use earlier ones."""
    for name, value in columns.items():
        df = df.withColumn(name, value)
    return df


def rename(df: DataFrame, new_from_old: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({old: new for new, old in new_from_old.items()})


def mutate_if_numeric(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """Apply ``fn`` to every numeric column."""
    numeric = {n for n, t in df.dtypes if t in NUMERIC_TYPES or t.startswith("decimal")}
    return df.select(*[fn(F.col(c)).alias(c) if c in numeric else F.col(c) for c in df.columns])


def mask_cells(df: DataFrame, keys: Sequence[str], cells: Sequence[tuple], value: str) -> DataFrame:
    """Set ``value`` to null in the rows whose key is one of ``cells``."""
    hidden = F.lit(False)
    for cell in cells:
        match = F.lit(True)
        for key, wanted in zip(keys, cell):
            match = match & F.col(key).eqNullSafe(F.lit(wanted))
        hidden = hidden | match
    return df.withColumn(value, F.when(~hidden, F.col(value)))


def arrange(df: DataFrame, *keys: str, levels: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Sort an output; columns with given levels sort in level order, others by value."""
    levels = levels or {}
    return df.orderBy(*[(level_rank(F.col(k), levels[k]) if k in levels else F.col(k)).asc_nulls_last() for k in keys])
