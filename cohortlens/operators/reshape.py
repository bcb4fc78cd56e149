"""Unions, long/wide conversion and row expansion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack_rows(*frames: DataFrame) -> DataFrame:
    """Bag union by column name; the frames have the same columns."""
    return reduce(DataFrame.unionByName, frames)


def bind_rows(*frames: DataFrame) -> DataFrame:
    """Bag union by column name; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack_tables(tables: Mapping[str, DataFrame], section: str = "Section") -> DataFrame:
    """Report tables under each other, each row marked with its table's name."""
    return bind_rows(*[df.select(F.lit(name).alias(section), "*") for name, df in tables.items()])


def pivot_counts(df: DataFrame, ids: Sequence[str], names: str, values: Sequence) -> DataFrame:
    """Row counts per id and level, one column per level; levels that do not occur are null."""
    return df.groupBy(*ids).pivot(names, list(values)).agg(F.count(F.lit(1)))


def pivot_values(df: DataFrame, ids: Sequence[str], names: str, x: str, values: Sequence) -> DataFrame:
    """One column per level holding the (single) value of ``x``."""
    return df.groupBy(*ids).pivot(names, list(values)).agg(F.max(x))


def pivot_bool(df: DataFrame, by: Sequence[str], cond: Column, yes: str = "yes", no: str = "no") -> DataFrame:
    """Counts of rows that meet and rows that fail a condition, in one pass."""
    return df.groupBy(*by).agg(F.count_if(cond).alias(yes), F.count_if(~cond).alias(no))


def pivot_longer(df: DataFrame, cols: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """One row per listed column; null values keep their row."""
    ids = [c for c in df.columns if c not in cols]
    return df.unpivot(ids, list(cols), name, value)


def separate(df: DataFrame, col: str, sep: str, into: str) -> DataFrame:
    """The first piece of the text of ``col``."""
    return df.withColumn(into, F.split_part(F.col(col).cast("string"), F.lit(sep), F.lit(1)))


def unite(df: DataFrame, new: str, cols: Sequence[str], sep: str = "_", remove: bool = True) -> DataFrame:
    """Join columns as text; a null is written as NA."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in cols]
    out = df.withColumn("_united", F.concat_ws(sep, *text))
    return (out.drop(*cols) if remove else out.drop(new)).withColumnRenamed("_united", new)


def replicate_rows(df: DataFrame, times: Column) -> DataFrame:
    """Repeat each row ``times`` times (at least one)."""
    copies = F.sequence(F.lit(1), F.greatest(times.cast("int"), F.lit(1)))
    return df.withColumn("_copy", F.explode(copies)).drop("_copy")


def expand_years(df: DataFrame, first: Column, last: Column, name: str = "Year") -> DataFrame:
    """One row per whole year from ``first`` to ``last``; none if the range is empty or unknown."""
    return df.filter(first <= last).withColumn(name, F.explode(F.sequence(first.cast("int"), last.cast("int"))))
