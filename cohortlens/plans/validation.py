"""The contract of the episode table, checked: violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules, in order, with what is counted for each.
RULES = {
    "repeated Episode": "rows that repeat an Episode of their person",
    "unknown DoB": "rows without a date of birth",
    "several DoB": "1 if a person's known dates of birth differ",
    "several DoD": "1 if a person's known dates of death differ (it may stand on some rows only)",
    "several Sex": "1 if a person's known codes differ, and 1 if some are known and some not",
    "starts after DoD": "rows that start after the date of death they hold",
    "starts before DoB": "rows that start before the date of birth they hold",
    "ends before start": "rows that end before they start",
    "unknown person": "rows without a person",
}


def _mixed(low: str, high: str) -> Column:
    return (F.col(low) < F.col(high)).cast("long")


def episode_violations(episodes: DataFrame) -> DataFrame:
    """Persons that break the contract of the episode table, one row per person and rule with the number of cases.

    Episodes are folded per (person, Episode) and then per person, both with map-side combine, so neither a person
    with very many rows nor an Episode repeated very often is gathered. Values themselves are not collected: their
    lowest and highest tell whether they differ. A row per rule leaves no person out: rows
    without a person are one person (null).
    """
    by_number = episodes.groupBy("IndividualId", "Episode").agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(c).alias(f"{n}{c}") for c in ("DoB", "DoD", "Sex") for n, f in (("low", F.min), ("high", F.max))],
        F.count_if(F.col("DoB").isNull()).alias("unborn"),
        F.bool_or(F.col("Sex").isNull()).alias("sexless"),
        F.count_if(F.col("EndDate") < F.col("StartDate")).alias("backward"),
        F.count_if(F.col("StartDate") > F.col("DoD")).alias("late"),
        F.count_if(F.col("StartDate") < F.col("DoB")).alias("early"),
    )
    folded = by_number.groupBy("IndividualId").agg(
        F.sum("rows").alias("rows"),
        F.sum(F.when(F.col("Episode").isNotNull(), F.col("rows") - 1).otherwise(0)).alias("repeated"),
        *[f(f"{n}{c}").alias(f"{n}{c}") for c in ("DoB", "DoD", "Sex") for n, f in (("low", F.min), ("high", F.max))],
        *[F.sum(c).alias(c) for c in ("unborn", "backward", "late", "early")],
        F.bool_or("sexless").alias("sexless"),
    )
    sexes = _mixed("lowSex", "highSex") + (F.col("sexless") & F.col("lowSex").isNotNull()).cast("long")
    known = F.col("IndividualId").isNotNull()
    counts = [
        F.when(known, F.col("repeated")), F.when(known, F.col("unborn")), F.when(known, _mixed("lowDoB", "highDoB")),
        F.when(known, _mixed("lowDoD", "highDoD")), F.when(known, sexes), F.when(known, F.col("late")),
        F.when(known, F.col("early")), F.when(known, F.col("backward")), F.when(~known, F.col("rows")),
    ]
    cells = [F.struct(F.lit(rule).alias("Rule"), F.coalesce(n, F.lit(0)).cast("long").alias("n")) for rule, n in zip(RULES, counts)]
    return folded.select("IndividualId", F.inline(F.array(*cells))).filter("n > 0")


def assert_valid(episodes: DataFrame) -> DataFrame:
    """The episodes; a table that breaks the contract stops the job that reads them, with the number of broken rules."""
    broken = episode_violations(episodes).agg(F.count(F.lit(1))).scalar()
    error = F.raise_error(F.concat(broken.cast("string"), F.lit(" violations of the contract of the episode table")))
    return episodes.filter(F.when(broken == 0, F.lit(True)).otherwise(error.cast("boolean")))
