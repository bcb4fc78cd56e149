"""Age at first birth: quantile summaries and analysis of variance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scalars import fixed_text, iqr_text, recode, round_half_even
from ..operators.aggregates import (
    anova_from_cells,
    cell_moments,
    counted_quantiles,
    counted_summary,
    merge_cells,
    value_counts,
)
from .fertility import with_age_at_birth
from .persons import analysis_persons, women_only

AGE_LIMITS = (12, 25)  # fixed values: from (included), to (not included)
# Ages between the limits are differences of days counted in fractions of years: few distinct values however many
# births, so one window ranks a group's.
CENTRE = 18.5


def first_births(pregnancies: DataFrame, episodes: DataFrame) -> DataFrame:
    """First births by mother's education and cohort: age and number of such records.

    Records are folded per woman and age before the join, so it meets a bounded number of rows
    per woman.
    """
    lo, hi = AGE_LIMITS
    firsts = with_age_at_birth(pregnancies.filter(F.col("BirthOrder") == 1)).filter(
        (F.col("AgeAtBirth") < hi) & (F.col("AgeAtBirth") >= lo)
    )
    folded = firsts.groupBy("WomanId", "AgeAtBirth").agg(F.count(F.lit(1)).alias("_records"))
    mothers = analysis_persons(women_only(episodes)).select("IndividualId", "EduMaxLbl", "Generation")
    return folded.join(mothers, folded["WomanId"] == mothers["IndividualId"]).drop("IndividualId")


def first_birth_summary(pregnancies: DataFrame, episodes: DataFrame) -> DataFrame:
    """Median, quartiles, mean, sd as two-decimal text, n and IQR per education and cohort."""
    by = ["EduMaxLbl", "Generation"]
    counts = value_counts(first_births(pregnancies, episodes), by, "AgeAtBirth", F.col("_records"))
    summary = counted_summary(counts, by, "AgeAtBirth", {"Median": 0.5, "Q1": 0.25, "Q3": 0.75}, CENTRE, small=True)
    # the generator makes plain columns of the statistics, so that the texts below don't repeat their formulas
    summary = summary.select(F.inline(F.array(F.struct(*summary.columns))))
    # the distance of the rounded quartiles, not the rounded distance
    iqr = round_half_even(F.col("Q3"), 2) - round_half_even(F.col("Q1"), 2)
    return summary.select(
        "EduMaxLbl",
        recode(F.col("Generation"), fv.COHORT_DISPLAY).alias("Generation"),
        *[fixed_text(F.col(c)).alias(c) for c in ("Median", "Q1", "Q3", "Mean", "sd")],
        "n",
        iqr.alias("IQR"),
    )


def first_birth_report(summary: DataFrame) -> DataFrame:
    """The summary with the quartiles written as one text, as in the report table."""
    iqr = iqr_text(F.col("Q1"), F.col("Q3"))
    return summary.select("Generation", "EduMaxLbl", "Median", iqr.alias("IQR"), "Mean", F.col("sd").alias("s.d."), "n")


def first_birth_medians(pregnancies: DataFrame, episodes: DataFrame) -> DataFrame:
    """Median age at first birth per cohort and over all cohorts."""
    rows = first_births(pregnancies, episodes).withColumn(
        "Generation", F.explode(F.array(F.col("Generation"), F.lit("Overall")))
    )
    counts = value_counts(rows, ["Generation"], "AgeAtBirth", F.col("_records"))
    return counted_quantiles(counts, ["Generation"], "AgeAtBirth", {"Median": 0.5}, small=True)


def anova_first_birth(pregnancies: DataFrame, episodes: DataFrame) -> DataFrame:
    """Age at first birth by cohort within each education group, by cohort, and by education.

    All six fits come from the moments of the twelve education x cohort cells.
    """
    births = first_births(pregnancies, episodes)
    cells = cell_moments(births, ["EduMaxLbl", "Generation"], "AgeAtBirth", "_records", CENTRE)
    fits = F.inline(
        F.array(
            F.struct(F.col("EduMaxLbl").alias("Subset"), F.lit("Generation").alias("Term"), F.col("Generation").alias("Level")),
            F.struct(F.lit("All").alias("Subset"), F.lit("Generation").alias("Term"), F.col("Generation").alias("Level")),
            F.struct(F.lit("All").alias("Subset"), F.lit("Education").alias("Term"), F.col("EduMaxLbl").alias("Level")),
        )
    )
    levels = merge_cells(cells.select("n", "mean", "ss", fits), ["Subset", "Term", "Level"])
    return anova_from_cells(levels, ["Subset", "Term"])
