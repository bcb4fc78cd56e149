"""Persons from episodes: ages, cohort, education group, ever-married, follow-up.

A person's rows are folded by one ``groupBy`` with map-side combine. Ages are not computed per
row: a maximum age is the age at the maximum date, so rows only take part in date and integer
maxima. A person with very many rows costs no more than any other after the combine.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scalars import age_at, cohort, date_between, education_group, in_study_cohort, matches_code
from ..operators.aggregates import count_by


def with_ages(episodes: DataFrame) -> DataFrame:
    """Row-level view: age at episode start, calendar year, age when education was seen."""
    return episodes.withColumns(
        {
            "AgeAtObs": age_at(F.col("StartDate"), F.col("DoB")),
            "Year": F.year("StartDate"),
            "AgeAtEduObs": age_at(F.col("EducationObsDate"), F.col("DoB")),
        }
    )


def ever_married() -> Column:
    """Aggregate: 1 if any known status counts as married once, 0 if none, null if none is known."""
    status = F.col("MaritalStatus")
    married = matches_code(status, fv.EVER_MARRIED_PATTERN, fv.EVER_MARRIED_CODES)
    return F.max(F.when(status.isNotNull(), married.cast("int")))


def first_known(col: str) -> Column:
    """Aggregate: the value in the first episode whose marital status is known."""
    return F.min_by(F.col(col), F.when(F.col("MaritalStatus").isNotNull(), F.col("Episode")))


def base_aggregates() -> dict[str, Column]:
    return {
        "DoB": F.min("DoB"),
        "DoD": F.max("DoD"),
        "Sex": first_known("Sex"),
        "MotherId": first_known("MotherId"),
        "EduMax": F.max("Education"),
        "EduLastSeen": F.max("EducationObsDate"),
        "LastSeen": F.max("StartDate"),
        "EverMarried": ever_married(),
    }


def finish_persons(folded: DataFrame) -> DataFrame:
    """Labels and ages from the folded dates; persons without education or known status go."""
    kept = folded.filter(F.col("EduMax").isNotNull() & F.col("EverMarried").isNotNull())
    aged = kept.withColumns(
        {
            "AgeEduObsMax": age_at(F.col("EduLastSeen"), F.col("DoB")),
            "AgeAtObsMax": age_at(F.col("LastSeen"), F.col("DoB")),
            "EduMaxLbl": education_group(F.col("EduMax")),
            "Generation": cohort(F.col("DoB")),
        }
    )
    followed = (F.col("AgeEduObsMax") >= fv.MIN_AGE_EDUCATION_SEEN) & (F.col("AgeAtObsMax") >= fv.MIN_AGE_LAST_SEEN)
    return aged.withColumn("Followed", F.coalesce(followed, F.lit(False)))


def person_summary(episodes: DataFrame, extras: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per person of the study cohorts. ``extras`` are further aggregates over their rows.

    Only what a query goes on to use is computed: the optimizer drops unused aggregates and
    their columns from the scan.
    """
    rows = episodes.filter(in_study_cohort(F.col("DoB")))
    aggs = {**base_aggregates(), **(extras or {})}
    return finish_persons(rows.groupBy("IndividualId").agg(*[a.alias(n) for n, a in aggs.items()]))


def analysis_persons(
    episodes: DataFrame,
    min_obs: float = fv.MIN_AGE_LAST_SEEN,
    min_edu: float | None = fv.MIN_AGE_EDUCATION_SEEN,
    extras: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Persons followed long enough; ``min_edu=None`` asks nothing of the education records."""
    people = person_summary(episodes, extras).filter(F.col("AgeAtObsMax") >= min_obs)
    return people if min_edu is None else people.filter(F.col("AgeEduObsMax") >= min_edu)


def cohort_sizes(persons: DataFrame) -> DataFrame:
    return count_by(persons, "Generation")


def women_only(episodes: DataFrame) -> DataFrame:
    """Rows of women. Sex does not change in a person, so restricting rows restricts persons."""
    return episodes.filter(F.col("Sex") == fv.FEMALE)


def last_cohort_women(episodes: DataFrame) -> DataFrame:
    """Rows of women born within the last cohort's window (plain comparisons, pushed to the scan)."""
    return women_only(episodes).filter(date_between(F.col("DoB"), *fv.LAST_COHORT_WINDOW))


def observed_before(episodes: DataFrame, age: float = 15) -> DataFrame:
    """Keys of followed last-cohort women with an episode that starts before ``age``."""
    seen = {"FirstSeen": F.min("StartDate")}
    women = analysis_persons(last_cohort_women(episodes), extras=seen)
    return women.filter(age_at(F.col("FirstSeen"), F.col("DoB")) < age).select("IndividualId")
