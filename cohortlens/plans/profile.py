"""Cohort profile: sex, education, headship, residence and employment per cohort."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scalars import in_study_cohort, level_code, level_label, percent, recode
from ..operators.aggregates import count_by
from .persons import analysis_persons, ever_married, finish_persons, first_known

BITS = 64


def _head_rows(episodes: DataFrame) -> DataFrame:
    """Rows as head of a household, with a known marital status as in the person frames."""
    rows = episodes.filter(in_study_cohort(F.col("DoB")) & F.col("MaritalStatus").isNotNull())
    return rows.filter(F.col("HHRelation") == fv.HOUSEHOLD_HEAD)


def _years_where(cond: Column) -> Column:
    """Aggregate: the years with such a row, as bits of the 64 years of the group."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("Bit"))
    return F.bit_or(F.when(cond, bit))


def _count_years(years: str, but_not: str | None = None) -> Column:
    mask = F.coalesce(F.col(years), F.lit(0).cast("long"))
    if but_not is not None:
        mask = mask.bitwiseAND(F.bitwise_not(F.coalesce(F.col(but_not), F.lit(0).cast("long"))))
    return F.sum(F.bit_count(mask).cast("long"))


def persons_with_years(episodes: DataFrame) -> DataFrame:
    """Persons with their number of observed years, years non-resident and years employed.

    A person's years are kept as bits, one group for each span of 64 calendar years, so the
    rows of a person fold to one or two rows before the shuffle however many years they cover.
    The highest residence code of a year is 1 if one row has it and none a higher one; the
    lowest employment code is one of the employed ones if a row has one and none a lower code.
    """
    known = F.col("MaritalStatus").isNotNull()
    away, work = F.col("NonResident"), F.col("CurrentlyEmployed")
    codes = list(fv.EMPLOYMENT_LABELS)
    rows = episodes.filter(in_study_cohort(F.col("DoB"))).withColumns(
        {"Span": F.floor(F.year("StartDate") / BITS), "Bit": F.year("StartDate") % BITS}
    )
    spans = rows.groupBy("IndividualId", "Span").agg(
        F.min("DoB").alias("DoB"),
        first_known("Sex").alias("Sex"),
        F.min(F.when(known, F.col("Episode"))).alias("FirstKnown"),
        F.max("Education").alias("EduMax"),
        F.max("EducationObsDate").alias("EduLastSeen"),
        F.max("StartDate").alias("LastSeen"),
        ever_married().alias("EverMarried"),
        _years_where(known & away.isNotNull()).alias("Residence"),
        _years_where(known & (away == 1)).alias("Away"),
        _years_where(known & (away > 1)).alias("OtherAway"),
        _years_where(known & work.isNotNull()).alias("Employment"),
        _years_where(known & work.isin(codes)).alias("Employed"),
        _years_where(known & (work < min(codes))).alias("OtherWork"),
    )
    folded = spans.groupBy("IndividualId").agg(
        F.min("DoB").alias("DoB"),
        F.min_by("Sex", "FirstKnown").alias("Sex"),
        F.max("EduMax").alias("EduMax"),
        F.max("EduLastSeen").alias("EduLastSeen"),
        F.max("LastSeen").alias("LastSeen"),
        F.max("EverMarried").alias("EverMarried"),
        _count_years("Away", but_not="OtherAway").alias("YearsAway"),
        _count_years("Residence").alias("YearsResidence"),
        _count_years("Employed", but_not="OtherWork").alias("YearsEmployed"),
        _count_years("Employment").alias("YearsEmployment"),
    )
    return finish_persons(folded).filter(F.col("Followed"))


def cohort_profile(episodes: DataFrame) -> DataFrame:
    """Count, base and percent of each characteristic per cohort and overall, long form."""
    heads = _head_rows(episodes).select("IndividualId", "HouseholdId").distinct()
    headed = heads.groupBy("IndividualId").agg(F.count(F.lit(1)).alias("Headed"))
    persons = persons_with_years(episodes).join(headed, "IndividualId", "left")
    female = F.col("Sex") == fv.FEMALE
    levels = [F.count_if(F.col("EduMaxLbl") == label).alias(f"edu{i}") for i, label in enumerate(fv.EDUCATION_LEVELS)]
    headships = F.coalesce(F.col("Headed"), F.lit(0))
    by_cohort = persons.groupBy("Generation").agg(
        F.count(F.lit(1)).alias("persons"),
        F.count_if(female).alias("female"),
        *levels,
        F.sum(headships).alias("headships"),
        F.sum(F.when(female, headships).otherwise(0)).alias("female_headships"),
        *[F.sum(c).alias(c) for c in ("YearsAway", "YearsResidence", "YearsEmployed", "YearsEmployment")],
    )
    # three rows are left: add the overall column and go to long form
    both = by_cohort.withColumn("Generation", F.explode(F.array(F.col("Generation"), F.lit("Overall"))))
    sums = both.groupBy("Generation").agg(*[F.sum(c).alias(c) for c in by_cohort.columns if c != "Generation"])

    def cell(variable: str, level: str, n: str, total: str) -> Column:
        return F.struct(
            F.lit(variable).alias("Variable"), F.lit(level).alias("Level"),
            F.col(n).alias("n"), F.col(total).alias("total"),
        )

    cells = [
        cell("Sex", "Female", "female", "persons"),
        *[cell("Education", label, f"edu{i}", "persons") for i, label in enumerate(fv.EDUCATION_LEVELS)],
        cell("Household head", "Female", "female_headships", "headships"),
        cell("Residence", "Non-resident in a year", "YearsAway", "YearsResidence"),
        cell("Employment", "Employed in a year", "YearsEmployed", "YearsEmployment"),
    ]
    long = sums.select("Generation", F.inline(F.array(*cells)))
    return long.withColumn("pct", percent(F.col("n"), F.col("total")))


def household_employment(episodes: DataFrame) -> DataFrame:
    """Best employment among a household's heads in a year, counted per cohort of that head."""
    best = (
        _head_rows(episodes)
        .filter(F.col("CurrentlyEmployed").isNotNull())
        .groupBy("IndividualId", "HouseholdId", F.year("StartDate").alias("Year"))
        .agg(F.min("CurrentlyEmployed").alias("CurrentlyEmployed"))
    )
    followed = analysis_persons(episodes).select("IndividualId", "Generation")
    cohorts = [*fv.COHORT_LEVELS, fv.OTHER_COHORT]
    # the key of the best employment, then of the lowest person, as one number of fixed size: no row is sorted
    place = F.col("CurrentlyEmployed").cast("decimal(38,0)") * F.lit(Decimal(10) ** 20) + F.col("IndividualId")
    homes = best.join(followed, "IndividualId").groupBy("HouseholdId", "Year").agg(
        F.min("CurrentlyEmployed").alias("Employed"),
        F.min_by(level_code(F.col("Generation"), cohorts), place).alias("Cohort"),
    )
    label = F.coalesce(recode(F.col("Employed"), fv.EMPLOYMENT_LABELS), F.lit(fv.UNEMPLOYED_LABEL))
    cohort = level_label(F.col("Cohort"), cohorts)
    return count_by(homes.select(label.alias("CurrentlyEmployed"), cohort.alias("Generation")), "CurrentlyEmployed", "Generation")
