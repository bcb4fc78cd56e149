"""Marriage: proportions by education, current state, transmission from mother to daughter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scalars import age_at, date_between, if_else, level_code, level_label, none_if_zero, percent, round_half_even, safe_divide
from ..operators.skew import salted_join
from ..operators.windows import ref_value, share_within
from .persons import analysis_persons

def prop_ever(persons: DataFrame, by: tuple[str, ...] = ("Generation", "Sex", "EduMaxLbl")) -> DataFrame:
    """Share ever married per cell; cells in which nobody married are left out."""
    counts = persons.groupBy(*by).agg(
        F.count_if(F.col("EverMarried") == 1).alias("MarEver"), F.count(F.lit(1)).alias("n")
    )
    return counts.filter("MarEver > 0").withColumn("MarProp", safe_divide(F.col("MarEver"), F.col("n")))


def relative_to(props: DataFrame, reference: str = fv.REFERENCE_EDUCATION, strict: bool = True) -> DataFrame:
    """Relative difference of each proportion to that of the reference education group."""
    is_ref = F.col("EduMaxLbl") == reference
    with_ref = ref_value(props, ["Generation", "Sex"], is_ref, "MarProp", "Ref", strict, small=True)
    return with_ref.withColumn("Adv", safe_divide(F.col("MarProp"), F.col("Ref")) - 1)


def current_state_aggregates(lo: str, hi: str) -> dict[str, Column]:
    inside = date_between(F.col("StartDate"), lo, hi)
    return {
        "SeenInWindow": F.max(inside.cast("int")),
        "MarriedInWindow": F.max((inside & F.coalesce(F.col("MaritalStatus") == fv.MARRIED, F.lit(False))).cast("int")),
    }


def marriage_rates(episodes: DataFrame, window: tuple[str, str] = fv.CURRENT_STATE_WINDOW) -> DataFrame:
    """Ever married and currently married, count and percent, per cohort and sex; one pass."""
    persons = analysis_persons(episodes, extras=current_state_aggregates(*window))
    cells = persons.groupBy("Generation", "Sex").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("EverMarried") == 1).alias("MarEver"),
        none_if_zero(F.count_if(F.col("MarriedInWindow") == 1)).alias("CurMar"),
        none_if_zero(F.count_if(F.col("SeenInWindow") == 1)).alias("_seen"),
    )
    return cells.filter("MarEver > 0").select(
        "Generation",
        if_else(F.col("Sex") == fv.MALE, "Male", "Female").alias("Sex"),
        round_half_even(percent(F.col("MarEver"), F.col("_n")), 2).alias("MarProp"),
        "MarEver",
        round_half_even(percent(F.col("CurMar"), F.col("_seen")), 2).alias("CurMarProp"),
        "CurMar",
    )


def fold_families(rows: DataFrame) -> DataFrame:
    """One row per parent: own flag and education, number of children with flag 1 and 0.

    Parents and children lie under the parent's key and are folded by one combined sum. There
    is no join, and a parent with very many children is folded before the shuffle.
    """
    folded = rows.groupBy("key").agg(
        F.max("is_parent").alias("is_parent"),
        F.max("ParentFlag").alias("ParentFlag"),
        level_label(F.max("EduCode"), fv.EDUCATION_LEVELS).alias("EduMaxLbl"),
        F.count_if(F.col("ChildFlag") == 1).alias("yes"),
        F.count_if(F.col("ChildFlag") == 0).alias("no"),
    )
    return folded.filter("is_parent = 1")


def persons_as_family_rows(persons: DataFrame, flag: str, is_parent: Column, is_child: Column) -> DataFrame:
    """Both roles of each person from a single pass over ``persons``."""
    role = F.when(is_parent, F.struct(
        F.col("IndividualId").alias("key"), F.col(flag).alias("ParentFlag"),
        level_code(F.col("EduMaxLbl"), fv.EDUCATION_LEVELS).alias("EduCode"), F.lit(1).alias("is_parent"), F.lit(None).cast("int").alias("ChildFlag"),
    ))
    child = F.when(is_child & F.col("MotherId").isNotNull(), F.struct(
        F.col("MotherId").alias("key"), F.lit(None).cast("int").alias("ParentFlag"),
        F.lit(None).cast("int").alias("EduCode"), F.lit(0).alias("is_parent"), F.col(flag).alias("ChildFlag"),
    ))
    return persons.select(F.explode(F.array_compact(F.array(role, child))).alias("r")).select("r.*")


def link_counts(families: DataFrame, parent: str, child: str) -> DataFrame:
    """Children per parent flag, child flag and parent education."""
    sums = families.groupBy("ParentFlag", "EduMaxLbl").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    long = sums.select(
        F.col("ParentFlag").alias(parent), "EduMaxLbl",
        F.inline(F.array(
            F.struct(F.lit(1).alias(child), F.col("yes").alias("n")),
            F.struct(F.lit(0).alias(child), F.col("no").alias("n")),
        )),
    )
    return long.filter("n > 0")


def mother_daughter_marriage(persons: DataFrame) -> DataFrame:
    """Daughters of the last cohort by own state, mother's state and mother's education, with shares."""
    women = persons.filter(F.col("Sex") == fv.FEMALE)
    last = F.col("Generation") == fv.COHORT_LEVELS[-1]
    families = fold_families(persons_as_family_rows(women, "EverMarried", F.lit(True), last))
    counts = link_counts(families, "MotherEverMarried", "ChldEverMarried")
    named = counts.withColumn(
        "MotherEverMarried", if_else(F.col("MotherEverMarried") == 0, "Never- \nMarried", "Ever- \nMarried")
    )
    return share_within(named, ["MotherEverMarried", "EduMaxLbl"], "n", small=True)


def mother_daughter_pairs(persons: DataFrame, salts: int | None = None) -> DataFrame:
    """One row per daughter of the last cohort with a followed mother, and the mother's age at the birth."""
    # the persons' fold shuffles once, by exchange reuse
    women = persons.filter(F.col("Sex") == fv.FEMALE)
    mothers = women.select(
        F.col("IndividualId").alias("_mother"), F.col("DoB").alias("MotherDoB"),
        F.col("EverMarried").alias("MotherEverMarried"), "EduMaxLbl",
    )
    daughters = women.filter((F.col("Generation") == fv.COHORT_LEVELS[-1]) & F.col("MotherId").isNotNull()).select(
        F.col("IndividualId").alias("ChildIndividualId"), F.col("MotherId").alias("MotherIndividualId"),
        F.col("DoB").alias("ChildDoB"), F.col("EverMarried").alias("ChldEverMarried"),
    )
    pairs = salted_join(daughters, mothers, [("MotherIndividualId", "_mother")], "inner", salts)
    return pairs.withColumn("AgeAtBirth", age_at(F.col("ChildDoB"), F.col("MotherDoB")))


def teen_flags(pregnancies: DataFrame, age: int = fv.TEEN_AGE) -> DataFrame:
    """Per woman with a pregnancy: 1 if any came before ``age``."""
    young = F.coalesce(F.col("MotherAge") < age, F.lit(False)).cast("int")
    return pregnancies.groupBy("WomanId").agg(F.max(young).alias("TeenagePreg"))


def mother_daughter_teen(persons: DataFrame, pregnancies: DataFrame) -> DataFrame:
    """Last-cohort children with a pregnancy by own and mother's teenage pregnancy and her education.

    Mothers without such a child fall together in one group without child, of which one row
    (the lowest key) counts.
    """
    flags = teen_flags(pregnancies)
    known = persons.join(flags, persons["IndividualId"] == flags["WomanId"]).drop("WomanId")
    last = F.col("Generation") == fv.COHORT_LEVELS[-1]
    families = fold_families(persons_as_family_rows(known, "TeenagePreg", F.lit(True), last))
    childless = F.min(F.when(F.col("yes") + F.col("no") == 0, F.col("key")))
    sums = families.groupBy("ParentFlag", "EduMaxLbl").agg(
        F.sum("yes").alias("yes"), F.sum("no").alias("no"), childless.alias("lowest")
    )
    # at most eight rows are left here
    lowest_of_all = F.min("lowest").over(Window.partitionBy(F.lit(1)))
    cells = sums.withColumn("alone", F.when(F.col("lowest") == lowest_of_all, F.lit(1)).otherwise(0).cast("long"))
    counts = cells.select(
        F.col("ParentFlag").alias("MotherTeenagePreg"), "EduMaxLbl",
        F.inline(F.array(
            F.struct(F.lit(1).alias("ChildTeenagePreg"), F.col("yes").alias("n")),
            F.struct(F.lit(0).alias("ChildTeenagePreg"), F.col("no").alias("n")),
            F.struct(F.lit(None).cast("int").alias("ChildTeenagePreg"), F.col("alone").alias("n")),
        )),
    ).filter("n > 0")
    named = counts.withColumn("MotherTeenagePreg", if_else(F.col("MotherTeenagePreg") == 0, "No", "Yes"))
    return share_within(named, ["MotherTeenagePreg", "EduMaxLbl"], "n", small=True)
