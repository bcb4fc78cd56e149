"""Queries that run the demographic calculations on episodes and pregnancies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import fixed_values as fv
from cohortlens.plans import events as E
from cohortlens.plans import fertility as Fe
from cohortlens.plans import first_birth as B
from cohortlens.plans import marriage as M
from cohortlens.plans import persons as P
from cohortlens.plans import profile as Pr
from cohortlens.plans import validation as V
from cohortlens.sources.derived import episodes, pregnancies
from cohortlens.sources.tables import delivered_before

from .sql_text import FAULTS


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def episode_ages(spark, sf):
    aged = P.with_ages(episodes(spark, sf)).select("IndividualId", "Episode", "AgeAtObs", "Year", "AgeAtEduObs")
    return rounded(aged, "AgeAtObs", "AgeAtEduObs")


def recorded_deliveries(spark, sf):
    return delivered_before(pregnancies(spark, sf), "2010-01-01")


def validate_episodes(spark, sf):
    """What breaks the contract in episodes with faults."""
    rows = episodes(spark, sf).select("IndividualId", "DoB", "DoD", "Sex", "Episode", "StartDate", "EndDate")
    faulty = rows.selectExpr(*[f"{FAULTS.get(c, c)} AS {c}" for c in rows.columns])
    return V.episode_violations(faulty)


def validate_clean(spark, sf):
    """The episodes that the other queries read keep the contract: no rows."""
    return V.episode_violations(episodes(spark, sf))


def union_age(spark, sf):
    """Age at the first union of the women observed, by what tells it: seen single before, or there from the start."""
    return rounded(E.union_age(episodes(spark, sf), pregnancies(spark, sf)), "UnionSeenAge", "UnionBeforeAge", "AgeAtUnion")


def first_birth_age(spark, sf):
    return rounded(E.first_births_of(pregnancies(spark, sf)), "AgeAnyFirstBirth", "AgeFirstBirth")


def person_summary(spark, sf):
    """Every person of the cohorts with labels, whether followed or not."""
    people = P.person_summary(episodes(spark, sf)).select(
        "IndividualId", "DoB", "DoD", "Sex", "MotherId", "EduMax", "EverMarried", "EduMaxLbl", "Generation",
        "AgeEduObsMax", "AgeAtObsMax", "Followed",
    )
    return rounded(people, "AgeEduObsMax", "AgeAtObsMax")


def person_frame(spark, sf):
    return P.analysis_persons(episodes(spark, sf)).select(
        "IndividualId", "Sex", "EduMaxLbl", "Generation", "EverMarried"
    )


def person_frame_fert(spark, sf):
    return P.analysis_persons(episodes(spark, sf), min_edu=None).select(
        "IndividualId", "Sex", "EduMaxLbl", "Generation", "EverMarried"
    )


def cohort_sizes(spark, sf):
    return P.cohort_sizes(P.analysis_persons(episodes(spark, sf)))


def prop_ever_married(spark, sf):
    return rounded(M.prop_ever(P.analysis_persons(episodes(spark, sf))), "MarProp")


def relative_to_matric(spark, sf):
    # a group without anyone married in the reference education has no relative difference
    relative = M.relative_to(M.prop_ever(P.analysis_persons(episodes(spark, sf))), strict=False)
    return rounded(relative.select("Generation", "Sex", "EduMaxLbl", "Ref", "Adv"), "Ref", "Adv")


def mother_daughter_marriage(spark, sf):
    return rounded(M.mother_daughter_marriage(P.analysis_persons(P.women_only(episodes(spark, sf)))), "share")


def mother_daughter_pairs(spark, sf):
    pairs = M.mother_daughter_pairs(P.analysis_persons(P.women_only(episodes(spark, sf))))
    return rounded(pairs, "AgeAtBirth")


def mother_daughter_teen(spark, sf):
    teen = M.mother_daughter_teen(P.analysis_persons(episodes(spark, sf)), pregnancies(spark, sf))
    return rounded(teen, "share")


def marriage_rates(spark, sf):
    return M.marriage_rates(episodes(spark, sf))


def births(spark, sf):
    rows = Fe.births(pregnancies(spark, sf), episodes(spark, sf))
    return rounded(
        rows.select("WomanId", "PregnancyId", "AgeAtBirth", "Agegroup", "Generation", "EverMarried", "EduMaxLbl"),
        "AgeAtBirth",
    )


def births_by_agegroup(spark, sf):
    return Fe.births_by_agegroup(pregnancies(spark, sf), episodes(spark, sf))


def person_years(spark, sf):
    return Fe.person_years(episodes(spark, sf)).select("IndividualId", "Year")


def exposure_rows(spark, sf):
    rows = Fe.exposure(episodes(spark, sf), pregnancies(spark, sf))
    return rounded(rows.select("IndividualId", "Year", "Age", "Agegroup", "Generation", "EverMarried"), "Age")


def exposure(spark, sf):
    return Fe.exposure_counts(episodes(spark, sf), pregnancies(spark, sf))


def lexis_cells(spark, sf):
    return Fe.lexis_cells(episodes(spark, sf))


def asfr_by_marital(spark, sf):
    return rounded(Fe.asfr(pregnancies(spark, sf), episodes(spark, sf)), "value")


def asfr_overall(spark, sf):
    return rounded(Fe.asfr(pregnancies(spark, sf), episodes(spark, sf), by=()), "value")


def asfr_all_women(spark, sf):
    """The overall rates with childless women counted in the person-years."""
    rates = Fe.asfr(pregnancies(spark, sf), episodes(spark, sf), by=(), require_pregnancy=False)
    return rounded(rates, "value")


def asfr_masked(spark, sf):
    rates = Fe.asfr_long(Fe.asfr(pregnancies(spark, sf), episodes(spark, sf)))
    return rounded(rates.select("Generation", "EverMarried", "Agegroup", "value"), "value")


def tfr(spark, sf):
    rates = Fe.asfr(pregnancies(spark, sf), episodes(spark, sf))
    return rounded(Fe.tfr(rates, ["Generation", "EverMarried"]), "TFR")


def tfr_overall(spark, sf):
    rates = Fe.asfr(pregnancies(spark, sf), episodes(spark, sf), by=())
    return rounded(Fe.tfr(rates, ["Generation"]), "TFR")


def cumulative_fertility(spark, sf):
    return Fe.cumulative_fertility(Fe.asfr_long(Fe.asfr(pregnancies(spark, sf), episodes(spark, sf))))


def cumulative_fertility_overall(spark, sf):
    rates = Fe.asfr(pregnancies(spark, sf), episodes(spark, sf), by=())
    return Fe.cumulative_fertility(Fe.asfr_long(rates), by=())


def births_never_married(spark, sf):
    return Fe.births_never_married(pregnancies(spark, sf), episodes(spark, sf))


def teen_birth_share(spark, sf):
    return rounded(Fe.teen_birth_share(pregnancies(spark, sf), episodes(spark, sf)), "perc")


def first_birth_summary(spark, sf):
    return rounded(B.first_birth_summary(pregnancies(spark, sf), episodes(spark, sf)), "IQR")


def first_birth_report(spark, sf):
    return B.first_birth_report(B.first_birth_summary(pregnancies(spark, sf), episodes(spark, sf)))


def first_birth_medians(spark, sf):
    return rounded(B.first_birth_medians(pregnancies(spark, sf), episodes(spark, sf)), "Median")


def anova_first_birth(spark, sf):
    table = B.anova_first_birth(pregnancies(spark, sf), episodes(spark, sf)).drop("p", "mark")
    return rounded(table, "ss_between", "ss_within", "ms_between", "ms_within", "f")


def anova_first_birth_p(spark, sf):
    """The tail probabilities of all six fits."""
    table = B.anova_first_birth(pregnancies(spark, sf), episodes(spark, sf))
    return rounded(table.select("Subset", "Term", "p", "mark"), "p")


def observed_before(spark, sf):
    return P.observed_before(episodes(spark, sf))


def matric_age(spark, sf):
    return rounded(E.matric_age(episodes(spark, sf)), "AgeMatric")


def first_union(spark, sf):
    return rounded(E.first_union(episodes(spark, sf)), "AgeAtUnion")


def union_left_censored(spark, sf):
    return rounded(E.union_left_censored(episodes(spark, sf), pregnancies(spark, sf)), "AgeAtUnion")


def life_events(spark, sf):
    return rounded(
        E.life_events(episodes(spark, sf), pregnancies(spark, sf)), "AgeFirstBirth", "AgeMatric", "AgeAtUnion"
    )


def event_order_table(spark, sf):
    return E.event_order_table(E.life_events(episodes(spark, sf), pregnancies(spark, sf)))


def event_order_medians(spark, sf):
    medians = E.event_order_medians(E.life_events(episodes(spark, sf), pregnancies(spark, sf)))
    return rounded(medians, "value")


def cohort_profile(spark, sf):
    return rounded(Pr.cohort_profile(episodes(spark, sf)), "pct")


def household_employment(spark, sf):
    return Pr.household_employment(episodes(spark, sf))


def education_names(spark, sf):
    """Persons by education group under its display name."""
    from cohortlens.functions.scalars import recode

    people = P.analysis_persons(episodes(spark, sf))
    named = people.select(recode(F.col("EduMaxLbl"), fv.EDUCATION_DISPLAY).alias("Education"))
    return named.groupBy("Education").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        episode_ages, recorded_deliveries, person_summary, person_frame, person_frame_fert, cohort_sizes,
        prop_ever_married, relative_to_matric, mother_daughter_marriage, mother_daughter_pairs,
        mother_daughter_teen, marriage_rates, births, births_by_agegroup, person_years, exposure_rows, exposure,
        lexis_cells, asfr_by_marital, asfr_overall, asfr_all_women, asfr_masked, tfr, tfr_overall,
        cumulative_fertility, cumulative_fertility_overall, births_never_married, teen_birth_share,
        first_birth_summary, first_birth_report, first_birth_medians, anova_first_birth, anova_first_birth_p,
        observed_before, matric_age, first_union, union_left_censored, life_events, event_order_table,
        event_order_medians, cohort_profile, household_employment, education_names, validate_episodes, validate_clean, union_age, first_birth_age,
    )
}
