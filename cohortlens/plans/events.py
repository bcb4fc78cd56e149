"""Life events of the last cohort's women: school leaving, first birth, first union, and their order.

The episodes of a woman are folded into everything the events need (by day first where union dates
are compared with other events); the pregnancies once into her first births. The two one-row-per-woman frames meet in a single join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scalars import age_at, date_between, decimal_date, mid_december_before, percent, round_half_even
from ..operators.aggregates import exact_quantiles
from ..operators.reshape import pivot_longer
from .fertility import with_age_at_birth
from .persons import analysis_persons, last_cohort_women

AGES = {"Matric": "AgeMatric", "Birth": "AgeFirstBirth", "Union": "AgeAtUnion"}


def _in_union(status: Column) -> Column:
    return F.coalesce(status.isin(fv.MARRIED, fv.INFORMAL_UNION), F.lit(False))


def event_aggregates() -> dict[str, Column]:
    status, start, seen = F.col("MaritalStatus"), F.col("StartDate"), F.col("EducationObsDate")
    union = _in_union(status)
    young = age_at(seen, F.col("DoB")) < fv.LIFE_EVENT_AGE
    known = status.isNotNull()
    return {
        "FirstSeen": F.min("StartDate"),
        "Matric12": F.min(F.when((F.col("Education") == fv.MATRIC_GRADE) & young, seen)),
        "Grade11": F.max(F.when(F.col("Education").isin(fv.GRADES_BEFORE_MATRIC), seen)),
        "UnionDate": F.min(F.when(union, start)),
        # distinct days of one woman's life as single: bounded by the days under observation
        "SingleDays": F.collect_set(F.when(status == fv.SINGLE, start)),
        # number of the first row with a known status; an unknown number is the lowest
        "FirstStatusEpisode": F.when(~F.bool_or(known & F.col("Episode").isNull()), F.min(F.when(known, F.col("Episode")))),
    }


def _seen_before(women: DataFrame, age: float) -> DataFrame:
    return women.filter(age_at(F.col("FirstSeen"), F.col("DoB")) < age)


def women_observed(episodes: DataFrame, age: float = 15) -> DataFrame:
    """Followed women of the last cohort seen before ``age``, with what their events need."""
    return _seen_before(analysis_persons(last_cohort_women(episodes), extras=event_aggregates()), age)


def by_day(episodes: DataFrame) -> DataFrame:
    """Rows folded by person, day and status, with the lowest ``Episode`` of each; grade dates are folded before the grades."""
    number, per_row = F.col("Episode"), event_aggregates()
    return episodes.groupBy("IndividualId", "DoB", "StartDate", "MaritalStatus").agg(
        # an unknown number is the lowest, as in the order of rows
        F.when(~F.bool_or(number.isNull()), F.min(number)).alias("Episode"),
        F.max("DoD").alias("DoD"),
        F.min_by("Sex", number).alias("Sex"),
        F.min_by("MotherId", number).alias("MotherId"),
        F.max("Education").alias("Education"),
        F.max("EducationObsDate").alias("EducationObsDate"),
        per_row["Matric12"].alias("Matric12"),
        per_row["Grade11"].alias("Grade11"),
    )


def women_with_union_starts(episodes: DataFrame, age: float = 15) -> DataFrame:
    """``women_observed`` with ``UnionStarts``, each day a union row starts with the lowest number of such a row.

    Rows are folded by day first, so that the set of a woman with very many episodes is no longer than
    the days under observation (two statuses a day).
    """
    union = _in_union(F.col("MaritalStatus"))
    extras = {
        **event_aggregates(),
        "Matric12": F.min("Matric12"),
        "Grade11": F.max("Grade11"),
        # rows may share a number: each of their union dates may be the one before the other events
        "UnionStarts": F.collect_set(F.when(union, F.struct("Episode", "StartDate"))),
    }
    return _seen_before(analysis_persons(by_day(last_cohort_women(episodes)), extras=extras), age)


def with_matric(women: DataFrame) -> DataFrame:
    """Age at the end of the school year before grade 12 was first seen.

    Needs an observation in one of the two grades before, not too long before; a later one is
    let through.
    """
    finished = mid_december_before(F.col("Matric12"))
    # both dates are a 15 December, so their distance in years is the difference of the years
    # but for a ten-thousandth (leap years), which the limit of 2.1 does not see
    near = F.year("Matric12") - F.year("Grade11") < fv.MATRIC_GAP_YEARS
    return women.withColumn("DateMatric", F.when(near, finished)).withColumn(
        "AgeMatric", age_at(F.col("DateMatric"), F.col("DoB"))
    )


def with_union_from_single(women: DataFrame) -> DataFrame:
    """Age and date of the first union, if the woman was seen single shortly before it."""
    earlier = F.array_max(F.filter("SingleDays", lambda d: d < F.col("UnionDate")))
    gap = decimal_date(F.col("UnionDate")) - decimal_date(F.col("SingleDate"))
    age = age_at(F.col("UnionDate"), F.col("DoB"))
    seen = (gap < fv.UNION_GAP_YEARS) & (age < fv.LIFE_EVENT_AGE)
    return women.withColumn("SingleDate", earlier).withColumns(
        {"UnionSeenDate": F.when(seen, F.col("UnionDate")), "UnionSeenAge": F.when(seen, age)}
    )


def first_births_of(pregnancies: DataFrame) -> DataFrame:
    """Per woman: age at the first birth on record, and the same within the limits of the analysis."""
    firsts = with_age_at_birth(pregnancies.filter(F.col("BirthOrder") == 1))
    age = F.col("AgeAtBirth")
    inside = date_between(F.col("MotherDoB"), *fv.LAST_COHORT_WINDOW) & (age > 15) & (age < fv.LIFE_EVENT_AGE)
    return firsts.groupBy(F.col("WomanId").alias("IndividualId")).agg(
        F.min(age).alias("AgeAnyFirstBirth"), F.min(F.when(inside, age)).alias("AgeFirstBirth")
    )


def with_union_before(women: DataFrame) -> DataFrame:
    """Age and date of a union already there in the first known status, before birth and matric."""
    tied = F.filter("UnionStarts", lambda x: x["Episode"].eqNullSafe(F.col("FirstStatusEpisode")))
    # of two dates in one life the earlier is the one at the lower age; of the rows that pass the latest counts
    passing = F.filter(
        F.transform(tied, lambda x: x["StartDate"]),
        lambda d: (d < F.col("DateMatric")) & (age_at(d, F.col("DoB")) < F.col("AgeAnyFirstBirth")),
    )
    latest = women.withColumn("UnionBeforeDate", F.array_max(passing))
    return latest.withColumn("UnionBeforeAge", age_at(F.col("UnionBeforeDate"), F.col("DoB")))


def women_with_events(episodes: DataFrame, pregnancies: DataFrame) -> DataFrame:
    women = with_union_from_single(with_matric(women_with_union_starts(episodes)))
    joined = with_union_before(women.join(first_births_of(pregnancies), "IndividualId", "left"))
    # greatest passes over null: the later of the two where both are known
    return joined.withColumn("AgeAtUnion", F.greatest("UnionSeenAge", "UnionBeforeAge"))


def matric_age(episodes: DataFrame) -> DataFrame:
    return (
        with_matric(women_observed(episodes))
        .filter(F.col("DateMatric").isNotNull())
        .select("IndividualId", "DateMatric", "AgeMatric")
    )


def first_union(episodes: DataFrame) -> DataFrame:
    return (
        with_union_from_single(women_observed(episodes))
        .filter(F.col("UnionSeenDate").isNotNull())
        .select("IndividualId", F.col("UnionSeenAge").alias("AgeAtUnion"), F.col("UnionSeenDate").alias("UnionDate"))
    )


def union_left_censored(episodes: DataFrame, pregnancies: DataFrame) -> DataFrame:
    return (
        women_with_events(episodes, pregnancies)
        .filter(F.col("UnionBeforeDate").isNotNull())
        .select("IndividualId", F.col("UnionBeforeAge").alias("AgeAtUnion"), F.col("UnionBeforeDate").alias("UnionDate"))
    )


def union_age(episodes: DataFrame, pregnancies: DataFrame) -> DataFrame:
    """Women with a known age at first union: seen from single, already there before other events, and the later of both."""
    known = women_with_events(episodes, pregnancies).filter(F.col("AgeAtUnion").isNotNull())
    return known.select("IndividualId", "UnionSeenAge", "UnionBeforeAge", "AgeAtUnion")


def life_events(episodes: DataFrame, pregnancies: DataFrame) -> DataFrame:
    """One row per observed woman: ages at first birth, matric and first union (null: not seen)."""
    return women_with_events(episodes, pregnancies).select(
        "IndividualId", "EduMaxLbl", "AgeFirstBirth", "AgeMatric", "AgeAtUnion", "DoB"
    )


def _strictly(first: str, second: str, third: str) -> Column:
    a, b, c = (F.col(AGES[e]) for e in (first, second, third))
    return (a < b) & (b < c)


def event_order_table(events: DataFrame) -> DataFrame:
    """Percent of women with all three events in each strict order; ties are in none. One pass."""
    complete = events.dropna(subset=list(AGES.values()))
    counts = complete.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(_strictly(*order)).alias(", ".join(order)) for _, *order in fv.EVENT_ORDERS],
    )
    labels = [", ".join(order) for _, *order in fv.EVENT_ORDERS]
    long = pivot_longer(counts, labels, "Label", "_with")
    return long.select("Label", round_half_even(percent(F.col("_with"), F.col("n")), 0).alias("perc"))


def order_class(fallback: str = fv.FALLBACK_ORDER) -> Column:
    """Code of the event order of a woman with all ages known; ties go to the fallback."""
    chain = F
    for code, *order in fv.EVENT_ORDERS:
        if code != fallback:
            chain = chain.when(_strictly(*order), code)
    return chain.otherwise(fallback)


def event_order_medians(events: DataFrame) -> DataFrame:
    """Median age at each event per order class, long form."""
    # women with an unknown age have no class; a test on the class itself would repeat its
    # whole expression in a filter
    classed = events.dropna(subset=list(AGES.values())).withColumn("Order", order_class())
    ages = {"MedianBirth": "AgeFirstBirth", "MedianUnion": "AgeAtUnion", "MedianMatric": "AgeMatric"}
    named = classed.select("Order", *[F.col(age).alias(name) for name, age in ages.items()])
    long = pivot_longer(named, list(ages), "Event", "value")
    return exact_quantiles(long, ["Order", "Event"], "value", {"Median": 0.5}, small=True).withColumnRenamed(
        "Median", "value"
    )
