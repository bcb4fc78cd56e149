"""Births, person-years and fertility rates.

Births and exposure of a woman are both folded to one row before anything is joined: births as
one count per age group, exposure as a 64-bit mask of the years she lived under observation
(bit k: the calendar year k years after her year of birth). Bitwise-or combines on the map
side, and the years spent in an age group are a bit count, so no year rows, no distinct and no
set per woman are needed. ``person_years`` writes the same years out as rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scalars import (
    age_at,
    age_group,
    cohort,
    date_between,
    decimal_date,
    in_study_cohort,
    matches,
    none_if_zero,
    recode,
    round_half_even,
    safe_divide,
)
from ..operators.columns import mask_cells
from ..operators.reshape import pivot_values, replicate_rows
from ..operators.skew import salted_join
from ..operators.windows import running_total
from .persons import analysis_persons, base_aggregates, women_only

BITS = 64
AGE_SPAN = {label: (lo, hi) for label, lo, hi in zip(fv.AGE_LABELS, fv.AGE_BREAKS, fv.AGE_BREAKS[1:])}


# --- births -----------------------------------------------------------------------------


def with_age_at_birth(pregnancies: DataFrame) -> DataFrame:
    return pregnancies.withColumn("AgeAtBirth", age_at(F.col("DDate"), F.col("MotherDoB")))


def multiplicity() -> Column:
    """Rows a delivery stands for: its live-born count if 2, 3 or 4, else one."""
    return F.when(F.col("LCnt").isin(2, 3, 4), F.col("LCnt")).otherwise(1).cast("long")


def live_deliveries(pregnancies: DataFrame) -> DataFrame:
    """Deliveries that count as births, with the age group."""
    dated = with_age_at_birth(pregnancies.filter(F.col("DDate") > F.to_date(F.lit(fv.BIRTHS_AFTER))))
    live = dated.filter(matches(F.col("Outcome"), fv.LIVE_BIRTH_PATTERN) & (F.col("AgeAtBirth") < 50))
    grouped = live.withColumn("Agegroup", age_group(F.col("AgeAtBirth")))
    return grouped.filter(F.col("Agegroup").isin(fv.FERTILE_AGES))


def mothers_frame(episodes: DataFrame) -> DataFrame:
    """Persons last seen old enough; attributes only for women whose education was followed too."""
    known = F.col("Followed") & (F.col("Sex") == fv.FEMALE)
    people = analysis_persons(episodes, min_edu=None)
    attributes = [F.when(known, F.col(c)).alias(c) for c in ("Generation", "EverMarried", "EduMaxLbl")]
    return people.select("IndividualId", *attributes)


def births(pregnancies: DataFrame, episodes: DataFrame, salts: int | None = None) -> DataFrame:
    """One row per live birth with the mother's cohort, state and education (null outside the full frame).

    The counts below do not use these rows; they weight deliveries instead.
    """
    live = live_deliveries(pregnancies)
    joined = salted_join(live, mothers_frame(episodes), [("WomanId", "IndividualId")], "inner", salts)
    return replicate_rows(joined, multiplicity())


def births_per_woman(pregnancies: DataFrame) -> DataFrame:
    """One row per woman with a pregnancy record: births in each fertile age group."""
    dated = with_age_at_birth(pregnancies)
    counts = (
        (F.col("DDate") > F.to_date(F.lit(fv.BIRTHS_AFTER)))
        & (F.col("AgeAtBirth") < 50)
        & matches(F.col("Outcome"), fv.LIVE_BIRTH_PATTERN)
    )
    rows = dated.select(
        "WomanId", F.when(counts, age_group(F.col("AgeAtBirth"))).alias("Agegroup"), multiplicity().alias("_m")
    )
    per_group = [
        F.sum(F.when(F.col("Agegroup") == label, F.col("_m")).otherwise(0)).alias(f"B_{label}")
        for label in fv.FERTILE_AGES
    ]
    return rows.groupBy("WomanId").agg(*per_group)


def _sums(labels: Sequence[str], prefix: str) -> list[Column]:
    return [F.sum(f"{prefix}{label}").alias(f"{prefix}{label}") for label in labels]


def _long(wide: DataFrame, ids: Sequence[str], prefix: str, value: str) -> DataFrame:
    """Wide sums over the fertile age groups to one row per group (a few dozen rows)."""
    cells = [F.struct(F.lit(g).alias("Agegroup"), F.col(f"{prefix}{g}").alias(value)) for g in fv.FERTILE_AGES]
    return wide.select(*ids, F.inline(F.array(*cells)))


def births_by_agegroup(pregnancies: DataFrame, episodes: DataFrame) -> DataFrame:
    """Number of births per cohort, marital state and age group; cells without births are left out."""
    women = births_per_woman(pregnancies)
    mothers = mothers_frame(episodes)
    joined = women.join(mothers, women["WomanId"] == mothers["IndividualId"])
    sums = joined.groupBy("Generation", "EverMarried").agg(*_sums(fv.FERTILE_AGES, "B_"))
    return _long(sums, ["Generation", "EverMarried"], "B_", "n").filter("n > 0")


# --- person-years -----------------------------------------------------------------------


def cohort_women(episodes: DataFrame) -> DataFrame:
    return women_only(episodes).filter(date_between(F.col("DoB"), *fv.ALL_COHORTS_WINDOW))


def _women_folded(episodes: DataFrame, extras: dict[str, Column]) -> DataFrame:
    """Women of the cohorts' window, one row each, with whether they are in the full frame.

    Unlike the person frames this keeps women without education or known status and those
    born on a day the study cohorts leave out.
    """
    # years since birth, unknown for a year that starts before it: that is no later than the year of the day before
    year = F.year("StartDate")
    rows = cohort_women(episodes).withColumn("_k", F.when(year > F.year(F.date_sub("DoB", 1)), year - F.year("DoB")))
    folded = rows.groupBy("IndividualId").agg(
        *[a.alias(n) for n, a in {**base_aggregates(), **extras}.items()]
    )
    full = (
        F.col("EduMax").isNotNull()
        & F.col("EverMarried").isNotNull()
        & in_study_cohort(F.col("DoB"))
        & (age_at(F.col("EduLastSeen"), F.col("DoB")) >= fv.MIN_AGE_EDUCATION_SEEN)
        & (age_at(F.col("LastSeen"), F.col("DoB")) >= fv.MIN_AGE_LAST_SEEN)
    )
    return folded.withColumn("Full", F.coalesce(full, F.lit(False)))


def lived_masks(episodes: DataFrame, y0: int = fv.FIRST_YEAR, y1: int = fv.LAST_YEAR) -> DataFrame:
    """One row per woman with the years she lived, as bits: ``Low`` and ``High`` hold the years 0 to 63 and 64 to 127
    after her year of birth.

    Women of the full frame have every year from birth to their last observed one (generated
    years stay within y0..y1); other women the years they were observed in. Bitwise-or has a buffer of fixed
    size, whatever the number of her rows. An observation 128 years after birth or later is no year of a life.
    """
    k = F.col("_k")
    masks = {
        "SeenLow": F.bit_or(F.when(k < BITS, _shifted(k))),
        "SeenHigh": F.bit_or(F.when((k >= BITS) & (k < 2 * BITS), _shifted(k))),
    }
    none = F.lit(0).cast("long")
    # the date of death may stand on some of a woman's rows only: years are cut at it after the fold
    died = F.coalesce(F.year("DoD") - F.year("DoB"), F.lit(2 * BITS))
    folded = _women_folded(episodes, masks).withColumn("Died", died)
    alive = folded.withColumns(
        {
            "SeenLow": F.coalesce("SeenLow", none).bitwiseAND(_upto(F.col("Died"))),
            "SeenHigh": F.coalesce("SeenHigh", none).bitwiseAND(_upto(F.col("Died") - BITS)),
        }
    )
    newest = F.when(F.col("SeenHigh") != 0, F.length(F.bin("SeenHigh")) + (BITS - 1)).when(
        F.col("SeenLow") != 0, F.length(F.bin("SeenLow")) - 1
    )
    spans = alive.withColumns(
        {
            "Until": F.least(newest, F.lit(y1) - F.year("DoB")),
            "From": F.greatest(F.lit(y0), F.year(F.date_sub("DoB", 1)) + 1) - F.year("DoB"),
        }
    )

    def filled(shift: int) -> Column:
        before = F.bitwise_not(_upto(F.col("From") - (shift + 1)))
        return F.when(F.col("Full"), _upto(F.col("Until") - shift).bitwiseAND(before)).otherwise(none)

    # the generator makes plain columns of the formulas, so that later conditions don't repeat them
    columns = F.struct(
        "IndividualId", "DoB", "Full", "EverMarried",
        F.col("SeenLow").bitwiseOR(filled(0)).alias("Low"), F.col("SeenHigh").bitwiseOR(filled(BITS)).alias("High"),
    )
    return spans.select(F.inline(F.array(columns))).filter((F.col("Low") != 0) | (F.col("High") != 0))


def _has_bit(k: Column) -> Column:
    """Whether year k is lived."""
    low = F.call_function("shiftrightunsigned", F.col("Low"), k.cast("int"))
    high = F.call_function("shiftrightunsigned", F.col("High"), (k - BITS).cast("int"))
    return F.when(k < BITS, low).otherwise(high).bitwiseAND(F.lit(1).cast("long"))


def person_years(episodes: DataFrame, y0: int = fv.FIRST_YEAR, y1: int = fv.LAST_YEAR) -> DataFrame:
    """One row per woman and calendar year lived (see :func:`lived_masks`), written out from the bits."""
    years = lived_masks(episodes, y0, y1).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(2 * BITS - 1))))
    return years.filter(_has_bit(F.col("_k")) == 1).select(
        "IndividualId", "DoB", (F.year("DoB") + F.col("_k")).alias("Year")
    )


def with_age_and_cohort(years: DataFrame) -> DataFrame:
    age = F.col("Year") - decimal_date(F.col("DoB"))
    return years.withColumns({"Age": age, "Agegroup": age_group(age), "Generation": cohort(F.col("DoB"), "left")})


def exposure(episodes: DataFrame, pregnancies: DataFrame, require_pregnancy: bool = True) -> DataFrame:
    """Person-years between 15 and 50 as rows, with cohort and marital state (null outside the full frame)."""
    years = with_age_and_cohort(person_years(episodes))
    fertile = years.filter(F.col("Agegroup").isin(fv.FERTILE_AGES) & (F.col("Generation") != fv.OTHER_COHORT))
    if require_pregnancy:
        mothers = pregnancies.select(F.col("WomanId").alias("IndividualId")).distinct()
        fertile = fertile.join(mothers, "IndividualId", "left_semi")
    state = analysis_persons(episodes).select("IndividualId", "EverMarried")
    return fertile.join(state, "IndividualId", "left")


def _mask(lo: int, hi: int) -> int:
    """Bits lo..hi."""
    return ((1 << (hi + 1)) - 1) ^ ((1 << lo) - 1)


def lived_mask(episodes: DataFrame, y1: int = fv.LAST_YEAR) -> DataFrame:
    """One row per woman: cohort, marital state and the mask of her first 64 years lived.

    A year k years after the year of birth falls into the age group (lo, hi] exactly if
    lo < k <= hi, whatever the day of birth, so age groups are bit ranges. The fertile ages
    end well below the 64 bits.
    """
    return lived_masks(episodes, y1=y1).select(
        "IndividualId",
        "Full",
        cohort(F.col("DoB"), "left").alias("Generation"),
        F.when(F.col("Full"), F.col("EverMarried")).alias("EverMarried"),
        F.col("Low").alias("Mask"),
    )


def _upto(k: Column) -> Column:
    """Bits 0..k, none for a negative k: -1 has every bit set."""
    cut = F.greatest(F.lit(0), F.lit(BITS - 1) - k).cast("int")
    return F.when(k >= 0, F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), cut)).otherwise(0)


def _shifted(k: Column) -> Column:
    """1 shifted left by k (by what is left of whole 64s) as a 64-bit number."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def years_per_group(mask: Column) -> list[Column]:
    """Years spent in each fertile age group."""
    spans = [(g, *AGE_SPAN[g]) for g in fv.FERTILE_AGES]
    return [
        F.bit_count(mask.bitwiseAND(F.lit(_mask(lo + 1, hi)).cast("long"))).cast("long").alias(f"Y_{g}")
        for g, lo, hi in spans
    ]


def exposure_counts(episodes: DataFrame, pregnancies: DataFrame, require_pregnancy: bool = True) -> DataFrame:
    """Person-years per cohort, marital state and age group, from the masks."""
    masks = lived_mask(episodes).filter(F.col("Generation") != fv.OTHER_COHORT)
    if require_pregnancy:
        mothers = pregnancies.select(F.col("WomanId").alias("IndividualId")).distinct()
        masks = masks.join(mothers, "IndividualId", "left_semi")
    wide = masks.select("*", *years_per_group(F.col("Mask")))
    sums = wide.groupBy("Generation", "EverMarried").agg(*_sums(fv.FERTILE_AGES, "Y_"))
    return _long(sums, ["Generation", "EverMarried"], "Y_", "n").filter("n > 0")


def lexis_cells(
    episodes: DataFrame, width: int = 10, first_year: int = 1945, last_year: int = 2020, last_age: int = 75,
    band: tuple[int, int] = (2000, 19),
) -> DataFrame:
    """Person-years per cohort, period cell and age cell of the Lexis grid; ``band`` marks observed years."""
    women = lived_masks(episodes).select(
        cohort(F.col("DoB"), "left").alias("Generation"), F.year("DoB").alias("_born"),
        (F.dayofyear("DoB") == 1).alias("_first_day"), "Low", "High",
    )
    # a year's cells depend on the year of birth and on k alone: years are counted per bit before they are cells,
    # in one row per cohort and year of birth
    bits = [F.sum(_has_bit(F.lit(k))).alias(f"_{k}") for k in range(last_age + 1)]
    counts = women.filter(F.col("Generation") != fv.OTHER_COHORT).groupBy("Generation", "_born", "_first_day").agg(*bits)
    cells = F.inline(F.array(*[F.struct(F.lit(k).alias("_k"), F.col(f"_{k}").alias("_n")) for k in range(last_age + 1)]))
    years = counts.select("Generation", "_born", "_first_day", cells).filter("_n > 0").select(
        "Generation", "_n", (F.col("_born") + F.col("_k")).alias("Year"),
        # the whole years of age when the year begins
        F.when(F.col("_first_day"), F.col("_k")).otherwise(F.col("_k") - 1).alias("Age"),
    )
    inside = years.filter(
        (F.col("Year") >= first_year) & (F.col("Year") < last_year) & (F.col("Age") >= 0) & (F.col("Age") < last_age)
    )
    start, length = band
    period = F.lit(first_year) + F.floor((F.col("Year") - first_year) / width) * width
    return inside.groupBy(
        "Generation",
        period.cast("long").alias("Period"),
        (F.floor(F.col("Age") / width) * width).cast("long").alias("AgeCell"),
    ).agg(
        F.sum("_n").alias("n"),
        F.sum(F.when((F.col("Year") >= start) & (F.col("Year") < start + length), F.col("_n")).otherwise(0)).alias("n_in_band"),
    )


# --- rates ------------------------------------------------------------------------------


def asfr(
    pregnancies: DataFrame, episodes: DataFrame, by: Sequence[str] = ("EverMarried",), require_pregnancy: bool = True
) -> DataFrame:
    """Age-specific fertility rates per cohort (and ``by``): births over person-years.

    One pass over each table and one join of one-row-per-woman frames. Births count for women
    of the full frame; years also for others, unless the marital state is asked for (it is
    known in the full frame only). A cell without births or without years has no rate.
    """
    # the full frame holds no other cohort
    years = lived_mask(episodes).filter(F.col("Full") if by else F.col("Generation") != fv.OTHER_COHORT)
    women = births_per_woman(pregnancies).withColumnRenamed("WomanId", "IndividualId")
    joined = years.join(women, "IndividualId", "inner" if require_pregnancy else "left")
    born = [F.when(F.col("Full"), F.col(f"B_{g}")).otherwise(0).alias(f"B_{g}") for g in fv.FERTILE_AGES]
    cells = joined.select("Generation", *by, *born, *years_per_group(F.col("Mask")))
    sums = cells.groupBy("Generation", *by).agg(*_sums(fv.FERTILE_AGES, "B_"), *_sums(fv.FERTILE_AGES, "Y_"))
    any_birth = reduce(lambda a, b: a + b, [F.col(f"B_{g}") for g in fv.FERTILE_AGES]) > 0
    return _rates(sums.filter(any_birth), ["Generation", *by])


def _rates(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    cells = [
        F.struct(
            F.lit(fv.AGE_DISPLAY[g]).alias("Agegroup"),
            none_if_zero(F.col(f"B_{g}")).alias("births"),
            none_if_zero(F.col(f"Y_{g}")).alias("years"),
        )
        for g in fv.FERTILE_AGES
    ]
    long = sums.select(*by, F.inline(F.array(*cells)))
    return long.withColumn("value", safe_divide(F.col("births"), F.col("years")))


def tfr(rates: DataFrame, by: Sequence[str], width: int = fv.AGE_GROUP_WIDTH) -> DataFrame:
    """Total fertility rate: width times the sum of all seven rates; unknown if one is."""
    complete = F.count("value") == len(fv.FERTILE_AGES)
    return rates.groupBy(*by).agg(F.when(complete, width * F.sum("value")).alias("TFR"))


def asfr_long(rates: DataFrame, masked: Sequence[tuple[str, str]] = tuple(fv.MASKED_RATES)) -> DataFrame:
    """Rates without the cells fewer than half of a cohort have reached."""
    return mask_cells(rates, ["Generation", "Agegroup"], masked, "value")


def cumulative_fertility(masked_rates: DataFrame, by: Sequence[str] = ("EverMarried",)) -> DataFrame:
    """Children born up to the end of each age group, one column per age group, rounded."""
    groups = ["Generation", *by]
    running = running_total(masked_rates, groups, ["Agegroup"], "value", "_cum", small=True)
    known = running.withColumn("_cum", fv.AGE_GROUP_WIDTH * F.col("_cum")).filter(F.col("_cum").isNotNull())
    labels = list(fv.AGE_DISPLAY.values())
    wide = pivot_values(known, groups, "Agegroup", "_cum", labels)
    rounded = [round_half_even(F.col(f"`{label}`"), 2).alias(label) for label in labels]
    named = recode(F.col("Generation"), fv.COHORT_DISPLAY).alias("Generation")
    states = [
        F.when(F.col(c) == 1, "Ever-married").when(F.col(c) == 0, "Never-married").alias(c) for c in by
    ]
    return wide.select(*states, named, *rounded)


# --- shares -----------------------------------------------------------------------------


def births_never_married(pregnancies: DataFrame, episodes: DataFrame) -> DataFrame:
    """Births of the two younger cohorts by whether the mother never married."""
    cells = births_by_agegroup(pregnancies, episodes).filter(F.col("Generation").isin(fv.COHORT_LEVELS[1:]))
    return cells.groupBy((F.col("EverMarried") == 0).alias("NeverMarried")).agg(F.sum("n").alias("n"))


def teen_birth_share(pregnancies: DataFrame, episodes: DataFrame, age: int = fv.TEEN_AGE) -> DataFrame:
    """First births before and after ``age`` per cohort (null: mother outside the full frame)."""
    young = F.col("MotherAge") < age
    firsts = pregnancies.filter(F.col("BirthOrder") == 1).groupBy("WomanId").agg(
        F.count_if(young).alias("_yes"), F.count_if(~young).alias("_no")
    )
    mothers = analysis_persons(women_only(episodes)).select("IndividualId", "Generation")
    joined = firsts.join(mothers, firsts["WomanId"] == mothers["IndividualId"], "left")
    sums = joined.groupBy("Generation").agg(
        none_if_zero(F.sum("_yes")).alias("under"), none_if_zero(F.sum("_no")).alias("over")
    )
    return sums.withColumn("perc", safe_divide(F.col("under"), F.col("under") + F.col("over")))
