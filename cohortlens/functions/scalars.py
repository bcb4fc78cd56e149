"""Column functions with the null, tie and edge rules the calculations need.

Everything here is a built-in Spark expression, so it stays in generated code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv


def decimal_date(d: Column) -> Column:
    """A date as a fractional year: the year plus the share of it that has passed."""
    year = F.year(d)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return year + (F.dayofyear(d) - 1) / F.when(leap, 366).otherwise(365)


def age_at(d: Column, born: Column) -> Column:
    return decimal_date(d) - decimal_date(born)


def mid_december_before(d: Column) -> Column:
    """15 December of the year before ``d``: the end of the school year."""
    return F.make_date(F.year(d) - 1, F.lit(12), F.lit(15))


def if_else(test: Column, yes, no) -> Column:
    """A condition that is unknown gives null, not the else value."""
    return F.when(test, yes).when(~test, no)


def matches(col: Column, pattern: str) -> Column:
    """Substring regex match on the text of ``col``; null is no match."""
    return F.coalesce(col.cast("string").rlike(pattern), F.lit(False))


def matches_code(code: Column, pattern: str, digits: Sequence[int]) -> Column:
    """``matches`` for a pattern that is a choice of digits: one-digit codes are compared as numbers."""
    return F.when((code >= 0) & (code <= 9), code.isin(list(digits))).otherwise(matches(code, pattern))


def between(col: Column, lo, hi, incl_lo: bool = False, incl_hi: bool = False) -> Column:
    above = col >= F.lit(lo) if incl_lo else col > F.lit(lo)
    below = col <= F.lit(hi) if incl_hi else col < F.lit(hi)
    return above & below


def date_between(col: Column, lo: str, hi: str, incl_lo: bool = False, incl_hi: bool = False) -> Column:
    return between(col, F.to_date(F.lit(lo)), F.to_date(F.lit(hi)), incl_lo, incl_hi)


def _cut(col: Column, edges: Sequence[Column], labels: Sequence[str], right: bool) -> Column:
    if len(edges) != len(labels) + 1:
        raise ValueError("one more break than labels is needed")
    bins = [
        ((col > lo) & (col <= hi) if right else (col >= lo) & (col < hi), label)
        for lo, hi, label in zip(edges, edges[1:], labels)
    ]
    return reduce(lambda chain, b: chain.when(b[0], b[1]), bins[1:], F.when(*bins[0]))


def cut_numeric(col: Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Bins closed on the right; the lowest break and anything outside give null."""
    return _cut(col, [F.lit(b) for b in breaks], labels, right=True)


def cut_date(col: Column, breaks: Sequence[str], labels: Sequence[str]) -> Column:
    """Bins closed on the left; a label may be used for several bins."""
    return _cut(col, [F.to_date(F.lit(b)) for b in breaks], labels, right=False)


def age_group(age: Column) -> Column:
    """``cut_numeric`` with the age breaks, which are all multiples of the group width.

    The label is looked up by the number of the five-year step, so that a computed age is
    evaluated once and not again for each bin. Outside the steps the lookup gives null.
    """
    width = fv.AGE_GROUP_WIDTH
    steps = [
        label
        for label, lo, hi in zip(fv.AGE_LABELS, fv.AGE_BREAKS, fv.AGE_BREAKS[1:])
        for _ in range((hi - lo) // width)
    ]
    return F.get(F.array(*[F.lit(label) for label in steps]), F.ceil(age / width).cast("int") - 1)


def cohort(born: Column, closed: str = "study") -> Column:
    """Birth cohort. ``study`` leaves some first days out, ``left`` closes every bin on the left."""
    if closed == "left":
        return cut_date(born, fv.COHORT_DATE_BREAKS, fv.COHORT_DATE_LABELS)
    if closed != "study":
        raise ValueError("closed must be 'study' or 'left'")
    chain = F.when(born.isNull(), None)
    for label, lo, hi, incl_lo in fv.COHORT_BINS:
        chain = chain.when(date_between(born, lo, hi, incl_lo=incl_lo), label)
    return chain.otherwise(fv.OTHER_COHORT)


def in_study_cohort(born: Column) -> Column:
    """The same rule as plain date comparisons, which reach the parquet scan."""
    tests = [date_between(born, lo, hi, incl_lo=incl_lo) for _, lo, hi, incl_lo in fv.COHORT_BINS]
    lowest, highest = fv.COHORT_BINS[0][1], fv.COHORT_BINS[-1][2]
    return date_between(born, lowest, highest) & reduce(lambda a, b: a | b, tests)


def education_group(level: Column) -> Column:
    primary, some_secondary, matric, some_tertiary = fv.EDUCATION_LEVELS
    return (
        F.when(level < 8, primary)
        .when(level < fv.MATRIC_GRADE, some_secondary)
        .when(level == fv.MATRIC_GRADE, matric)
        .when(level > fv.MATRIC_GRADE, some_tertiary)
    )


def round_half_even(col: Column, digits: int = 0) -> Column:
    """The nearer of the two neighbours with ``digits`` decimals; the even one if both are as near.

    Nearness is measured on the stored number: 2.675 is a little less than it looks and gives
    2.67. The built-in rounding functions look at the decimal text instead and give 2.68.
    """
    scale = F.lit(float(10**digits))
    steps = F.floor(col * scale)
    down, up = steps / scale, (steps + 1) / scale
    nearer_down = (col - down < up - col) | ((col - down == up - col) & (F.abs(steps) % 2 == 0))
    return F.when(nearer_down, down).when(~nearer_down, up)


def fixed_text(col: Column, digits: int = 2) -> Column:
    """Rounded number as text with a fixed count of decimals, no grouping marks; null is NA."""
    value = round_half_even(col, digits)
    return F.when(value.isNull(), "NA").otherwise(F.format_string(f"%.{digits}f", value))


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def none_if_zero(count: Column) -> Column:
    """A count of nothing is a missing cell in tables that are matched by key."""
    return F.nullif(count, F.lit(0))


def percent(part: Column, whole: Column) -> Column:
    return 100 * safe_divide(part, whole)


def recode(col: Column, names: Mapping) -> Column:
    """Replace values by a fixed map; values outside it give null."""
    chain = None
    for old, new in names.items():
        chain = F.when(col == F.lit(old), F.lit(new)) if chain is None else chain.when(col == F.lit(old), F.lit(new))
    return chain


def level_rank(col: Column, levels: Sequence[str]) -> Column:
    """1-based place of a label in its level order; null for unknown labels."""
    return recode(col, {label: place for place, label in enumerate(levels, start=1)})


def assign_where(col: Column, cond: Column, value) -> Column:
    return F.when(cond, F.lit(value)).otherwise(col)


def to_number(col: Column, kind: str = "double") -> Column:
    """Text to number; text that is no number gives null."""
    return col.try_cast(kind)


def to_day(col: Column) -> Column:
    return col.try_cast("date")


def iqr_text(q1: Column, q3: Column) -> Column:
    return F.concat(F.lit(" ("), q1, F.lit(", "), q3, F.lit(")"))


def significance_mark(p: Column) -> Column:
    chain = F.when(p.isNull(), None)
    for limit, mark in fv.SIGNIFICANCE:
        chain = chain.when(p < limit, mark)
    return chain.otherwise("")


def level_code(label: Column, levels: Sequence[str]) -> Column:
    """Place of a label in its levels, from 1; a number folds without sorting rows, unlike a text. Null for other labels."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in levels]), label).cast("int"), F.lit(0))


def level_label(code: Column, levels: Sequence[str]) -> Column:
    """The label of a :func:`level_code`."""
    return F.get(F.array(*[F.lit(x) for x in levels]), code - 1)
