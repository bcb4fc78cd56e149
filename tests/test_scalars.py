import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import fixed_values as fv
from cohortlens.functions import scalars as S


def values(spark, data, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def days(*texts):
    return [dt.date.fromisoformat(t) if t else None for t in texts]


def test_decimal_date(spark):
    got = values(spark, days("2000-07-01", "2001-07-01", "1999-12-31", "2001-01-01", None), "date", S.decimal_date)
    assert got[:4] == pytest.approx([2000.497268, 2001.495890, 1999.997260, 2001.0], abs=1e-6)
    assert got[4] is None
    leap = days("1900-12-31", "2000-12-31", "2004-12-31", "2100-12-31")
    ends = [1900 + 364 / 365, 2000 + 365 / 366, 2004 + 365 / 366, 2100 + 364 / 365]
    assert values(spark, leap, "date", S.decimal_date) == ends


def test_if_else_unknown_condition(spark):
    assert values(spark, [1, 5, None], "int", lambda c: S.if_else(c > 3, "yes", "no")) == ["no", "yes", None]


def test_matches(spark):
    assert values(spark, [12, None, 5, 3], "int", lambda c: S.matches(c, "2|3|4")) == [True, False, False, True]
    assert values(spark, ["SB", "L", None], "string", lambda c: S.matches(c, fv.LIVE_BIRTH_PATTERN)) == [
        False, True, False,
    ]


def test_matches_code_is_matches(spark):
    codes = [None, -3, 0, 1, 2, 3, 4, 5, 9, 10, 12, 15, 24, 100]
    fast = values(spark, codes, "int", lambda c: S.matches_code(c, fv.EVER_MARRIED_PATTERN, fv.EVER_MARRIED_CODES))
    assert fast == values(spark, codes, "int", lambda c: S.matches(c, fv.EVER_MARRIED_PATTERN))


def test_age_bins_closed_right(spark):
    ages = [0.0, 15.0, 15.001, 20.0, 20.001, 50.0, 50.001, 100.1, None]
    assert values(spark, ages, "double", S.age_group) == [
        None, "xu15", "x1519", "x1519", "x2024", "x4549", "xo50", None, None,
    ]


def test_age_group_is_the_numeric_cut(spark):
    ages = [x for b in fv.AGE_BREAKS for x in (b - 2.3e-13, float(b), b + 2.3e-13, b + 1 / 366, b - 1 / 365, b + 2.5)]
    cut = values(spark, ages, "double", lambda c: S.cut_numeric(c, fv.AGE_BREAKS, fv.AGE_LABELS))
    assert values(spark, ages, "double", S.age_group) == cut


COHORT_EDGES = days(
    "1945-01-01", "1945-01-02", "1964-12-31", "1965-01-01", "1984-12-31", "1985-01-01", "1985-01-02", "1994-12-31",
    "1995-01-01", None,
)


def test_cohort_edges(spark):
    labels = values(spark, COHORT_EDGES, "date", S.cohort)
    assert labels == ["Other", "Gen1", "Gen1", "Gen2", "Gen2", "Other", "Gen3", "Gen3", "Other", None]
    inside = values(spark, COHORT_EDGES, "date", S.in_study_cohort)
    assert [bool(i) for i in inside] == [g not in ("Other", None) for g in labels]


def test_cohort_edges_left_closed(spark):
    edges = days("1945-01-01", "1965-01-01", "1985-01-01", "1995-01-01", "1944-12-31")
    assert values(spark, edges, "date", lambda c: S.cohort(c, "left")) == ["Gen1", "Gen2", "Gen3", "Other", "Other"]


def test_education_group(spark):
    primary, secondary, matric, tertiary = fv.EDUCATION_LEVELS
    assert values(spark, [0, 7, 8, 11, 12, 13, None], "int", S.education_group) == [
        primary, primary, secondary, secondary, matric, tertiary, None,
    ]


def test_rounding(spark):
    got = values(spark, [0.125, 0.375, 2.675, -0.125, 7.0, 0.15, None], "double", lambda c: S.round_half_even(c, 2))
    assert got == [0.12, 0.38, 2.67, -0.12, 7.0, 0.15, None]
    assert values(spark, [0.5, 1.5, 2.5, -0.5], "double", S.round_half_even) == [0.0, 2.0, 2.0, 0.0]


def test_fixed_text(spark):
    assert values(spark, [1234.5, 3.0, None], "double", S.fixed_text) == ["1234.50", "3.00", "NA"]


def test_lenient_casts(spark):
    assert values(spark, ["7", "x", None], "string", lambda c: S.to_number(c, "int")) == [7, None, None]
    assert values(spark, ["2001-02-03", "never"], "string", S.to_day) == [dt.date(2001, 2, 3), None]


def test_division(spark):
    df = spark.createDataFrame([(1, 4), (1, 0), (None, 2)], "a int, b int")
    assert [r[0] for r in df.select(S.percent(F.col("a"), F.col("b"))).collect()] == [25.0, None, None]


def test_labels(spark):
    assert values(spark, ["b", "a", "z"], "string", lambda c: S.level_rank(c, ["b", "a"])) == [1, 2, None]
    assert values(spark, [10, 11], "int", lambda c: S.assign_where(c, c == 10, 11)) == [11, 11]
    assert values(spark, days("2003-05-06"), "date", S.mid_december_before) == days("2002-12-15")


def test_significance(spark):
    marks = values(spark, [0.0001, 0.001, 0.02, 0.05, None], "double", S.significance_mark)
    assert marks == ["***", "**", "*", "", None]


def test_date_bins_repeat_label(spark):
    got = values(
        spark, days("1999-12-31", "2000-01-01", "2001-01-01", "2002-01-01"), "date",
        lambda c: S.cut_date(c, ["2000-01-01", "2001-01-01", "2002-01-01", "2003-01-01"], ["o", "in", "o"]),
    )
    assert got == [None, "o", "in", "o"]


def test_nan_free(spark):
    assert not any(isinstance(v, float) and math.isnan(v) for v in values(spark, [1.0], "double", S.age_group))
