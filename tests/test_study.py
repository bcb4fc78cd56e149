"""The demographic calculations on hand-made persons."""

import datetime as dt

import pytest
import tiny
from pyspark.sql import functions as F

from cohortlens.plans import events as E
from cohortlens.plans import fertility as Fe
from cohortlens.plans import first_birth as B
from cohortlens.plans import marriage as M
from cohortlens.plans import persons as P
from cohortlens.plans import profile as Pr
from cohortlens.plans import validation as V
from cohortlens.sources import derived

SF = "/root/testdata/sf0.001"


# --- persons ----------------------------------------------------------------------------


def test_person_maxima_use_all_rows(spark, rows):
    ep = tiny.episodes(
        spark,
        # the highest education is seen in a row without known status
        dict(IndividualId=1, Education=8, MaritalStatus=1, Sex=2),
        dict(IndividualId=1, Education=13, MaritalStatus=None, StartDate="2012-01-01"),
        dict(IndividualId=1, Education=None, EducationObsDate=None, MaritalStatus=12, StartDate="2011-01-01"),
    )
    got = rows(P.person_summary(ep), "EduMax", "EduMaxLbl", "EverMarried", "Generation", "Followed")
    assert got == [(13, "Some \ntertiary", 1, "Gen2", True)]


def test_persons_left_out(spark, rows):
    ep = tiny.episodes(
        spark,
        dict(IndividualId=1, Education=None, EducationObsDate=None),
        dict(IndividualId=2, MaritalStatus=None),
        dict(IndividualId=3, DoB="1985-01-01"),
        dict(IndividualId=4, DoB="1945-01-01"),
        dict(IndividualId=5, DoB="1988-01-01", StartDate="2010-12-31", EducationObsDate="2010-12-31"),
        dict(IndividualId=6, DoB="1988-01-01", StartDate="2011-01-01", EducationObsDate="2008-12-31"),
        dict(IndividualId=7, DoB="1988-01-01", StartDate="2011-01-01", EducationObsDate="2009-01-01"),
        # the same calendar day 23 years on: a leap year's day is a smaller share of its year
        dict(IndividualId=8, DoB="1988-06-01", StartDate="2011-06-01", EducationObsDate="2011-06-01"),
    )
    assert rows(P.analysis_persons(ep), "IndividualId") == [(7,)]
    assert rows(P.analysis_persons(ep, min_edu=None), "IndividualId") == [(6,), (7,)]


def test_first_known_row_gives_attributes(spark, rows):
    ep = tiny.episodes(
        spark,
        dict(IndividualId=1, MaritalStatus=None, MotherId=5, Episode=1),
        dict(IndividualId=1, MaritalStatus=1, MotherId=7, Episode=3),
        dict(IndividualId=1, MaritalStatus=1, MotherId=6, Episode=2),
    )
    assert rows(P.person_summary(ep), "MotherId") == [(6,)]


def test_row_ages(spark, rows):
    ep = tiny.episodes(spark, dict(IndividualId=1, DoB="1970-01-01", StartDate="2000-07-01", EducationObsDate=None, Education=None))
    assert rows(P.with_ages(ep), "AgeAtObs", "Year", "AgeAtEduObs") == [(pytest.approx(30.497268, abs=1e-6), 2000, None)]


def test_frames_are_unique_and_nested(spark):
    ep = derived.episodes(spark, SF)
    full, fert = P.analysis_persons(ep), P.analysis_persons(ep, min_edu=None)
    assert full.count() == full.select("IndividualId").distinct().count()
    assert full.join(fert, "IndividualId", "left_anti").count() == 0
    sizes = {r["Generation"]: r["n"] for r in P.cohort_sizes(full).collect()}
    assert sum(sizes.values()) == full.count()


# --- marriage ---------------------------------------------------------------------------


def test_unmarried_cells_are_absent(spark, rows):
    ep = tiny.episodes(
        spark,
        dict(IndividualId=1, MaritalStatus=2), dict(IndividualId=2), dict(IndividualId=3, Sex=1),
        dict(IndividualId=4, Education=3, MaritalStatus=4),
    )
    props = M.prop_ever(P.analysis_persons(ep))
    assert rows(props, "Sex", "EduMaxLbl", "MarEver", "n", "MarProp") == [
        (2, "Matric", 1, 2, 0.5), (2, "Primary\nor less", 1, 1, 1.0),
    ]
    assert rows(M.relative_to(props), "EduMaxLbl", "Adv") == [("Matric", 0.0), ("Primary\nor less", 1.0)]
    with pytest.raises(Exception, match="exactly one"):
        M.relative_to(props.filter("EduMaxLbl <> 'Matric'")).collect()


def test_marriage_rates_window_is_open(spark, rows):
    ep = tiny.episodes(
        spark,
        dict(IndividualId=1, MaritalStatus=2, StartDate="2018-01-01"),
        dict(IndividualId=2, MaritalStatus=2, StartDate="2018-01-02"),
        dict(IndividualId=3, MaritalStatus=1, StartDate="2018-06-01"),
        dict(IndividualId=4, Sex=1, MaritalStatus=3, StartDate="2017-06-01"),
    )
    assert rows(M.marriage_rates(ep)) == [
        ("Gen2", "Female", 66.67, 2, 50.0, 1), ("Gen2", "Male", 100.0, 1, None, None),
    ]


def _families(spark):
    young = dict(DoB="1990-01-02", StartDate="2015-01-01", EducationObsDate="2015-01-01")
    return tiny.episodes(
        spark,
        dict(IndividualId=1, MaritalStatus=2), dict(IndividualId=2, Education=3), dict(IndividualId=3, Sex=1),
        dict(IndividualId=9),
        dict(IndividualId=11, MotherId=1, **young), dict(IndividualId=12, MotherId=1, MaritalStatus=2, **young),
        dict(IndividualId=13, MotherId=2, **young), dict(IndividualId=14, MotherId=3, **young),
        dict(IndividualId=15, MotherId=99, **young), dict(IndividualId=16, MotherId=1, Sex=1, **young),
        dict(IndividualId=17, MotherId=None, **young),
    )


def test_mother_daughter_marriage(spark, rows):
    persons = P.analysis_persons(_families(spark))
    # no daughterless mother, no father as mother, no son, no unknown mother
    assert rows(M.mother_daughter_marriage(persons)) == [
        ("Ever- \nMarried", "Matric", 0, 1, 0.5), ("Ever- \nMarried", "Matric", 1, 1, 0.5),
        ("Never- \nMarried", "Primary\nor less", 0, 1, 1.0),
    ]
    pairs = rows(M.mother_daughter_pairs(persons), "ChildIndividualId", "MotherIndividualId", "AgeAtBirth")
    assert [p[:2] for p in pairs] == [(11, 1), (12, 1), (13, 2)]
    assert pairs[0][2] == pytest.approx(19.8411, abs=1e-3)


def test_mother_daughter_teen(spark, rows):
    persons = P.analysis_persons(_families(spark))
    pr = tiny.pregnancies(
        spark,
        dict(WomanId=1, MotherAge=18), dict(WomanId=1, MotherAge=30, BirthOrder=2), dict(WomanId=2, MotherAge=25),
        dict(WomanId=9, MotherAge=22), dict(WomanId=11, MotherAge=20), dict(WomanId=12, MotherAge=19),
        dict(WomanId=17, MotherAge=19),
    )
    # mothers 2, 9, 11, 12, 17 have no child with a pregnancy: one row, of the lowest key (2)
    assert rows(M.mother_daughter_teen(persons, pr)) == [
        ("No", "Primary\nor less", None, 1, 1.0), ("Yes", "Matric", 0, 1, 0.5), ("Yes", "Matric", 1, 1, 0.5),
    ]


# --- fertility --------------------------------------------------------------------------


def test_births(spark, rows):
    ep = tiny.episodes(
        spark,
        dict(IndividualId=1, MaritalStatus=2),
        dict(IndividualId=2, Education=3, EducationObsDate="1980-01-01"),  # education not followed
        dict(IndividualId=3, StartDate="1990-01-01"),  # not followed at all
    )
    ok = dict(WomanId=1, DDate="1992-01-01")
    pr = tiny.pregnancies(
        spark, ok, {**ok, "LCnt": 2}, {**ok, "LCnt": 3}, {**ok, "LCnt": 4}, {**ok, "LCnt": 0}, {**ok, "LCnt": 5},
        {**ok, "Outcome": "SB"}, {**ok, "Outcome": "FM"},
        {**ok, "DDate": "1985-03-01"},  # exactly 15
        {**ok, "DDate": "2020-03-01"},  # 50
        {**ok, "DDate": "1990-03-01"},  # exactly 20: still the first group
        {**ok, "WomanId": 2}, {**ok, "WomanId": 3}, {**ok, "WomanId": 4},
    )
    expected = [("Gen2", 1, "x1519", 1), ("Gen2", 1, "x2024", 1 + 2 + 3 + 4 + 1 + 1 + 1), (None, None, "x2024", 1)]
    assert rows(Fe.births_by_agegroup(pr, ep), "Generation", "EverMarried", "Agegroup", "n") == expected
    assert rows(Fe.births(pr, ep).groupBy("Generation", "EverMarried", "Agegroup").count()) == expected
    assert rows(Fe.births_never_married(pr, ep)) == [(False, 14)]


def literal_person_years(ep, full):
    """The person x year grid with fills, row by row in Python."""

    def dd(d):
        start, end = dt.date(d.year, 1, 1), dt.date(d.year + 1, 1, 1)
        return d.year + (d - start).days / (end - start).days

    data, lo, hi = {}, dt.date(1945, 1, 1), dt.date(1995, 1, 1)
    for r in ep.collect():
        if r.Sex == 2 and lo < r.DoB < hi:
            data.setdefault(r.IndividualId, []).append(r)
    out = set()
    for person, rs in data.items():
        grid = [(r.StartDate.year, 0, r.Episode) for r in rs]
        if person in full:
            grid += [(y, 1, None) for y in range(1945, 2020)]
        born, died = rs[0].DoB, max((r.DoD for r in rs if r.DoD), default=None)
        grid = sorted((g for g in grid if g[0] >= dd(born) and (died is None or g[0] <= dd(died))), key=lambda g: g[:2])
        later = None
        for year, _, episode in reversed(grid):
            later = episode if episode is not None else later
            if later is not None:
                out.add((person, year))
    return out


def test_person_years_equal_the_grid(spark):
    ep = derived.episodes(spark, SF)
    full = {r[0] for r in P.analysis_persons(ep).select("IndividualId").collect()}
    got = [tuple(r) for r in Fe.person_years(ep).select("IndividualId", "Year").collect()]
    assert len(got) == len(set(got))
    assert set(got) == literal_person_years(ep, full)


def _year_people(spark):
    return tiny.episodes(
        spark,
        dict(IndividualId=1, DoB="1970-01-01", StartDate="2010-05-01"),  # born on 1 January: exact ages
        dict(IndividualId=1, DoB="1970-01-01", StartDate="2021-05-01"),  # beyond the grid: only this year
        dict(IndividualId=2, DoB="1985-01-01", StartDate="2012-01-01"),  # not a study cohort: observed years only
        dict(IndividualId=2, DoB="1985-01-01", StartDate="2015-01-01"),
        dict(IndividualId=3, DoB="1980-07-01", DoD="2009-02-01", StartDate="2008-01-01"),
        dict(IndividualId=3, DoB="1980-07-01", DoD="2009-02-01", StartDate="2012-01-01"),  # after death
        dict(IndividualId=3, DoB="1980-07-01", StartDate="2011-01-01"),  # after the death that other rows know
        dict(IndividualId=4, DoB="1950-01-01", StartDate="2016-01-01"),
        dict(IndividualId=5, Sex=1),
        dict(IndividualId=6, DoB="1992-05-05", StartDate="2013-01-01", EducationObsDate="2013-01-01"),  # 20 when last seen
        dict(IndividualId=7, DoB="1990-05-05", StartDate="1989-01-01", EducationObsDate="2013-01-01"),  # before birth
    )


def test_person_years_edges(spark, rows):
    ep = _year_people(spark)
    years = {}
    for person, year in rows(Fe.person_years(ep), "IndividualId", "Year"):
        years.setdefault(person, []).append(year)
    assert years[1] == [*range(1970, 2020), 2021]
    assert years[2] == [2012, 2015]
    assert years[3] == list(range(1981, 2009))
    assert years[4] == list(range(1950, 2017))
    assert years[6] == [2013]
    assert set(years) == {1, 2, 3, 4, 6}
    full = {r[0] for r in P.analysis_persons(ep).select("IndividualId").collect()}
    assert {(p, y) for p, ys in years.items() for y in ys} == literal_person_years(ep, full)


@pytest.mark.parametrize("source", ["edges", "derived"])
@pytest.mark.parametrize("require", [True, False])
def test_masks_count_like_rows(spark, rows, source, require):
    if source == "edges":
        ep = _year_people(spark)
        pr = tiny.pregnancies(spark, *[dict(WomanId=i) for i in (1, 2, 3, 6)])
    else:
        ep, pr = derived.episodes(spark, SF), derived.pregnancies(spark, SF)
    counted = Fe.exposure(ep, pr, require).groupBy("Generation", "EverMarried", "Agegroup").count()
    assert rows(Fe.exposure_counts(ep, pr, require)) == rows(counted)
    assert counted.count() > 0


def test_born_on_the_edge_counts_in_the_last_cohort(spark, rows):
    ep, pr = _year_people(spark), tiny.pregnancies(spark, dict(WomanId=2))
    # 27 and exactly 30 years old in the two observed years
    assert rows(Fe.exposure_counts(ep, pr)) == [("Gen3", None, "x2529", 2)]


def test_rates(spark, rows):
    ep, pr = derived.episodes(spark, SF), derived.pregnancies(spark, SF)
    for by in (("EverMarried",), ()):
        keys = ["Generation", *by]
        rates = Fe.asfr(pr, ep, by)
        births = Fe.births_by_agegroup(pr, ep).filter("Generation IS NOT NULL").groupBy(*keys, "Agegroup").agg(F.sum("n").alias("b"))
        years = Fe.exposure_counts(ep, pr).groupBy(*keys, "Agegroup").agg(F.sum("n").alias("y"))
        want = {tuple(r)[:-1]: r["b"] for r in births.collect()}, {tuple(r)[:-1]: r["y"] for r in years.collect()}
        assert rates.count() == 7 * rates.select(*keys).distinct().count()
        for r in rates.collect():
            key = (*[r[k] for k in keys], "x" + r["Agegroup"].replace("-", ""))
            assert (r["births"], r["years"]) == (want[0].get(key), want[1].get(key))
            known = r["births"] is not None and r["years"] is not None
            assert (r["value"] is None) == (not known)


def _rates(spark, values, generation="Gen1"):
    groups = ["15-19", "20-24", "25-29", "30-34", "35-39", "40-44", "45-49"]
    data = [(generation, 1, g, v) for g, v in zip(groups, values)]
    return spark.createDataFrame(data, "Generation string, EverMarried int, Agegroup string, value double")


def test_tfr_needs_every_group(spark, rows):
    full, gap = _rates(spark, [0.1] * 7), _rates(spark, [0.1] * 6 + [None], "Gen2")
    got = rows(Fe.tfr(full.union(gap), ["Generation", "EverMarried"]))
    assert got == [("Gen1", 1, pytest.approx(3.5)), ("Gen2", 1, None)]


def test_cumulative_fertility(spark, rows):
    rates = _rates(spark, [0.1, 0.1, None, 0.1, 0.1, 0.1, 0.1]).union(_rates(spark, [0.1] * 7, "Gen3"))
    table = Fe.cumulative_fertility(Fe.asfr_long(rates))
    assert table.columns[:4] == ["EverMarried", "Generation", "15-19", "20-24"]
    assert rows(table) == [
        ("Ever-married", "1945-64", 0.5, 1.0, None, None, None, None, None),
        ("Ever-married", "1985-94", 0.5, 1.0, 1.5, None, None, None, None),  # 30-34 is masked
    ]


def test_lexis_cells(spark, rows):
    cells = Fe.lexis_cells(derived.episodes(spark, SF))
    years = Fe.with_age_and_cohort(Fe.person_years(derived.episodes(spark, SF)))
    inside = years.filter("Generation <> 'Other' AND Age >= 0 AND Age < 75 AND Year BETWEEN 1945 AND 2019")
    assert cells.agg(F.sum("n")).first()[0] == inside.count()
    assert cells.agg(F.sum("n_in_band")).first()[0] == inside.filter("Year BETWEEN 2000 AND 2018").count()
    assert cells.filter("AgeCell % 10 <> 0 OR (Period - 1945) % 10 <> 0").count() == 0


def test_teen_birth_share(spark, rows):
    ep = tiny.episodes(spark, dict(IndividualId=1), dict(IndividualId=2))
    pr = tiny.pregnancies(
        spark, dict(WomanId=1, MotherAge=19), dict(WomanId=2, MotherAge=20), dict(WomanId=2, BirthOrder=2, MotherAge=15),
        dict(WomanId=8, MotherAge=30),
    )
    assert rows(Fe.teen_birth_share(pr, ep)) == [("Gen2", 1, 1, 0.5), (None, None, 1, None)]


# --- first births -----------------------------------------------------------------------


def test_first_birth_limits(spark, rows):
    ep = tiny.episodes(spark, dict(IndividualId=1), dict(IndividualId=2, Sex=1))
    one = dict(WomanId=1)
    pr = tiny.pregnancies(
        spark, {**one, "DDate": "1982-03-01"}, {**one, "DDate": "1995-03-01"}, {**one, "DDate": "1982-02-27"},
        {**one, "DDate": "1990-03-01"}, {**one, "DDate": "1990-03-01"}, {**one, "DDate": "1991-03-01", "BirthOrder": 2},
        dict(WomanId=2, DDate="1990-03-01"), dict(WomanId=5, DDate="1990-03-01"),
    )
    assert rows(B.first_births(pr, ep), "AgeAtBirth", "_records") == [(12.0, 1), (20.0, 2)]
    (r,) = B.first_birth_summary(pr, ep).collect()
    assert (r["Median"], r["Q1"], r["Q3"], r["Mean"], r["n"], r["IQR"]) == ("20.00", "16.00", "20.00", "17.33", 3, 4.0)
    (t,) = B.first_birth_report(B.first_birth_summary(pr, ep)).collect()
    assert t["IQR"] == " (16.00, 20.00)"


# --- life events ------------------------------------------------------------------------

GIRL = dict(IndividualId=1, DoB="1990-01-02", Education=9)


def _girl(spark, *rows):
    """A followed woman of the last cohort seen at 13, with further rows."""
    early = dict(GIRL, StartDate="2003-05-01", EducationObsDate="2003-05-01", MaritalStatus=None, Episode=1)
    late = dict(GIRL, StartDate="2016-05-01", EducationObsDate="2016-05-01", MaritalStatus=1, Episode=99)
    return tiny.episodes(spark, early, late, *[{**GIRL, "MaritalStatus": None, "Episode": 10 + i, **r} for i, r in enumerate(rows)])


def test_observed_before(spark, rows):
    assert rows(P.observed_before(_girl(spark))) == [(1,)]
    assert rows(P.observed_before(_girl(spark), age=13)) == []


def _school(day, grade):
    return dict(StartDate=day, EducationObsDate=day, Education=grade)


@pytest.mark.parametrize(
    "grade11, kept",
    [(("2010-02-01", 11), True), (("2006-02-01", 10), True), (("2005-02-01", 11), False), (None, False)],
)
def test_matric_gap(spark, rows, grade11, kept):
    seen = [_school("2008-02-01", 12), _school("2009-02-01", 12)] + ([_school(*grade11)] if grade11 else [])
    got = rows(E.matric_age(_girl(spark, *seen)), "DateMatric", "AgeMatric")
    assert got == ([(dt.date(2007, 12, 15), pytest.approx(17.950685, abs=1e-6))] if kept else [])


def test_matric_too_late(spark, rows):
    seen = [_school("2015-02-01", 12), _school("2014-02-01", 11)]
    assert rows(E.matric_age(_girl(spark, *seen))) == []


def _status(day, status):
    return dict(StartDate=day, MaritalStatus=status)


@pytest.mark.parametrize(
    "seen, union",
    [
        ([("2008-01-01", 1), ("2009-06-01", 5), ("2010-01-01", 2)], "2009-06-01"),
        ([("2008-01-01", 1), ("2009-06-01", 3), ("2010-01-01", 2)], None),  # single too long ago
        ([("2008-01-01", 1), ("2008-06-01", 1), ("2010-05-01", 2), ("2011-01-01", 1)], "2010-05-01"),
        ([("2009-06-01", 5)], None),  # never seen single before
        ([("2009-06-01", 5), ("2009-06-01", 1)], None),  # not strictly before
        ([("2014-06-01", 1), ("2015-06-01", 2)], None),  # after 25
    ],
)
def test_first_union(spark, rows, seen, union):
    got = rows(E.first_union(_girl(spark, *[_status(*s) for s in seen])), "UnionDate")
    assert got == ([(tiny.day(union),)] if union else [])


def test_union_left_censored(spark, rows):
    school = [_school("2008-02-01", 12), _school("2007-02-01", 11)]
    birth = tiny.pregnancies(spark, dict(WomanId=1, MotherDoB="1990-01-02", DDate="2010-01-01"))
    first = dict(StartDate="2005-01-01", MaritalStatus=5, Episode=2)
    ep = _girl(spark, first, *school)
    assert rows(E.union_left_censored(ep, birth), "UnionDate") == [(dt.date(2005, 1, 1),)]
    assert rows(E.life_events(ep, birth), "AgeAtUnion") == [(pytest.approx(14.997260, abs=1e-6),)]
    # not before the birth; no birth or no matric on record; first status single
    early = tiny.pregnancies(spark, dict(WomanId=1, MotherDoB="1990-01-02", DDate="2004-12-01"))
    assert rows(E.union_left_censored(ep, early)) == []
    assert rows(E.union_left_censored(ep, tiny.pregnancies(spark, dict(WomanId=2)))) == []
    assert rows(E.union_left_censored(_girl(spark, first), birth)) == []
    assert rows(E.union_left_censored(_girl(spark, {**first, "MaritalStatus": 1}, *school), birth)) == []
    # rows with the same number are all looked at
    tie = _girl(spark, {**first, "MaritalStatus": 1}, first, {**first, "StartDate": "2005-03-01"}, *school)
    assert rows(E.union_left_censored(tie, birth), "UnionDate") == [(dt.date(2005, 3, 1),)]
    # and the latest of those that pass counts, not the latest
    half = _girl(spark, first, {**first, "StartDate": "2009-03-01"}, *school)
    assert rows(E.union_left_censored(half, birth), "UnionDate") == [(dt.date(2005, 1, 1),)]


def test_first_birth_in_events(spark, rows):
    mine = dict(WomanId=1, MotherDoB="1990-01-02")
    pr = tiny.pregnancies(spark, {**mine, "DDate": "2004-01-01"}, {**mine, "DDate": "2009-01-02"}, {**mine, "DDate": "2010-01-02"})
    assert rows(E.life_events(_girl(spark), pr), "AgeFirstBirth", "AgeMatric", "AgeAtUnion") == [
        (pytest.approx(19.0, abs=0.003), None, None)
    ]


def _events(spark, *ages):
    return spark.createDataFrame(list(ages), "AgeMatric double, AgeFirstBirth double, AgeAtUnion double")


def test_event_orders(spark, rows):
    # matric, birth, union
    ages = [(1.0, 2.0, 3.0)] * 3 + [(2.0, 1.0, 3.0), (3.0, 1.0, 2.0), (1.0, 1.0, 2.0), (None, 1.0, 2.0)]
    table = dict(rows(E.event_order_table(_events(spark, *ages))))
    assert table == {
        "Matric, Birth, Union": 50.0, "Birth, Matric, Union": 17.0, "Birth, Union, Matric": 17.0,
        "Union, Birth, Matric": 0.0, "Union, Matric, Birth": 0.0, "Matric, Union, Birth": 0.0,
    }
    # six separate counts give the same as the single pass
    complete = _events(spark, *ages).dropna()
    mbu = complete.filter("AgeMatric < AgeFirstBirth AND AgeFirstBirth < AgeAtUnion").count()
    assert round(100 * mbu / complete.count()) == table["Matric, Birth, Union"]
    medians = {(o, e): v for o, e, v in rows(E.event_order_medians(_events(spark, *ages)))}
    # the tie falls to the last class, the unknown age is left out
    assert medians[("BUM", "MedianMatric")] == 2.0 and medians[("MBU", "MedianUnion")] == 3.0
    assert {o for o, _ in medians} == {"MBU", "BMU", "BUM"}


def test_no_events(spark, rows):
    assert {p for _, p in rows(E.event_order_table(_events(spark, (None, 1.0, 2.0))))} == {None}


# --- profile ----------------------------------------------------------------------------


def _profile_people(spark):
    return tiny.episodes(
        spark,
        dict(IndividualId=1, HHRelation=1, HouseholdId=1, NonResident=1, CurrentlyEmployed=3),
        dict(IndividualId=1, HHRelation=1, HouseholdId=1, NonResident=0, CurrentlyEmployed=2),
        dict(IndividualId=1, HHRelation=1, HouseholdId=2, StartDate="2011-01-01", CurrentlyEmployed=3),
        dict(IndividualId=1, HHRelation=1, HouseholdId=3, MaritalStatus=None, StartDate="2012-01-01", CurrentlyEmployed=1),
        dict(IndividualId=2, Sex=1, Education=3, DoB="1950-01-01", HHRelation=1, HouseholdId=1, CurrentlyEmployed=1),
        dict(IndividualId=3, Sex=1, StartDate="1985-01-01", EducationObsDate="1985-01-01", HHRelation=1),
    )


def test_cohort_profile(spark, rows):
    got = {(g, v, lv): (n, t) for g, v, lv, n, t in rows(
        Pr.cohort_profile(_profile_people(spark)), "Generation", "Variable", "Level", "n", "total")}
    assert got[("Overall", "Sex", "Female")] == (1, 2)
    assert got[("Gen2", "Education", "Matric")] == (1, 1)
    assert got[("Gen1", "Education", "Primary\nor less")] == (1, 1)
    assert got[("Overall", "Household head", "Female")] == (2, 3)
    assert got[("Gen2", "Residence", "Non-resident in a year")] == (1, 2)
    assert got[("Gen2", "Employment", "Employed in a year")] == (1, 2)
    assert got[("Overall", "Employment", "Employed in a year")] == (2, 3)
    assert len(got) == 3 * 8


def test_profile_adds_up(spark):
    cells = Pr.cohort_profile(derived.episodes(spark, SF)).collect()
    for variable in {r["Variable"] for r in cells}:
        mine = [r for r in cells if r["Variable"] == variable]
        overall = sum(r["n"] for r in mine if r["Generation"] == "Overall")
        assert overall == sum(r["n"] for r in mine if r["Generation"] != "Overall")


def test_household_employment(spark, rows):
    # household 1 in 2010: the best code is the full-time one of person 2
    assert rows(Pr.household_employment(_profile_people(spark))) == [
        ("Full-time", "Gen1", 1), ("Unemployed", "Gen2", 1),
    ]


def test_union_starts_of_a_person_with_many_episodes_are_no_more_than_their_days(spark):
    days = ["1999-01-01", "2000-01-01", "2009-06-01"]
    row = dict(IndividualId=1, DoB="1986-01-01", Education=11)
    many = [dict(row, StartDate=days[i % 3], MaritalStatus=2, Episode=2 + i // 2, EducationObsDate="2008-02-01") for i in range(300)]
    e = tiny.episodes(spark, *many, dict(row, MaritalStatus=None, StartDate="2010-01-01", Episode=1))
    [got] = E.women_with_events(e, tiny.pregnancies(spark, dict(WomanId=1, MotherDoB="1986-01-01"))).collect()
    assert max(len(v) for v in got if isinstance(v, list)) <= len(days)
    assert {(x.Episode, str(x.StartDate)) for x in got.UnionStarts} == {(2, days[0]), (2, days[1]), (3, days[2])}


def test_violations(spark, rows):
    day = dt.date
    data = [
        (1, day(1970, 1, 1), None, 2, 1, day(2001, 1, 1), day(2002, 1, 1)),
        (1, day(1970, 1, 1), day(2010, 1, 1), 2, 2, day(2003, 1, 1), day(2004, 1, 1)),  # a known death on some rows only
        (2, day(1970, 1, 1), day(2010, 1, 1), 2, 1, day(2011, 1, 1), day(2010, 1, 1)),
        (2, day(1970, 1, 2), day(2010, 1, 2), 1, 1, day(2001, 1, 1), day(2002, 1, 1)),
        (2, None, None, None, 1, day(2001, 1, 1), day(2002, 1, 1)),
        (2, day(2005, 1, 1), None, 1, None, day(2001, 1, 1), None),
        (None, None, None, None, None, None, None),
    ]
    names = "IndividualId int, DoB date, DoD date, Sex int, Episode long, StartDate date, EndDate date"
    df = spark.createDataFrame(data, names)
    assert rows(V.episode_violations(df)) == [
        (2, "ends before start", 1), (2, "repeated Episode", 2), (2, "several DoB", 1), (2, "several DoD", 1), (2, "several Sex", 2),
        (2, "starts after DoD", 1), (2, "starts before DoB", 1), (2, "unknown DoB", 1), (None, "unknown person", 1),
    ]
    assert V.episode_violations(df.limit(0)).count() == 0
    assert V.assert_valid(df.filter("IndividualId = 1")).count() == 2
    with pytest.raises(Exception, match="violations of the contract"):
        V.assert_valid(df).collect()
