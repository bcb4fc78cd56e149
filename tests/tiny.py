"""Small episode and pregnancy tables for tests: name what matters, the rest has defaults."""

import datetime as dt

from cohortlens.sources.tables import EPISODES, PREGNANCIES


def day(text):
    return dt.date.fromisoformat(text) if text else None


DATES = {"DoB", "DoD", "StartDate", "EndDate", "EducationObsDate", "MotherDoB", "DDate", "FirstRecordedDate"}


def _table(spark, schema, defaults, rows):
    full = []
    for row in rows:
        r = {**defaults, **row}
        unknown = set(r) - set(schema.names)
        assert not unknown, unknown
        full.append(tuple(day(r[c]) if c in DATES else r[c] for c in schema.names))
    return spark.createDataFrame(full, schema)


def episodes(spark, *rows):
    """Episode numbers follow the order of each person's rows unless given."""
    seen, numbered = {}, []
    for row in rows:
        n = seen[row["IndividualId"]] = seen.get(row["IndividualId"], 0) + 1
        numbered.append({"Episode": n, **row})
    defaults = dict(
        DoB="1970-03-01", DoD=None, Sex=2, MotherId=None, StartDate="2010-01-01", EndDate="2010-12-31", HouseholdId=1,
        HHRelation=2, Education=12, EducationObsDate="2010-01-05", MaritalStatus=1, CurrentlyEmployed=None,
        NonResident=0,
    )
    return _table(spark, EPISODES, defaults, numbered)


def pregnancies(spark, *rows):
    numbered = [{"PregnancyId": i, **row} for i, row in enumerate(rows, 1)]
    defaults = dict(
        MotherDoB="1970-03-01", DDate="1992-01-01", MotherAge=21, Outcome="L", LCnt=1, BirthOrder=1,
        FirstRecordedDate="2000-01-01",
    )
    return _table(spark, PREGNANCIES, defaults, numbered)
