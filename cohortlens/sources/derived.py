"""Episode and pregnancy tables derived from the ``orders`` and ``customer`` tables.

The given tables hold no life-course data, so each order becomes four episodes of its
customer and each second customer a woman with up to seven pregnancies. The formulas use only
integer and date arithmetic that means the same in every SQL engine; they are shared with the
check SQL, while the shape of the query is written separately for each engine. All of it is
row by row: no join, sort or shuffle is added in front of the calculations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# columns from a person's key ``id``
PERSON = {
    "DoB": "DATE '1940-01-01' + CAST(id * 7919 % 20819 AS INT)",
    "DoD": "CASE WHEN id % 11 = 0 THEN DATE '2010-01-01' + CAST(id * 37 % 3000 AS INT) END",
    "Sex": "CAST(CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS INT)",
    "MotherId": "CASE WHEN id % 5 <> 0 THEN CAST((id - id % 6) / 3 AS BIGINT) END",
    "HouseholdId": "id - id % 3",
    "final_level": (
        "CASE WHEN ((id * 7919 + 11) % 1009) % 3 = 0 THEN ((id * 7919 + 11) % 1009) % 12"
        " ELSE 10 + ((id * 7919 + 11) % 1009) % 6 END"
    ),
    "school_lag": "((id * 6007 + 29) % 1013) % 3",
    "school_lost": "((id * 3001 + 71) % 991) % 13",
    "union_type": "((id * 4001 + 53) % 997) % 10",
    "union_wait": "(9 + ((id * 5003 + 41) % 1019) % 16) * 365",
}

# columns from an order key ``k`` and a copy number ``r``, in two steps
EPISODE_DATES = {
    "StartDate": "DATE '2000-01-01' + CAST((k * 613 + r * 1733) % 6900 AS INT)",
    "day_no": "(k * 613 + r * 1733) % 6900",
}
EPISODE = {
    # ordered like (StartDate, k, r) and unique for each
    "Episode": "day_no * 1099511627776 + k * 4 + r",
    "EndDate": "StartDate + CAST(30 + k % 150 AS INT)",
    "HHRelation": "CAST(1 + (k + r) % 4 AS INT)",
    "Education": (
        "CAST(CASE WHEN (k + r) % 7 = 0 OR (school_lost = 0 AND year(StartDate) - year(DoB) > 20) THEN NULL"
        " ELSE least(final_level, greatest(0, year(StartDate) - year(DoB) - 5 - school_lag)) END AS INT)"
    ),
    "EducationObsDate": (
        "CASE WHEN (k + r) % 7 = 0 OR (school_lost = 0 AND year(StartDate) - year(DoB) > 20) THEN NULL"
        " ELSE StartDate + CAST(k % 20 AS INT) END"
    ),
    "MaritalStatus": (
        "CAST(CASE WHEN (k + r) % 9 = 0 THEN NULL"
        " WHEN union_type < 3 OR StartDate < DoB + CAST(union_wait AS INT) THEN 1"
        " WHEN union_type < 5 THEN 5"
        " WHEN union_type = 9 AND StartDate > DoB + CAST(union_wait + 3650 AS INT) THEN 3"
        " ELSE 2 END AS INT)"
    ),
    "CurrentlyEmployed": (
        "CAST(CASE (k + r) % 5 WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS INT)"
    ),
    "NonResident": "CAST(CASE WHEN (k * 3 + r) % 3 = 0 THEN 1 ELSE 0 END AS INT)",
}

# columns from a woman's key ``id``, her nation ``nation`` and the number ``i`` of her pregnancy
PREGNANCY_DAYS = {
    "MotherDoB": PERSON["DoB"],
    "off": "4745 + (id * 911 + nation) % 3701 + (i - 1) * (450 + id * 577 % 1301)",
    "q": "id * 31 + i * 17",
    "n_preg": "((id * 2689 + 17) % 1013) % 8",
}
PREGNANCY = {
    "PregnancyId": "id * 8 + i",
    "DDate": "MotherDoB + CAST(off AS INT)",
    "MotherAge": "CAST(floor(off / 365.25) AS INT)",
    "Outcome": "CASE q % 7 WHEN 0 THEN 'SB' WHEN 1 THEN 'AB' WHEN 2 THEN 'M' WHEN 3 THEN 'F' ELSE 'L' END",
    "LCnt": "CAST(CASE q % 50 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 0 ELSE 1 END AS INT)",
    "BirthOrder": "CAST(i AS INT)",
    "FirstRecordedDate": "MotherDoB + CAST(off + 60 AS INT)",
}

EPISODE_COLUMNS = [
    "IndividualId", "DoB", "DoD", "Sex", "MotherId", "Episode", "StartDate", "EndDate", "HouseholdId",
    "HHRelation", "Education", "EducationObsDate", "MaritalStatus", "CurrentlyEmployed", "NonResident",
]
PREGNANCY_COLUMNS = [
    "PregnancyId", "WomanId", "MotherDoB", "DDate", "MotherAge", "Outcome", "LCnt", "BirthOrder",
    "FirstRecordedDate",
]


def named(formulas: dict[str, str]) -> list[str]:
    return [f"{text} AS {name}" for name, text in formulas.items()]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # what depends on the person alone is computed before the copies are made, so that
    # filters on it are applied to orders and not to four times as many rows
    people = load(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS id")
    people = people.selectExpr("id AS IndividualId", "id", "k", *named(PERSON))
    copies = people.selectExpr("*", "explode(sequence(0, 3)) AS r")
    dated = copies.selectExpr("*", *named(EPISODE_DATES)).filter("DoD IS NULL OR StartDate <= DoD")
    return dated.selectExpr("*", *named(EPISODE)).select(*EPISODE_COLUMNS)


def pregnancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    women = load(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_nationkey AS nation")
    numbered = women.filter("id % 2 = 0").selectExpr("id", "nation", "id AS WomanId", "explode(sequence(1, 7)) AS i")
    placed = numbered.selectExpr("*", *named(PREGNANCY_DAYS)).filter("i <= n_preg")
    # the generator makes plain columns of the formulas, as if they were read from a file;
    # otherwise they would be repeated inside every later condition on a delivery date
    columns = ", ".join(["WomanId", "MotherDoB", *named(PREGNANCY)])
    dated = placed.selectExpr(f"inline(array(struct({columns})))").filter("DDate < DATE '2019-01-01'")
    return dated.select(*PREGNANCY_COLUMNS)
