import pytest
import tiny
from pyspark.sql import functions as F

from cohortlens.plans import persons as P
from cohortlens.sources import tables as T


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_round_trip(spark, rows, tmp_path, fmt):
    ep = tiny.episodes(spark, dict(IndividualId=1, DoD="2015-01-01"), dict(IndividualId=2, MotherId=1, Education=None))
    path = str(tmp_path / fmt)
    T.write_frame(ep, path, fmt)
    back = T.read_episodes(spark, path, fmt)
    assert back.dtypes == ep.dtypes
    assert rows(back) == rows(ep)


def test_unused_columns_are_dropped(spark):
    names = ["IndividualId", "Node", "Enumeration", "x", "Memberships", "DoB", "SpouseId", "y", "SEObsDate", "Days"]
    df = spark.createDataFrame([tuple(range(len(names)))], names)
    assert T.drop_unused(df).columns == ["IndividualId", "DoB"]


def test_missing_column(spark, tmp_path):
    path = str(tmp_path / "p")
    tiny.episodes(spark, dict(IndividualId=1)).drop("Sex").write.parquet(path)
    with pytest.raises(ValueError, match="Sex"):
        T.read_episodes(spark, path)
    with pytest.raises(ValueError, match="format"):
        T.read_episodes(spark, path, "xlsx")


def test_cutoff_reaches_the_scan(spark, rows, tmp_path):
    path = str(tmp_path / "p")
    pr = tiny.pregnancies(spark, dict(WomanId=1, DDate="2018-12-31"), dict(WomanId=2, DDate="2019-01-01"))
    T.write_frame(pr, path)
    got = T.read_pregnancies(spark, path)
    assert rows(got, "WomanId") == [(1,)]
    assert "LessThan(DDate,2019-01-01)" in got._jdf.queryExecution().executedPlan().toString()


def test_person_query_prunes_and_pushes(spark, tmp_path):
    path = str(tmp_path / "e")
    T.write_frame(tiny.episodes(spark, dict(IndividualId=1)), path)
    sizes = P.cohort_sizes(P.analysis_persons(T.read_episodes(spark, path)))
    scan = [ln for ln in sizes._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in ln]
    assert len(scan) == 1
    assert "GreaterThan(DoB,1945-01-01)" in scan[0] and "LessThan(DoB,1995-01-01)" in scan[0]
    assert "HouseholdId" not in scan[0] and "NonResident" not in scan[0]


def test_bucketed_table_needs_no_shuffle(spark, tmp_path):
    table = "persons_bucketed_test"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    T.write_person_table(tiny.episodes(spark, dict(IndividualId=1), dict(IndividualId=2)), table, buckets=4)
    try:
        people = spark.table(table).groupBy("IndividualId").agg(F.max("Education"))
        assert "Exchange" not in people._jdf.queryExecution().executedPlan().toString()
        assert people.count() == 2
    finally:
        spark.sql(f"DROP TABLE {table}")


def test_report(spark, tmp_path):
    path = tmp_path / "report"
    T.write_report(spark.range(20).repartition(4), str(path))
    assert len(list(path.glob("part-*.csv"))) == 1


def test_text_that_is_no_value_is_null(spark, tmp_path):
    ep = tiny.episodes(spark, dict(IndividualId=1), dict(IndividualId=2))
    texts = ep.select([F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in ep.columns])
    texts.withColumn("DoD", F.lit("NA")).write.option("header", True).csv(f"{tmp_path}/e")
    assert T.read_episodes(spark, f"{tmp_path}/e", "csv").select("DoD").distinct().collect() == [(None,)]
