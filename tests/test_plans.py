"""The physical plans have the shape the design asks for."""

import re

import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
QUERIES = entry_points.queries()


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def person_exchanges(text):
    return len(re.findall(r"Exchange hashpartitioning\(IndividualId#\d+L?, \d+\)", text))


ONE_PASS = [
    "person_frame", "cohort_sizes", "prop_ever_married", "marriage_rates", "observed_before", "matric_age", "first_union",
    "person_years", "lexis_cells", "mother_daughter_marriage",
]


@pytest.mark.parametrize("name", ONE_PASS)
def test_one_scan_and_one_person_exchange(spark, name):
    text = plan(spark, name)
    assert text.count("FileScan") == 1
    assert person_exchanges(text) == 1


@pytest.mark.parametrize("name", ["asfr_by_marital", "asfr_overall", "life_events", "event_order_table", "births_by_agegroup"])
def test_each_table_is_read_once(spark, name):
    assert plan(spark, name).count("FileScan") == 2


STUDY = list(entry_points.study_queries.QUERIES)


@pytest.mark.parametrize("name", STUDY)
def test_no_python_no_cross_join_no_row_windows(spark, name):
    text = plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroups", "MapInPandas"):
        assert bad not in text
    assert "ArrowEvalPython" not in text
    # windows only run over aggregated cells, never over the rows of a person
    assert not re.search(r"Window .*partitionBy.*IndividualId|windowspecdefinition\(IndividualId", text)


def test_rows_are_combined_before_the_person_exchange(spark):
    for name in ONE_PASS:
        text = plan(spark, name)
        exchange = text.index("Exchange hashpartitioning(IndividualId")
        assert re.search(r"Aggregate\(keys=\[IndividualId", text[exchange:])


@pytest.mark.parametrize("name", ["births", "asfr_by_marital", "life_events", "event_order_medians", "first_birth_report"])
def test_generated_methods_can_be_compiled(spark, name):
    """The JVM leaves methods above 8000 bytes to the interpreter, many times slower."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        executed = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    text = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(executed)
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)) < 8000


@pytest.mark.parametrize("name", STUDY)
def test_no_rows_are_sorted_to_be_folded(spark, name):
    assert "SortAggregate" not in plan(spark, name)
