"""Prefix scans over runs of rows, and joins that are dealt out: they give what plain ones give."""

import re

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import joins as J
from cohortlens.operators import skew as K
from cohortlens.operators import windows as W

SALTS = 6


@pytest.fixture(autouse=True)
def short_runs(monkeypatch):
    """Runs of some ten rows, so that small groups are cut too."""
    monkeypatch.setattr(K, "RUN_ROWS", 10)


@pytest.fixture(scope="module")
def skewed(spark):
    """600 rows, a third of them in one group, a third in a group without a name, the rest small."""
    i = F.col("id")
    key = F.when(i % 3 == 0, 1).when(i % 3 == 1, None).otherwise(10 + i % 60)
    df = spark.range(600).select(
        key.cast("int").alias("k"),
        (i * 7919 % 601).alias("o"),
        F.when(i * 31 % 17 == 0, i).alias("v"),
        F.when(i % 7 != 3, (i % 5).cast("double")).alias("w"),
        F.date_add(F.lit("2000-01-01"), (i * 13 % 97).cast("int")).alias("d"),
        i.alias("i"),
    )
    return df.repartition(5).cache()


def both(fn, rows, other=SALTS, usual=None):
    one, two = fn(other), fn(usual)
    assert one.dtypes == two.dtypes
    assert rows(one) == rows(two)
    return one


def scanned(fn, rows):
    """``fn`` with and without ``small``: cut into runs, and by one window."""
    return both(fn, rows, False, True)


ORDERS = {
    "number": "o",
    "date": "d",
    "text": "concat('n', o)",
    "long common beginning": "concat(repeat('x', 40), o)",
    "timestamp": "timestamp_seconds(o * 5000)",
    "binary": "encode(string(o), 'utf-8')",
    "all null": "double(null)",
    "one busy day": "date'2000-01-01'",
    "some null": "if(i % 11 != 0, o, null)",
}


@pytest.mark.parametrize("kind", ORDERS)
def test_fills(skewed, rows, kind):
    df = skewed.withColumn("s", F.expr(ORDERS[kind]))
    scanned(lambda small: W.fill_up(df, ["k"], ["s", "i"], ["v", "w"], small), rows)
    scanned(lambda small: W.fill_downup(df, ["k"], ["s", "i"], ["v", "w"], small), rows)


def test_local_times_around_a_clock_change(spark, skewed, rows):
    """Wall clock times of a night in which the zone's clock goes back an hour."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        start = F.lit("2021-11-07 00:00:00").cast("timestamp_ntz")
        df = skewed.withColumn("s", start + F.make_dt_interval(mins=F.col("o").cast("int")))
        scanned(lambda small: W.fill_up(df, ["k"], ["s", "i"], ["v"], small), rows)
        scanned(lambda small: W.running_total(df.withColumn("w", F.col("i")), ["k"], ["s", "i"], "w", small=small), rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_running_total(skewed, rows):
    whole = skewed.withColumn("w", F.coalesce("w", F.lit(1.0)))
    scanned(lambda small: W.running_total(whole, ["k"], ["o", "i"], "w", small=small), rows)
    exact = whole.withColumn("w", F.col("w").cast("decimal(10,2)"))
    scanned(lambda small: W.running_total(exact, ["k"], ["o", "i"], "w", small=small), rows)
    poisoned = scanned(lambda small: W.running_total(skewed, ["k"], ["o", "i"], "w", small=small), rows)
    assert poisoned.filter("cumsum IS NULL").count() > 0


@pytest.mark.parametrize("by", [[], ["k", "t"]])
def test_no_group_and_several_keys(skewed, rows, by):
    df = skewed.withColumn("t", F.when(F.col("i") % 5 != 0, "x"))
    scanned(lambda small: W.fill_up(df, by, ["d", "i"], ["v", "w"], small), rows)
    scanned(lambda small: W.fill_downup(df, by, ["d", "i"], ["v", "w"], small), rows)
    scanned(lambda small: W.running_total(df, by, ["d", "i"], "i", small=small), rows)


@pytest.mark.parametrize("run_rows", [1, 3, 100, 10_000])
def test_any_length_of_runs(skewed, rows, monkeypatch, run_rows):
    monkeypatch.setattr(K, "RUN_ROWS", run_rows)
    scanned(lambda small: W.fill_downup(skewed, ["k"], ["o", "i"], ["v", "w"], small), rows)


def test_empty_table(skewed):
    assert W.fill_up(skewed.filter("i < 0"), ["k"], ["o"], ["v"]).count() == 0
    assert W.running_total(skewed.filter("i < 0"), [], ["o"], "i").count() == 0


@pytest.mark.parametrize("kind", ["number", "long common beginning", "one busy day"])
@pytest.mark.parametrize("by", [["k"], []])
def test_runs_have_like_sizes(spark, monkeypatch, kind, by):
    """6,000 rows, a third of them in one group, also where the first order column is of no use, or no group is asked for."""
    monkeypatch.setattr(K, "RUN_ROWS", 100)
    i = F.col("id").alias("i")
    df = spark.range(6000).select(F.when(i % 3 == 0, 1).otherwise(i).alias("k"), (i * 7919 % 6007).alias("o"), i)
    df = df.withColumn("s", F.expr(ORDERS[kind])).withColumn("one", F.lit(1))
    cut, several = K.order_runs(df.select("k", "s", "i", "one"), by or ["one"], ["s", "i"])
    hot = cut.filter("k = 1").groupBy("_run").count().toPandas() if by else cut.groupBy("_run").count().toPandas()
    assert len(cut.columns) == 5 and cut.count() == 6000
    # a group is cut by its share of the rows; groups without a cut carry nothing
    assert (10 if by else 40) <= len(hot) <= (35 if by else 90) and hot["count"].max() <= 800
    assert several.filter("k <> 1").count() <= 90 or not by


def test_cuts_are_bounded(skewed, monkeypatch):
    monkeypatch.setattr(K, "RUN_ROWS", 1)
    assert K.order_cuts(skewed, ["k"], ["i"], cuts=10).count() <= 20
    assert K.order_cuts(skewed, ["k"], ["i"]).count() == 600


def test_blocks_of_cuts(skewed, rows, monkeypatch):
    """Groups of 200 cuts in blocks of 4: runs are numbered through, and every row is its own run."""
    monkeypatch.setattr(K, "RUN_ROWS", 1)
    monkeypatch.setattr(K, "BLOCK", 4)
    small = skewed.filter("k = 1").limit(16)
    cut, _ = K.order_runs(small, ["k"], ["i"])
    assert sorted(r["_run"] for r in cut.collect()) == list(range(1, 17))


def test_a_scan_moves_the_rows_once(skewed):
    """The rows are shuffled once; all else is drawn cuts and one row per run."""
    for out in (
        W.fill_up(skewed, ["k"], ["o", "i"], ["v"]), W.fill_downup(skewed, ["k"], ["o", "i"], ["v"]),
        W.running_total(skewed, ["k"], ["o", "i"], "w"),
    ):
        text = out._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning\(k#\d+, _run#\d+, \d+\)[^\n]*\n[^\n]*Project", text)) == 1


def test_group_values(skewed, rows):
    maxima = {"m": F.max("v"), "last": F.max("d")}
    assert rows(K.attach_group(skewed, ["k"], maxima)) == rows(K.attach_group(skewed, ["k"], maxima, small=True))
    assert rows(W.share_within(skewed, ["k"], "i")) == rows(W.share_within(skewed, ["k"], "i", small=True))
    assert rows(W.share_within(skewed, [], "i")) == rows(W.share_within(skewed, [], "i", small=True))


def test_group_values_need_no_window(skewed):
    plan = W.group_max(skewed, ["k"], {"m": "v"})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max" in plan


def test_nothing_runs_while_a_plan_is_built(spark, skewed):
    skewed.count()
    spark.sparkContext.setJobGroup("plan", "plan")
    try:
        other = skewed.select(F.col("k").alias("j"))
        W.fill_up(skewed, ["k"], ["o"], ["v"])
        W.fill_downup(skewed, ["k"], ["o"], ["v"])
        W.running_total(skewed, ["k"], ["o"], "w")
        W.group_max(skewed, ["k"], {"m": "v"})
        J.semi(skewed, other, "k", "j")
        J.in_flag(skewed, other, "k", "hit", "j")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_equal_rows_are_spread(spark):
    copies = spark.range(0, 400, 1, 8).select(F.lit(1).alias("k"))
    spread = copies.withColumn("s", K.row_spread(["k"], F.lit(8)))
    assert spread.select("s").distinct().count() == 8


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_salted_join(spark, skewed, rows, how):
    right = spark.createDataFrame([(1, "a"), (1, "b"), (12, "c"), (None, "n")], "j int, t string")
    both(lambda n: K.salted_join(skewed, right, [("k", "j")], how, n), rows)


def test_membership(spark, skewed, rows):
    other = spark.createDataFrame([(1,), (1,), (12,), (None,)], "j int")
    both(lambda n: J.semi(skewed, other, "k", "j", n), rows)
    both(lambda n: J.in_flag(skewed, other, "k", "hit", "j", n), rows)
    marks = skewed.groupBy("k").agg(F.max("d").alias("m"))
    both(lambda n: J.latest_before(skewed, marks, "k", "d", "m", salts=n).select("k", "m", "d"), rows)


def test_first_rows_are_cut_before_the_shuffle(skewed):
    plan = W.slice_first(skewed, ["k"], ["o", "i"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
