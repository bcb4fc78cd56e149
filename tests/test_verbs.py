import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import aggregates as A
from cohortlens.operators import columns as C
from cohortlens.operators import joins as J
from cohortlens.operators import reshape as R
from cohortlens.operators import skew as K
from cohortlens.operators import windows as W


@pytest.fixture
def picks(spark):
    return spark.createDataFrame(
        [("a", 1, None), ("a", 2, 2), ("a", 3, 2), ("a", 4, 5), ("b", 1, None), ("b", 2, None), (None, 1, 7)],
        "g string, o int, x int",
    )


def test_slices(picks, rows):
    assert rows(W.slice_first(picks, ["g"], ["o"])) == [("a", 1, None), ("b", 1, None), (None, 1, 7)]
    assert rows(W.slice_min(picks, ["g"], "x", ["o"])) == [("a", 2, 2), ("b", 1, None), (None, 1, 7)]
    assert rows(W.slice_max(picks, ["g"], "x", ["o"])) == [("a", 4, 5), ("b", 1, None), (None, 1, 7)]


def test_slice_min_keeps_ties(picks, rows):
    got = rows(W.slice_min(picks, ["g"], "x", with_ties=True))
    assert got == [("a", 2, 2), ("a", 3, 2), ("b", 1, None), ("b", 2, None), (None, 1, 7)]


def test_fills(spark, rows):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 7), (1, 3, None)], "id int, y int, v int")
    assert rows(W.fill_up(df, ["id"], ["y"], ["v"])) == [(1, 1, 7), (1, 2, 7), (1, 3, None)]
    assert rows(W.fill_downup(df, ["id"], ["y"], ["v"])) == [(1, 1, 7), (1, 2, 7), (1, 3, 7)]


def test_running_total_is_poisoned(spark, rows):
    df = spark.createDataFrame([(1, 0.1), (2, None), (3, 0.2)], "o int, x double").withColumn("g", F.lit(1))
    total = W.running_total(df, ["g"], ["o"], "x").withColumn("cumsum", 5 * F.col("cumsum"))
    assert rows(total, "o", "cumsum") == [(1, 0.5), (2, None), (3, None)]


def test_ref_value(spark, rows):
    df = spark.createDataFrame([("a", "r", 2.0), ("a", "s", 3.0), ("b", "s", 1.0)], "g string, l string, x double")
    good = W.ref_value(df.filter("g = 'a'"), ["g"], F.col("l") == "r", "x", "ref")
    assert rows(good, "l", "ref") == [("r", 2.0), ("s", 2.0)]
    with pytest.raises(Exception, match="exactly one reference row"):
        W.ref_value(df, ["g"], F.col("l") == "r", "x", "ref").collect()
    assert rows(W.ref_value(df, ["g"], F.col("l") == "r", "x", "ref", strict=False), "g", "ref")[-1] == ("b", None)


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 5)], "g string, n int")
    sums = W.share_within(df, ["g"], "n").groupBy("g").agg(F.sum("share")).collect()
    assert [r[1] for r in sums] == [1.0, 1.0]


def test_membership(spark, rows):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(2,), (2,), (None,)], "j int")
    assert rows(J.semi(a, b, "k", "j")) == [(2,)]
    assert rows(J.in_flag(a, b, "k", "hit", "j")) == [(1, False), (2, True), (None, False)]


def test_left_join_suffix(spark, rows):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "m int, v string")
    assert rows(J.left_join(a, b, [("k", "m")])) == [(1, "x", "p"), (1, "x", "q"), (2, "y", None)]
    assert rows(J.left_join(a, b, [("k", "m")], "inner")) == [(1, "x", "p"), (1, "x", "q")]


def test_parent_join(spark, rows):
    people = spark.createDataFrame([(1, None, "m"), (2, 1, "c"), (3, 9, "o")], "id int, mum int, v string")
    out = J.parent_join(people, "id", "mum", ["v"])
    assert out.columns == ["Childid", "Childv", "Parentid", "Parentv"]
    assert rows(out) == [(2, "c", 1, "m")]


def test_latest_before(spark, rows):
    d = [dt.date(2000, 1, i) for i in range(1, 9)]
    states = spark.createDataFrame([(1, d[0]), (1, d[2]), (1, d[2]), (1, d[4]), (2, d[7])], "k int, s date")
    marks = spark.createDataFrame([(1, d[4]), (2, d[7])], "k int, m date")
    assert rows(J.latest_before(states, marks, "k", "s", "m"), "k", "m", "s") == [(1, d[4], d[2])]
    near = F.datediff("m", "s") < 2
    assert rows(J.latest_before(states, marks, "k", "s", "m", near)) == []


def test_counts(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 3)], "g string, x int")
    assert rows(A.count_by(df, "g")) == [("a", 2), (None, 1)]
    assert rows(A.count_by(df, big=F.col("x") > 2)) == [(False, 1), (True, 1), (None, 1)]
    assert rows(A.pct_of(df, [], F.col("x") > 2)) == [(1, 2, 50.0)]


def test_pct_table(spark, rows):
    df = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "p"), ("b", None)], "g string, l string")
    assert rows(A.pct_table(df, "g", "l")) == [
        ("Overall", "p", 2, pytest.approx(200 / 3)), ("Overall", "q", 1, pytest.approx(100 / 3)),
        ("a", "p", 1, 50.0), ("a", "q", 1, 50.0), ("b", "p", 1, 100.0),
    ]


PROBS = {"q1": 0.25, "med": 0.5, "q3": 0.75, "top": 1.0, "low": 0.0, "odd": 0.137}


def quantile_data(spark):
    rng = np.random.default_rng(1)
    data = [("n", float(v)) for v in rng.normal(20, 3, 501)] + [("t", float(v)) for v in rng.integers(0, 5, 400)]
    data += [("heavy", float(v)) for v in 10.0 ** rng.uniform(-200, 200, 600)]
    data += [("one", 4.0), (None, 1.0), (None, 2.0), ("n", None)]
    return data, spark.createDataFrame(data, "g string, x double")


@pytest.mark.parametrize("run_rows", [1, 20, 10_000])
@pytest.mark.parametrize("small", [False, True])
def test_exact_quantiles(spark, monkeypatch, run_rows, small):
    monkeypatch.setattr(K, "RUN_ROWS", run_rows)
    data, df = quantile_data(spark)
    got = {r["g"]: r for r in A.exact_quantiles(df, ["g"], "x", PROBS, small).collect()}
    for g in ("n", "t", "heavy", "one", None):
        values = [v for k, v in data if k == g and v is not None]
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-300)
    assert A.exact_quantiles(df.filter("x < 0"), ["g"], "x", PROBS, small).collect() == []


def test_quantile_example(spark, rows):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.5,), (9.0,)], "x double")
    assert rows(A.exact_quantiles(df, [], "x", {"a": 0.25, "b": 0.5, "c": 0.75})) == [(1.75, 2.75, 4.875)]


def test_summary_moments(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 5.0)], "g string, x double")
    got = rows(A.counted_summary(A.value_counts(df, ["g"], "x"), ["g"], "x", {"m": 0.5}, 2.0))
    assert got == [("a", 2.0, 3, pytest.approx(5 / 3), pytest.approx(np.std([1, 2, 2], ddof=1))), ("b", 5.0, 1, 5.0, None)]


GROUPS = {"a": (6, 8, 4, 5, 3, 4), "b": (8, 12, 9, 11, 6, 8), "c": (13, 9, 11, 8, 7, 12)}


def test_anova(spark):
    df = spark.createDataFrame([(g, float(v)) for g, vs in GROUPS.items() for v in vs], "g string, y double")
    (r,) = A.anova_oneway(df, "y", "g").collect()
    assert (r.df_between, r.df_within) == (2, 15)
    assert r.f == pytest.approx(9.264706, abs=1e-6)
    assert r.p == pytest.approx(0.002399, abs=1e-6)
    assert r.mark == "**"


NODES, WEIGHTS = np.polynomial.legendre.leggauss(400)


def tail_by_quadrature(f, a, b):
    """P(F > f) as an integral of the beta density over s, with t = x exp(-s^2)."""
    x, p, q = b / (b + a * f), b / 2, a / 2
    top = math.sqrt(60 / p)
    s, w = (NODES + 1) * top / 2, WEIGHTS * top / 2
    density = np.exp(-p * s * s) * (1 - x * np.exp(-s * s)) ** (q - 1) * 2 * s
    return math.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * math.log(x)) * float(density @ w)


def test_f_tail(spark):
    # known points of the F distribution: its 5 % and 1 % critical values, and F(1, n) = t(n)^2
    points = [(4.0662, 3, 8, 0.05), (5.9525, 3, 12, 0.01), (4.9646, 1, 10, 0.05), (161.4476, 1, 1, 0.05)]
    df = spark.createDataFrame([p[:3] for p in points], "f double, a int, b int").coalesce(1)
    got = [r[0] for r in df.select(A.f_tail("f", "a", "b")).collect()]
    assert got == pytest.approx([p[3] for p in points], rel=2e-4)
    cases = [(f, a, b) for f in (0.01, 0.8, 2.5, 9.0, 40.0) for a in (1, 2, 3, 4, 5, 8, 11) for b in (1, 2, 3, 7, 40, 1001, 10**6)]
    df = spark.createDataFrame(cases, "f double, a int, b int").coalesce(1)
    got = [r[0] for r in df.select(A.f_tail("f", "a", "b")).collect()]
    assert got == pytest.approx([tail_by_quadrature(*c) for c in cases], rel=1e-5, abs=1e-10)
    edges = [(0.0, 3, 5), (None, 3, 5), (1.0, 0, 5), (1.0, 3, 0), (1e9, 3, 10**9)]
    df = spark.createDataFrame(edges, "f double, a int, b int").coalesce(1)
    assert [r[0] for r in df.select(A.f_tail("f", "a", "b")).collect()] == [1.0, None, None, None, 0.0]


def test_weighted_moments(spark, rows):
    data = [(g, float(v), 1 + i % 3) for g, vs in GROUPS.items() for i, v in enumerate(vs)] + [("a", 7.0, 0), ("a", None, 4)]
    df = spark.createDataFrame(data, "g string, y double, w int")
    copies = df.filter("y IS NOT NULL AND w > 0").withColumn("w", F.explode(F.sequence(F.lit(1), "w")))
    plain = {r.g: r for r in A.cell_moments(copies, ["g"], "y").collect()}
    for r in A.cell_moments(df, ["g"], "y", "w", centre=8.0).collect():
        assert (r.n, r["mean"], r.ss) == (plain[r.g].n, pytest.approx(plain[r.g]["mean"]), pytest.approx(plain[r.g].ss))


def test_asof_before(spark, rows):
    states = spark.createDataFrame([(1, 5), (1, 5), (1, 9), (2, 3), (None, 1), (3, None)], "k int, s int")
    marks = spark.createDataFrame(
        [(1, 5, "a"), (1, 6, "b"), (1, 6, "b"), (1, 10, "c"), (2, 3, "d"), (2, 4, None), (None, 7, "e"), (3, 8, "f"), (1, None, "g"), (4, 1, "h")],
        "k int, m int, t string",
    )
    got = {r: None for r in rows(J.asof_before(states, marks, "k", "s", "m", ["t"]).select("k", "m", "t", "s"))}
    assert set(got) == {
        (1, 5, "a", None), (1, 6, "b", 5), (1, 10, "c", 9), (2, 3, "d", None), (2, 4, None, 3), (None, 7, "e", None),
        (3, 8, "f", None), (1, None, "g", None), (4, 1, "h", None),
    }
    assert J.asof_before(states.limit(0), marks, "k", "s", "m", ["t"]).filter("s IS NOT NULL").count() == 0


def test_merge_cells(spark):
    data = [(g, h, float(v)) for g, vs in GROUPS.items() for h, v in enumerate(vs)]
    df = spark.createDataFrame(data, "g string, h int, y double").withColumn("h", F.col("h") % 2)
    cells = A.merge_cells(A.cell_moments(df, ["g", "h"], "y"), ["g"])
    direct = {r.g: r for r in A.cell_moments(df, ["g"], "y").collect()}
    for r in cells.collect():
        assert (r.n, r.mean, r.ss) == pytest.approx((direct[r.g].n, direct[r.g].mean, direct[r.g].ss))


def test_unions(spark, rows):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([("y", 2)], "v string, k int")
    assert rows(R.stack_rows(a, b)) == [(1, "x"), (2, "y")]
    assert rows(R.bind_rows(a, b.drop("v"))) == [(1, "x"), (2, None)]
    assert rows(R.stack_tables({"one": a, "two": b})) == [("one", 1, "x"), ("two", 2, "y")]


def test_pivots(spark, rows):
    df = spark.createDataFrame([("a", "p", 1), ("a", "q", 2), ("b", "p", 3), ("b", "p", 4)], "g string, l string, x int")
    assert rows(R.pivot_counts(df, ["g"], "l", ["p", "q"])) == [("a", 1, 1), ("b", 2, None)]
    assert rows(R.pivot_values(df, ["g"], "l", "x", ["p", "q"])) == [("a", 1, 2), ("b", 4, None)]
    assert rows(R.pivot_bool(df, ["g"], F.col("x") > 2)) == [("a", 0, 2), ("b", 2, 0)]
    wide = R.pivot_counts(df, ["g"], "l", ["p", "q"])
    assert rows(R.pivot_longer(wide, ["p", "q"], "l", "n")) == [("a", "p", 1), ("a", "q", 1), ("b", "p", 2), ("b", "q", None)]


def test_text_pieces(spark, rows):
    df = spark.createDataFrame([(dt.date(2001, 5, 6), None, 3)], "d date, s string, n int")
    assert rows(R.separate(df, "d", "-", "yr"), "yr") == [("2001",)]
    assert rows(R.unite(df, "t", ["n", "s"], "-")) == [(dt.date(2001, 5, 6), "3-NA")]


def test_row_expansion(spark, rows):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, None)], "i int, n int")
    times = F.when(F.col("n").isin(2, 3, 4), F.col("n")).otherwise(1)
    counts = R.replicate_rows(df, times).groupBy("i").count()
    assert rows(counts) == [(0, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 1)]
    spans = spark.createDataFrame([(1, 2000, 2002), (2, 2001, 2000), (3, None, 2000)], "i int, a int, b int")
    assert rows(R.expand_years(spans, F.col("a"), F.col("b")), "i", "Year") == [(1, 2000), (1, 2001), (1, 2002)]


def test_columns(spark, rows):
    df = spark.createDataFrame([(1, "x", 2.345, "y")], "a int, b string, c double, d string")
    assert C.select_range(df, "b", "c", keep=["d"]).columns == ["d", "b", "c"]
    assert C.drop_range(df, "b", "c").columns == ["a", "d"]
    assert rows(C.with_cols(df, {"e": F.col("a") + 1, "f": F.col("e") * 2}), "e", "f") == [(2, 4)]
    assert C.rename(df, {"z": "a"}).columns == ["z", "b", "c", "d"]
    assert rows(C.mutate_if_numeric(df, lambda c: c * 2)) == [(2, "x", 4.69, "y")]
    masked = C.mask_cells(df, ["a", "b"], [(1, "x")], "c")
    assert rows(masked, "c") == [(None,)]
    assert rows(C.mask_cells(df, ["a", "b"], [(2, "x")], "c"), "c") == [(2.345,)]


def test_arrange(spark):
    df = spark.createDataFrame([("hi", 1), ("lo", 2), ("lo", 1)], "l string, k int")
    got = [tuple(r) for r in C.arrange(df, "l", "k", levels={"l": ["lo", "hi"]}).collect()]
    assert got == [("lo", 1), ("lo", 2), ("hi", 1)]


def test_zip_by_key(spark, rows):
    a = spark.createDataFrame([("g1", 1), ("g2", 2)], "g string, x int")
    b = spark.createDataFrame([("g2", 20), ("g1", 10), ("g3", 30)], "g string, y int")
    assert rows(J.zip_by_key(a, b, ["g"])) == [("g1", 1, 10), ("g2", 2, 20)]
