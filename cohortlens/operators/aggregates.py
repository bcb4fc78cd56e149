"""Counts, summaries, percentage tables, exact quantiles and one-way ANOVA."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import percent, safe_divide, significance_mark
from .skew import order_runs, same_keys


def count_by(df: DataFrame, *keys: str, name: str = "n", **named: Column) -> DataFrame:
    """Rows per combination of keys and named conditions; null is a group of its own."""
    groups = [F.col(k) for k in keys] + [expr.alias(label) for label, expr in named.items()]
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias(name))


def pct_of(df: DataFrame, by: Sequence[str], cond: Column, part: str = "n", whole: str = "total") -> DataFrame:
    """Rows meeting a condition, rows where it is known, and the percentage."""
    return (
        df.groupBy(*by)
        .agg(F.count_if(cond).alias(part), F.count(cond).alias(whole))
        .withColumn("pct", percent(F.col(part), F.col(whole)))
    )


def pct_table(df: DataFrame, by: str, level: str, overall: str = "Overall") -> DataFrame:
    """Count and percentage of each level per column group and overall; missing levels are not counted."""
    cells = df.filter(F.col(level).isNotNull()).groupBy(F.col(by).cast("string").alias(by), level).agg(F.count(F.lit(1)).alias("_n"))
    # rows are counted once; the overall column adds up cells, of which a few are left
    kinds = F.array(F.struct(F.lit(False).alias("_all"), F.col(by).alias("_by")), F.struct(F.lit(True).alias("_all"), F.lit(overall).alias("_by")))
    both = cells.select(F.inline(kinds), level, "_n").groupBy("_all", "_by", level).agg(F.sum("_n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("_all", "_by"))
    return both.withColumn("pct", percent(F.col("n"), total)).select(F.col("_by").alias(by), level, "n", "pct")


def value_counts(df: DataFrame, by: Sequence[str], x: str, weight: Column | None = None) -> DataFrame:
    """Distinct values per group with their number of rows."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(n.alias("_n"))


def _picked(ranked: DataFrame, by: Sequence[str], x: str, probs: Mapping[str, float]) -> DataFrame:
    """Quantiles (linear interpolation) from values with their range of ranks, ``_start`` to ``_stop``, and ``_total``."""
    places = {name: (F.col("_total") - 1) * F.lit(float(p)) for name, p in probs.items()}
    picks = []
    for name, h in places.items():
        for end, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            picks.append(F.max(F.when(_holds(rank, "_start", "_stop"), F.col(x))).alias(f"_{end}_{name}"))
    found = ranked.groupBy(*by).agg(*picks, F.max("_total").alias("_total"))
    values = []
    for name, h in places.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        values.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return found.select(*by, *values)


def _holds(rank: Column, start: str, stop: str) -> Column:
    return (F.col(start) <= rank) & (rank < F.col(stop))


def counted_quantiles(
    counts: DataFrame, by: Sequence[str], x: str, probs: Mapping[str, float], small: bool = False
) -> DataFrame:
    """Exact quantiles (linear interpolation) of counted values, without gathering a group.

    Splitters are drawn from the values themselves and rows are counted between them; the counts tell between
    which splitters the wanted ranks lie, and only the values there are ranked. However the values are spread, that is
    a bounded number of them for each wanted rank. ``small``: a group has few distinct values, which one window ranks.
    """
    whole = Window.partitionBy(*by)
    if small:
        ranked = counts.withColumns(
            {"_stop": F.sum("_n").over(whole.orderBy(x)), "_total": F.sum("_n").over(whole)}
        ).withColumn("_start", F.col("_stop") - F.col("_n"))
        return _picked(ranked, by, x, probs)
    keyed, keys = (counts, list(by)) if by else (counts.withColumn("_all", F.lit(1)), ["_all"])
    runs, _ = order_runs(keyed, keys, [x])
    between = (
        runs.groupBy(*keys, "_run").agg(F.sum("_n").alias("_in_run"))
        .withColumn("_upto", F.sum("_in_run").over(Window.partitionBy(*keys).orderBy("_run")))
        .withColumn("_before", F.col("_upto") - F.col("_in_run"))
        .withColumn("_total", F.sum("_in_run").over(Window.partitionBy(*keys)))
    )
    ranks = [end((F.col("_total") - 1) * F.lit(float(p))) for p in probs.values() for end in (F.floor, F.ceil)]
    target = between.filter(reduce(lambda a, b: a | b, [_holds(r, "_before", "_upto") for r in ranks]))
    side = target.select(*[F.col(c).alias(f"_b_{c}") for c in [*keys, "_run"]], "_before", "_total")
    within = Window.partitionBy(*keys, "_run").orderBy(x)
    ranked = (
        runs.join(side, same_keys(runs, side, [(c, f"_b_{c}") for c in [*keys, "_run"]]))
        .withColumn("_stop", F.col("_before") + F.sum("_n").over(within))
        .withColumn("_start", F.col("_stop") - F.col("_n"))
    )
    return _picked(ranked, by, x, probs)


def counted_summary(
    counts: DataFrame, by: Sequence[str], x: str, probs: Mapping[str, float], centre: float = 0.0, small: bool = False
) -> DataFrame:
    """Quantiles and moments of counted values side by side: one row per group on both sides."""
    moments = counted_moments(counts, by, x, centre).withColumnsRenamed({c: f"_m_{c}" for c in by})
    quantiles = counted_quantiles(counts, by, x, probs, small)
    matched = same_keys(quantiles, moments, [(c, f"_m_{c}") for c in by])
    return quantiles.join(moments, matched).drop(*[f"_m_{c}" for c in by])


def exact_quantiles(df: DataFrame, by: Sequence[str], x: str, probs: Mapping[str, float], small: bool = False) -> DataFrame:
    return counted_quantiles(value_counts(df, by, x), by, x, probs, small)


def counted_moments(counts: DataFrame, by: Sequence[str], x: str, centre: float = 0.0) -> DataFrame:
    """n, Mean and sd (n - 1) of counted values; ``centre`` near the mean keeps the digits."""
    d, n = F.col(x) - F.lit(centre), F.col("_n")
    sums = counts.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.sum(n * d).alias("_s1"), F.sum(n * d * d).alias("_s2")
    )
    mean = F.col("_s1") / F.col("n")
    spread = F.col("_s2") - F.col("n") * mean * mean
    sd = F.sqrt(F.greatest(safe_divide(spread, F.col("n") - 1), F.lit(0.0)))
    return sums.select(*by, "n", (mean + F.lit(centre)).alias("Mean"), F.when(F.col("n") > 1, sd).alias("sd"))


def cell_moments(df: DataFrame, by: Sequence[str], y: str, weight: str | None = None, centre: float = 0.0) -> DataFrame:
    """Per cell: n, mean and sum of squared deviations; a row counts ``weight`` times.

    With weights the sums are taken around ``centre``, which keeps their digits if it is near the values.
    """
    known = df.filter(F.col(y).isNotNull())
    if weight is None:
        return known.groupBy(*by).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), (F.var_pop(y) * F.count(y)).alias("ss"))
    d, w = F.col(y) - F.lit(centre), F.col(weight)
    sums = known.filter(w > 0).groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * d).alias("_s1"), F.sum(w * d * d).alias("_s2"))
    mean = F.col("_s1") / F.col("n")
    spread = F.greatest(F.col("_s2") - F.col("n") * mean * mean, F.lit(0.0))
    return sums.select(*by, "n", (mean + F.lit(centre)).alias("mean"), spread.alias("ss"))


def merge_cells(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Moments of coarser cells from those of finer ones (a few rows)."""
    total = F.sum("n").over(Window.partitionBy(*by))
    centre = F.sum(F.col("n") * F.col("mean")).over(Window.partitionBy(*by)) / total
    deviations = F.col("ss") + F.col("n") * (F.col("mean") - F.col("_centre")) ** 2
    centred = cells.withColumn("_centre", centre)
    return centred.groupBy(*by).agg(
        F.sum("n").alias("n"), F.first("_centre").alias("mean"), F.sum(deviations).alias("ss")
    )


def anova_from_cells(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """One-way ANOVA over the cells of each ``by`` group: each row of ``cells`` is one level."""
    w = Window.partitionBy(*by)
    centre = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    table = (
        cells.withColumn("_centre", centre)
        .groupBy(*by)
        .agg(
            (F.count(F.lit(1)) - 1).alias("df_between"),
            (F.sum("n") - F.count(F.lit(1))).alias("df_within"),
            F.sum(F.col("n") * (F.col("mean") - F.col("_centre")) ** 2).alias("ss_between"),
            F.sum("ss").alias("ss_within"),
        )
        .withColumn("ms_between", safe_divide(F.col("ss_between"), F.col("df_between")))
        .withColumn("ms_within", safe_divide(F.col("ss_within"), F.col("df_within")))
        .withColumn("f", safe_divide(F.col("ms_between"), F.col("ms_within")))
    )
    return table.withColumn("p", f_tail("f", "df_between", "df_within")).withColumn(
        "mark", significance_mark(F.col("p"))
    )


def anova_oneway(df: DataFrame, y: str, g: str, by: Sequence[str] = ()) -> DataFrame:
    return anova_from_cells(cell_moments(df, [*by, g], y), by)


def _sum_of_terms(first: int | Column, last: Column, ratio: Callable[[Column], Column]) -> tuple[Column, Column]:
    """Sum of the terms ``first`` to ``last`` of a series that begins with 1, term n + 1 being ``ratio(n)`` times term n;
    and term ``first``. For frames of a few rows."""
    start = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s"), F.lit(0.0).alias("f"))

    def add(a: Column, n: Column) -> Column:
        return F.struct(
            (a["t"] * ratio(n)).alias("t"),
            (a["s"] + F.when(n >= first, a["t"]).otherwise(0.0)).alias("s"),
            F.when(n == first, a["t"]).otherwise(a["f"]).alias("f"),
        )

    end = F.aggregate(F.sequence(F.lit(0).cast("long"), last.cast("long")), start, add)
    return end["s"], end["f"]


def _gamma_ratio(p: Column) -> Column:
    """Gamma(p + 1/2) / Gamma(p) for p > 0: the asymptotic series 32 steps further on, and back."""
    z = p + 32
    far = F.sqrt(z) * (1 - 1 / (8 * z) + 1 / (128 * z**2) + 5 / (1024 * z**3) - 21 / (32768 * z**4))
    back = F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(1.0), lambda a, i: a * (p + i) / (p + i + 0.5))
    return far * back


def f_tail(f: str, df_between: str, df_within: str) -> Column:
    """P(F > f) for whole degrees of freedom, in built-in functions: finite sums for an even numerator, else a
    series of positive terms in y = 1 - x, or in x where that is the smaller, with x = d2 / (d2 + d1 f).
    """
    v, d1, d2 = (F.col(c).cast("double") for c in (f, df_between, df_within))
    x, p, q = d2 / (d2 + d1 * v), d2 / 2, d1 / 2
    y = d1 * v / (d2 + d1 * v)
    power = F.exp(p * F.log(x))
    even = power * _sum_of_terms(0, F.greatest(q - 1, F.lit(0.0)), lambda n: y * (p + n) / (n + 1))[0]
    # odd: the terms from (d1 - 1) / 2 on add up to P(F <= f)
    m = F.floor((d1 - 1) / 2)
    front = power * F.sqrt(y) * _gamma_ratio(p) / (math.sqrt(math.pi) / 2)
    # a tail of any size has p y under a thousand here; for x below 1/2 only the term that the other series begins with
    enough = F.when(x < 0.5, m + 1).otherwise(m + 144 + F.ceil(4 * p * y))
    below, term = _sum_of_terms(m, enough, lambda n: y * (p + 0.5 + n) / (n + 1.5))
    near = F.greatest(1 - front * below, F.lit(0.0))
    far = front * term * (q / p) * _sum_of_terms(0, F.lit(200), lambda n: x * (p + q + n) / (p + 1 + n))[0]
    odd = F.when(x < 0.5, far).otherwise(near)
    known = F.col(f).isNotNull() & (d1 >= 1) & (d2 >= 1)
    return F.when(
        known, F.when(v <= 0, F.lit(1.0)).when(-p * F.log(x) > 700, F.lit(0.0)).when(d1 % 2 == 0, even).otherwise(odd)
    )
