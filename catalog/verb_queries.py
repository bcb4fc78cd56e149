"""Queries that run single verbs over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import scalars as S
from cohortlens.operators import aggregates as A
from cohortlens.operators import columns as C
from cohortlens.operators import joins as J
from cohortlens.operators import reshape as R
from cohortlens.operators import windows as W
from cohortlens.sources.derived import load

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]


#: Salts of the query that deals its join out.
SALTS = 4


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("*", F.to_date("o_orderdate").alias("o_day")).drop("o_orderdate")


def _gaps(spark, sf, *more):
    """Orders whose price is known for each third order only."""
    price = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("price")
    return orders(spark, sf).select("o_custkey", "o_orderkey", "o_day", price, *more)


def slice_first(spark, sf):
    return W.slice_first(orders(spark, sf), ["o_custkey"], ["o_day", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_day"
    )


def slice_min(spark, sf):
    return W.slice_min(orders(spark, sf), ["o_custkey"], "o_totalprice", ["o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_totalprice"
    )


def slice_min_ties(spark, sf):
    by_year = orders(spark, sf).select("o_custkey", "o_orderkey", F.year("o_day").alias("yr"))
    return W.slice_min(by_year, ["o_custkey"], "yr", with_ties=True)


def slice_max(spark, sf):
    return W.slice_max(orders(spark, sf), ["o_custkey"], "o_totalprice", ["o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_totalprice"
    )


def fill_up(spark, sf):
    return W.fill_up(_gaps(spark, sf), ["o_custkey"], ["o_day", "o_orderkey"], ["price"])


def fill_downup(spark, sf):
    return W.fill_downup(_gaps(spark, sf), ["o_custkey"], ["o_day", "o_orderkey"], ["price"])


def fill_up_status(spark, sf):
    """The next known price among the orders of a status: three groups, each with much of the table."""
    gaps = _gaps(spark, sf, "o_orderstatus").drop("o_custkey")
    return W.fill_up(gaps, ["o_orderstatus"], ["o_day", "o_orderkey"], ["price"])


def cumsum_all(spark, sf):
    """Customer numbers added up over the whole table in order: one group."""
    return W.running_total(orders(spark, sf).select("o_orderkey", "o_custkey", "o_day"), [], ["o_day", "o_orderkey"], "o_custkey", "upto")


def r_cumsum(spark, sf):
    price = F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")).alias("price")
    known = orders(spark, sf).select("o_custkey", "o_orderkey", "o_day", price)
    out = W.running_total(known, ["o_custkey"], ["o_day", "o_orderkey"], "price")
    return out.select("o_custkey", "o_orderkey", F.round("cumsum", 2).alias("cumsum"))


def group_max(spark, sf):
    return W.group_max(
        orders(spark, sf).select("o_custkey", "o_orderkey", "o_totalprice", "o_day"),
        ["o_custkey"], {"max_price": "o_totalprice", "last_day": "o_day"},
    )


def _cells(spark, sf):
    return A.count_by(orders(spark, sf), "o_orderstatus", "o_orderpriority")


def ref_value(spark, sf):
    is_ref = F.col("o_orderpriority") == PRIORITIES[0]
    out = W.ref_value(_cells(spark, sf), ["o_orderstatus"], is_ref, "n", "ref", small=True)
    return out.withColumn("adv", F.round(S.safe_divide(F.col("n"), F.col("ref")) - 1, 6))


def share_within(spark, sf):
    out = W.share_within(_cells(spark, sf), ["o_orderstatus"], "n", small=True)
    return out.withColumn("share", F.round("share", 6))


def cut_numeric(spark, sf):
    size = S.cut_numeric(F.col("o_totalprice"), [1000, 50000, 150000, 300000], ["low", "mid", "high"])
    return orders(spark, sf).select("o_orderkey", size.alias("size"))


def cut_date(spark, sf):
    era = S.cut_date(F.col("o_day"), ["1995-06-01", "1997-01-01", "1998-06-15", "2001-01-01"], ["a", "b", "a"])
    return orders(spark, sf).select("o_orderkey", era.alias("era"))


def decimal_date(spark, sf):
    return orders(spark, sf).select("o_orderkey", F.round(S.decimal_date(F.col("o_day")), 9).alias("ddate"))


def mid_december(spark, sf):
    return orders(spark, sf).select("o_orderkey", S.mid_december_before(F.col("o_day")).alias("school_end"))


def round_half_even(spark, sf):
    eighth = F.col("o_orderkey") / 8
    return orders(spark, sf).select("o_orderkey", S.round_half_even(eighth, 2).alias("rounded"))


def fixed_text(spark, sf):
    return orders(spark, sf).select("o_orderkey", S.fixed_text(F.col("o_totalprice") / 4, 2).alias("text"))


def r_ifelse(spark, sf):
    return _gaps(spark, sf).select("o_orderkey", S.if_else(F.col("price") > 200000, "big", "small").alias("size"))


def regex_code(spark, sf):
    code = F.when(F.col("l_linenumber") != 4, F.col("l_linenumber") + F.col("l_partkey") % 20)
    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", S.matches(code, "2|3|4").alias("hit")
    )


def date_range(spark, sf):
    inside = S.date_between(F.col("o_day"), "1996-03-01", "1997-10-31", incl_lo=True)
    return orders(spark, sf).filter(inside).select("o_orderkey", "o_day")


def assign_where(spark, sf):
    moved = S.assign_where(F.col("o_orderpriority"), F.col("o_orderpriority") == "2-HIGH", "1-URGENT")
    return orders(spark, sf).select("o_orderkey", moved.alias("priority"))


def recode_levels(spark, sf):
    names = {"F": "finished", "O": "open"}
    return orders(spark, sf).select(
        "o_orderkey",
        S.recode(F.col("o_orderstatus"), names).alias("state"),
        S.level_rank(F.col("o_orderpriority"), PRIORITIES[::-1]).alias("place"),
    )


def lenient_cast(spark, sf):
    text = F.split_part(F.col("o_orderpriority"), F.lit("-"), F.lit(1))
    mixed = F.when(F.col("o_orderkey") % 2 == 0, text).otherwise(F.col("o_orderstatus"))
    return orders(spark, sf).select("o_orderkey", S.to_number(mixed, "int").alias("number"))


def semi_in(spark, sf):
    rich = load(spark, sf, "customer").filter("c_acctbal > 5000")
    return J.semi(orders(spark, sf), rich, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


def in_flag(spark, sf):
    urgent = orders(spark, sf).filter(F.col("o_orderpriority") == PRIORITIES[0])
    return J.in_flag(load(spark, sf, "customer"), urgent, "c_custkey", "has_urgent", "o_custkey").select(
        "c_custkey", "has_urgent"
    )


def left_join_named(spark, sf, salts=None):
    some = load(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    return J.left_join(orders(spark, sf), some, [("o_custkey", "c_custkey")], salts=salts).select(
        "o_orderkey", "o_custkey", "c_mktsegment"
    )


def left_join_split(spark, sf):
    return left_join_named(spark, sf, SALTS)


def inner_join(spark, sf):
    some = load(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    return J.left_join(orders(spark, sf), some, [("o_custkey", "c_custkey")], "inner").select(
        "o_orderkey", "o_custkey", "c_mktsegment"
    )


def parent_join(spark, sf):
    parent = F.when(F.col("c_custkey") % 4 != 0, F.floor(F.col("c_custkey") / 3)).alias("c_parent")
    people = load(spark, sf, "customer").select("c_custkey", parent, "c_mktsegment")
    return J.parent_join(people, "c_custkey", "c_parent", ["c_mktsegment"])


def prior_state(spark, sf):
    days = orders(spark, sf)
    opened = days.filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.min("o_day").alias("opened"))
    closed = days.filter("o_orderstatus = 'F'").withColumnRenamed("o_day", "closed")
    near = F.datediff("opened", "closed") < 365
    return J.latest_before(closed, opened, "o_custkey", "closed", "opened", near)


def count_by(spark, sf):
    return A.count_by(orders(spark, sf), "o_orderstatus", "o_orderpriority")


def count_pred(spark, sf):
    return A.count_by(_gaps(spark, sf), big=F.col("price") > 200000)


def quantile_summary(spark, sf):
    by = ["o_orderpriority"]
    priced = orders(spark, sf)
    counts = A.value_counts(priced, by, "o_totalprice")
    probs = {"median": 0.5, "q1": 0.25, "q3": 0.75}
    summary = A.counted_summary(counts, by, "o_totalprice", probs, 250000.0)
    return summary.select(
        "o_orderpriority", *[F.round(c, 2).alias(c.lower()) for c in ("median", "q1", "q3", "Mean", "sd")], "n"
    )


def quantile_heavy(spark, sf):
    """Quantiles of a heavy-tailed column (powers of the price) over the whole table."""
    heavy = orders(spark, sf).select((F.col("o_totalprice") / 1000 * F.pow(F.col("o_totalprice") / 400000, 8)).alias("x"))
    found = A.exact_quantiles(heavy, [], "x", {"q01": 0.01, "median": 0.5, "q99": 0.99})
    return found.select(*[F.round(c, 9).alias(c) for c in ("q01", "median", "q99")])


def asof_states(spark, sf):
    """For each open order the day of the customer's latest finished order before it, if there is one."""
    days = orders(spark, sf)
    marks = days.filter("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", F.col("o_day").alias("opened"))
    states = days.filter("o_orderstatus = 'F'").select("o_custkey", F.col("o_day").alias("closed"))
    return J.asof_before(states, marks, "o_custkey", "closed", "opened", ["o_orderkey"])


def pct_table(spark, sf):
    out = A.pct_table(orders(spark, sf), "o_orderstatus", "o_orderpriority")
    return out.withColumn("pct", F.round("pct", 6))


def pct_of(spark, sf):
    out = A.pct_of(_gaps(spark, sf, "o_orderstatus"), ["o_orderstatus"], F.col("price") > 200000)
    return out.withColumn("pct", F.round("pct", 6))


def anova_orders(spark, sf):
    table = A.anova_oneway(orders(spark, sf), "o_totalprice", "o_orderpriority", ["o_orderstatus"])
    return table.select("o_orderstatus", "df_between", "df_within", F.round("f", 6).alias("f"), F.round("p", 6).alias("p"))


def pivot_counts(spark, sf):
    return R.pivot_counts(orders(spark, sf), ["o_orderpriority"], "o_orderstatus", STATUSES)


def pivot_values(spark, sf):
    cells = orders(spark, sf).groupBy("o_custkey", "o_orderstatus").agg(F.max("o_day").alias("last"))
    return R.pivot_values(cells, ["o_custkey"], "o_orderstatus", "last", STATUSES)


def pivot_bool(spark, sf):
    return R.pivot_bool(orders(spark, sf), ["o_orderpriority"], F.col("o_totalprice") > 200000)


def pivot_longer(spark, sf):
    wide = R.pivot_counts(orders(spark, sf), ["o_custkey"], "o_orderstatus", STATUSES)
    return R.pivot_longer(wide, STATUSES, "status", "n")


def replicate_rows(spark, sf):
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return R.replicate_rows(lines, F.when(F.col("l_quantity").isin(2, 3, 4), F.col("l_quantity")).otherwise(1))


def expand_years(spark, sf):
    spans = orders(spark, sf).groupBy("o_custkey").agg(F.min("o_day").alias("a"), F.max("o_day").alias("b"))
    return R.expand_years(spans, F.year("a"), F.year("b")).select("o_custkey", "Year")


def separate_unite(spark, sf):
    parts = R.separate(orders(spark, sf), "o_day", "-", "yr")
    return R.unite(parts, "tag", ["yr", "o_orderstatus"], "-").select("o_orderkey", "tag")


def union_by_name(spark, sf):
    days = orders(spark, sf)
    urgent = days.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_day")
    dear = days.filter("o_totalprice > 300000").select("o_day", "o_orderkey")
    return R.stack_rows(urgent, dear)


def union_missing(spark, sf):
    a = orders(spark, sf).filter("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    b = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return R.bind_rows(a, b)


def stack_tables(spark, sf):
    by_status = A.count_by(orders(spark, sf), "o_orderstatus")
    by_priority = A.count_by(orders(spark, sf), "o_orderpriority")
    return R.stack_tables({"status": by_status, "priority": by_priority})


def zip_by_key(spark, sf):
    days = orders(spark, sf)
    dear = A.count_by(days.filter("o_totalprice > 300000"), "o_orderpriority", name="dear")
    return J.zip_by_key(dear, A.count_by(days, "o_orderpriority", name="total"), ["o_orderpriority"])


def mask_cells(spark, sf):
    return C.mask_cells(
        _cells(spark, sf), ["o_orderstatus", "o_orderpriority"], [("F", "5-LOW"), ("O", "3-MEDIUM")], "n"
    )


def mutate_if_round(spark, sf):
    means = orders(spark, sf).groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"), F.min("o_day").alias("d"))
    return C.mutate_if_numeric(means, lambda c: S.round_half_even(c, 1))


def select_range(spark, sf):
    return C.select_range(load(spark, sf, "customer"), "c_nationkey", "c_mktsegment", keep=["c_custkey"])


def drop_range(spark, sf):
    return C.drop_range(load(spark, sf, "customer"), "c_nationkey", "c_mktsegment")


def with_cols_rename(spark, sf):
    chained = C.with_cols(
        load(spark, sf, "customer").select("c_custkey", "c_acctbal"),
        {"half": F.col("c_acctbal") / 2, "rest": F.col("half") - 1},
    )
    return C.rename(chained, {"account": "c_acctbal"})


def arrange_levels(spark, sf):
    return C.arrange(_cells(spark, sf), "o_orderpriority", "o_orderstatus", levels={"o_orderpriority": PRIORITIES[::-1]})


QUERIES = {
    f.__name__: f
    for f in (
        slice_first, slice_min, slice_min_ties, slice_max, fill_up, fill_downup, r_cumsum, group_max, ref_value,
        share_within, cut_numeric, cut_date, decimal_date, mid_december, round_half_even, fixed_text, r_ifelse,
        regex_code, date_range, assign_where, recode_levels, lenient_cast, semi_in, in_flag, left_join_named,
        inner_join, parent_join, prior_state, count_by, count_pred, quantile_summary, pct_table, pct_of,
        anova_orders, pivot_counts, pivot_values, pivot_bool, pivot_longer, replicate_rows, expand_years,
        separate_unite, union_by_name, union_missing, stack_tables, zip_by_key, mask_cells, mutate_if_round,
        select_range, drop_range, with_cols_rename, arrange_levels, fill_up_status, cumsum_all, left_join_split, quantile_heavy, asof_states,
    )
}
