"""Check SQL of the verb queries."""

from .sql_text import decimal_year, nearest

ORDERS = "(SELECT *, CAST(o_orderdate AS DATE) AS o_day FROM orders)"
GAPS = f"(SELECT o_custkey, o_orderkey, o_day, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS price FROM {ORDERS})"
CELLS = "(SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)"
RICH = "(SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0)"


def _first(order: str, cols: str) -> str:
    return (
        f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {order}) AS rn"
        f" FROM {ORDERS}) WHERE rn = 1"
    )


def _status_columns(value: str) -> str:
    return ", ".join(f"{value.format(s=s)} AS {s}" for s in "FOP")


SQL = {
    "slice_first": _first("o_day, o_orderkey", "o_custkey, o_orderkey, o_day"),
    "slice_min": _first("o_totalprice, o_orderkey", "o_custkey, o_orderkey, o_totalprice"),
    "slice_min_ties": (
        "SELECT o_custkey, o_orderkey, CAST(yr AS INT) AS yr FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY yr) AS rk"
        f" FROM (SELECT *, year(o_day) AS yr FROM {ORDERS})) WHERE rk = 1"
    ),
    "slice_max": _first("o_totalprice DESC, o_orderkey", "o_custkey, o_orderkey, o_totalprice"),
    "fill_up": f"""
        SELECT o_custkey, o_orderkey, o_day, first_value(price IGNORE NULLS) OVER (
            PARTITION BY o_custkey ORDER BY o_day, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS price
        FROM {GAPS}""",
    "fill_downup": f"""
        SELECT o_custkey, o_orderkey, o_day, coalesce(
            last_value(price IGNORE NULLS) OVER (
                PARTITION BY o_custkey ORDER BY o_day, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            first_value(price IGNORE NULLS) OVER (
                PARTITION BY o_custkey ORDER BY o_day, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price
        FROM {GAPS}""",
    "r_cumsum": f"""
        SELECT o_custkey, o_orderkey, CASE WHEN bad = 0 THEN round(total, 2) END AS cumsum FROM (
            SELECT *, sum(price) OVER w AS total, sum(CASE WHEN price IS NULL THEN 1 ELSE 0 END) OVER w AS bad
            FROM (SELECT o_custkey, o_orderkey, o_day, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS price FROM {ORDERS})
            WINDOW w AS (PARTITION BY o_custkey ORDER BY o_day, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "fill_up_status": f"""
        SELECT o_orderkey, o_day, o_orderstatus, first_value(price IGNORE NULLS) OVER (
            PARTITION BY o_orderstatus ORDER BY o_day, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS price
        FROM (SELECT o_orderkey, o_day, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS price FROM {ORDERS})""",
    "cumsum_all": f"""
        SELECT o_orderkey, o_custkey, o_day, CAST(sum(o_custkey) OVER (ORDER BY o_day, o_orderkey) AS BIGINT) AS upto FROM {ORDERS}""",
    "group_max": f"""
        SELECT o_custkey, o_orderkey, o_totalprice, o_day, max(o_totalprice) OVER (PARTITION BY o_custkey) AS max_price,
               max(o_day) OVER (PARTITION BY o_custkey) AS last_day
        FROM {ORDERS}""",
    "ref_value": f"""
        SELECT c.o_orderstatus, c.o_orderpriority, c.n, r.n AS ref, round(c.n / r.n - 1, 6) AS adv
        FROM {CELLS} c JOIN {CELLS} r ON r.o_orderstatus = c.o_orderstatus AND r.o_orderpriority = '1-URGENT'""",
    "share_within": f"""
        SELECT o_orderstatus, o_orderpriority, n, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS share FROM {CELLS}""",
    "cut_numeric": """
        SELECT o_orderkey, CASE WHEN o_totalprice <= 1000 THEN NULL WHEN o_totalprice <= 50000 THEN 'low'
            WHEN o_totalprice <= 150000 THEN 'mid' WHEN o_totalprice <= 300000 THEN 'high' END AS size FROM orders""",
    "cut_date": f"""
        SELECT o_orderkey, CASE WHEN o_day < DATE '1995-06-01' THEN NULL WHEN o_day < DATE '1997-01-01' THEN 'a'
            WHEN o_day < DATE '1998-06-15' THEN 'b' WHEN o_day < DATE '2001-01-01' THEN 'a' END AS era FROM {ORDERS}""",
    "decimal_date": f"SELECT o_orderkey, round({decimal_year('o_day')}, 9) AS ddate FROM {ORDERS}",
    "mid_december": f"SELECT o_orderkey, make_date(year(o_day) - 1, 12, 15) AS school_end FROM {ORDERS}",
    "round_half_even": f"SELECT o_orderkey, {nearest('o_orderkey / 8', 2)} AS rounded FROM orders",
    "fixed_text": f"SELECT o_orderkey, printf('%.2f', {nearest('o_totalprice / 4', 2)}) AS text FROM orders",
    "r_ifelse": f"""
        SELECT o_orderkey, CASE WHEN price IS NULL THEN NULL WHEN price > 200000 THEN 'big' ELSE 'small' END AS size FROM {GAPS}""",
    "regex_code": """
        SELECT l_orderkey, l_linenumber, l_partkey, coalesce(regexp_matches(CAST(
            CASE WHEN l_linenumber <> 4 THEN l_linenumber + l_partkey % 20 END AS VARCHAR), '2|3|4'), FALSE) AS hit
        FROM lineitem""",
    "date_range": f"""
        SELECT o_orderkey, o_day FROM {ORDERS} WHERE o_day >= DATE '1996-03-01' AND o_day < DATE '1997-10-31'""",
    "assign_where": """
        SELECT o_orderkey, CASE WHEN o_orderpriority = '2-HIGH' THEN '1-URGENT' ELSE o_orderpriority END AS priority FROM orders""",
    "recode_levels": """
        SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS state,
               CAST(6 - CAST(left(o_orderpriority, 1) AS INT) AS INT) AS place FROM orders""",
    "lenient_cast": """
        SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 2 = 0 THEN split_part(o_orderpriority, '-', 1)
            ELSE o_orderstatus END AS INT) AS number FROM orders""",
    "semi_in": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    "in_flag": """
        SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS has_urgent
        FROM customer""",
    "left_join_named": f"SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN {RICH} ON o_custkey = c_custkey",
    "inner_join": f"SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN {RICH} ON o_custkey = c_custkey",
    "parent_join": """
        SELECT c.c_custkey AS Childc_custkey, c.c_mktsegment AS Childc_mktsegment,
               p.c_custkey AS Parentc_custkey, p.c_mktsegment AS Parentc_mktsegment
        FROM customer c JOIN customer p ON c.c_custkey % 4 <> 0 AND p.c_custkey = c.c_custkey // 3""",
    "prior_state": f"""
        SELECT o_custkey, opened, closed FROM (
            SELECT s.o_custkey, m.opened, max(s.o_day) AS closed
            FROM {ORDERS} s JOIN (SELECT o_custkey, min(o_day) AS opened FROM {ORDERS} WHERE o_orderstatus = 'O' GROUP BY 1) m
              ON m.o_custkey = s.o_custkey AND s.o_day < m.opened
            WHERE s.o_orderstatus = 'F' GROUP BY ALL)
        WHERE opened - closed < 365""",
    "count_by": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
    "count_pred": f"SELECT price > 200000 AS big, count(*) AS n FROM {GAPS} GROUP BY ALL",
    "quantile_summary": """
        SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 2) AS median, round(quantile_cont(o_totalprice, 0.25), 2) AS q1,
               round(quantile_cont(o_totalprice, 0.75), 2) AS q3, round(avg(o_totalprice), 2) AS mean,
               round(stddev_samp(o_totalprice), 2) AS sd, count(*) AS n
        FROM orders GROUP BY 1""",
    "quantile_heavy": """
        SELECT round(quantile_cont(x, 0.01), 9) AS q01, round(quantile_cont(x, 0.5), 9) AS median, round(quantile_cont(x, 0.99), 9) AS q99
        FROM (SELECT o_totalprice / 1000 * pow(o_totalprice / 400000, 8) AS x FROM orders)""",
    "asof_states": f"""
        SELECT m.o_custkey, m.o_orderkey, m.o_day AS opened,
               (SELECT max(s.o_day) FROM {ORDERS} s WHERE s.o_custkey = m.o_custkey AND s.o_orderstatus = 'F' AND s.o_day < m.o_day) AS closed
        FROM {ORDERS} m WHERE m.o_orderstatus = 'O'""",
    "pct_table": """
        WITH c AS (SELECT coalesce(o_orderstatus, 'Overall') AS o_orderstatus, o_orderpriority, count(*) AS n,
                          grouping(o_orderpriority) AS total
                   FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), (o_orderstatus), ()))
        SELECT a.o_orderstatus, a.o_orderpriority, a.n, round(100 * (a.n / b.n), 6) AS pct
        FROM c a JOIN c b ON a.o_orderstatus = b.o_orderstatus AND b.total = 1 WHERE a.total = 0""",
    "pct_of": f"""
        SELECT o_orderstatus, count(*) FILTER (WHERE price > 200000) AS n, count(price) AS total,
               round(100 * (count(*) FILTER (WHERE price > 200000) / count(price)), 6) AS pct
        FROM {GAPS} JOIN (SELECT o_orderkey AS k, o_orderstatus FROM orders) ON k = o_orderkey GROUP BY 1""",
    "anova_orders": """
        WITH m AS (SELECT o_orderstatus, o_totalprice AS y, avg(o_totalprice) OVER (PARTITION BY o_orderstatus) AS grand,
                          avg(o_totalprice) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS mean, o_orderpriority AS g FROM orders)
, fits AS (
        SELECT o_orderstatus, count(DISTINCT g) - 1 AS df_between, count(*) - count(DISTINCT g) AS df_within,
               (sum((mean - grand) ** 2) / (count(DISTINCT g) - 1)) / (sum((y - mean) ** 2) / (count(*) - count(DISTINCT g))) AS f
        FROM m GROUP BY 1)
        -- four numerator degrees of freedom: five priorities
        SELECT o_orderstatus, df_between, df_within, round(f, 6) AS f, round(pow(df_within / (df_within + 4 * f), df_within / 2)
            * (1 + df_within / 2 * (4 * f / (df_within + 4 * f))), 6) AS p FROM fits""",
    "pivot_counts": "SELECT o_orderpriority, "
    + _status_columns("nullif(count(*) FILTER (WHERE o_orderstatus = '{s}'), 0)")
    + " FROM orders GROUP BY 1",
    "pivot_values": "SELECT o_custkey, "
    + _status_columns("max(o_day) FILTER (WHERE o_orderstatus = '{s}')")
    + f" FROM {ORDERS} GROUP BY 1",
    "pivot_bool": """
        SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice > 200000) AS yes,
               count(*) FILTER (WHERE NOT o_totalprice > 200000) AS no FROM orders GROUP BY 1""",
    "pivot_longer": """
        SELECT c.o_custkey, s.status, nullif(count(o.o_orderkey), 0) AS n
        FROM (SELECT DISTINCT o_custkey FROM orders) c CROSS JOIN (VALUES ('F'), ('O'), ('P')) s(status)
        LEFT JOIN orders o ON o.o_custkey = c.o_custkey AND o.o_orderstatus = s.status GROUP BY ALL""",
    "replicate_rows": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (
            SELECT *, unnest(generate_series(1, CASE WHEN l_quantity IN (2, 3, 4) THEN CAST(l_quantity AS INT) ELSE 1 END)) FROM lineitem)""",
    "expand_years": f"""
        SELECT o_custkey, CAST(unnest(generate_series(year(min(o_day)), year(max(o_day)))) AS INT) AS Year FROM {ORDERS} GROUP BY o_custkey""",
    "separate_unite": f"SELECT o_orderkey, CAST(year(o_day) AS VARCHAR) || '-' || o_orderstatus AS tag FROM {ORDERS}",
    "union_by_name": f"""
        SELECT o_orderkey, o_day FROM {ORDERS} WHERE o_orderpriority = '1-URGENT'
        UNION ALL SELECT o_orderkey, o_day FROM {ORDERS} WHERE o_totalprice > 300000""",
    "union_missing": """
        SELECT o_orderkey, o_custkey, NULL AS c_mktsegment FROM orders WHERE o_orderstatus = 'P'
        UNION ALL SELECT NULL, c_custkey, c_mktsegment FROM customer""",
    "stack_tables": """
        SELECT 'status' AS Section, o_orderstatus, NULL AS o_orderpriority, count(*) AS n FROM orders GROUP BY 2
        UNION ALL SELECT 'priority', NULL, o_orderpriority, count(*) FROM orders GROUP BY 3""",
    "zip_by_key": """
        SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice > 300000) AS dear, count(*) AS total FROM orders GROUP BY 1
        HAVING count(*) FILTER (WHERE o_totalprice > 300000) > 0""",
    "mask_cells": f"""
        SELECT o_orderstatus, o_orderpriority, CASE WHEN (o_orderstatus, o_orderpriority) IN (('F', '5-LOW'), ('O', '3-MEDIUM'))
            THEN NULL ELSE n END AS n FROM {CELLS}""",
    "mutate_if_round": f"""
        SELECT o_orderpriority, {nearest('avg(o_totalprice)', 1)} AS mean, min(o_day) AS d FROM {ORDERS} GROUP BY 1""",
    "select_range": "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "drop_range": "SELECT c_custkey, c_name FROM customer",
    "with_cols_rename": "SELECT c_custkey, c_acctbal AS account, c_acctbal / 2 AS half, c_acctbal / 2 - 1 AS rest FROM customer",
    "arrange_levels": f"SELECT * FROM {CELLS} ORDER BY o_orderpriority DESC, o_orderstatus",
}
# a join that is dealt out gives what the plain one gives
SQL["left_join_split"] = SQL["left_join_named"]
