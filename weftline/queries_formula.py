"""Queries of the formula language beyond those in queries.py: every function, method and sign."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators.steps import apply_steps
from .plans.config import Step
from .registry import formula, query, table


def evaluated(df, key: str, formulas: dict[str, str], **options):
    return apply_steps(df, [Step(key, key), *(formula(o, t) for o, t in formulas.items())], **options).df


@query("""
SELECT l_orderkey, CAST(l_linenumber * l_linenumber * l_linenumber AS BIGINT) AS cube,
       CASE l_linenumber WHEN 1 THEN CAST(1 AS BIGINT) WHEN 2 THEN 137438953472 WHEN 3 THEN 450283905890997363 END AS high,
       CASE l_linenumber WHEN 1 THEN CAST(1 AS BIGINT) WHEN 2 THEN 4 WHEN 3 THEN 27 WHEN 4 THEN 256 WHEN 5 THEN 3125 WHEN 6 THEN 46656 WHEN 7 THEN 823543 END AS itself, CAST(1 AS BIGINT) AS none
FROM lineitem""")
def formula_power(spark, sf_dir):
    """Integer powers are exact, beyond what a double holds too, and null beyond 64 bits."""
    return evaluated(table(spark, sf_dir, "lineitem"), "l_orderkey", {"cube": "l_linenumber ** 3", "high": "l_linenumber ** 37", "itself": "l_linenumber ** l_linenumber", "none": "l_linenumber ** 0"})


@query("""
WITH v AS (SELECT *, l_linenumber - 4 AS a, l_quantity - 25 AS q FROM lineitem)
SELECT l_orderkey, CAST(a - 3 * floor(a / 3.0) AS BIGINT) AS up, CAST(a + 3 * floor(a / -3.0) AS BIGINT) AS down, q - 7 * floor(q / 7) AS rest, CAST(floor(a / -3.0) AS BIGINT) AS whole,
       CASE WHEN a <> 0 THEN CAST(floor(5.0 / a) AS BIGINT) END AS quotient, CASE WHEN a <> 0 THEN CAST(5 - a * floor(5.0 / a) AS BIGINT) END AS remainder FROM v""")
def formula_signs(spark, sf_dir):
    """Quotients and remainders of negative numbers follow the divisor's sign; by zero they are null."""
    rows = table(spark, sf_dir, "lineitem").withColumn("a", F.col("l_linenumber") - 4).withColumn("q", F.col("l_quantity") - 25)
    return evaluated(rows, "l_orderkey", {"up": "a % 3", "down": "a % -3", "rest": "q % 7", "whole": "a // -3", "quotient": "5 // a", "remainder": "5 % a"})


@query("""
WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS x, o_orderkey % 3 = 1 AS nan FROM orders)
SELECT o_orderkey, x IS NOT NULL AND NOT nan AND x > 1000 AS large, x IS NOT NULL AND NOT nan AS same, x IS NULL OR nan AS other, coalesce(NOT nan AND x IN (1, 2), false) AS few,
       NOT (x IS NOT NULL AND NOT nan AND x <= 1000) AS turned, x IS NULL OR nan AS missing FROM v""")
def formula_nan(spark, sf_dir):
    """Comparisons with null and NaN are False, inequality True."""
    x = F.when(F.col("o_orderkey") % 3 == 1, float("nan")).when(F.col("o_orderkey") % 3 == 2, F.col("o_totalprice"))
    formulas = {"large": "x > 1000", "same": "x == x", "other": "x != x", "few": "x in [1, 2]", "turned": "not x <= 1000", "missing": "x.isnull()"}
    return evaluated(table(spark, sf_dir, "orders").withColumn("x", x), "o_orderkey", formulas)


TRIGONOMETRY = ["sin", "cos", "tan", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "arcsinh", "arccosh", "arctanh"]


@query(
    "SELECT l_orderkey, "
    + ", ".join(f"round({n.replace('arc', 'a')}({'l_discount + 1' if n == 'arccosh' else 'l_discount'}), 9) AS {n}" for n in TRIGONOMETRY)
    + " FROM lineitem"
)
def formula_trigonometry(spark, sf_dir):
    formulas = {n: f"{n}({'l_discount + 1' if n == 'arccosh' else 'l_discount'})" for n in TRIGONOMETRY}
    return evaluated(table(spark, sf_dir, "lineitem"), "l_orderkey", formulas).withColumns({n: F.round(n, 9) for n in TRIGONOMETRY})


@query("""
SELECT l_orderkey, round(exp(l_tax) - 1, 9) AS expm1, round(ln(1 + l_tax), 9) AS log1p, CASE WHEN l_quantity > 25 THEN round(ln(l_quantity - 25), 9) END AS narrow, round(atan2(l_quantity - 25, -2), 9) AS turned,
       abs(25 - l_quantity) AS away, CAST(abs(4 - l_linenumber) AS BIGINT) AS steps, floor(-l_discount) AS low, ceil(-l_tax) AS high FROM lineitem""")
def formula_mathematics(spark, sf_dir):
    formulas = {"expm1": "expm1(l_tax)", "log1p": "log1p(l_tax)", "narrow": "log(l_quantity - 25)", "turned": "arctan2(l_quantity - 25, -2)", "away": "abs(25 - l_quantity)", "steps": "abs(4 - l_linenumber)", "low": "floor(-l_discount)", "high": "ceil(-l_tax)"}
    return evaluated(table(spark, sf_dir, "lineitem"), "l_orderkey", formulas).withColumns({n: F.round(n, 9) for n in ("expm1", "log1p", "narrow", "turned")})


@query("""
SELECT c_custkey, lower(c_name) AS small, trim(c_mktsegment) AS bare, regexp_matches(c_name, '[13579]$') AS odd, contains(c_mktsegment, 'UIL') AS built, CAST(length(' ' || c_name) AS BIGINT) AS n,
       substr(c_name, 3, 5) AS middle, upper(substr(c_mktsegment, 1, 2)) || '-' || c_name AS tag FROM customer""")
def formula_texts(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("padded", F.concat(F.lit(" \t"), "c_mktsegment", F.lit("\n ")))
    formulas = {"small": "c_name.str.lower()", "bare": "padded.str.strip()", "odd": "c_name.str.contains('[13579]$')", "built": "c_mktsegment.str.contains('UIL')", "n": "(' ' + c_name).str.len()", "middle": "c_name.str.slice(2, 7)", "tag": "c_mktsegment.str.slice(0, 2).str.upper() + '-' + c_name"}
    return evaluated(df, "c_custkey", formulas)


@query("""
SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS code, TRY_CAST(p_name AS DOUBLE) AS none, CAST(p_size AS VARCHAR) AS text, p_size % 5 = 0 AS empty, p_size % 5 <> 0 AS full,
       CASE WHEN p_size % 5 <> 0 THEN least(greatest(p_size, 10), 20) END AS held, coalesce(CASE WHEN p_size % 5 <> 0 THEN p_size END, -1) AS filled, CAST(p_size AS DOUBLE) AS wide FROM part""")
def formula_methods(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("code", F.replace("p_brand", F.lit("Brand#"), F.lit(""))).withColumn("gap", F.when(F.col("p_size") % 5 != 0, F.col("p_size")))
    formulas = {"code": "code.astype('int')", "none": "p_name.astype('float')", "text": "p_size.astype(str)", "empty": "gap.isnull()", "full": "gap.notnull()", "held": "gap.clip(10, 20)", "filled": "gap.fillna(-1)", "wide": "p_size.astype('float')"}
    return evaluated(df, "p_partkey", formulas)


@query("""
SELECT l_orderkey, round(round_even(l_quantity / 4, 0), 6) AS even, round(l_quantity / (SELECT sum(l_quantity) FROM lineitem), 12) AS share, round(l_tax - (SELECT avg(l_tax) FROM lineitem), 9) AS beyond FROM lineitem""")
def formula_sums(spark, sf_dir):
    formulas = {"even": "(l_quantity / 4).round(0)", "share": "l_quantity / l_quantity.sum()", "beyond": "l_tax - l_tax.mean()"}
    return evaluated(table(spark, sf_dir, "lineitem"), "l_orderkey", formulas).withColumns({"even": F.round("even", 6), "share": F.round("share", 12), "beyond": F.round("beyond", 9)})


@query("""
SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS place,
       CASE WHEN p_size % 5 <> 0 THEN rank() OVER (ORDER BY CASE WHEN p_size % 5 <> 0 THEN p_size END NULLS LAST) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 END AS among,
       rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS own FROM part""")
def formula_rank(spark, sf_dir):
    """Mean places among equal values, in the whole table and within each brand; nulls have none."""
    df = table(spark, sf_dir, "part").withColumn("gap", F.when(F.col("p_size") % 5 != 0, F.col("p_size")))
    every = evaluated(df, "p_partkey", {"place": "p_size.rank()", "among": "gap.rank()"})
    within = evaluated(df, "p_partkey", {"own": "p_size.rank()"}, partition_by=["p_brand"])
    return every.join(within, "p_partkey")


@query("""
SELECT o_orderkey, lag(o_custkey) OVER w AS before, lag(o_custkey, 3) OVER w AS third, lead(o_custkey) OVER w AS after, CAST(sum(o_custkey) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running,
       o_custkey - lag(o_custkey, 2) OVER w AS gap FROM orders WINDOW w AS (ORDER BY o_orderkey)""")
def formula_whole_order(spark, sf_dir):
    """Shifts, running totals and differences in the order of all rows, which no single task sees."""
    formulas = {"before": "o_custkey.shift(1)", "third": "o_custkey.shift(3)", "after": "o_custkey.shift(-1)", "running": "o_custkey.cumsum()", "gap": "o_custkey.diff(2)"}
    return evaluated(table(spark, sf_dir, "orders"), "o_orderkey", formulas, order_by=["o_orderkey"])
