"""Registered queries over the given tables, one or more per operator family, with equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_files, queries_formula, queries_order, queries_reports  # noqa: F401  registered there
from .functions.iri import BASE
from .operators import contract, entail, numbering, quality, shapes, specmine, triples
from .operators.steps import apply_steps
from .plans.config import Field, Step, TableSchema
from .registry import ORACLE_SQL, QUERIES, formula, query, table
from .samples import CUSTOMER, GAPPY, NATION, ORDERS, gappy_customers, order_rows, spec_lines
from .sources import readers, writers
from .streaming import checks
from .streaming.run import run_to_table, stream_of

# Steps


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey FROM customer")
def map_rename(spark, sf_dir):
    return apply_steps(table(spark, sf_dir, "customer"), [Step("id", "c_custkey"), Step("name", "c_name"), Step("c_nationkey", "c_nationkey")]).df


@query("SELECT c_custkey AS id, coalesce(nullif(c_mktsegment, 'BUILDING'), c_name) AS label FROM customer")
def map_fill(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return apply_steps(df, [Step("id", "c_custkey"), Step("label", "segment"), Step("label", "c_name")], overwrite=False).df


@query("SELECT c_custkey AS id, CAST(NULL AS VARCHAR) AS gone, CAST(NULL AS VARCHAR) AS odd FROM customer")
def map_missing(spark, sf_dir):
    return apply_steps(table(spark, sf_dir, "customer"), [Step("id", "c_custkey"), Step("gone", "nope"), Step("odd", "c_name", "pivot")]).df


@query("""
SELECT l_orderkey, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, CAST(floor(l_quantity / 7) AS DOUBLE) AS packs,
       l_partkey % 7 AS rest, CAST(-(l_linenumber * l_linenumber) AS BIGINT) AS square, l_extendedprice / l_quantity AS unit,
       CAST(floor((l_linenumber - 4) / 3.0) AS BIGINT) AS third FROM lineitem""")
def formula_arith(spark, sf_dir):
    steps = [
        Step("l_orderkey", "l_orderkey"), formula("charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)"), formula("packs", "l_quantity // 7"),
        formula("rest", "l_partkey % 7"), formula("square", "-l_linenumber ** 2"), formula("unit", "l_extendedprice / l_quantity"), formula("third", "(l_linenumber - 4) // 3"),
    ]
    return apply_steps(table(spark, sf_dir, "lineitem"), steps).df


@query("""
SELECT l_orderkey, l_quantity > 30 AND l_discount < 0.05 AS large, 10 < l_quantity AND l_quantity < 20 AS middle,
       l_returnflag IN ('A', 'R') AS back, NOT (l_linestatus = 'O') AS closed, l_tax <> 0.02 OR l_linenumber = 1 AS other FROM lineitem""")
def formula_bool(spark, sf_dir):
    steps = [
        Step("l_orderkey", "l_orderkey"), formula("large", "l_quantity > 30 & l_discount < 0.05"), formula("middle", "10 < l_quantity < 20"),
        formula("back", "l_returnflag in ['A', 'R']"), formula("closed", "not l_linestatus == 'O'"), formula("other", "l_tax != 0.02 | l_linenumber == 1"),
    ]
    return apply_steps(table(spark, sf_dir, "lineitem"), steps).df


@query("""
SELECT l_orderkey, round(sqrt(l_extendedprice), 6) AS root, round(ln(l_quantity), 6) AS natural, round(exp(l_discount), 6) AS grown,
       floor(l_extendedprice) AS low, ceil(l_extendedprice) AS high, round(atan2(l_tax, l_discount + 1), 6) AS angle,
       round(sin(l_quantity), 6) AS sine, round(log10(l_extendedprice), 6) AS tens, abs(l_discount - 0.05) AS away FROM lineitem""")
def formula_math(spark, sf_dir):
    steps = [
        Step("l_orderkey", "l_orderkey"), formula("root", "sqrt(l_extendedprice)"), formula("natural", "log(l_quantity)"), formula("grown", "exp(l_discount)"), formula("low", "floor(l_extendedprice)"),
        formula("high", "ceil(l_extendedprice)"), formula("angle", "arctan2(l_tax, l_discount + 1)"), formula("sine", "sin(l_quantity)"), formula("tens", "log10(l_extendedprice)"), formula("away", "abs(l_discount - 0.05)"),
    ]
    df = apply_steps(table(spark, sf_dir, "lineitem"), steps).df
    return df.withColumns({c: F.round(c, 6) for c in ("root", "natural", "grown", "angle", "sine", "tens")})


@query("""
SELECT upper(c_name) AS loud, CAST(length(c_name) AS BIGINT) AS n, replace(c_name, '#', '-') AS dashed, substr(c_name, 1, 4) AS start,
       starts_with(c_mktsegment, 'B') AS b, c_name || c_mktsegment AS both, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS filled FROM customer""")
def formula_text(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    steps = [
        formula("loud", "c_name.str.upper()"), formula("n", "c_name.str.len()"), formula("dashed", "c_name.str.replace('#', '-')"), formula("start", "c_name.str.slice(0, 4)"),
        formula("b", "c_mktsegment.str.startswith('B')"), formula("both", "c_name + c_mktsegment"), formula("filled", "segment.fillna('none')"),
    ]
    return apply_steps(df, steps).df


@query("SELECT c_custkey AS id, c_acctbal - (SELECT min(c_acctbal) FROM customer) AS above, (SELECT max(c_custkey) FROM customer) - c_custkey AS left_over, (SELECT count(c_name) FROM customer) AS n FROM customer")
def formula_reduce(spark, sf_dir):
    return apply_steps(table(spark, sf_dir, "customer"), [Step("id", "c_custkey"), formula("above", "c_acctbal - c_acctbal.min()"), formula("left_over", "c_custkey.max() - c_custkey"), formula("n", "c_name.count()")]).df


@query("SELECT o_orderkey AS id, o_custkey + 14000 IN (SELECT o_orderkey FROM orders) AS known FROM orders")
def formula_member(spark, sf_dir):
    return apply_steps(table(spark, sf_dir, "orders"), [Step("id", "o_orderkey"), formula("known", "o_custkey + 14000 in o_orderkey")]).df


@query("""
SELECT o_orderkey AS id, lag(o_orderkey) OVER w AS before, CAST(sum(o_orderkey) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running,
       o_orderkey - lag(o_orderkey) OVER w AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def formula_ordered(spark, sf_dir):
    steps = [Step("id", "o_orderkey"), formula("before", "o_orderkey.shift(1)"), formula("running", "o_orderkey.cumsum()"), formula("gap", "o_orderkey.diff()")]
    return apply_steps(table(spark, sf_dir, "orders"), steps, order_by=["o_orderkey"], partition_by=["o_custkey"]).df


@query("SELECT o_orderkey AS id, CAST(NULL AS VARCHAR) AS assigned, CAST(NULL AS VARCHAR) AS unknown, CAST(NULL AS VARCHAR) AS chosen FROM orders")
def formula_invalid(spark, sf_dir):
    steps = [Step("id", "o_orderkey"), formula("assigned", "x = o_custkey"), formula("unknown", "nothing + 1"), formula("chosen", "o_custkey if o_custkey > 1 else 2")]
    return apply_steps(table(spark, sf_dir, "orders"), steps).df


@query("""
SELECT r.step_no, r.column, r.status, count(*) AS n FROM customer, (VALUES
  (CAST(1 AS BIGINT), 'id', 'generated'), (2, 'c_name', 'overwritten'), (3, 'cents', 'generated'), (4, 'gone', 'missing'), (5, 'bad', 'missing')) r(step_no, "column", status) GROUP BY ALL""")
def step_audit(spark, sf_dir):
    steps = [Step("id", "c_custkey"), Step("c_name", "c_name"), formula("cents", "c_acctbal * 100"), Step("gone", "nope"), formula("bad", "c_name +")]
    done = apply_steps(table(spark, sf_dir, "customer"), steps)
    return done.report().crossJoin(done.df.agg(F.count("*").alias("n")))  # one row of counts


@query("SELECT * FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100")
def sample_n(spark, sf_dir):
    """The sampling operator itself: its row count is its argument."""
    return quality.sample_n(table(spark, sf_dir, "orders"), 100, ["o_orderkey"])


@query("SELECT count(*) AS n_rows, least(100, count(*)) AS n_sample, least(100, count(*)) AS n_keys, least(100, count(*)) AS n_known FROM orders")
def sample_counts(spark, sf_dir):
    """A sample holds as many rows as it is told, all different and of the table; the steps take it as they take all."""
    orders = table(spark, sf_dir, "orders")
    steps = [Step("id", "o_orderkey"), formula("cents", "o_totalprice * 100")]
    every = apply_steps(orders, steps).df
    some = apply_steps(quality.sample_n(orders, 100, ["o_orderkey"]), steps).df
    known = some.join(every, ["id", "cents"], "left_semi").agg(F.count("*").alias("n_known"))
    counts = some.agg(F.count("*").alias("n_sample"), F.count_distinct("id").alias("n_keys"))
    return every.agg(F.count("*").alias("n_rows")).crossJoin(counts).crossJoin(known)  # one row each


@query("SELECT o_orderkey AS id, o_custkey AS who FROM orders")
def steps_later_wins(spark, sf_dir):
    """A step without an output is passed over, and of two steps for one output the later one counts."""
    steps = [Step("", "o_clerk"), Step("id", "o_custkey"), Step("who", "nope"), Step("id", "o_orderkey"), Step("who", "o_custkey"), formula("", "1 + 1")]
    return apply_steps(table(spark, sf_dir, "orders"), steps).df


@query("""
SELECT r.step_no, r.column, r.status, count(*) AS n FROM customer, (VALUES
  (CAST(1 AS BIGINT), 'c_name', 'missing'), (2, 'c_name', 'overwritten'), (3, 'c_phone', 'generated'), (4, 'c_phone', 'generated'), (5, 'id', 'missing'), (6, 'id', 'generated')) r(step_no, "column", status) GROUP BY ALL""")
def step_exact_audit(spark, sf_dir):
    """An output of nothing but nulls is replaced, one with values is filled: only the first counts as overwritten."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit("x").alias("c_phone"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    steps = [Step("c_name", "nope"), Step("c_name", "c_name"), formula("c_phone", "segment.fillna('none')"), Step("c_phone", "c_name"), Step("id", "nope"), Step("id", "c_custkey")]
    done = apply_steps(df, steps, overwrite=False, exact_audit=True)
    return done.report().crossJoin(done.df.agg(F.count("*").alias("n")))  # one row of counts


# Summaries

@query(f"""
WITH g AS ({GAPPY}) SELECT * FROM (
  SELECT 'c_name' AS column_name, count(*) FILTER (c_name IS NULL OR c_name = '') AS n_empty FROM g UNION ALL
  SELECT 'c_mktsegment', count(*) FILTER (c_mktsegment IS NULL OR c_mktsegment = '') FROM g) WHERE n_empty > 0""")
def required_empty(spark, sf_dir):
    return quality.required_empty(gappy_customers(spark, sf_dir), CUSTOMER)


@query("SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem")
def table_counts(spark, sf_dir):
    return quality.shape_of(table(spark, sf_dir, "lineitem"))


# Shapes


def broken(df: DataFrame, fields: list[Field], key: str) -> DataFrame:
    schema = TableSchema("T", fields)
    return shapes.violations(df, shapes.constraints(df, schema), F.col(key)).select("subject", "path", "constraint", "value")


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS subject, 'code' AS path, 'datatype' AS "constraint", replace(p_brand, 'Brand#1', '') AS value
FROM part WHERE NOT regexp_full_match(replace(p_brand, 'Brand#1', ''), '[0-9]+')""")
def shape_datatype(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("code", F.replace("p_brand", F.lit("Brand#1"), F.lit("")))
    return broken(df, [Field("code", "integer")], "p_partkey")


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS subject, 'c_mktsegment' AS path, 'minCount' AS "constraint", c_mktsegment AS value FROM ({GAPPY}) WHERE c_mktsegment IS NULL""")
def shape_min_count(spark, sf_dir):
    return broken(gappy_customers(spark, sf_dir), [Field("c_mktsegment", required=True)], "c_custkey")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS subject, 'p_name' AS path, 'maxLength' AS "constraint", p_name AS value FROM part WHERE length(p_name) > 9""")
def shape_max_length(spark, sf_dir):
    return broken(table(spark, sf_dir, "part"), [Field("p_name", length=9)], "p_partkey")


@query(r"""
SELECT CAST(o_orderkey AS VARCHAR) AS subject, 'price' AS path, 'pattern' AS "constraint", CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS VARCHAR) AS value
FROM orders WHERE NOT regexp_full_match(CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS VARCHAR), '-?[0-9]{1,5}(\.[0-9]{1,2})?')""")
def shape_digits(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(15,2)"))
    return broken(df, [Field("price", "decimal", precision=7, scale=2)], "o_orderkey")


@query(r"""
WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS subject, 'day' AS path, 'pattern' AS "constraint", day AS value FROM d WHERE NOT regexp_full_match(day, '[0-9]{4}-[0-9]{2}-[0-9]{2}')""")
def shape_date_pattern(spark, sf_dir):
    day = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return broken(table(spark, sf_dir, "orders").withColumn("day", day), [Field("day", "date", format="%Y-%m-%d")], "o_orderkey")


@query(r"""
WITH d AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '99/99/2020' WHEN 2 THEN 'garbage' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS day,
                  CASE WHEN o_orderkey % 7 = 0 THEN '2020-02-31' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS subject, 'day' AS path, 'datatype' AS "constraint", day AS value FROM d WHERE try_strptime(day, '%d/%m/%Y') IS NULL UNION ALL
SELECT CAST(o_orderkey AS VARCHAR), 'iso', 'datatype', iso FROM d WHERE try_strptime(iso, '%Y-%m-%d') IS NULL""")
def shape_date_formats(spark, sf_dir):
    """Dates are held to their format, whichever it is; what a pattern allows must be a date too."""
    kinds = F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 5 == 1, "99/99/2020").when(F.col("o_orderkey") % 5 == 2, "garbage")
    df = table(spark, sf_dir, "orders").withColumn("day", kinds.otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")))
    df = df.withColumn("iso", F.when(F.col("o_orderkey") % 7 == 0, "2020-02-31").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return broken(df, [Field("day", "date", format="%d/%m/%Y"), Field("iso", "date", format="%Y-%m-%d")], "o_orderkey")


@query(f"""
WITH g AS ({GAPPY}) SELECT 'whole' AS name, count(*) = 0 AS conforms FROM customer WHERE c_custkey IS NULL OR c_name IS NULL
UNION ALL SELECT 'gappy', count(*) = 0 FROM g WHERE c_mktsegment IS NULL OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') OR length(c_name) > 12""")
def shape_verdicts(spark, sf_dir):
    """Whether a table conforms to its schema."""
    whole = TableSchema("C", [Field("c_custkey", "integer", True), Field("c_name", required=True)])
    found = [("whole", quality.conforms(shapes.validate(table(spark, sf_dir, "customer"), whole).violations)), ("gappy", shapes.validate(gappy_customers(spark, sf_dir), CUSTOMER).conforms)]
    return spark.createDataFrame(found, "name string, conforms boolean")


@query("""
WITH t AS (SELECT p_type AS name, max(p_size) AS n, p_type LIKE '%O%' AS needed FROM part GROUP BY ALL),
l AS (SELECT name, '    sh:property [ sh:path <http://weftline.local/ont#' || replace(url_encode(upper(name)), '+', '%20') || '> ; sh:datatype <http://www.w3.org/2001/XMLSchema#string> ; sh:minCount '
             || CAST(CAST(needed AS INTEGER) AS VARCHAR) || ' ; sh:maxLength ' || n || ' ]' AS line, row_number() OVER (ORDER BY name) = count(*) OVER () AS at_end FROM t)
SELECT line || CASE WHEN at_end THEN ' .' ELSE ' ;' END AS line FROM l UNION ALL
SELECT unnest(['@prefix sh: <http://www.w3.org/ns/shacl#> .', '', '<http://weftline.local/ont#PARTSShape> a sh:NodeShape ;', '    sh:targetClass <http://weftline.local/ont#PARTS> ;'])""")
def shape_document(spark, sf_dir):
    """The constraints of a schema with a field per kind of part, as text."""
    kinds = table(spark, sf_dir, "part").groupBy("p_type").agg(F.max("p_size").alias("n")).orderBy("p_type").collect()  # one row per kind
    schema = TableSchema("Parts", [Field(k.p_type, required="O" in k.p_type, length=int(k.n)) for k in kinds])
    return spark.createDataFrame([(line,) for line in shapes.shapes_text(schema).splitlines()], "line string")


@query(f"""
WITH g AS ({GAPPY}), v AS (
  SELECT 'c_name' AS path, 'maxLength' AS "constraint" FROM g WHERE length(c_name) > 12 UNION ALL
  SELECT 'c_mktsegment', 'minCount' FROM g WHERE c_mktsegment IS NULL UNION ALL
  SELECT 'c_mktsegment', 'enum' FROM g WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD'))
SELECT path, "constraint", count(*) AS n FROM v GROUP BY ALL""")
def shape_report(spark, sf_dir):
    return shapes.validate(gappy_customers(spark, sf_dir), CUSTOMER).summary


# Contract


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def pk_duplicates(spark, sf_dir):
    return contract.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"SELECT 'c_mktsegment' AS column_name, count(*) FILTER (c_mktsegment IS NULL) AS n_null FROM ({GAPPY})")
def key_nulls(spark, sf_dir):
    return contract.null_keys(gappy_customers(spark, sf_dir), ["c_custkey", "c_mktsegment"])


@query("""
SELECT 'p_name,p_brand' AS columns, '["' || p_name || '","' || p_brand || '"]' AS key, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1 UNION ALL
SELECT 'p_type', '["' || p_type || '"]', count(*) FROM part GROUP BY ALL HAVING count(*) > 1""")
def unique_sets(spark, sf_dir):
    return contract.unique_sets(table(spark, sf_dir, "part"), [["p_name", "p_brand"], ["p_type"]])


@query("""
SELECT value, count(*) AS n FROM (SELECT CAST(p_partkey AS VARCHAR) AS value FROM part UNION ALL SELECT CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_name FROM part)
WHERE value <> '' GROUP BY ALL HAVING count(*) > 1""")
def cross_unique(spark, sf_dir):
    return contract.cross_unique(table(spark, sf_dir, "part"), ["p_partkey", "p_size", "p_name"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def fk_orphans(spark, sf_dir):
    parents = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'")
    return contract.orphans(table(spark, sf_dir, "orders"), "o_custkey", parents, "c_custkey").select("o_orderkey", "o_custkey")


@query("""
SELECT 'ORDERS' AS "table", 'o_custkey' AS "column", 'Customer.c_custkey' AS reference, 'orphans' AS problem, count(*) AS n
FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')
UNION ALL SELECT 'ORDERS', 'o_orderstatus', 'States.code', 'unknown parent', CAST(NULL AS BIGINT)""")
def fk_report(spark, sf_dir):
    tables = {"ORDERS": table(spark, sf_dir, "orders"), "CUSTOMER": table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'")}
    schemas = {"ORDERS": TableSchema("ORDERS", [Field("o_custkey", foreign_key="Customer.c_custkey"), Field("o_orderstatus", foreign_key="States.code")])}
    return contract.foreign_keys(tables, schemas)


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY ALL")
def enum_check(spark, sf_dir):
    return contract.enum_violations(table(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 3 = 2")
def date_formats(spark, sf_dir):
    kinds = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss"))
    df = table(spark, sf_dir, "orders").withColumn("day", kinds.otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return contract.date_violations(df, "day", ["%d/%m/%Y", "%d/%m/%Y %H:%M:%S"]).select("o_orderkey", "day")


@query(f"SELECT 'c_mktsegment' AS column_name, count(c_mktsegment) AS n FROM ({GAPPY})")
def deprecated_used(spark, sf_dir):
    return contract.deprecated_used(gappy_customers(spark, sf_dir), TableSchema("C", [Field("c_mktsegment", deprecated=True), Field("c_name")]))


@query(r"""SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS VARCHAR) AS balance FROM customer WHERE NOT regexp_full_match(CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS VARCHAR), '-?[0-9]{1,3}(\.[0-9]{1,2})?')""")
def number_formats(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(12,2)").cast("string").alias("balance"))
    return contract.format_violations(df, "balance", "[-XXX.XX, XXX.XX]")


@query("""
SELECT 'l_discount < 0.08' AS "check", count(*) FILTER (NOT l_discount < 0.08) AS n FROM lineitem UNION ALL
SELECT 'l_quantity * 2 > l_linenumber', count(*) FILTER (NOT l_quantity * 2 > l_linenumber) FROM lineitem""")
def check_counts(spark, sf_dir):
    return contract.check_counts(table(spark, sf_dir, "lineitem"), ["l_discount < 0.08", "l_quantity * 2 > l_linenumber"])


LAYOUT = ["c_custkey", "C_NAME", "c_mktsegment", "c_nationkey", "c_fax"]


@query(f"""
WITH a AS (SELECT column_name AS name, row_number() OVER () AS position FROM (DESCRIBE SELECT * FROM customer)),
e AS (SELECT unnest({LAYOUT}) AS name, generate_subscripts({LAYOUT}, 1) AS position),
m AS (SELECT c.folded, coalesce(a.position, e.position) AS position, e.name AS expected, a.name AS actual,
             CASE WHEN e.name IS NULL THEN 'extra' WHEN a.name IS NOT NULL AND (e.name = a.name OR c.folded AND lower(e.name) = lower(a.name)) THEN 'ok'
                  WHEN EXISTS (SELECT 1 FROM a x WHERE e.name = x.name OR c.folded AND lower(e.name) = lower(x.name)) THEN 'moved' ELSE 'missing' END AS status
      FROM (VALUES (true), (false)) c(folded), a FULL JOIN e ON a.position = e.position)
SELECT NOT folded AS case_sensitive, CAST(position AS BIGINT) AS position, expected, actual, status FROM m""")
def column_layout(spark, sf_dir):
    """Declared against present columns, place by place, with and without regard to case."""
    df, schema = table(spark, sf_dir, "customer"), TableSchema("Customer", [Field(n) for n in LAYOUT])
    exact, folded = (contract.column_order(df, schema, case).withColumn("case_sensitive", F.lit(case)) for case in (True, False))
    return exact.unionByName(folded)


# Triples

XSD, RDF, RDFS, OWL = triples.XSD, triples.RDF_TYPE, triples.RDFS, triples.OWL


@query(f"""
WITH f AS (SELECT DISTINCT upper(replace(p_brand, '#', '')) AS t, upper(replace(p_type, ' ', '')) AS f, CASE WHEN p_type = 'PROMO' THEN 'integer' ELSE 'string' END AS k FROM part)
SELECT '{BASE}' || t AS s, '{RDF}' AS p, '{OWL}Class' AS o FROM f UNION SELECT '{BASE}' || f, '{RDF}', '{OWL}DatatypeProperty' FROM f
UNION SELECT '{BASE}' || f, '{RDFS}domain', '{BASE}' || t FROM f UNION SELECT '{BASE}' || f, '{RDFS}range', '{XSD}integer' FROM f WHERE k = 'integer'""")
def tbox_triples(spark, sf_dir):
    fields = table(spark, sf_dir, "part").select(F.replace("p_brand", F.lit("#"), F.lit("")).alias("table"), F.replace("p_type", F.lit(" "), F.lit("")).alias("field"), F.when(F.col("p_type") == "PROMO", "integer").otherwise("string").alias("kind"))
    return triples.tbox(fields).select("s", "p", "o")


@query(f"SELECT p_partkey, '{BASE}Part_' || replace(url_encode(p_name || '*' || p_brand), '+', '%20') AS s FROM part")
def subject_iri(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("label", F.concat("p_name", F.lit("*"), "p_brand"))
    return df.select("p_partkey", triples.subject(df, TableSchema("Part", primary_key=["label"])).alias("s"))


@query("SELECT p_partkey, replace(url_encode(split_part(p_name, ' ', 1)), '+', '%20') AS first, replace(url_encode(p_name), '+', '%20') AS whole FROM part")
def iri_tokens(spark, sf_dir):
    from .functions.iri import token

    return table(spark, sf_dir, "part").select("p_partkey", token(F.col("p_name"), first_token=True).alias("first"), token(F.col("p_name")).alias("whole"))


ABOX_SQL = f"""
WITH r AS (SELECT '{BASE}Orders_' || o_orderkey AS s, nullif(o_custkey, 7) AS c, * FROM orders)
SELECT s, '{RDF}' AS p, '{BASE}ORDERS' AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS datatype FROM r UNION ALL
SELECT s, '{BASE}O_ORDERKEY', CAST(o_orderkey AS VARCHAR), 'literal', '{XSD}integer' FROM r UNION ALL
SELECT s, '{BASE}O_CUSTKEY', CAST(c AS VARCHAR), 'literal', '{XSD}integer' FROM r WHERE c IS NOT NULL UNION ALL
SELECT s, '{BASE}O_ORDERSTATUS', o_orderstatus, 'literal', NULL FROM r WHERE o_orderstatus IS NOT NULL UNION ALL
SELECT s, '{BASE}O_ORDERDATE', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), 'literal', '{XSD}dateTime' FROM r WHERE o_orderdate IS NOT NULL UNION ALL
SELECT s, '{BASE}OPEN', CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END, 'literal', '{XSD}boolean' FROM r WHERE o_orderstatus IS NOT NULL"""


@query(ABOX_SQL)
def abox_triples(spark, sf_dir):
    return triples.abox(order_rows(spark, sf_dir), ORDERS)


@query(f"SELECT p, count(*) AS n_triples, count(DISTINCT s) AS n_subjects FROM (SELECT DISTINCT * FROM ({ABOX_SQL} UNION ALL SELECT '{BASE}Nation_' || n_name, '{RDF}', '{BASE}NATION', 'iri', NULL FROM nation UNION ALL SELECT '{BASE}Nation_' || n_name, '{BASE}N_NATIONKEY', CAST(n_nationkey AS VARCHAR), 'literal', '{XSD}integer' FROM nation UNION ALL SELECT '{BASE}Nation_' || n_name, '{BASE}N_NAME', n_name, 'literal', NULL FROM nation)) GROUP BY p")
def graph_union(spark, sf_dir):
    orders = triples.abox(order_rows(spark, sf_dir), ORDERS)
    nations = triples.abox(table(spark, sf_dir, "nation"), NATION)
    return quality.triple_statistics(triples.graph_union(orders, nations, nations), is_set=True)


@query(f"""
WITH r AS (SELECT '{BASE}PARTS_' || p_partkey AS s, CASE WHEN p_size % 5 <> 0 THEN p_size END AS z, * FROM part)
SELECT s, '{RDF}' AS p, '{BASE}PARTS' AS o, 'iri' AS o_kind FROM r UNION ALL
SELECT s, '{BASE}P_NAME', p_name, 'literal' FROM r UNION ALL SELECT s, '{BASE}P_SIZE', CAST(z AS VARCHAR), 'literal' FROM r""")
def untyped_triples(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("p_size", F.when(F.col("p_size") % 5 != 0, F.col("p_size")))
    found = triples.untyped(df, [TableSchema("A", [Field("p_name")]), TableSchema("B", [Field("p_size")])], "parts", "p_partkey")
    return found.select("s", "p", "o", "o_kind")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS row_id FROM lineitem")
def row_numbers(spark, sf_dir):
    df = numbering.with_row_number(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"])
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "row_id")


@query(f"SELECT '{BASE}Orders_' || o_orderkey AS s, c.name AS o FROM orders, (VALUES ('{BASE}ORDERS'), ('{BASE}LEDGER'), ('{BASE}RECORD')) c(name)")
def rdfs_closure(spark, sf_dir):
    """Every order is typed by its class, by a second table's domain and by that class's superclass."""
    tbox = triples.tbox(triples.schema_fields(spark, [ORDERS, TableSchema("Ledger", [Field("o_orderkey", "integer")])]))
    rule = spark.createDataFrame([(f"{BASE}LEDGER", f"{RDFS}subClassOf", f"{BASE}RECORD", "iri", None)], triples.TRIPLE)
    found = entail.rdfs_closure(triples.abox(order_rows(spark, sf_dir), ORDERS), tbox.unionByName(rule))
    return found.where(F.col("p") == RDF).select("s", "o")


@query(f"""
SELECT '{BASE}Orders_' || o_orderkey AS s, '{BASE}O_CUSTKEY' AS p, CAST(nullif(o_custkey, 7) AS VARCHAR) AS o, 'disjoint' AS reason FROM orders WHERE o_custkey <> 7 UNION ALL
SELECT '{BASE}Orders_' || o_orderkey, '{BASE}O_ORDERSTATUS', o_orderstatus, 'datatype' FROM orders WHERE o_orderstatus IS NOT NULL""")
def range_consistency(spark, sf_dir):
    """Another table declares o_custkey boolean and o_orderstatus integer."""
    other = TableSchema("Ledger", [Field("o_custkey", "boolean"), Field("o_orderstatus", "integer")])
    tbox = triples.tbox(triples.schema_fields(spark, [ORDERS, other]))
    return entail.inconsistencies(triples.abox(order_rows(spark, sf_dir), ORDERS), tbox).select("s", "p", "o", "reason")


@query("""
SELECT 'sound' AS name, true AS consistent FROM (SELECT count(*) FROM orders) UNION ALL
SELECT 'contradicted', count(*) = 0 FROM orders WHERE o_custkey <> 7""")
def graph_verdict(spark, sf_dir):
    """Whether the triples of the orders contradict the declared ranges, by their own schema and with another one."""
    rows = triples.abox(order_rows(spark, sf_dir), ORDERS)
    own = triples.schema_fields(spark, [ORDERS])
    other = triples.schema_fields(spark, [ORDERS, TableSchema("Ledger", [Field("o_custkey", "boolean")])])
    found = [("sound", entail.consistent(rows, triples.tbox(own))), ("contradicted", entail.consistent(rows, triples.tbox(other)))]
    return spark.createDataFrame(found, "name string, consistent boolean")


@query(f"""
SELECT '{BASE}Slim_' || c_custkey AS s, '{RDF}' AS p, '{BASE}SLIM' AS o FROM customer UNION ALL
SELECT '{BASE}Slim_' || c_custkey, '{BASE}C_NAME', c_name FROM customer""")
def abox_present_fields(spark, sf_dir):
    """Only fields that are declared and present become triples."""
    schema = TableSchema("Slim", [Field("c_name"), Field("c_fax")], ["c_custkey"])
    return triples.abox(table(spark, sf_dir, "customer"), schema).select("s", "p", "o")


@query(f"""
SELECT '{BASE}Bag_' || p_partkey AS subject, 'p_size' AS path, CAST(p_size AS VARCHAR) AS value, 'datatype' AS "constraint" FROM part UNION ALL
SELECT '{BASE}Bag_' || p_partkey, 'p_brand', p_brand, 'enum' FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12') UNION ALL
SELECT '{BASE}Bag_' || p_partkey, 'made', '31/02/2020', 'datatype' FROM part WHERE p_partkey % 3 = 0""")
def triple_shape_kinds(spark, sf_dir):
    """Lists, the literals' own datatypes and dates with a format, on triples: sizes are numbers, but declared as texts."""
    made = F.when(F.col("p_partkey") % 3 == 0, "31/02/2020").when(F.col("p_partkey") % 3 == 1, "28/02/2020")
    schema = TableSchema("Bag", [Field("p_size"), Field("p_brand", enum=["Brand#11", "Brand#12"]), Field("made", "date", format="%d/%m/%Y")], ["p_partkey"])
    return shapes.validate_triples(triples.abox(table(spark, sf_dir, "part").withColumn("made", made), schema), schema)


@query(f"""
WITH g AS ({GAPPY}) SELECT * FROM (
SELECT '{BASE}Customer_' || c_custkey AS subject, 'c_name' AS path, c_name AS value, 'maxLength' AS "constraint" FROM g WHERE length(c_name) > 12 UNION ALL
SELECT '{BASE}Customer_' || c_custkey, 'c_mktsegment', NULL, 'minCount' FROM g WHERE c_mktsegment IS NULL)""")
def triple_shapes(spark, sf_dir):
    """The constraints of shape_report, found on the triples."""
    schema = TableSchema("Customer", [Field(f.name, f.kind, f.required, f.length) for f in CUSTOMER.fields if f.name != "c_acctbal"], ["c_custkey"])
    return shapes.validate_triples(triples.abox(gappy_customers(spark, sf_dir), schema), schema)


@query(f"""
SELECT '<{BASE}Nation_' || n_name || '> <{RDF}> <{BASE}NATION> .' AS value FROM nation UNION ALL
SELECT '<{BASE}Nation_' || n_name || '> <{BASE}N_NATIONKEY> "' || n_nationkey || '"^^<{XSD}integer> .' FROM nation UNION ALL
SELECT '<{BASE}Nation_' || n_name || '> <{BASE}N_NAME> "' || n_name || '" .' FROM nation""")
def triple_lines(spark, sf_dir):
    return writers.triple_lines(triples.abox(table(spark, sf_dir, "nation"), NATION))


# Specifications: one file per brand, whose lines come from the brand's parts.

@query("""
SELECT p_brand AS file, upper(p_brand) AS "table", 'p' || p_partkey AS field, CASE WHEN p_partkey % 2 = 0 THEN 'Numérico' ELSE 'Alfanumérico' END AS kind, CAST(p_size AS VARCHAR) AS length,
       CASE WHEN p_partkey % 7 = 0 THEN 'x,y' ELSE '' END AS format, CASE WHEN p_partkey % 3 = 0 THEN 'Sí' ELSE 'No' END AS required FROM part""")
def spec_fields(spark, sf_dir):
    found = specmine.spec_fields(spec_lines(spark, sf_dir).where(f"line_no < {1 << 40}"))
    return found.select("file", "table", "field", "kind", "length", "format", "required")


@query("""
SELECT p_brand AS file, 'p' || p_partkey AS field, CASE WHEN p_partkey % 2 = 0 THEN 'integer' ELSE 'string' END AS kind, CASE p_partkey % 5 WHEN 0 THEN 'SI|NO' WHEN 1 THEN 'M|H' WHEN 2 THEN 'A|B' END AS enum FROM part
UNION ALL SELECT DISTINCT p_brand, 'La clave está compuesta por id + tienda', '', NULL FROM part UNION ALL SELECT DISTINCT p_brand, 'a', 'b y c deben ser UNIQUE', NULL FROM part""")
def spec_fields_and_notes(spark, sf_dir):
    """Lines below a header are fields, notes too: they are told apart in spec_notes."""
    found = specmine.enriched(specmine.spec_fields(spec_lines(spark, sf_dir)))
    return found.select("file", "field", "kind", F.array_join("enum", "|").alias("enum"))


@query("""
SELECT 'p' || p_partkey AS field, CASE WHEN p_partkey % 2 = 0 THEN 'integer' ELSE 'string' END AS kind,
       CASE p_partkey % 5 WHEN 0 THEN 'SI|NO' WHEN 1 THEN 'M|H' WHEN 2 THEN 'A|B' END AS enum, p_partkey % 5 = 3 AS deprecated,
       CASE WHEN p_partkey % 5 = 4 THEN 'Clientes.id' END AS foreign_key FROM part""")
def spec_enrich(spark, sf_dir):
    found = specmine.enriched(specmine.spec_fields(spec_lines(spark, sf_dir).where(f"line_no < {1 << 40}")))
    return found.select("field", "kind", F.array_join("enum", "|").alias("enum"), "deprecated", "foreign_key")


@query("""
SELECT upper(p_brand) AS "table", 'id|tienda' AS primary_key, 'concat' AS operation, 'id + tienda' AS expression, 'a|b y c' AS unique_fields,
       count(*) FILTER (p_partkey % 5 = 3) + 3 AS n_notes FROM part GROUP BY p_brand""")
def spec_notes(spark, sf_dir):
    found = specmine.metadata(spec_lines(spark, sf_dir))
    return found.select("table", F.array_join("primary_key", "|").alias("primary_key"), "operation", "expression", F.array_join("unique_fields", "|").alias("unique_fields"), F.size("notes").cast("long").alias("n_notes"))


@query("""SELECT upper(p_brand) AS "table", count(*) FILTER (p_partkey % 3 = 0) AS n_keys, count(*) AS n_fields, coalesce(string_agg('p' || p_partkey, '|' ORDER BY p_partkey) FILTER (p_partkey % 3 = 0), '') AS primary_key FROM part GROUP BY p_brand""")
def spec_required_keys(spark, sf_dir):
    lines = spec_lines(spark, sf_dir).where(f"line_no > 2 AND line_no < {1 << 40}").withColumn("file", F.concat(F.lit("/in/T_"), "file", F.lit(".csv")))
    found = specmine.required_keys(specmine.single_table_fields(lines))
    return found.select("table", F.size("primary_key").cast("long").alias("n_keys"), F.size("fields").cast("long").alias("n_fields"), F.array_join("primary_key", "|").alias("primary_key"))


@query("""
SELECT '/in/' || upper(replace(p_name, ' ', '_')) || '_sample.csv' AS path, CASE WHEN p_name NOT LIKE 'red%' THEN replace(p_name, ' ', '_') || '.yaml' END AS matched FROM part""")
def schema_match(spark, sf_dir):
    stem = F.replace("p_name", F.lit(" "), F.lit("_"))
    parts = table(spark, sf_dir, "part")
    files = parts.select(F.concat(F.lit("/in/"), F.upper(stem), F.lit("_sample.csv")).alias("path"))
    schemas = parts.where("p_name NOT LIKE 'red%'").select(F.concat(stem, F.lit(".yaml")).alias("schema")).distinct()
    return readers.match_schemas(files, schemas)


# Streams

EVENTS = TableSchema("Events", [Field("event_type", required=True, enum=["click", "view"]), Field("props", length=8)])


@query("""
WITH v AS (SELECT ts, 'event_type' AS path, 'enum' AS "constraint" FROM events WHERE event_type NOT IN ('click', 'view')
           UNION ALL SELECT ts, 'props', 'maxLength' FROM events WHERE length(props) > 8),
w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, path, "constraint", count(*) AS n FROM v GROUP BY ALL)
SELECT epoch(start) // 1 AS start_s, path, "constraint", n FROM w WHERE start + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""")
def stream_violations(spark, sf_dir):
    """Broken constraints by closed hour, computed as a stream."""
    stream = checks.windowed_violations(stream_of(spark, f"{sf_dir}/events.parquet"), EVENTS, "ts", window="1 hour")
    return run_to_table(stream).select(F.unix_timestamp(F.col("start").cast("timestamp")).cast("double").alias("start_s"), "path", "constraint", "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders mapped by steps, their broken constraints by kind, and references without a customer."""
    steps = [Step("id", "o_orderkey"), Step("customer", "o_custkey"), Step("priority", "o_orderpriority"), formula("cents", "o_totalprice * 100")]
    done = apply_steps(table(spark, sf_dir, "orders"), steps).df
    schema = TableSchema("Orders", [Field("id", "integer", True), Field("priority", required=True, length=5), Field("customer", "integer", True)], ["id"])
    report = shapes.validate(done, schema).summary
    parents = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'")
    missing = contract.orphans(done, "customer", parents, "c_custkey").agg(F.count("*").alias("n")).select(F.lit("customer").alias("path"), F.lit("foreignKey").alias("constraint"), "n")
    return report.unionByName(missing)


QUERIES["orders_report"] = flagship
ORACLE_SQL["orders_report"] = """
SELECT 'priority' AS path, 'maxLength' AS "constraint", count(*) AS n FROM orders WHERE length(o_orderpriority) > 5 UNION ALL
SELECT 'customer', 'foreignKey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')"""
