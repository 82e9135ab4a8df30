"""Queries of rows as they stand in their files, of records that can't be read, and of long hierarchies and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.iri import BASE
from .operators import entail, numbering, specmine, triples
from .operators.steps import apply_steps
from .plans import pipeline
from .plans.config import Contract, ContractTable, Field, Step, TableSchema
from .registry import formula, query, table
from .samples import spec_lines
from .sources import readers, writers
from .sources.shared import new_folder

RDF, RDFS, OWL, XSD = triples.RDF_TYPE, triples.RDFS, triples.OWL, triples.XSD


def lineitem_files(spark: SparkSession, sf_dir: str) -> str:
    """The lines as CSV files in the order of their keys, without a line break in any cell."""
    path, n = new_folder(spark, "ordered-csv"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    rows.repartitionByRange(n, "l_orderkey", "l_linenumber").sortWithinPartitions("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").write.option("header", True).csv(path)
    return path


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS row_id FROM lineitem")
def row_numbers_in_file_order(spark, sf_dir):
    """Rows of several files numbered as they stand there, with no sort and no shuffle of rows."""
    df = numbering.with_file_order(readers.read_csv(spark, lineitem_files(spark, sf_dir), multiLine=False))
    return df.select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"), "row_id")


@query("""
SELECT l_orderkey, l_linenumber, lag(l_quantity) OVER w AS before, sum(l_quantity) OVER w AS upto
FROM lineitem WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING)""")
def formula_file_order(spark, sf_dir):
    """Formulas in the order of the rows in their files."""
    schema = TableSchema("L", [Field("l_orderkey", "integer"), Field("l_linenumber", "integer"), Field("l_quantity", "float")])
    df = readers.typed(readers.read_csv(spark, lineitem_files(spark, sf_dir), multiLine=False), schema)
    steps = [Step("l_orderkey", "l_orderkey"), Step("l_linenumber", "l_linenumber"), formula("before", "l_quantity.shift(1)"), formula("upto", "l_quantity.cumsum()")]
    return apply_steps(numbering.with_file_order(df), steps, row_id="row_id").df


def write_lines(df: DataFrame, line: Column, header: str, path: str) -> None:
    """Each task's rows as a file of lines that begins with the header."""
    rows = df.select(line.alias("line"), F.spark_partition_id().alias("part"), F.lit(1).alias("at"))
    both = rows.unionByName(rows.select(F.lit(header).alias("line"), "part", F.lit(0).alias("at")).distinct())
    both.repartition("part").sortWithinPartitions("part", "at").select("line", "part").write.partitionBy("part").text(path)


@query(f"""
WITH r AS (SELECT '<{BASE}Lines_' || row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) || '> ' AS s, * FROM lineitem)
SELECT s || '<{RDF}> <{BASE}LINES> .' AS value FROM r UNION ALL SELECT s || '<{BASE}L_PARTKEY> "' || l_partkey || '"^^<{XSD}integer> .' FROM r UNION ALL
SELECT '<{BASE}' || x[1] || '> <' || x[2] || '> <' || x[3] || '> .' FROM (SELECT unnest([['LINES', '{RDF}', '{OWL}Class'], ['L_PARTKEY', '{RDF}', '{OWL}DatatypeProperty'], ['L_PARTKEY', '{RDFS}domain', '{BASE}LINES'], ['L_PARTKEY', '{RDFS}range', '{XSD}integer']]) AS x)""")
def csv_to_triples_in_file_order(spark, sf_dir):
    """CSV files without a key to statements: subjects are numbered as the rows stand in the files."""
    folder = new_folder(spark, "e1")
    schema = "table: Lines\nfields:\n  - {name: l_partkey, type: integer}\n"
    writers.write_files(spark.createDataFrame([("lines.yaml", schema)], "name string, value string"), f"{folder}/schemas")
    pipeline.csv_to_triples(spark, f"{folder}/schemas/lines.yaml", lineitem_files(spark, sf_dir), f"{folder}/out", schema_folder=f"{folder}/schemas")
    return spark.read.text(f"{folder}/out")


def ragged(spark: SparkSession, sf_dir: str) -> str:
    """Customers as CSV files: every seventh record has a cell too many, others lack one or hold a line break."""
    path, key = new_folder(spark, "ragged"), F.col("c_custkey")
    text = lambda *parts: F.concat(*(F.lit(p) if i % 2 else F.col(p).cast("string") for i, p in enumerate(parts)))
    line = F.when(key % 7 == 0, text("c_custkey", ",", "c_name", ",x,")).when(key % 7 == 1, text("c_custkey", ",", "c_name"))
    line = line.when(key % 7 == 2, text("c_custkey", ',"', "c_name", '\n,""b""",', "c_nationkey")).otherwise(text("c_custkey", ",", "c_name", ",", "c_nationkey"))
    write_lines(table(spark, sf_dir, "customer"), line, "key,text,nation", path)
    return path


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS key, CASE c_custkey % 7 WHEN 0 THEN 'too many cells' ELSE 'good' END AS what,
       CASE c_custkey % 7 WHEN 0 THEN c_custkey || ',' || c_name || ',x,' WHEN 2 THEN c_name || chr(10) || ',"b"' ELSE c_name END AS text,
       CASE WHEN c_custkey % 7 > 1 THEN CAST(c_nationkey AS VARCHAR) END AS nation FROM customer""")
def csv_rejects(spark, sf_dir):
    """Records with too many cells as a table of their own; short ones end in nulls, quoted line breaks stay."""
    found = readers.read_csv_checked(spark, ragged(spark, sf_dir))
    good = found.rows.select("key", F.lit("good").alias("what"), "text", "nation")
    bad = found.rejects.select(F.split("text", ",")[0].alias("key"), F.col("reason").alias("what"), F.rtrim("text", F.lit("\n")).alias("text"), F.lit(None).cast("string").alias("nation"))
    return good.unionByName(bad)


@query("""
WITH c AS (SELECT c_custkey % 7 = 0 AS bad FROM customer), o AS (SELECT o_orderkey % 5 = 0 AS bad FROM orders)
SELECT 'Customers' AS "table", count(*) AS n_records, count(*) FILTER (NOT bad) AS n_rows, count(*) FILTER (bad) AS n_rejects, CAST(sum(CAST(bad AS INTEGER)) AS BIGINT) AS n_places FROM c UNION ALL
SELECT 'Orders', count(*), count(*) FILTER (NOT bad), count(*) FILTER (bad), CAST(sum(CAST(bad AS INTEGER)) AS BIGINT) FROM o""")
def contract_rejects(spark, sf_dir):
    """The rows and the wrong records of a contract's tables add up to all records; each wrong one has a place of its own."""
    folder = new_folder(spark, "contract")
    key = F.col("c_custkey")
    text = F.when(key % 7 == 0, F.concat_ws(";", "c_custkey", "c_name", "c_nationkey", F.lit("x"))).otherwise(F.concat(key.cast("string"), F.lit(';"'), "c_name", F.lit('\n";'), "c_nationkey"))
    orders = F.concat_ws(";", "o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "a;b;c").otherwise("a"))
    write_lines(table(spark, sf_dir, "customer"), text, "id;name;nation", f"{folder}/customers.csv")
    write_lines(table(spark, sf_dir, "orders"), orders, "id;status;note", f"{folder}/orders.csv")
    fields = [Field("id", "integer", True), Field("name"), Field("nation", "integer"), Field("status"), Field("note")]
    contract = Contract(options={"csv_options": {"delimiter": ";"}}, tables=[ContractTable("customers.csv", TableSchema("Customers", fields)), ContractTable("orders.csv", TableSchema("Orders", fields))])
    tables, rejects = readers.read_contract_checked(spark, contract, folder)
    counts = None
    for name, df in tables.items():
        one = df.where("id IS NOT NULL").agg(F.lit(name).alias("table"), F.count("*").alias("n_rows"))
        counts = one if counts is None else counts.unionByName(one)
    wrong = rejects.groupBy("table").agg(F.count("*").alias("n_rejects"), F.countDistinct("file", "record").alias("n_places"))
    return counts.join(wrong, "table").select("table", (F.col("n_rows") + F.col("n_rejects")).alias("n_records"), "n_rows", "n_rejects", "n_places")


@query("""
WITH RECURSIVE e AS (
  SELECT 'N' || o_orderkey AS low, 'N' || lead(o_orderkey) OVER (ORDER BY o_orderkey) AS high FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1000) UNION
  SELECT 'C' || c_custkey, 'T' || c_nationkey FROM customer UNION SELECT 'T' || n_nationkey, 'R' || n_regionkey FROM nation UNION SELECT 'R' || r_regionkey, 'R' || (r_regionkey + 1) % 3 FROM region WHERE r_regionkey < 3),
w AS (SELECT low, high FROM e WHERE high IS NOT NULL UNION SELECT w.low, e.high FROM w JOIN e ON e.low = w.high WHERE e.high IS NOT NULL)
SELECT low, high FROM w""")
def subclass_closure(spark, sf_dir):
    """What is above each class: a chain of 1,000 orders, a wide tree of customers, and regions in a circle."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").limit(1000)
    numbered = numbering.with_row_number(orders, ["o_orderkey"])
    chain = numbered.alias("a").join(numbered.alias("b"), F.expr("b.row_id = a.row_id + 1")).select(F.expr("concat('N', a.o_orderkey) AS low"), F.expr("concat('N', b.o_orderkey) AS high"))
    customers = table(spark, sf_dir, "customer").selectExpr("concat('C', c_custkey) AS low", "concat('T', c_nationkey) AS high")
    nations = table(spark, sf_dir, "nation").selectExpr("concat('T', n_nationkey) AS low", "concat('R', n_regionkey) AS high")
    regions = table(spark, sf_dir, "region").where("r_regionkey < 3").selectExpr("concat('R', r_regionkey) AS low", "concat('R', (r_regionkey + 1) % 3) AS high")
    pairs = chain.unionByName(customers).unionByName(nations).unionByName(regions)
    return entail.hierarchies(pairs.select(F.col("low").alias("s"), F.lit(RDFS + "subClassOf").alias("p"), F.col("high").alias("o")), "subClassOf")[0]


@query("""
SELECT 'all' AS file, upper(p.p_brand) AS "table", 'p' || p_partkey AS field, CASE WHEN p_partkey % 2 = 0 THEN 'Numérico' ELSE 'Alfanumérico' END AS kind, CAST(p_size AS VARCHAR) AS length FROM part p""")
def spec_one_file(spark, sf_dir):
    """All specifications as one long file, whose titles and headers are carried forward over runs of lines."""
    lines = spec_lines(spark, sf_dir).where(f"line_no < {1 << 40}")
    one = numbering.with_row_number(lines, ["file", "line_no"], "place")
    return specmine.spec_fields(one.select(F.lit("all").alias("file"), F.col("place").alias("line_no"), "cells")).select("file", "table", "field", "kind", "length")
