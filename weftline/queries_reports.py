"""Queries of reports made in one pass, of streams' keys and references, of stored graphs, and of total formulas."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.iri import BASE
from .operators import contract, numbering, quality, triples
from .operators.steps import apply_steps
from .plans import config, pipeline
from .plans.config import Contract, ContractTable, Field, Step, TableSchema
from .registry import formula, query, table
from .samples import GAPPY, NATION, ORDERS, gappy_customers, order_rows, spec_lines
from .sources import readers, writers
from .sources.shared import new_folder
from .streaming import keys
from .streaming.run import run_to_table, stream_of

RDF, RDFS, OWL, XSD = triples.RDF_TYPE, triples.RDFS, triples.OWL, triples.XSD


@query(f"""
WITH g AS ({GAPPY})
SELECT * FROM (
  SELECT 'rows' AS what, '' AS path, '' AS "constraint", count(*) AS n FROM g UNION ALL SELECT 'written', '', '', count(*) FROM g UNION ALL SELECT 'cents', '', '', CAST(sum(floor(c_acctbal * 100 + 0.5)) AS BIGINT) FROM g UNION ALL
  SELECT 'empty', 'name', '', count(*) FILTER (c_name = '') FROM g UNION ALL SELECT 'empty', 'segment', '', count(*) FILTER (c_mktsegment IS NULL) FROM g UNION ALL
  SELECT 'broken', 'segment', 'minCount', count(*) FILTER (c_mktsegment IS NULL) FROM g UNION ALL SELECT 'broken', 'name', 'maxLength', count(*) FILTER (length(c_name) > 12) FROM g) WHERE n <> 0""")
def export_with_report(spark, sf_dir):
    """A table written once, with its emptiness and broken constraints counted on the way."""
    path = new_folder(spark, "export")
    steps = [Step("id", "c_custkey"), Step("name", "c_name"), Step("segment", "c_mktsegment"), formula("cents", "floor(c_acctbal * 100 + 0.5)")]
    schema = TableSchema("C", [Field("id", "integer", True), Field("name", required=True, length=12), Field("segment", required=True), Field("cents", "float")])
    done = pipeline.export_with_report(gappy_customers(spark, sf_dir), steps, schema, lambda df: writers.write_parquet(df, path))
    written = spark.read.parquet(path)
    counted = spark.createDataFrame([("rows", "", "", done.n_rows)], done.report.schema)
    there = written.agg(F.count("*").alias("written"), F.sum("cents").cast("long").alias("cents"))
    told = there.select(F.expr("stack(2, 'written', '', '', written, 'cents', '', '', cents) AS (what, path, constraint, n)"))
    return counted.unionByName(done.report).unionByName(told)


CONTRACT_SQL = """
WITH o AS (SELECT *, CASE WHEN o_orderkey % 100 < 50 THEN o_orderkey ELSE o_orderkey - o_orderkey % 100 END AS k, nullif(o_custkey, 7) AS c, CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS day,
  CAST(3 - o_orderkey % 20 AS VARCHAR) AS rate FROM orders)
SELECT * FROM (
  SELECT 'Orders' AS "table", 'primary key' AS rule, 'k' AS detail, (SELECT count(*) FROM (SELECT k FROM o GROUP BY k HAVING count(*) > 1)) AS n UNION ALL
  SELECT 'Orders', 'unique', 'c,o_orderdate', (SELECT count(*) FROM (SELECT c, o_orderdate FROM o WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) > 1)) UNION ALL
  SELECT 'Orders', 'unique', 'o_orderstatus', (SELECT count(*) FROM (SELECT o_orderstatus FROM o GROUP BY ALL HAVING count(*) > 1)) UNION ALL
  SELECT 'Orders', 'cross unique', 'k,c', (SELECT count(*) FROM (SELECT v FROM (SELECT k AS v FROM o UNION ALL SELECT c FROM o WHERE c IS NOT NULL) GROUP BY v HAVING count(*) > 1)) UNION ALL
  SELECT 'Orders', 'required', 'c', (SELECT count(*) FROM o WHERE c IS NULL) UNION ALL
  SELECT 'Orders', 'enum', 'o_orderpriority', (SELECT count(*) FROM o WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) UNION ALL
  SELECT 'Orders', 'date format', 'day', (SELECT count(*) FROM o WHERE day = 'n/a') UNION ALL
  SELECT 'Orders', 'number format', 'rate', (SELECT count(*) FROM o WHERE NOT regexp_full_match(rate, '-?[0-9]')) UNION ALL
  SELECT 'Orders', 'deprecated', 'o_orderstatus', (SELECT count(*) FROM o) UNION ALL
  SELECT 'Orders', 'check', 'o_totalprice < 100000', (SELECT count(*) FROM o WHERE o_totalprice >= 100000) UNION ALL
  SELECT 'Orders', 'orphans', 'c -> Customers.c_custkey', (SELECT count(*) FROM o WHERE c NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 > 0)) UNION ALL
  SELECT 'Customers', 'unique', 'c_nationkey', (SELECT count(*) FROM (SELECT c_nationkey FROM customer WHERE c_custkey % 4 > 0 GROUP BY ALL HAVING count(*) > 1))) WHERE n > 0"""


@query(CONTRACT_SQL)
def contract_report_all(spark, sf_dir):
    """Keys, unique sets, values, formats and checks of a contract: one scan and one exchange of counts for a table, and its references."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").withColumns({"k": F.when(key % 100 < 50, key).otherwise(key - key % 100), "c": F.nullif("o_custkey", F.lit(7).cast("long"))})
    orders = orders.withColumns({"day": F.when(key % 3 == 0, "n/a").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")), "rate": (F.lit(3) - key % 20).cast("string")})
    fields = [Field("k", "integer", True), Field("c", "integer", True, foreign_key="Customers.c_custkey"), Field("o_orderpriority", enum=["1-URGENT", "2-HIGH"]), Field("day", "date", format="%d/%m/%Y"), Field("rate", format="[-X, X]"), Field("o_orderstatus", deprecated=True)]
    schema = TableSchema("Orders", fields, ["k"], [["c", "o_orderdate"], ["o_orderstatus"]], ["o_totalprice < 100000"], {"cross_unique": [["k", "c"]]})
    customers = TableSchema("Customers", [Field("c_custkey", "integer", True)], ["c_custkey"], [["c_nationkey"]])
    given = Contract(tables=[ContractTable("orders.csv", schema), ContractTable("customers.csv", customers)])
    return contract.contract_report({"Orders": orders, "Customers": table(spark, sf_dir, "customer").where("c_custkey % 4 > 0")}, given)


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 3 = 0)")
def enum_long_list(spark, sf_dir):
    """Values against a list that is a table: the rows of brands that no third part has."""
    parts = table(spark, sf_dir, "part")
    bad = contract.enum_violations(parts, "p_brand", parts.where("p_partkey % 3 = 0").select("p_brand"))
    return parts.join(bad.select(F.col("value").alias("p_brand")), "p_brand").select("p_partkey", "p_brand")


# Schema documents and the plain variant of a graph


@query("""
SELECT upper(p_brand) AS "table", 'p' || p_partkey AS field, CASE WHEN p_partkey % 2 = 0 THEN 'integer' ELSE 'string' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN true ELSE false END AS required,
       p_size AS length, CASE p_partkey % 5 WHEN 0 THEN 'SI|NO' WHEN 1 THEN 'M|H' WHEN 2 THEN 'A|B' END AS enum, CASE WHEN p_partkey % 5 = 4 THEN 'Clientes.id' END AS foreign_key FROM part""")
def schema_documents_read(spark, sf_dir):
    """Mined fields written as schema documents, which the reader of schemas understands again."""
    fields = pipeline.mine(spec_lines(spark, sf_dir).where(f"line_no < {1 << 40}")).fields
    path = new_folder(spark, "documents")
    documents = writers.schema_documents(fields)
    writers.write_files(documents.select(F.concat(F.translate("table", "#", "_"), F.lit(".yaml")).alias("name"), F.col("document").alias("value")), path)
    read = readers.read_schema_fields(spark, path).where("error IS NULL")
    return read.select("table", "field", "kind", "required", F.col("length").cast("int").alias("length"), F.array_join("enum", "|").alias("enum"), "foreign_key")


@query(f"""
WITH r AS (SELECT '{BASE}PARTS_' || row_number() OVER (ORDER BY p_partkey) AS s, CASE WHEN p_size % 5 <> 0 THEN p_size END AS z, * FROM part)
SELECT s, '{RDF}' AS p, '{BASE}PARTS' AS o FROM r UNION ALL SELECT s, '{BASE}P_NAME', p_name FROM r UNION ALL SELECT s, '{BASE}P SIZE', CAST(z AS VARCHAR) FROM r UNION ALL
SELECT '{BASE}' || x[1], x[2], x[3] FROM (SELECT unnest([['PARTS', '{RDF}', '{OWL}Class'], ['SIZES', '{RDF}', '{OWL}Class'], ['P_NAME', '{RDF}', '{OWL}DatatypeProperty'], ['P SIZE', '{RDF}', '{OWL}DatatypeProperty'],
  ['P_NAME', '{RDFS}domain', '{BASE}PARTS'], ['P_NAME', '{RDFS}domain', '{BASE}SIZES'], ['P SIZE', '{RDFS}domain', '{BASE}SIZES']]) AS x)""")
def untyped_graph(spark, sf_dir):
    """The plain variant from schema files to the whole graph: names as they are, nulls kept, numbered rows."""
    folder = new_folder(spark, "plain")
    files = [("parts.yaml", "- {Campo: p_name}\n"), ("sizes.yaml", "columns: [{name: p size}, p_name]\n")]
    writers.write_files(spark.createDataFrame(files, "name string, value string"), folder)
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("p size"))
    return triples.untyped_graph(numbering.with_row_number(df, ["p_partkey"]), config.load_schemas(folder, spark)[0], "parts").select("s", "p", "o")


# Streams


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def stream_key_violations(spark, sf_dir):
    """The keys of a stream that come again, told as they do; the last word on each is its count."""
    found = keys.key_violations(stream_of(spark, f"{sf_dir}/events.parquet"), ["user_id", "event_type"], "ts")
    return run_to_table(found).groupBy("user_id", "event_type").agg(F.max("n").alias("n"))


@query("""
WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), c AS (SELECT * FROM events WHERE event_type = 'click'),
e AS (SELECT least((SELECT max(ts) FROM p), (SELECT max(ts) FROM c)) - INTERVAL '10 minutes' AS closed)
SELECT p.event_id, p.user_id FROM p, e WHERE p.ts <= closed AND NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = p.user_id AND c.ts BETWEEN p.ts - INTERVAL '3 hours' AND p.ts)""")
def stream_orphans(spark, sf_dir):
    """Purchases without a click of the same user in the three hours before, as two streams joined."""
    events = lambda kind: stream_of(spark, f"{sf_dir}/events.parquet").where(F.col("event_type") == kind)
    found = keys.orphan_stream(events("purchase"), "user_id", "ts", events("click"), "user_id", "ts", within="3 hours")
    return run_to_table(found.select("event_id", "user_id"))


# Stored graphs

GRAPH_SQL = f"""
SELECT '{BASE}Orders_' || o_orderkey AS s, '{RDF}' AS p, '{BASE}ORDERS' AS o, 'iri' AS o_kind, NULL AS datatype FROM orders UNION
SELECT '{BASE}Orders_' || o_orderkey, '{BASE}O_ORDERKEY', CAST(o_orderkey AS VARCHAR), 'literal', '{XSD}integer' FROM orders UNION
SELECT '{BASE}Orders_' || o_orderkey, '{BASE}O_CUSTKEY', CAST(o_custkey AS VARCHAR), 'literal', '{XSD}integer' FROM orders WHERE o_custkey <> 7 UNION
SELECT '{BASE}Orders_' || o_orderkey, '{BASE}O_ORDERSTATUS', o_orderstatus, 'literal', NULL FROM orders UNION
SELECT '{BASE}Orders_' || o_orderkey, '{BASE}O_ORDERDATE', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), 'literal', '{XSD}dateTime' FROM orders UNION
SELECT '{BASE}Orders_' || o_orderkey, '{BASE}OPEN', CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END, 'literal', '{XSD}boolean' FROM orders UNION
SELECT '{BASE}Nation_' || n_name, '{RDF}', '{BASE}NATION', 'iri', NULL FROM nation UNION
SELECT '{BASE}Nation_' || n_name, '{BASE}N_NATIONKEY', CAST(n_nationkey AS VARCHAR), 'literal', '{XSD}integer' FROM nation UNION
SELECT '{BASE}Nation_' || n_name, '{BASE}N_NAME', n_name, 'literal', NULL FROM nation"""


def appended(spark: SparkSession, sf_dir: str) -> triples.StoredGraph:
    """Two thirds of the orders stored, then the last two thirds and the nations appended, the nations twice."""
    rows = order_rows(spark, sf_dir)
    graph = triples.StoredGraph.create(triples.abox(rows.where("o_orderkey % 3 < 2"), ORDERS), f"graph_{uuid.uuid4().hex}")
    nations = triples.abox(table(spark, sf_dir, "nation"), NATION)
    graph.append(triples.abox(rows.where("o_orderkey % 3 > 0"), ORDERS).unionByName(nations))
    graph.append(nations)
    return graph


@query(GRAPH_SQL)
def graph_append(spark, sf_dir):
    """A stored graph with what further parts add: the union of all, of which only the new parts were shuffled."""
    return appended(spark, sf_dir).triples()


@query(f"SELECT p, count(*) AS n_triples, true AS near FROM ({GRAPH_SQL}) GROUP BY p")
def triple_statistics_merged(spark, sf_dir):
    """Statistics of a graph from those kept with its parts: counts exact, distinct subjects within 5 %."""
    graph = appended(spark, sf_dir)
    exact = quality.triple_statistics(graph.triples(), is_set=True).select("p", F.col("n_subjects").alias("exact"))
    near = F.abs(F.col("n_subjects") - F.col("exact")) <= F.col("exact") * 0.05
    return graph.statistics().join(exact, "p").select("p", "n_triples", near.alias("near"))


# Formulas that can't fail


@query("""
WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN -9223372036854775808 ELSE o_custkey END AS big, o_orderkey % 4 = 0 AS least FROM orders)
SELECT v.o_orderkey, false AS other_list, false AS other_column, CASE WHEN NOT least THEN abs(big) END AS size, CASE WHEN NOT least THEN -big END AS turned, CASE WHEN NOT least THEN -big END AS halved,
       false AS no_date, o_orderdate = TIMESTAMP '1995-01-01' AS day, CAST(NULL AS VARCHAR) AS fill, CAST(NULL AS VARCHAR) AS clip, CAST(NULL AS VARCHAR) AS pattern, CAST(NULL AS DOUBLE) AS divided, CAST(NULL AS INTEGER) AS cast_,
       CASE WHEN NOT least AND big IN (0, 1) THEN CAST(big AS BIGINT) END AS power, CASE WHEN NOT least THEN CAST(round_even(big, -1) AS BIGINT) END AS tens FROM v JOIN orders USING (o_orderkey)""")
def formula_total(spark, sf_dir):
    """What fails in Spark is null or the stated value: other kinds in lists and columns, the least number, bad patterns, divisions by zero, huge powers."""
    big = F.when(F.col("o_orderkey") % 4 == 0, F.lit(-(1 << 63))).otherwise(F.col("o_custkey").cast("long"))
    formulas = {
        "other_list": "big in ['a']", "other_column": "big in o_orderstatus", "size": "abs(big)", "turned": "-big", "halved": "big // -1", "no_date": "o_orderdate == 'abc'", "day": "o_orderdate == '1995-01-01'",
        "fill": "big.fillna('none')", "clip": "big.clip(1, 'q')", "pattern": "o_orderstatus.str.contains('[')", "divided": "sql:1 / 0", "cast_": "sql:cast(o_orderstatus as int)", "power": "big ** 10 ** 9", "tens": "big.round(-1)",
    }
    steps = [Step("o_orderkey", "o_orderkey"), *(formula(o, t) for o, t in formulas.items())]
    return apply_steps(table(spark, sf_dir, "orders").withColumn("big", big), steps).df
