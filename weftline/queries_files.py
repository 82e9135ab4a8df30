"""Queries of sources, sinks and whole compositions: what is written is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.iri import BASE
from .operators import triples
from .plans import config, pipeline
from .plans.config import Contract, ContractTable, Field, Step, TableSchema
from .registry import formula, query, table
from .samples import NATION, gappy_customers, spec_lines
from .sources import readers, writers
from .sources.shared import new_folder

RDF, RDFS, XSD, OWL = triples.RDF_TYPE, triples.RDFS, triples.XSD, triples.OWL


def noted_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with codes that look like numbers, and texts with all that a CSV file must quote."""
    code, note = F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"\nend'))
    return table(spark, sf_dir, "customer").select(code.alias("code"), note.alias("note"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), "c_acctbal")


NOTED = """SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS code, c_name || ', "' || c_mktsegment || '"' || chr(10) || 'end' AS note, nullif(c_mktsegment, 'BUILDING') AS segment, c_acctbal FROM customer"""


# Sources and sinks


@query(f"SELECT * FROM ({NOTED})")
def csv_round_trip(spark, sf_dir):
    """A table as CSV and back by its schema: codes, quotes, commas and line breaks stay."""
    path = new_folder(spark, "csv")
    writers.write_csv(noted_customers(spark, sf_dir), path)
    df = readers.read_csv(spark, path)
    return readers.typed(df, TableSchema("T", [Field("code"), Field("note"), Field("segment"), Field("c_acctbal", "float")]))


@query("""SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS "0", nullif(c_mktsegment, 'MACHINERY') AS "1" FROM customer""")
def csv_without_header(spark, sf_dir):
    """Columns of a file without a header are numbered; certain words are read as nulls."""
    path = new_folder(spark, "csv")
    table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 9, "0"), "c_mktsegment").write.csv(path)
    return readers.read_csv(spark, path, header=False, null_tokens=["MACHINERY"])


@query("SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, l_extendedprice, l_returnflag FROM lineitem")
def parquet_round_trip(spark, sf_dir):
    path = new_folder(spark, "parquet")
    writers.write_parquet(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_returnflag"), path)
    return readers.read_parquet(spark, path).withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


@query("""
SELECT 'Orders' AS name, CAST(o_orderkey AS BIGINT) AS id, o_totalprice AS amount, epoch(o_orderdate) // 1 AS day_s FROM orders UNION ALL
SELECT 'Customers', c_custkey, c_acctbal, NULL FROM customer""")
def contract_read(spark, sf_dir):
    """Two tables of a contract, read with its delimiter, decimal sign and date formats."""
    folder = new_folder(spark, "contract")
    comma = lambda c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), comma("o_totalprice").alias("amount"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    orders.write.option("header", True).option("sep", ";").csv(f"{folder}/orders.csv")
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), comma("c_acctbal").alias("amount")).write.option("header", True).option("sep", ";").csv(f"{folder}/customers.csv")
    fields = [Field("id", "integer", True), Field("amount", "float")]
    tables = [ContractTable("orders.csv", TableSchema("Orders", [*fields, Field("day", "date", format="%d/%m/%Y")])), ContractTable("customers.csv", TableSchema("Customers", fields))]
    contract = Contract(options={"csv_options": {"delimiter": ";", "decimal": ","}, "date_formats": ["%d/%m/%Y"]}, tables=tables)
    found = readers.read_contract(spark, contract, folder)
    day = F.unix_timestamp("day").cast("double")
    orders, customers = found["Orders"].withColumn("day_s", day), found["Customers"].withColumn("day_s", F.lit(None).cast("double"))
    both = orders.select(F.lit("Orders").alias("name"), "id", "amount", "day_s")
    return both.unionByName(customers.select(F.lit("Customers").alias("name"), "id", "amount", "day_s"))


def spec_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, value): the specifications of spec_lines as CSV texts, with every cell quoted and a line break in the last."""
    lines = spec_lines(spark, sf_dir).where(f"line_no < {1 << 40}")
    cells = F.transform("cells", lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))
    quoted = F.array_join(F.when(F.size("cells") > 2, F.concat(cells, F.array(F.lit('"a\r\n""b"", c"')))).otherwise(cells), ",")
    rows = lines.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line_no", quoted.alias("text")))).alias("lines"))
    value = F.array_join(F.transform("lines", lambda x: x["text"]), "\r\n")
    return rows.select(F.concat(F.lit("T_"), F.replace("file", F.lit("#"), F.lit("_")), F.lit(".csv")).alias("name"), F.concat(value, F.lit("\r\n")).alias("value"))


@query("""
SELECT 'T_' || replace(p_brand, '#', '_') || '.csv' AS name, count(*) + 3 AS n_lines, count(*) + 1 AS n_last, count(*) FILTER (p_partkey % 7 = 0) + 1 AS n_wide,
       CAST(3 + count(*) AS BIGINT) AS last_line FROM part GROUP BY p_brand""")
def spec_files(spark, sf_dir):
    """Specification files: quoted cells may hold commas, quotes and line breaks; files of other names are passed over."""
    folder = new_folder(spark, "specs")
    texts = spec_texts(spark, sf_dir)
    writers.write_files(texts.unionByName(texts.select(F.replace("name", F.lit("T_"), F.lit("X_")).alias("name"), "value")), folder)
    lines = readers.table_files(spark, folder)
    last = F.element_at("cells", -1) == 'a\r\n"b", c'
    found = lines.groupBy(F.regexp_extract("file", r"([^/]+)$", 1).alias("name"))
    return found.agg(F.count("*").alias("n_lines"), F.count_if(last).alias("n_last"), F.count_if(F.size("cells") > 6).alias("n_wide"), F.max("line_no").alias("last_line"))


@query("""SELECT 'p' || p_partkey AS field, upper(replace(p_brand, '#', '_')) AS "table", CAST(p_size AS VARCHAR) AS length FROM part""")
def spec_file_fields(spark, sf_dir):
    """Files of one table each, named by the file, through to their fields."""
    folder = new_folder(spark, "specs")
    writers.write_files(spec_texts(spark, sf_dir), folder)
    found = pipeline.mine(readers.table_files(spark, folder).where("line_no > 2"), single_tables=True).fields
    return found.select("field", "table", "length")


@query(f"""
SELECT '<{BASE}Customer_' || c_custkey || '> <{RDF}> <{BASE}CUSTOMER> .' AS value FROM customer UNION ALL
SELECT '<{BASE}Customer_' || c_custkey || '> <{BASE}C_CUSTKEY> "' || c_custkey || '"^^<{XSD}integer> .' FROM customer UNION ALL
SELECT '<{BASE}Customer_' || c_custkey || '> <{BASE}NOTE> "' || c_name || '\\n\\"' || c_mktsegment || '\\"\\\\" .' FROM customer""")
def triples_file(spark, sf_dir):
    """Triples as a file of statements: what a literal may not hold is written as it wants."""
    path, note = new_folder(spark, "triples"), F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('"\\'))
    schema = TableSchema("Customer", [Field("c_custkey", "integer"), Field("note")], ["c_custkey"])
    writers.write_triples(triples.abox(table(spark, sf_dir, "customer").withColumn("note", note), schema), path)
    return spark.read.text(path)


@query("""
SELECT upper(p_brand) AS "table", count(*) AS n_fields, count(*) FILTER (p_partkey % 2 = 0) AS n_integers, min_by('p' || p_partkey, p_partkey) AS first_field, max_by('p' || p_partkey, p_partkey) AS last_field FROM part GROUP BY ALL""")
def schema_files(spark, sf_dir):
    """Mined fields as one document per table, in a folder of the table's name, fields in line order."""
    path = new_folder(spark, "schemas")
    writers.write_schema_documents(pipeline.mine(spec_lines(spark, sf_dir).where(f"line_no < {1 << 40}")).fields, path)
    fields = F.from_json("value", "table string, fields array<struct<name: string, type: string>>")["fields"]
    rows = spark.read.option("basePath", path).text(path).select("table", fields.alias("fields"))
    integers = F.filter("fields", lambda f: f["type"] == "integer")
    return rows.select("table", F.size("fields").cast("long").alias("n_fields"), F.size(integers).cast("long").alias("n_integers"), F.element_at("fields", 1)["name"].alias("first_field"), F.element_at("fields", -1)["name"].alias("last_field"))


@query("""SELECT upper(p_brand) AS "table", 'id|tienda' AS primary_key, 'a|b y c' AS unique_fields, count(*) FILTER (p_partkey % 5 = 3) + 3 AS n_notes FROM part GROUP BY p_brand""")
def metadata_file(spark, sf_dir):
    """What notes say of keys, written and read."""
    path = new_folder(spark, "metadata")
    writers.write_metadata(pipeline.mine(spec_lines(spark, sf_dir)).metadata, path)
    df = spark.read.json(path)
    return df.select("table", F.array_join("primary_key", "|").alias("primary_key"), F.array_join("unique_fields", "|").alias("unique_fields"), F.size("notes").cast("long").alias("n_notes"))


# Configuration files


def schema_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a schema file per brand, whose fields are its kinds of parts, and files that are no schemas."""
    folder = new_folder(spark, "yaml")
    kinds = table(spark, sf_dir, "part").select(F.replace("p_brand", F.lit("#"), F.lit("_")).alias("brand"), "p_type").distinct()
    line = F.concat(F.lit("  - {name: '"), "p_type", F.lit("', type: integer, required: 'sí', length: 9}"))
    texts = kinds.groupBy("brand").agg(F.concat_ws("\n", F.lit("fields:"), F.array_sort(F.collect_list(line))).alias("value"))
    files = texts.select(F.concat("brand", F.lit(".yaml")).alias("name"), "value")
    other = texts.select(F.concat(F.lit("x_"), "brand", F.lit(".yml")).alias("name"), F.lit("just: [a, list]").alias("value"))
    broken = texts.select(F.concat(F.lit("y_"), "brand", F.lit(".yaml")).alias("name"), F.lit("a: [").alias("value"))
    notes = texts.select(F.concat(F.lit("metadatos_"), "brand", F.lit(".yaml")).alias("name"), "value")
    writers.write_files(files.unionByName(other).unionByName(broken).unionByName(notes), folder)
    return folder


@query(f"""
WITH f AS (SELECT DISTINCT upper(replace(p_brand, '#', '_')) AS t, replace(url_encode(upper(p_type)), '+', '%20') AS f FROM part)
SELECT '{BASE}' || t AS s, '{RDF}' AS p, '{OWL}Class' AS o FROM f UNION SELECT '{BASE}' || f, '{RDF}', '{OWL}DatatypeProperty' FROM f
UNION SELECT '{BASE}' || f, '{RDFS}domain', '{BASE}' || t FROM f UNION SELECT '{BASE}' || f, '{RDFS}range', '{XSD}integer' FROM f""")
def tbox_of_folder(spark, sf_dir):
    """The schema graph of all readable schema files of a folder; others are skipped, and told."""
    schemas, _ = config.load_schemas(schema_folder(spark, sf_dir), spark)
    return triples.tbox(triples.schema_fields(spark, schemas)).select("s", "p", "o")


@query("""
WITH b AS (SELECT DISTINCT replace(p_brand, '#', '_') AS b FROM part)
SELECT 'x_' || b || '.yml' AS file, 'layout not recognised' AS problem FROM b UNION ALL SELECT 'y_' || b || '.yaml', 'not YAML' FROM b""")
def skipped_files(spark, sf_dir):
    """The files of a folder that give no schema, and why."""
    _, errors = config.load_schemas(schema_folder(spark, sf_dir), spark)
    rows = [(name, text if text == "layout not recognised" else "not YAML") for name, text in errors.items()]
    return spark.createDataFrame(rows, "file string, problem string")


# Compositions


@query(f"""
WITH c AS (SELECT '<{BASE}Nations_' || row_number() OVER (ORDER BY n_name) || '> ' AS s, * FROM nation)
SELECT s || '<{RDF}> <{BASE}NATIONS> .' AS value FROM c UNION ALL
SELECT s || '<{BASE}N_NATIONKEY> "' || n_nationkey || '"^^<{XSD}integer> .' FROM c UNION ALL
SELECT s || '<{BASE}N_NAME> "' || n_name || '" .' FROM c UNION ALL
SELECT unnest(['<{BASE}NATIONS> <{RDF}> <{OWL}Class> .', '<{BASE}N_NATIONKEY> <{RDF}> <{OWL}DatatypeProperty> .', '<{BASE}N_NAME> <{RDF}> <{OWL}DatatypeProperty> .',
  '<{BASE}N_NATIONKEY> <{RDFS}domain> <{BASE}NATIONS> .', '<{BASE}N_NAME> <{RDFS}domain> <{BASE}NATIONS> .', '<{BASE}N_NATIONKEY> <{RDFS}range> <{XSD}integer> .'])""")
def csv_to_triples(spark, sf_dir):
    """A CSV file through its schema file to statements; without a key rows are numbered in a given order."""
    folder = new_folder(spark, "e1")
    writers.write_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), f"{folder}/nations.csv")
    schema = "table: Nations\nfields:\n  - {name: n_nationkey, type: integer, required: true}\n  - {name: n_name, type: string}\n"
    writers.write_files(spark.createDataFrame([("nations.yaml", schema)], "name string, value string"), f"{folder}/schemas")
    pipeline.csv_to_triples(spark, f"{folder}/schemas/nations.yaml", f"{folder}/nations.csv", f"{folder}/out", schema_folder=f"{folder}/schemas", order_by=["n_name"])
    return spark.read.text(f"{folder}/out")


@query("""
WITH g AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 3 THEN '' ELSE c_name END AS name, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer)
SELECT * FROM (
  SELECT 'empty' AS what, 'name' AS path, '' AS "constraint", count(*) FILTER (name = '') AS n FROM g UNION ALL SELECT 'empty', 'segment', '', count(*) FILTER (segment IS NULL) FROM g UNION ALL
  SELECT 'broken', 'segment', 'minCount', count(*) FILTER (segment IS NULL) FROM g UNION ALL SELECT 'broken', 'name', 'maxLength', count(*) FILTER (length(name) > 12) FROM g UNION ALL
  SELECT 'step', 'id', 'generated', count(*) FROM g UNION ALL SELECT 'step', 'name', 'generated', count(*) FROM g UNION ALL SELECT 'step', 'segment', 'generated', count(*) FROM g UNION ALL SELECT 'step', 'cents', 'generated', count(*) FROM g) WHERE n > 0""")
def transform_and_validate(spark, sf_dir):
    """Steps, then the empty required columns and the broken constraints of what they make."""
    steps = [Step("id", "c_custkey"), Step("name", "c_name"), Step("segment", "c_mktsegment"), formula("cents", "c_acctbal * 100")]
    schema = TableSchema("C", [Field("id", "integer", True), Field("name", required=True, length=12), Field("segment", required=True), Field("cents", "float")])
    done = pipeline.transform_and_validate(gappy_customers(spark, sf_dir), steps, schema)
    empty = done.empty.select(F.lit("empty").alias("what"), F.col("column_name").alias("path"), F.lit("").alias("constraint"), F.col("n_empty").alias("n"))
    broken = done.validation.summary.select(F.lit("broken").alias("what"), "path", "constraint", "n")
    told = done.steps.report().crossJoin(done.steps.df.agg(F.count("*").alias("n")))  # one row of counts
    return empty.unionByName(broken).unionByName(told.select(F.lit("step").alias("what"), F.col("column").alias("path"), F.col("status").alias("constraint"), "n"))


@query(f"""
SELECT '{BASE}Nation_' || n_name AS s, '{RDF}' AS p, '{BASE}NATION' AS o FROM nation UNION ALL SELECT '{BASE}Nation_' || n_name, '{BASE}N_NATIONKEY', CAST(n_nationkey AS VARCHAR) FROM nation
UNION ALL SELECT '{BASE}Nation_' || n_name, '{BASE}N_NAME', n_name FROM nation UNION ALL
SELECT '{BASE}' || x[1], '{RDFS}' || x[2], x[3] FROM (SELECT unnest([['N_NATIONKEY', 'domain', '{BASE}NATION'], ['N_NAME', 'domain', '{BASE}NATION'], ['N_NATIONKEY', 'range', '{XSD}integer']]) AS x) UNION ALL
SELECT '{BASE}' || x[1], '{RDF}', '{OWL}' || x[2] FROM (SELECT unnest([['NATION', 'Class'], ['N_NATIONKEY', 'DatatypeProperty'], ['N_NAME', 'DatatypeProperty']]) AS x)""")
def table_to_triples(spark, sf_dir):
    """The graph of a table and its schema, found consistent before anything is given."""
    return pipeline.table_to_triples(table(spark, sf_dir, "nation"), NATION, [NATION]).select("s", "p", "o")


@query("""
SELECT 'sections' AS mode, upper(p_brand) AS "table", count(*) AS n_fields, CAST(2 AS BIGINT) AS n_keys FROM part GROUP BY p_brand UNION ALL
SELECT 'files', upper(p_brand), count(*), count(*) FILTER (p_partkey % 3 = 0) FROM part GROUP BY p_brand""")
def mined_modes(spark, sf_dir):
    """Both ways of mining: files with a section per table, whose notes name keys, and files of one table, keyed by their required fields."""
    lines = spec_lines(spark, sf_dir)
    sections = pipeline.mine(lines)
    fields = pipeline.mine(lines.where(f"line_no < {1 << 40}")).fields.groupBy("table").agg(F.count("*").alias("n_fields"))
    one = fields.join(sections.metadata.select("table", F.size("primary_key").cast("long").alias("n_keys")), "table").withColumn("mode", F.lit("sections"))
    single = lines.where(f"line_no > 2 AND line_no < {1 << 40}").withColumn("file", F.concat(F.lit("/in/T_"), "file", F.lit(".csv")))
    found = pipeline.mine(single, single_tables=True).metadata
    other = found.select(F.lit("files").alias("mode"), "table", F.size("fields").cast("long").alias("n_fields"), F.size("primary_key").cast("long").alias("n_keys"))
    return one.select("mode", "table", "n_fields", "n_keys").unionByName(other)
