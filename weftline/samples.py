"""Tables and schemas that several queries share, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.config import Field, TableSchema
from .registry import table

CUSTOMER = TableSchema("Customer", [Field("c_custkey", "integer", True), Field("c_name", required=True, length=12), Field("c_mktsegment", required=True, enum=["BUILDING", "MACHINERY", "HOUSEHOLD"]), Field("c_acctbal", "float")], ["c_custkey"])


def gappy_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with nulls and empty texts where the table has none."""
    df = table(spark, sf_dir, "customer")
    return df.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING"))).withColumn("c_name", F.when(F.col("c_custkey") % 10 == 3, "").otherwise(F.col("c_name")))


GAPPY = "SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN '' ELSE c_name END AS c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer"

ORDERS = TableSchema("Orders", [Field("o_orderkey", "integer", True), Field("o_custkey", "integer"), Field("o_orderstatus"), Field("o_orderdate", "date"), Field("open", "boolean")], ["o_orderkey"])
NATION = TableSchema("Nation", [Field("n_nationkey", "integer", True), Field("n_name")], ["n_name"])


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    return df.withColumn("open", F.col("o_orderstatus") == "O").withColumn("o_custkey", F.nullif("o_custkey", F.lit(7).cast("long")))

DESCRIPTIONS = ["Sólo SI/NO", "M= Mujer, H= Hombre", "Valores posibles: [A, B]", "Deprecado", "Ver Clientes.id"]


def spec_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title, a header, a field row per part and two notes; a stray line comes before the header."""
    parts = table(spark, sf_dir, "part")
    described = F.element_at(F.array(*(F.lit(d) for d in DESCRIPTIONS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    row = F.array(
        F.concat(F.lit(" p"), "p_partkey"), F.when(F.col("p_partkey") % 2 == 0, "Numérico").otherwise("Alfanumérico"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "Sí").otherwise("No"), described
    )
    # The overflow of every seventh row belongs to its last cell.
    row = F.when(F.col("p_partkey") % 7 == 0, F.concat(row, F.array(F.lit("x"), F.lit("y")))).otherwise(row)
    fields = parts.select(F.col("p_brand").alias("file"), (F.col("p_partkey") + 10).alias("line_no"), row.alias("cells"))
    brands = parts.select(F.col("p_brand").alias("file")).distinct()
    fixed = F.array(
        F.struct(F.lit(1).cast("long").alias("line_no"), F.array(F.concat(F.lit("1. Parts (T_"), F.col("file"), F.lit(".csv)")), F.lit("")).alias("cells")),
        F.struct(F.lit(2).cast("long").alias("line_no"), F.array(F.lit("stray")).alias("cells")),
        F.struct(F.lit(3).cast("long").alias("line_no"), F.array(*(F.lit(x) for x in ("Campo", "Tipo", "Longitud", "Obligatorio", "Descripción", "Formato"))).alias("cells")),
        F.struct(F.lit(1 << 40).cast("long").alias("line_no"), F.array(F.lit("La clave está compuesta por id + tienda")).alias("cells")),
        F.struct(F.lit((1 << 40) + 1).cast("long").alias("line_no"), F.array(F.lit("a"), F.lit(" b y c deben ser UNIQUE")).alias("cells")),
    )
    return fields.unionByName(brands.select("file", F.inline(fixed)))
