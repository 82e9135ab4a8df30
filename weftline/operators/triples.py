"""Tables and schemas as triples (s, p, o, o_kind, datatype).

o_kind is `iri` or `literal`; datatype is null for IRIs and plain literals. A graph is a set of triples, so a
union of graphs ends in distinct() unless its parts are known to be sets that don't meet.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.iri import BASE, iri, python_token, token
from ..plans.config import Field, TableSchema
from ..sources.shared import new_folder
from .numbering import name_of
from .quality import dealt_set, estimated, merged_statistics, with_sketches

# The vocabularies' IRIs.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
RANGES = {"integer": XSD + "integer", "float": XSD + "float", "boolean": XSD + "boolean", "date": XSD + "dateTime"}
TRIPLE = "s string, p string, o string, o_kind string, datatype string"
#: Above so many fields one row's array of triples is built in several parts.
FIELDS_PER_PART = 100


def class_iri(name: str, base: str = BASE, first_token: bool = False) -> str:
    return base + python_token(name.upper(), first_token)


def property_iri(name: str, base: str = BASE, first_token: bool = False) -> str:
    return base + python_token(name.upper(), first_token)


def schema_fields(spark: SparkSession, schemas: Iterable[TableSchema]) -> DataFrame:
    """(table, field, kind): the declared columns as a table, as small as the configuration."""
    rows = [(s.name, f.name, f.kind) for s in schemas for f in s.fields]
    return spark.createDataFrame(rows, "table string, field string, kind string")


def tbox(fields: DataFrame, base: str = BASE, first_token: bool = False) -> DataFrame:
    """Class, property, domain and range triples of declared columns (table, field, kind)."""
    cls, prop = iri(F.upper("table"), base, first_token), iri(F.upper("field"), base, first_token)
    ranges = F.create_map(*(F.lit(x) for pair in RANGES.items() for x in pair))
    made = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), (F.lit(o) if isinstance(o, str) else o).alias("o"))
    parts = F.array(
        made(cls, RDF_TYPE, OWL + "Class"),
        made(prop, RDF_TYPE, OWL + "DatatypeProperty"),
        made(prop, RDFS + "domain", cls),
        made(prop, RDFS + "range", F.try_element_at(ranges, F.col("kind"))),
    )
    rows = fields.select(F.inline(parts)).where(F.col("s").isNotNull() & F.col("o").isNotNull())
    return rows.select("s", "p", "o", F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("datatype")).distinct()


def subject(df: DataFrame, schema: TableSchema, base: str = BASE, *, row_id: str | None = None, first_token: bool = False, null_key: str | None = None) -> Column:
    """The subject's IRI: table and key values; the row number where there is no key or it is blank.

    A null in a key gives null_key, else counts as blank text. Without a row_id column such rows have a null
    subject.
    """
    name = token(F.lit(schema.name), first_token)
    keys = [k for k in schema.primary_key if k in df.columns]
    number = F.concat_ws("_", name, name_of(row_id).cast("string")) if row_id else F.lit(None).cast("string")
    if not keys:
        return F.concat(F.lit(base), number)
    parts = [F.coalesce(name_of(k).cast("string"), F.lit(null_key or "")) for k in keys]
    key = token(F.concat_ws("-", *parts), first_token)
    blank = F.concat(*parts) == ""
    return F.concat(F.lit(base), F.when(~blank & key.isNotNull(), F.concat(name, F.lit("_"), key)).otherwise(number))


def date_text(text: Column) -> Column:
    """A bare date gets midnight as its time."""
    bare = (F.length(text) == 10) & (F.length(F.replace(text, F.lit("-"), F.lit(""))) == 8)
    return F.when(bare, F.concat(text, F.lit("T00:00:00"))).otherwise(text)


def literal(df: DataFrame, field: Field) -> tuple[Column, Column, str | None]:
    """Whether a value is there, its text, and its datatype."""
    c, data_type = name_of(field.name), df.schema[field.name].dataType
    there = c.isNotNull()
    if isinstance(data_type, T.FloatType | T.DoubleType):
        there = there & ~F.isnan(c)
    if field.kind in ("date", "datetime") and isinstance(data_type, T.TimestampType | T.TimestampNTZType | T.DateType):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    elif field.kind == "date":
        text = date_text(c.cast("string"))
    else:
        text = c.cast("string")
    kind = field.kind
    if kind == "string" and isinstance(data_type, T.IntegralType | T.FractionalType | T.BooleanType):
        kind = "integer" if isinstance(data_type, T.IntegralType) else "boolean" if isinstance(data_type, T.BooleanType) else "float"  # typed by value
    return there, text, RANGES.get(kind)


def abox(df: DataFrame, schema: TableSchema, base: str = BASE, *, row_id: str | None = None, first_token: bool = False, null_key: str | None = None) -> DataFrame:
    """A type triple for each row and a literal triple for each value that is there: one scan, no shuffle."""
    fields = [f for f in schema.fields if f.name in df.columns]
    s = subject(df, schema, base, row_id=row_id, first_token=first_token, null_key=null_key)
    kind = F.struct(F.lit(RDF_TYPE).alias("p"), F.lit(class_iri(schema.name, base, first_token)).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("datatype"))
    found = None
    for at in range(0, max(1, len(fields)), FIELDS_PER_PART):
        parts = [] if at else [kind]
        for f in fields[at : at + FIELDS_PER_PART]:
            there, text, datatype = literal(df, f)
            one = F.struct(F.lit(property_iri(f.name, base, first_token)).alias("p"), text.alias("o"), F.lit("literal").alias("o_kind"), F.lit(datatype).cast("string").alias("datatype"))
            parts.append(F.when(there, one))
        # The subject comes out of a generator of its own, so that it is computed once for a row, not for a triple.
        named = df.select(F.inline(F.array(F.struct(s.alias("s"), F.array(*parts).alias("parts"))))).where(F.col("s").isNotNull())
        rows = named.select("s", F.inline(F.array_compact("parts")))
        found = rows if found is None else found.unionByName(rows)
    return found


def untyped(df: DataFrame, schemas: Iterable[TableSchema], class_name: str, row_id: str, base: str = BASE) -> DataFrame:
    """The plain variant: numbered subjects, upper-cased names as they are, untyped literals, nulls kept.

    A column takes part if any of the tables declares it; its class is a triple of each row.
    """
    declared = {f.name for s in schemas for f in s.fields}
    name = class_name.upper()
    parts = [F.struct(F.lit(RDF_TYPE).alias("p"), F.lit(base + name).alias("o"), F.lit("iri").alias("o_kind"))]
    parts += [F.struct(F.lit(base + c.upper()).alias("p"), name_of(c).cast("string").alias("o"), F.lit("literal").alias("o_kind")) for c in df.columns if c in declared]
    s = F.concat(F.lit(f"{base}{name}_"), name_of(row_id).cast("string"))
    return df.select(s.alias("s"), F.inline(F.array(*parts))).withColumn("datatype", F.lit(None).cast("string"))


def untyped_schema(schemas: Iterable[TableSchema], base: str = BASE) -> list[tuple]:
    """The plain variant's classes, properties and domains: one class per schema file, upper-cased names as they are."""
    found: dict[tuple, None] = {}
    for schema in schemas:
        cls = base + schema.name.upper()
        found[cls, RDF_TYPE, OWL + "Class"] = None
        for f in schema.fields:
            found[base + f.name.upper(), RDF_TYPE, OWL + "DatatypeProperty"] = None
            found[base + f.name.upper(), RDFS + "domain", cls] = None
    return [(*triple, "iri", None) for triple in found]


def untyped_graph(df: DataFrame | None, schemas: Iterable[TableSchema], class_name: str | None = None, row_id: str = "row_id", base: str = BASE) -> DataFrame:
    """The plain variant's whole graph: its schema, and the rows of one class where a table is given.

    ValueError if no schema file gives the class. Numbered rows share no triple with each other or the schema.
    """
    schemas = list(schemas)
    if class_name is not None and class_name.upper() not in {s.name.upper() for s in schemas}:
        raise ValueError(f"no schema for {class_name}")
    rows = untyped_schema(schemas, base)
    spark = df.sparkSession if df is not None else SparkSession.active()
    graph = spark.createDataFrame(rows, TRIPLE)
    if df is None or class_name is None:
        return graph
    return graph_union(graph, untyped(df, schemas, class_name, row_id, base).select(*graph.columns), disjoint=True)


def graph_union(*graphs: DataFrame, disjoint: bool = False) -> DataFrame:
    """The set union; disjoint skips the shuffle where the parts are sets that share no triple.

    The rows are counted and dealt by subject and property, which serves what groups by these afterwards too.
    """
    found, *rest = graphs
    for g in rest:
        found = found.unionByName(g)
    return found if disjoint else dealt_set(found)


#: What tells triples apart, as one text: the kind, the datatype and the text of the object.
TERM = "concat_ws(' ', o_kind, coalesce(datatype, ''), coalesce(o, 'null'), o IS NULL)"


@dataclass
class StoredGraph:
    """A set of triples kept as a table in buckets of subject, property and object, with statistics by property.

    The tables' files are in the shared folder; their names are in the session's catalog. Each append is a further set of files of the same buckets, marked as a part of its own, so that a union shuffles only what is new. Files aren't sorted: Spark uses no order of a bucket that has several.
    """

    spark: SparkSession
    name: str

    @classmethod
    def create(cls, graph: DataFrame, name: str, buckets: int | None = None) -> StoredGraph:
        """Stores the set of a graph's triples; buckets: as many as shuffle partitions unless told."""
        spark = graph.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        keyed = graph.select("s", "p", "o", "o_kind", "datatype", F.expr(TERM).alias("term"))
        kept = cls(spark, name)
        kept.add(keyed.repartition(n, "s", "p", "term").dropDuplicates(["s", "p", "term"]), n, path=new_folder(spark, "graph"), statistics_path=new_folder(spark, "graph-statistics"))
        return kept

    def add(self, new: DataFrame, n: int, path: str | None = None, statistics_path: str | None = None) -> None:
        """Writes triples that aren't there once, as a part of the table, and their statistics; paths where tables are made."""
        part = uuid.uuid4().hex
        at = lambda p: {} if p is None else {"path": p}
        new.withColumn("part", F.lit(part)).write.mode("append").options(**at(path)).bucketBy(n, "s", "p", "term").saveAsTable(self.name)
        written = self.spark.table(self.name).where(F.col("part") == part)
        with_sketches(written).write.mode("append").options(**at(statistics_path)).saveAsTable(f"{self.name}_statistics")

    def triples(self) -> DataFrame:
        return self.spark.table(self.name).select("s", "p", "o", "o_kind", "datatype")

    def missing(self, graph: DataFrame) -> DataFrame:
        """The triples of a graph that aren't stored; the stored side is read where it lies."""
        new = graph.select("s", "p", "o", "o_kind", "datatype", F.expr(TERM).alias("term")).dropDuplicates(["s", "p", "term"])
        return new.join(self.spark.table(self.name).select("s", "p", "term").hint("merge"), ["s", "p", "term"], "left_anti")

    def append(self, graph: DataFrame) -> None:
        """Adds what is missing, and its statistics beside those of earlier parts."""
        n = next(int(r["data_type"]) for r in self.spark.sql(f"DESCRIBE EXTENDED {self.name}").collect() if r["col_name"] == "Num Buckets")
        self.add(self.missing(graph), n)

    def statistics(self) -> DataFrame:
        """(p, n_triples, n_subjects) of all parts, from what was kept with each."""
        return estimated(merged_statistics(self.spark.table(f"{self.name}_statistics")))


def subjects_are_unique(df: DataFrame, subject: Column) -> bool:
    """Whether each subject is of one row, so that abox() gives a set as it is; one narrow aggregation."""
    return df.groupBy(subject.alias("s")).agg(F.count("*").alias("n")).where(F.col("s").isNotNull() & (F.col("n") > 1)).isEmpty()
