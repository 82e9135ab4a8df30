"""Table and specification sources."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.contract import parsed_date
from ..operators.numbering import name_of, with_file_order
from ..plans.config import Contract, TableSchema, schemas_of, whole_number

SUFFIXES = r"(?i)(_sample|_muestra|_datos|_data)+$"


#: The column that holds the text of a record whose cells aren't as many as the columns, and a cell put after its last.
RECORD, END = "__record", "\x01end\x01"


def csv_records(spark: SparkSession, path: str, header: bool, infer: bool, options: dict) -> tuple[DataFrame, Column]:
    """The records of a CSV file or folder with the column RECORD, and what is wrong with each (null where nothing is).

    A record is wrong if it has more cells than there are columns; one with fewer ends in nulls. A quote that
    isn't closed takes the rest of its file into its cell, and is told where cells are missing then. Spark marks
    records of another number of cells: only those are looked at again, with END behind them, which is among the
    first cells exactly where none is too many and no quote is open.
    """
    given = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": True, "recursiveFileLookup": True} | options
    first = spark.read.options(**given).csv(path, header=header, inferSchema=infer)
    if not first.columns or first.isEmpty():
        raise ValueError(f"{path} has no rows")
    schema = T.StructType([*first.schema.fields, T.StructField(RECORD, T.StringType())])
    df = spark.read.options(**given, columnNameOfCorruptRecord=RECORD).schema(schema).csv(path, header=header)
    n, sep, quote = len(first.columns), given.get("sep", given.get("delimiter", ",")), given["quote"]
    text = F.regexp_replace(RECORD, r"[\r\n]+$", "")
    cells = F.from_csv(F.concat(text, F.lit(sep + END)), F.lit(", ".join(f"c{i} string" for i in range(n + 1))), {"sep": sep, "quote": quote, "escape": given["escape"]})
    fits = F.array_contains(F.array(*(cells[f"c{i}"] for i in range(n + 1))), END)
    quotes = F.length(text) - F.length(F.replace(text, F.lit(quote), F.lit("")))
    wrong = F.when(F.col(RECORD).isNotNull() & ~F.coalesce(fits, F.lit(False)), F.when(quotes % 2 == 1, "quote not closed").otherwise("too many cells"))
    return df, wrong


def named(df: DataFrame, n: int, header: bool, null_tokens: list[str] | None) -> DataFrame:
    """The first n columns named 0, 1, ... without a header; certain words in them as nulls."""
    names = df.columns[:n]
    if not header:
        df = df.toDF(*(str(i) for i in range(n)), *df.columns[n:])
        names = df.columns[:n]
    if null_tokens:
        texts = {n for n, t in df.dtypes if t == "string"}
        df = df.withColumns({c: F.when(~name_of(c).isin(null_tokens), name_of(c)) for c in names if c in texts})
    return df


def read_csv(spark: SparkSession, path: str, *, header: bool = True, infer: bool = False, null_tokens: list[str] | None = None, **options) -> DataFrame:
    """A CSV file or folder as texts, or with inferred types; ValueError if it has no columns or no rows.

    Texts are the default because inference turns codes such as `001` into numbers. Without a header the
    columns are named 0, 1, ...; null_tokens are read as nulls in every text column. The names of nested folders
    give no columns. Quoted cells may hold line
    breaks, so that one task reads a file; multiLine=False splits large files that have none. A record with too
    many cells, or one that ends in an open quote, fails the job that reads it; read_csv_checked() gives it.
    """
    df, wrong = csv_records(spark, path, header, infer, options)
    # A column beside RECORD must be read, or Spark refuses to count.
    told = F.raise_error(F.concat_ws(": ", F.lit(path), wrong, RECORD, name_of(df.columns[0]).cast("string"))).cast("boolean")
    return named(df.where(F.when(wrong.isNotNull(), told).otherwise(True)).drop(RECORD), len(df.columns) - 1, header, null_tokens)


@dataclass
class CheckedRead:
    """What a source holds: its good rows with their numbers (row_id), and (file, record, reason, text) of the others.

    Records are numbered from 1 in each file, the header aside; rows and rejects together are all of them.
    """

    rows: DataFrame
    rejects: DataFrame


def read_csv_checked(spark: SparkSession, path: str, *, header: bool = True, infer: bool = False, null_tokens: list[str] | None = None, row_id: str = "row_id", **options) -> CheckedRead:
    """As read_csv, parsed once and stored: wrong records are given as a table instead of failing the job.

    row_id: the place of a row among all records, in the order of the files and of the records in each.
    """
    df, wrong = csv_records(spark, path, header, infer, options)
    placed = with_file_order(df.withColumn("__wrong", wrong), row_id, file_col="__file")
    firsts = placed.groupBy("__file").agg(F.min(row_id).alias("__first"))
    bad = placed.where("__wrong IS NOT NULL").join(firsts, "__file")
    rejects = bad.select(F.col("__file").alias("file"), (name_of(row_id) - F.col("__first") + 1).alias("record"), F.col("__wrong").alias("reason"), F.col(RECORD).alias("text"))
    rows = placed.where("__wrong IS NULL").drop("__wrong", "__file", RECORD)
    return CheckedRead(named(rows, len(df.columns) - 1, header, null_tokens), rejects)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def typed(df: DataFrame, schema: TableSchema, *, decimal: str = ".", date_formats: list[str] | None = None) -> DataFrame:
    """The columns cast to the schema's types; values that don't fit become null, other columns stay."""
    columns = []
    for c in df.columns:
        f, text = schema.field(c), name_of(c)
        if f is None or f.kind == "string":
            columns.append(text)
        elif f.kind in ("integer", "float", "decimal"):
            clean = F.replace(text.cast("string"), F.lit(decimal), F.lit(".")) if decimal != "." else text
            columns.append(clean.try_cast(f.spark_type).alias(c))
        elif f.kind in ("date", "datetime") and (formats := [*([f.format] if f.format else []), *(date_formats or [])]):
            columns.append(F.coalesce(parsed_date(text.cast("string"), formats), text.try_cast("timestamp")).alias(c))
        else:
            columns.append(text.try_cast(f.spark_type).alias(c))
    return df.select(*columns)


def contract_options(contract: Contract) -> dict:
    """The contract's CSV options as Spark's."""
    given = contract.options.get("csv_options") or {}
    words = {"delimiter": "sep", "quotechar": "quote", "encoding": "encoding", "comment": "comment", "multiLine": "multiLine"}
    return {word: given[k] for k, word in words.items() if given.get(k) not in (None, "")}


def contract_typed(df: DataFrame, contract: Contract, schema: TableSchema) -> DataFrame:
    decimal = (contract.options.get("csv_options") or {}).get("decimal", ".")
    return typed(df, schema, decimal=decimal, date_formats=contract.options.get("date_formats"))


def read_contract(spark: SparkSession, contract: Contract, folder: str, cast: bool = True) -> dict[str, DataFrame]:
    """The contract's tables by name, read with its CSV options; wrong records fail the job that reads them."""
    found = {}
    for table in contract.tables:
        df = read_csv(spark, f"{folder.rstrip('/')}/{table.file}", **contract_options(contract))
        found[table.schema.name] = contract_typed(df, contract, table.schema) if cast else df
    return found


def read_contract_checked(spark: SparkSession, contract: Contract, folder: str, cast: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """The contract's tables by name, with row_id, and (table, file, record, reason, text) of the wrong records of all."""
    found, rejects = {}, spark.createDataFrame([], "table string, file string, record long, reason string, text string")
    for table in contract.tables:
        read = read_csv_checked(spark, f"{folder.rstrip('/')}/{table.file}", **contract_options(contract))
        found[table.schema.name] = contract_typed(read.rows, contract, table.schema) if cast else read.rows
        rejects = rejects.unionByName(read.rejects.withColumn("table", F.lit(table.schema.name)))
    return found, rejects


#: What read_schema_fields() gives of a field.
FIELD_ROW = pa.schema([
    ("file", pa.string()), ("table", pa.string()), ("place", pa.int64()), ("field", pa.string()), ("kind", pa.string()), ("required", pa.bool_()), ("length", pa.int64()), ("precision", pa.int64()), ("scale", pa.int64()),
    ("format", pa.string()), ("enum", pa.list_(pa.string())), ("foreign_key", pa.string()), ("deprecated", pa.bool_()), ("error", pa.string()),
])
FIELD_DDL = "file string, table string, place long, field string, kind string, required boolean, length long, precision long, scale long, format string, enum array<string>, foreign_key string, deprecated boolean, error string"
#: So many fields make a batch.
FIELDS_PER_BATCH = 10_000


def field_rows(name: str, text: str) -> Iterator[tuple]:
    """The rows of FIELD_ROW of one schema file."""
    schemas, error = schemas_of(name, text)
    for s in schemas:
        for at, f in enumerate(s.fields):
            yield name, s.name, at, f.name, f.kind, f.required, f.length, whole_number(f.precision), whole_number(f.scale), f.format, f.enum, f.foreign_key, f.deprecated, None
    if error is not None:
        yield name, *[None] * (len(FIELD_ROW) - 2), error


def read_schema_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The fields that a folder's schema files declare, a row each, in the order `place` of their table; a file without any schema gives its error.

    Files are parsed where they are read, one at a time in a task, so that many or long ones never meet on the
    driver; config.load_schemas() gives the few that jobs are configured by as objects.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                found = field_rows(name.as_py(), text.as_py())
                while part := list(islice(found, FIELDS_PER_BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part, strict=True), FIELD_ROW, strict=True)], schema=FIELD_ROW)

    files = spark.read.text(folder, wholetext=True).select("_metadata.file_name", "value")
    return files.where("file_name LIKE '%.yaml' OR file_name LIKE '%.yml'").mapInArrow(parse, FIELD_DDL)


def match_schemas(files: DataFrame, schemas: DataFrame, file_col: str = "path", schema_col: str = "schema") -> DataFrame:
    """Files with the schema of the same stem, suffixes such as `_sample` and case aside; null where none fits."""
    stem = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(file_col, r"([^/\\]+)$", 1), r"\.[^.]*$", ""), SUFFIXES, ""))
    names = schemas.select(F.col(schema_col).alias("matched"), F.lower(F.regexp_replace(schema_col, r"\.[^.]*$", "")).alias("__stem"))
    return files.withColumn("__stem", stem).join(names, "__stem", "left").drop("__stem")


def table_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, line_no, cells) of all `T_*.csv` files of a folder, whatever their case."""
    lines = spec_lines(spark, folder, glob="*.[cC][sS][vV]")
    return lines.where(F.upper(F.regexp_extract("file", r"([^/]+)$", 1)).startswith("T_"))


def spec_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, line_no, cells) of specification files; quoted cells may hold commas and line breaks.

    line_no counts the records of a file: a file is read as one row, which a specification's size allows.
    """
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    texts = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    # A cell is quoted or runs to the next comma or line break.
    cell = r'(?:[ \t]*+"(?:[^"]++|"")*+"[ \t]*+(?=[,\r\n]|\z)|[^,\r\n]*+)'
    records = F.regexp_extract_all(F.concat(F.lit("\n"), F.regexp_replace("value", r"\r?\n\z", "")), F.lit(rf"\r?\n({cell}(?:,{cell})*+)"), F.lit(1))
    rows = texts.select("file", F.posexplode(records).alias("place", "line"))
    cells = F.regexp_extract_all(F.concat(F.lit(","), "line"), F.lit(f",({cell})"), F.lit(1))
    plain = F.transform(cells, lambda c: F.when(F.trim(c).rlike(r'(?s)^".*"$'), F.replace(F.regexp_extract(F.trim(c), r'(?s)^"(.*)"$', 1), F.lit('""'), F.lit('"'))).otherwise(c))
    return rows.select("file", (F.col("place") + 1).cast("long").alias("line_no"), plain.alias("cells"))
