"""Sinks for tables, triples and mined schemas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_files(files: DataFrame, folder: str) -> None:
    """One file per row (name, value), each written by the task that has the row."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_output_stream(f"{inner}/{name}", compression=None) as out:
                    out.write((value or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])

    files.select("name", "value").mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def escaped(text: Column) -> Column:
    """A literal's text as N-Triples wants it."""
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def triple_lines(triples: DataFrame) -> DataFrame:
    """(value): one N-Triples statement per triple, which is Turtle too; null literals are left out."""
    iri = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    kind = F.when(F.col("datatype").isNotNull(), F.concat(F.lit("^^"), iri(F.col("datatype")))).otherwise("")
    value = F.when(F.col("o_kind") == "iri", iri(F.col("o"))).otherwise(F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'), kind))
    return triples.where(F.col("o").isNotNull()).select(F.concat(iri(F.col("s")), F.lit(" "), iri(F.col("p")), F.lit(" "), value, F.lit(" .")).alias("value"))


def write_triples(triples: DataFrame, path: str, compression: str = "gzip") -> None:
    """A folder of N-Triples; statements repeat their names, so that compressed ones take a small part of the room."""
    triple_lines(triples).write.options(**{"compression": compression, "zlib.compress.level": "BEST_SPEED"}).text(path)


#: Names of mined columns as schema files spell them; other columns keep theirs.
SPELLED = {"field": "name", "kind": "type"}


def schema_documents(fields: DataFrame) -> DataFrame:
    """(table, document): the mined fields of each table, in line order, as a JSON document that load_schema() reads."""
    names = [c for c in fields.columns if c not in ("file", "table", "line_no", "cells")]
    row = F.struct("line_no", F.struct(*(F.col(c).alias(SPELLED.get(c, c)) for c in names)).alias("field"))
    rows = fields.groupBy("table").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return rows.select("table", F.to_json(F.struct("table", F.transform("rows", lambda r: r["field"]).alias("fields"))).alias("document"))


def write_schema_documents(fields: DataFrame, path: str) -> None:
    """One JSON document per table, in a folder of the table's name."""
    schema_documents(fields).write.partitionBy("table").text(path)


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata.write.json(path)
