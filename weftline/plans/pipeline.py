"""Compositions: table to triples, transform and validate, specification to schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.iri import BASE
from ..operators import entail, numbering, quality, shapes, specmine, triples
from ..operators.steps import StepResult, apply_steps
from ..sources import readers, writers
from .config import Step, TableSchema, load_schema, load_schemas


class Inconsistent(ValueError):
    """The triples contradict the declared ranges."""


def table_to_triples(df: DataFrame, schema: TableSchema, schemas: Iterable[TableSchema], *, base: str = BASE, row_id: str | None = None, check: bool = True, numbered: bool = False) -> DataFrame:
    """The graph of a table and of all declared schemas; with check, raises Inconsistent before anything is written.

    Where each subject is of one row, which one narrow count of subjects tells, and each field has a property of
    its own, the triples are a set as they are, none is one of the schemas', and no triple is shuffled. numbered:
    no two rows have the same row_id, so that without key columns nothing need be counted.
    """
    tbox = triples.tbox(triples.schema_fields(df.sparkSession, schemas), base)
    abox = triples.abox(df, schema, base, row_id=row_id)
    if check and not entail.consistent(abox, tbox):
        raise Inconsistent("literals outside their properties' ranges; see entail.inconsistencies()")
    properties = [triples.property_iri(f.name, base) for f in schema.fields if f.name in df.columns]
    by_number = numbered and row_id is not None and not any(k in df.columns for k in schema.primary_key)
    unique = len(set(properties)) == len(properties) and (by_number or triples.subjects_are_unique(df, triples.subject(df, schema, base, row_id=row_id)))
    return triples.graph_union(tbox, abox, disjoint=unique)


def csv_to_triples(spark, schema_path: str, csv_path: str, output: str, *, schema_folder: str, order_by: list[str] | None = None, check: bool = True) -> None:
    """A CSV file through its schema to a folder of N-Triples; rows are numbered as they stand in it, or as order_by says."""
    schema = load_schema(schema_path, spark)
    if schema is None:
        raise ValueError(f"{schema_path}: layout not recognised")
    df = readers.read_csv(spark, csv_path)
    df = numbering.with_row_number(df, order_by) if order_by else numbering.with_file_order(df)
    graph = table_to_triples(df, schema, load_schemas(schema_folder, spark)[0], row_id="row_id", check=check, numbered=True)
    writers.write_triples(graph, output)


@dataclass
class Outcome:
    steps: StepResult
    empty: DataFrame
    validation: shapes.ValidationResult


def transform_and_validate(df: DataFrame, steps: Iterable[Step], schema: TableSchema, **options) -> Outcome:
    """The steps' table, its empty required columns and its broken constraints."""
    done = apply_steps(df, steps, **options)
    return Outcome(done, quality.required_empty(done.df, schema), shapes.validate(done.df, schema))


@dataclass
class Export:
    """The steps' result, and what was counted while it was written: (what, path, constraint, n), and all rows."""

    steps: StepResult
    report: DataFrame
    n_rows: int


def export_with_report(df: DataFrame, steps: Iterable[Step], schema: TableSchema, write: Callable[[DataFrame], None], **options) -> Export:
    """Writes the steps' table and reports its empty required columns and broken constraints, in one pass.

    The counts are observed on the rows as they are written, so the table is neither read nor computed again.
    """
    done = apply_steps(df, steps, **options)
    names = [f.name for f in schema.fields if f.required and f.name in done.df.columns]
    rules = shapes.constraints(done.df, schema)
    told = [("empty", n, "", quality.is_empty(numbering.name_of(n))) for n in names] + [("broken", r.path, r.kind, r.broken) for r in rules]
    seen = Observation()
    counted = done.df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.coalesce(broken, F.lit(False))).alias(f"c{i}") for i, (*_, broken) in enumerate(told)))
    write(counted)
    counts = seen.get
    sums: dict[tuple, int] = {}
    for i, (what, path, constraint, _) in enumerate(told):
        sums[what, path, constraint] = sums.get((what, path, constraint), 0) + counts[f"c{i}"]
    rows = [(*key, n) for key, n in sums.items() if n]
    return Export(done, df.sparkSession.createDataFrame(rows, "what string, path string, constraint string, n long"), counts["n_rows"])


@dataclass
class Mined:
    fields: DataFrame
    metadata: DataFrame


def mine(lines: DataFrame, single_tables: bool = False) -> Mined:
    """Schemas and metadata of specification lines; single_tables for files of one table each."""
    if single_tables:
        fields = specmine.enriched(specmine.single_table_fields(lines))
        return Mined(fields, specmine.required_keys(fields))
    return Mined(specmine.enriched(specmine.spec_fields(lines)), specmine.metadata(lines))
