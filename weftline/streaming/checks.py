"""The row-local operators on streams, and windowed forms of the others.

Steps without whole-table or ordered formulas, IRIs, triples and constraints are projections, so they take a
streaming DataFrame as it is. What needs many rows gets a watermark and a window here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quality import is_empty
from ..operators.shapes import constraints, violations
from ..operators.numbering import name_of
from ..plans.config import TableSchema


def timed(df: DataFrame, time_col: str, late: str) -> DataFrame:
    """The rows with a watermark; times without a zone are taken in the session's."""
    return df.withColumn(time_col, name_of(time_col).cast("timestamp")).withWatermark(time_col, late)


def violation_stream(df: DataFrame, schema: TableSchema, subject: str | None = None) -> DataFrame:
    """Broken constraints as they come."""
    return violations(df, constraints(df, schema), None if subject is None else name_of(subject))


def windowed_violations(df: DataFrame, schema: TableSchema, time_col: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, path, constraint, n) of each closed window; rows later than `late` are ignored."""
    rules = constraints(df, schema)
    parts = F.array_compact(F.array(*(F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(r.path).alias("path"), F.lit(r.kind).alias("constraint"))) for r in rules)))
    rows = timed(df, time_col, late).select(name_of(time_col).alias("time"), F.inline(parts))
    found = rows.groupBy(F.window("time", window), "path", "constraint").agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("start"), "path", "constraint", "n")


def windowed_required_empty(df: DataFrame, schema: TableSchema, time_col: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, column_name, n_empty) of the required columns, by window."""
    names = [f.name for f in schema.fields if f.required and f.name in df.columns]
    counts = timed(df, time_col, late).groupBy(F.window(time_col, window)).agg(*(F.count_if(is_empty(name_of(n))).alias(f"c{i}") for i, n in enumerate(names)))
    rows = F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(f"c{i}").alias("n_empty")) for i, n in enumerate(names)))
    return counts.select(F.col("window.start").alias("start"), F.inline(rows)).where(F.col("n_empty") > 0)


def repeated_keys(df: DataFrame, keys: list[str], time_col: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, keys, n) of keys that occur more than once within a window."""
    found = timed(df, time_col, late).groupBy(F.window(time_col, window), *(name_of(k) for k in keys)).agg(F.count("*").alias("n"))
    return found.where(F.col("n") > 1).select(F.col("window.start").alias("start"), *(name_of(k) for k in keys), "n")


def first_of_keys(df: DataFrame, keys: list[str], time_col: str, late: str = "10 minutes") -> DataFrame:
    """The rows without repeats of a key within the watermark."""
    return timed(df, time_col, late).dropDuplicatesWithinWatermark(keys)
