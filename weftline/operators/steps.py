"""The step engine: an ordered list of column steps becomes one projection, with an audit.

A mapping step copies an input column; a formula step evaluates an expression over the input's columns
(never over earlier outputs). A later step for the same output replaces the earlier one; with
overwrite=False a later mapping only fills nulls. Steps that can't be done give null and are reported as
missing; a missing input wipes the output in either mode. The result has the steps' outputs in the order of
their first mention, and as many rows as the input.

A mapping that only fills is reported as generated. With exact_audit a column that held nothing but nulls
until then counts as replaced: one more scan finds out, and an output named like an input is overwritten.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formula import Compiled, FormulaError, compile_formula
from ..plans.config import Step, as_steps
from .numbering import name_of, ranked_values, with_row_number, with_running_total, with_shift

MAPPINGS, FORMULAS = ("mapping", "map"), ("calculo", "formula")


@dataclass
class StepResult:
    df: DataFrame
    generated: list[str] = field(default_factory=list)
    overwritten: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    audit: list[tuple[int, str, str]] = field(default_factory=list)

    def report(self) -> DataFrame:
        """(step_no, column, status), one row per step."""
        return self.df.sparkSession.createDataFrame(self.audit, "step_no long, column string, status string")


def no_nan(df: DataFrame, column: str) -> Column:
    """The column with NaN as null."""
    c = name_of(column)
    return F.when(~F.isnan(c), c) if isinstance(df.schema[column].dataType, T.FloatType | T.DoubleType) else c


def with_inputs(df: DataFrame, parts: Iterable[Compiled], order_by: list[str] | None = None, row_id: str | None = None) -> DataFrame:
    """The table with what the formulas need besides its own columns.

    Whole-table aggregates come from one scan and are joined as a single row; membership looks values up in
    the distinct values of the other column, and a rank in the ranked values. Places need the rows numbered, by
    row_id if there is one.
    """
    joined, parts = df, list(parts)
    for part in parts:
        for probe, values, alias in part.members:
            found = df.select(values.alias(f"{alias}_value")).where(F.col(f"{alias}_value").isNotNull()).distinct().withColumn(alias, F.lit(True))
            joined = joined.join(found, probe == F.col(f"{alias}_value"), "left").drop(f"{alias}_value")
        for values, alias in part.ranks:
            ranked = ranked_values(df, values, alias).withColumnRenamed("__ranked", f"{alias}_value")
            joined = joined.join(ranked, values == F.col(f"{alias}_value"), "left").drop(f"{alias}_value")
    reducers = {alias: c for part in parts for alias, c in part.reducers.items()}
    if reducers:
        joined = joined.crossJoin(F.broadcast(df.agg(*(c.alias(a) for a, c in reducers.items()))))  # one row
    places = [p for part in parts for p in part.places]
    if places:
        row = row_id or "__row"
        joined = joined if row_id else with_row_number(joined, order_by, row)
        for method, values, n, alias in places:
            joined = with_shift(joined, values, n, alias, row) if method == "shift" else with_running_total(joined, values, alias, row)
    return joined


@contextlib.contextmanager
def lenient(spark: SparkSession) -> Iterator[None]:
    """Expressions that are analysed within give null for what they can't compute."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def checked(df: DataFrame, part: Compiled) -> None:
    """Raises AnalysisException where the formula doesn't fit the table; reads nothing."""
    reduced = df.agg(F.count("*"), *(c.alias(a) for a, c in part.reducers.items())).schema
    df.select(*(c for probe, values, _ in part.members for c in (probe, values))).schema  # noqa: B018
    columns = {alias: F.lit(None).cast(reduced[alias].dataType) for alias in part.reducers}
    columns |= {alias: F.lit(True) for *_, alias in part.members} | {alias: F.lit(0.0) for _, alias in part.ranks}
    columns |= {alias: values for _, values, _, alias in part.places}
    df.withColumns(columns).select(part.column.alias("x")).schema  # noqa: B018


def apply_steps(df: DataFrame, steps: Iterable[Step | dict], *, overwrite: bool = True, pandas_inf: bool = False, order_by: list[str] | None = None, partition_by: list[str] | None = None, row_id: str | None = None, exact_audit: bool = False) -> StepResult:
    """Runs the steps over df.

    row_id names a column of contiguous numbers in the order that formulas mean, such as that of the rows in
    their files (with_file_order); it takes the place of order_by. Nothing is computed before the result is used, but for an exact audit, and for ranks and formulas in the
    order of all rows, which number the rows first.
    """
    names, columns, needs, result = set(df.columns), {}, [], StepResult(df)
    order_by = order_by or ([row_id] if row_id else None)
    null = F.lit(None).cast("string")
    fills: list[tuple[int, str, Column]] = []
    raw: dict[str, Column] = {}

    def note(number: int, output: str, status: str) -> None:
        getattr(result, status).append(output)
        result.audit.append((number, output, status))

    for number, step in enumerate((s for s in as_steps(steps) if s.output), 1):
        out, kind = step.output, (step.kind or "").strip().lower()
        if kind in MAPPINGS and step.input in names:
            if overwrite or out not in columns:
                columns[out] = name_of(step.input)
                note(number, out, "overwritten" if out in names else "generated")
            else:
                if out in names:
                    fills.append((len(result.audit), out, columns[out]))
                columns[out] = F.coalesce(columns[out], no_nan(df, step.input))
                note(number, out, "generated")
        elif kind in FORMULAS and step.formula:
            try:
                part = compile_formula(step.formula, df.schema, pandas_inf=pandas_inf, order_by=order_by, partition_by=partition_by, prefix=f"__{number}_")
                with lenient(df.sparkSession) if part.is_sql else contextlib.nullcontext():
                    checked(df, part)
            except (FormulaError, AnalysisException):
                columns[out] = null
                note(number, out, "missing")
            else:
                needs.append(part)
                if part.is_sql:
                    columns[out] = name_of(f"__{number}_sql")
                    raw[f"__{number}_sql"] = part.column
                else:
                    columns[out] = part.column
                note(number, out, "generated")
        else:
            columns[out] = null
            note(number, out, "missing")
    if raw:
        with lenient(df.sparkSession):
            df = df.withColumns(raw)
    joined = with_inputs(df, needs, order_by, row_id)
    if exact_audit and fills:
        held = joined.agg(*(F.count(c).alias(f"c{i}") for i, (_, _, c) in enumerate(fills))).first()
        for (at, out, _), n in zip(fills, held, strict=True):
            if not n:
                result.audit[at] = (result.audit[at][0], out, "overwritten")
                result.generated.remove(out)
                result.overwritten.append(out)
    result.df = joined.select(*(c.alias(out) for out, c in columns.items()))
    return result
