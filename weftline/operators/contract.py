"""Checks of a data contract over whole tables: keys, uniqueness, references, values, formats, layout."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.config import Contract, TableSchema
from .numbering import name_of

#: Directives of strptime and letters of spelled-out formats, as Spark's pattern letters.
DIRECTIVES = {"%d": "dd", "%m": "MM", "%Y": "yyyy", "%y": "yy", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%p": "a", "%I": "hh", "%j": "DDD"}


def all_there(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (name_of(c).isNotNull() for c in columns))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values of more than one row, with their number n; keys with a null don't count."""
    return df.where(all_there(keys)).groupBy(*(name_of(k) for k in keys)).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(column_name, n_null) of key columns with nulls."""
    counts = df.agg(*(F.count_if(name_of(k).isNull()).alias(f"c{i}") for i, k in enumerate(keys)))
    rows = F.array(*(F.struct(F.lit(k).alias("column_name"), F.col(f"c{i}").alias("n_null")) for i, k in enumerate(keys)))
    return counts.select(F.inline(rows)).where(F.col("n_null") > 0)


def unique_sets(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """(columns, key, n): repeated values of each column set, as text."""
    found = None
    for columns in sets:
        key = F.to_json(F.array(*(name_of(c).cast("string") for c in columns)))
        one = df.where(all_there(columns)).select(F.lit(",".join(columns)).alias("columns"), key.alias("key"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("columns", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def cross_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """(value, n): values that occur more than once over all the columns together; empty ones don't count."""
    values = df.select(F.explode(F.array(*(name_of(c).cast("string") for c in columns))).alias("value"))
    return values.where(F.col("value").isNotNull() & (F.col("value") != "")).groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """The child rows whose reference has no parent; null references don't count."""
    keys = parent.select(name_of(parent_column).alias("__key")).where(F.col("__key").isNotNull())
    return child.where(name_of(column).isNotNull()).join(keys, name_of(column) == F.col("__key"), "left_anti")


def foreign_keys(tables: dict[str, DataFrame], schemas: dict[str, TableSchema]) -> DataFrame:
    """(table, column, reference, problem, n): orphans counted, and references to unknown tables or columns."""
    spark = next(iter(tables.values())).sparkSession
    known, found, unknown = {n.lower(): n for n in tables}, None, []
    for name, schema in schemas.items():
        for f in schema.fields:
            if not f.foreign_key or f.name not in tables[name].columns:
                continue
            table, _, column = f.foreign_key.partition(".")
            parent = known.get(table.lower())
            real = next((c for c in tables[parent].columns if c.lower() == column.lower()), None) if parent else None
            if real is None:
                unknown.append((name, f.name, f.foreign_key, "unknown parent", None))
                continue
            one = orphans(tables[name], f.name, tables[parent], real).agg(F.count("*").alias("n"))
            one = one.select(F.lit(name).alias("table"), F.lit(f.name).alias("column"), F.lit(f.foreign_key).alias("reference"), F.lit("orphans").alias("problem"), "n").where("n > 0")
            found = one if found is None else found.unionByName(one)
    rest = spark.createDataFrame(unknown, "table string, column string, reference string, problem string, n long")
    return rest if found is None else found.unionByName(rest)


def enum_violations(df: DataFrame, column: str, values: list[str] | DataFrame) -> DataFrame:
    """(value, n) of values that aren't listed; nulls don't count.

    values: a list in the configuration, or a table whose first column lists them, however long it is.
    """
    rows = df.select(name_of(column).cast("string").alias("value")).where("value IS NOT NULL")
    if isinstance(values, DataFrame):
        listed = values.select(name_of(values.columns[0]).cast("string").alias("value")).where("value IS NOT NULL")
        return rows.groupBy("value").agg(F.count("*").alias("n")).join(listed, "value", "left_anti")
    return rows.where(~F.col("value").isin(values)).groupBy("value").agg(F.count("*").alias("n"))


def column_order(df: DataFrame, schema: TableSchema, case_sensitive: bool = True) -> DataFrame:
    """(position, expected, actual, status) of declared and present columns, compared place by place."""
    same = (lambda a, b: a == b) if case_sensitive else (lambda a, b: (a or "").lower() == (b or "").lower())
    wanted, there, rows = [f.name for f in schema.fields], list(df.columns), []
    for i in range(max(len(wanted), len(there))):
        a, b = (x[i] if i < len(x) else None for x in (wanted, there))
        if a is None:
            status = "extra"
        elif same(a, b):
            status = "ok"
        else:
            status = "moved" if any(same(a, c) for c in there) else "missing"
        rows.append((i + 1, a, b, status))
    return df.sparkSession.createDataFrame(rows, "position long, expected string, actual string, status string")


def spark_pattern(fmt: str) -> str:
    """A strptime format, or one such as `dd/mm/yyyy hh:mm:ss`, as Spark's datetime pattern."""
    if "%" in fmt:
        parts = re.split(r"(%[a-zA-Z%])", fmt)
        return "".join("%" if p == "%%" else DIRECTIVES.get(p, p) if p.startswith("%") else re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", p) for p in parts)
    day, _, time = fmt.strip().lower().partition(" ")
    day = day.replace("mm", "MM").replace("aaaa", "yyyy")
    return f"{day} {time.replace('hh', 'HH')}" if time else day


def parsed_date(text: Column, formats: list[str]) -> Column:
    """The first format that reads the text gives the timestamp."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(spark_pattern(f))) for f in formats))


def date_violations(df: DataFrame, column: str, formats: list[str]) -> DataFrame:
    """The rows whose text none of the formats reads; null and empty texts don't count."""
    text = name_of(column).cast("string")
    return df.where(text.isNotNull() & (text != "") & parsed_date(text, formats).isNull())


def deprecated_used(df: DataFrame, schema: TableSchema) -> DataFrame:
    """(column_name, n) of deprecated columns that hold values."""
    names = [f.name for f in schema.fields if f.deprecated and f.name in df.columns]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, n long")
    counts = df.agg(*(F.count(name_of(n)).alias(f"c{i}") for i, n in enumerate(names)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(f"c{i}").alias("n")) for i, n in enumerate(names))))).where("n > 0")


def number_format_pattern(fmt: str) -> str | None:
    """A regular expression for formats such as `[-XX.XX, XX.XX]` or `X.XX`; None for others.

    A range allows a sign if its lower end has one, and up to as many digits as its ends.
    """
    ends = [e.strip() for e in fmt.strip().strip("[]").split(",")]
    if not ends or any(not re.fullmatch(r"-?X+(\.X+)?", e) for e in ends):
        return None
    sign = "-?" if any(e.startswith("-") for e in ends) else ""
    whole = max(len(e.lstrip("-").split(".")[0]) for e in ends)
    fraction = max(len(e.partition(".")[2]) for e in ends)
    return rf"^{sign}\d{{1,{whole}}}" + (rf"(\.\d{{1,{fraction}}})?" if fraction else "") + "$"


def format_violations(df: DataFrame, column: str, fmt: str) -> DataFrame:
    """The rows whose text doesn't fit a number format; nulls don't count."""
    pattern, text = number_format_pattern(fmt), name_of(column).cast("string")
    return df.where(text.isNotNull() & ~text.rlike(pattern)) if pattern else df.limit(0)


def check_counts(df: DataFrame, checks: list[str]) -> DataFrame:
    """(check, n) of predicates that rows break; a null result counts as broken."""
    counts = df.agg(*(F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(f"c{i}") for i, c in enumerate(checks)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("check"), F.col(f"c{i}").alias("n")) for i, c in enumerate(checks)))))


@dataclass
class Rule:
    """A rule of a table and what a row gives for it: an array of texts, null where the row gives nothing.

    keyed: the texts are values that must not be repeated, and each repeated one counts once; else each counts.
    """

    rule: str
    detail: str
    given: Column
    keyed: bool = False


def table_rules(df: DataFrame, schema: TableSchema, options: dict) -> list[Rule]:
    """Everything a contract says of one table that its rows and their grouping by value can tell."""
    there, found = set(df.columns), []
    text = lambda c: name_of(c).cast("string")
    once = lambda broken: F.when(F.coalesce(broken, F.lit(False)), F.array(F.lit("")))
    key = lambda columns: F.when(all_there(columns), F.array(F.to_json(F.array(*map(text, columns)))))
    keys = [k for k in schema.primary_key if k in there]
    if keys:
        found.append(Rule("primary key", ",".join(keys), key(keys), True))
    found += [Rule("null key", k, once(name_of(k).isNull())) for k in keys]
    found += [Rule("unique", ",".join(u), key(u), True) for u in schema.unique if all(c in there for c in u)]
    for columns in schema.extra.get("cross_unique") or []:
        if all(c in there for c in columns):
            found.append(Rule("cross unique", ",".join(columns), F.filter(F.array(*map(text, columns)), lambda v: v != ""), True))
    for f in schema.fields:
        if f.name not in there:
            continue
        value = text(f.name)
        if f.deprecated:
            found.append(Rule("deprecated", f.name, once(value.isNotNull())))
        if f.required and f.name not in keys:
            found.append(Rule("required", f.name, once(value.isNull() | (value == ""))))
        if f.enum is not None:
            found.append(Rule("enum", f.name, once(value.isNotNull() & ~value.isin(f.enum))))
        formats = [*([f.format] if f.format else []), *(options.get("date_formats") or [])]
        if f.kind in ("date", "datetime") and formats and isinstance(df.schema[f.name].dataType, T.StringType):
            found.append(Rule("date format", f.name, once((value != "") & parsed_date(value, formats).isNull())))
        if f.kind not in ("date", "datetime") and f.format and (pattern := number_format_pattern(f.format)):
            found.append(Rule("number format", f.name, once(~value.rlike(pattern))))
    return found + [Rule("check", c, once(~F.coalesce(F.expr(c), F.lit(False)))) for c in schema.checks]


def table_report(df: DataFrame, schema: TableSchema, options: dict | None = None) -> DataFrame:
    """(rule, detail, n) of the broken rules of a table: one scan, and one exchange of (rule, value) counts.

    Each row is expanded to what it gives for each rule. Tasks count equal values first, so that a rule that
    every row breaks, or a value that a third of all rows have, is one row per task in the shuffle.
    """
    rules = table_rules(df, schema, options or {})
    if not rules:
        return df.sparkSession.createDataFrame([], "rule string, detail string, n long")
    numbered = lambda i: lambda v: F.struct(F.lit(i).alias("i"), v.alias("value"))
    given = [F.transform(r.given, numbered(i)) for i, r in enumerate(rules)]
    values = df.select(F.inline(F.flatten(F.array_compact(F.array(*given))))).groupBy("i", "value").agg(F.count("*").alias("n"))
    n = F.when(F.col("i").isin([i for i, r in enumerate(rules) if r.keyed]), (F.col("n") > 1).cast("long")).otherwise(F.col("n"))
    names = F.array(*(F.struct(F.lit(r.rule).alias("rule"), F.lit(r.detail).alias("detail")) for r in rules))
    counts = values.groupBy("i").agg(F.sum(n).alias("n")).where("n > 0")
    name = F.element_at(names, F.col("i") + 1)
    return counts.select(name["rule"].alias("rule"), name["detail"].alias("detail"), "n")


def contract_report(tables: dict[str, DataFrame], contract: Contract) -> DataFrame:
    """(table, rule, detail, n): one row per broken rule of the contract, over all its tables.

    A table is read once for all rules of its own; references and the order of columns come on top.
    """
    spark: SparkSession = next(iter(tables.values())).sparkSession
    schemas = {n: s for n, s in contract.schemas().items() if n in tables}
    found = spark.createDataFrame([], "table string, rule string, detail string, n long")
    add = lambda name, rows: rows.select(F.lit(name).alias("table"), "rule", "detail", F.col("n").cast("long").alias("n"))
    for name, schema in schemas.items():
        found = found.unionByName(add(name, table_report(tables[name], schema, contract.options)))
        if contract.options.get("enforce_column_order"):
            order = column_order(tables[name], schema, contract.options.get("column_case_sensitive", True)).where("status <> 'ok'")
            found = found.unionByName(add(name, order.groupBy(F.col("status").alias("detail")).agg(F.count("*").alias("n")).withColumn("rule", F.lit("column order"))))
    if schemas:
        references = foreign_keys({n: tables[n] for n in schemas}, schemas)
        found = found.unionByName(references.select("table", F.col("problem").alias("rule"), F.concat_ws(" -> ", "column", "reference").alias("detail"), F.coalesce("n", F.lit(1)).alias("n")))
    return found.where("n > 0")
