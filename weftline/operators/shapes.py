"""Shape constraints of a table's schema, checked on the table itself or on its triples.

All row-local constraints of a table are one array expression, so a report needs one scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.iri import BASE
from ..plans.config import Field, TableSchema
from .contract import parsed_date
from .quality import violation_summary
from .numbering import name_of
from .triples import RDF_TYPE, XSD, class_iri, property_iri

#: Lexical forms of the datatypes.
LEXICAL = {
    XSD + "integer": r"^[+-]?\d+$",
    XSD + "decimal": r"^[+-]?(\d+(\.\d*)?|\.\d+)$",
    XSD + "float": r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)$",
    XSD + "boolean": r"^(true|false|1|0)$",
    XSD + "dateTime": r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$",
}
DATATYPES = {"integer": XSD + "integer", "float": XSD + "float", "decimal": XSD + "decimal", "boolean": XSD + "boolean", "date": XSD + "dateTime", "datetime": XSD + "dateTime"}
DATE_PATTERNS = {"%Y-%m-%d": r"^\d{4}-\d{2}-\d{2}$", "%Y/%m/%d": r"^\d{4}/\d{2}/\d{2}$"}


@dataclass
class Constraint:
    path: str
    kind: str
    broken: Column
    value: Column
    message: str


def digit_pattern(field: Field) -> str | None:
    """The pattern of a field with a precision."""
    if not field.precision:
        return None
    if field.kind in ("float", "decimal"):
        scale = field.scale or 0
        fraction = rf"(\.\d{{1,{scale}}})?" if scale else ""
        return rf"^-?\d{{1,{max(1, field.precision - scale)}}}{fraction}$"
    return rf"^-?\d{{1,{field.precision}}}$"


def date_pattern(field: Field) -> str | None:
    return DATE_PATTERNS.get(field.format or "") if field.kind == "date" else None


def wrong_date(text: Column, field: Field) -> Column:
    """Whether a text is no date or time of the field's format; what a date pattern excludes is left to it."""
    if not field.format:
        return text.try_cast("timestamp").isNull()
    parsed = parsed_date(text, [field.format]).isNull()
    pattern = date_pattern(field)
    return text.rlike(pattern) & parsed if pattern else parsed


def wrong_type(c: Column, field: Field, actual: T.DataType) -> Column:
    """Whether a value that is there doesn't have the field's type."""
    if field.kind not in DATATYPES or isinstance(field.spark_type, type(actual)):
        return F.lit(False)
    text = c.cast("string")
    if field.kind in ("date", "datetime"):
        if isinstance(actual, T.DateType | T.TimestampType | T.TimestampNTZType):
            return F.lit(False)
        return c.isNotNull() & wrong_date(text, field)
    return c.isNotNull() & ~text.rlike(LEXICAL[DATATYPES[field.kind]])


def constraints(df: DataFrame, schema: TableSchema, empty_is_null: bool = False) -> list[Constraint]:
    """The row-local constraints on the columns present; absent required columns break for every row."""
    found = []
    for f in schema.fields:
        if f.name not in df.columns:
            if f.required:
                found.append(Constraint(f.name, "minCount", F.lit(True), F.lit(None).cast("string"), "required column is absent"))
            continue
        c, actual = name_of(f.name), df.schema[f.name].dataType
        text = c.cast("string")
        add = lambda kind, broken, message, f=f, text=text: found.append(Constraint(f.name, kind, broken, text, message))
        if f.kind in DATATYPES:
            add("datatype", wrong_type(c, f, actual), f"not a value of type {f.kind}")
        if f.required:
            add("minCount", c.isNull() | (text == "") if empty_is_null else c.isNull(), "required value is missing")
        if f.length:
            add("maxLength", F.length(text) > f.length, f"longer than {f.length}")
        for pattern in (digit_pattern(f), date_pattern(f)):
            if pattern:
                add("pattern", ~text.rlike(pattern), f"does not match {pattern}")
        if f.enum is not None:
            add("enum", c.isNotNull() & ~text.isin(f.enum), "not among the listed values")
    return found


def violations(df: DataFrame, rules: list[Constraint], subject: Column | None = None) -> DataFrame:
    """(subject, path, constraint, value, message): one row per broken constraint; one scan, no shuffle."""
    s = F.lit(None).cast("string") if subject is None else subject.cast("string")
    if not rules:
        return df.select(s.alias("subject")).limit(0).select("subject", *(F.lit(None).cast("string").alias(n) for n in ("path", "constraint", "value", "message")))
    parts = [F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(r.path).alias("path"), F.lit(r.kind).alias("constraint"), r.value.alias("value"), F.lit(r.message).alias("message"))) for r in rules]
    return df.select(s.alias("subject"), F.inline(F.array_compact(F.array(*parts))))


@dataclass
class ValidationResult:
    violations: DataFrame
    summary: DataFrame

    @property
    def conforms(self) -> bool:
        return self.violations.isEmpty()


def validate(df: DataFrame, schema: TableSchema, *, subject: Column | None = None, empty_is_null: bool = False) -> ValidationResult:
    found = violations(df, constraints(df, schema, empty_is_null), subject)
    return ValidationResult(found, violation_summary(found))


#: Datatypes that a literal of each kind may have; a plain literal is a string.
OWN_TYPES = {"integer": ["integer"], "float": ["float"], "boolean": ["boolean"], "date": ["dateTime"], "datetime": ["dateTime", "string"], "decimal": ["decimal", "string"]}


def broken_literal(field: Field) -> Column:
    """The constraints that the literal in column o breaks, an array with nulls."""
    o, own = F.col("o"), F.coalesce("datatype", F.lit(XSD + "string"))
    bare = F.regexp_replace("o", "T00:00:00$", "")  # dates carry a midnight that the table's text hasn't
    wrong = ~own.isin([XSD + t for t in OWN_TYPES.get(field.kind, ["string"])])
    if field.kind in ("date", "datetime") and field.format:
        wrong = wrong | wrong_date(bare, field)
    elif field.kind in DATATYPES:
        wrong = wrong | ~o.rlike(LEXICAL[DATATYPES[field.kind]])
    tests = [("datatype", wrong)]
    if field.length:
        tests.append(("maxLength", F.length(o) > field.length))
    if digits := digit_pattern(field):
        tests.append(("pattern", ~o.rlike(digits)))
    if dates := date_pattern(field):
        tests.append(("pattern", ~bare.rlike(dates)))
    if field.enum is not None:
        tests.append(("enum", ~o.isin(field.enum)))
    return F.array(*(F.when(t, n) for n, t in tests))


def validate_triples(triples: DataFrame, schema: TableSchema, base: str = BASE) -> DataFrame:
    """(subject, path, constraint, value): the same constraints on triples, for instances of the schema's class.

    Only the class's properties are read. One grouping by subject tells whether it is an instance, which
    required properties it has and which of its literals broke something; those were found row by row.
    """
    cls = class_iri(schema.name, base)
    paths = {property_iri(f.name, base): f for f in schema.fields}
    found = None
    for p, f in paths.items():
        one = F.col("p") == p
        found = F.when(one, broken_literal(f)) if found is None else found.when(one, broken_literal(f))
    is_type = (F.col("p") == RDF_TYPE) & (F.col("o") == cls)
    rows = triples.where(is_type | F.col("p").isin(list(paths)))
    if found is None:
        found = F.lit(None).cast("array<string>")
    literal = (F.col("o_kind") == "literal") & F.col("o").isNotNull()
    names = F.array_compact(F.when(literal, found))
    name = F.lit("")
    for p, f in paths.items():
        name = F.when(F.col("p") == p, f.name).otherwise(name)
    detail = F.when(F.size(names) > 0, F.struct(name.alias("path"), F.col("o").alias("value"), names.alias("names")))
    required = [(p, f) for p, f in paths.items() if f.required]
    flags = [F.max(F.col("p") == p).alias(f"has_{i}") for i, (p, _) in enumerate(required)]
    by = rows.groupBy("s").agg(F.max(is_type).alias("target"), F.collect_list(detail).alias("broken"), *flags).where("target")
    absent = [F.when(~F.col(f"has_{i}"), F.struct(F.lit(f.name).alias("path"), F.lit(None).cast("string").alias("value"), F.array(F.lit("minCount")).alias("names"))) for i, (_, f) in enumerate(required)]
    every = F.concat("broken", F.array_compact(F.array(*absent))) if absent else F.col("broken")
    each = by.select(F.col("s").alias("subject"), F.inline(every))
    return each.select("subject", "path", F.explode("names").alias("constraint"), "value")


def shapes_text(schema: TableSchema, base: str = BASE) -> str:
    """The constraints as SHACL in Turtle."""
    text = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    blocks = []
    for f in schema.fields:
        lines = [f"sh:path <{property_iri(f.name, base)}>", f"sh:datatype <{DATATYPES.get(f.kind, XSD + 'string')}>", f"sh:minCount {int(f.required)}"]
        lines += [f"sh:maxLength {f.length}"] if f.length else []
        lines += [f"sh:pattern {text(p)}" for p in (digit_pattern(f), date_pattern(f)) if p]
        blocks.append("    sh:property [ " + " ; ".join(lines) + " ]")
    cls = class_iri(schema.name, base)
    return "@prefix sh: <http://www.w3.org/ns/shacl#> .\n\n" + " ;\n".join([f"<{cls}Shape> a sh:NodeShape", f"    sh:targetClass <{cls}>", *blocks]) + " .\n"
