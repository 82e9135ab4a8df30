"""Table schemas, data contracts and step lists that parameterise the jobs.

Only configuration passes through here: a few kilobytes, read on the driver; `readers.read_schema_fields` gives
what long or many schema files declare as a table. Schemas come from parsed YAML in any of these layouts: `table` with `columns`/`fields`/`campos`; one upper-case key holding those; a bare
definition; a list of `Campo` entries; tables keyed by name, each a list of `Campo` entries; and files with
`esquema` entries. English and Spanish keys are read alike, whatever their case.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

# Fixed values of schema files: truth words, and the accepted spellings of each attribute and type.
TRUE_WORDS = frozenset(["sí", "si", "yes", "true", "1"])
FALSE_WORDS = frozenset(["no", "false", "0"])
SPELLINGS = {
    "name": ("name", "campo", "nombre"),
    "kind": ("type", "tipo"),
    "required": ("required", "obligatorio", "requerido"),
    "length": ("length", "longitud", "max_length"),
    "format": ("format", "formato", "formnato"),
    "precision": ("precision",),
    "scale": ("scale",),
    "enum": ("enum",),
    "foreign_key": ("foreign_key",),
    "deprecated": ("deprecated", "deprecado"),
}
KINDS = {"int": "integer", "integer": "integer", "float": "float", "double": "float", "decimal": "decimal", "bool": "boolean", "boolean": "boolean", "date": "date", "datetime": "datetime", "str": "string", "string": "string", "": "string"}
TABLE_KEYS = ("table", "fields", "columns", "campos", "primary_key", "unique", "description", "checks", "notes")


@dataclass
class Field:
    name: str
    kind: str = "string"
    required: bool = False
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    format: str | None = None
    enum: list[str] | None = None
    foreign_key: str | None = None
    deprecated: bool | None = None
    extra: dict[str, Any] = field(default_factory=dict)

    @property
    def spark_type(self) -> T.DataType:
        if self.kind == "integer":
            return T.LongType()
        if self.kind in ("float", "decimal"):
            if self.precision and (self.scale is not None or self.kind == "decimal"):
                return T.DecimalType(min(38, self.precision), min(self.scale or 0, self.precision, 38))
            return T.DoubleType() if self.kind == "float" else T.DecimalType(38, 18)
        return {"boolean": T.BooleanType(), "date": T.TimestampType(), "datetime": T.TimestampType()}.get(self.kind, T.StringType())


@dataclass
class TableSchema:
    name: str
    fields: list[Field] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    extra: dict[str, Any] = field(default_factory=dict)

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def struct(self) -> T.StructType:
        """Spark's schema; each field's metadata carries its constraints."""
        attributes = ("required", "length", "precision", "scale", "format", "enum", "foreign_key", "deprecated")
        return T.StructType([T.StructField(f.name, f.spark_type, True, {k: v for k in attributes if (v := getattr(f, k)) is not None}) for f in self.fields])


@dataclass
class ContractTable:
    file: str
    schema: TableSchema
    description: str | None = None
    notes: list[str] = field(default_factory=list)


@dataclass
class Contract:
    name: str = ""
    version: str = ""
    owner: str = ""
    options: dict[str, Any] = field(default_factory=dict)
    tables: list[ContractTable] = field(default_factory=list)

    def schemas(self) -> dict[str, TableSchema]:
        return {t.schema.name: t.schema for t in self.tables}


@dataclass
class Step:
    """One output column: a copy of an input column, or a formula over the input's columns."""

    output: str
    input: str | None = None
    kind: str = "mapping"
    formula: str | None = None
    description: str | None = None


def whole_number(value: Any) -> int | None:
    """The value as a number if it consists of digits only: `4GB` has none."""
    if isinstance(value, int) and not isinstance(value, bool):
        return value
    text = "" if value is None else str(value).strip()
    return int(text) if text.isdecimal() else None


def precision_and_scale(value: Any) -> tuple[int | None, int | None]:
    """Both numbers of a length such as `20,6`."""
    found = re.fullmatch(r"(\d+),\s*(\d+)", "" if value is None else str(value).strip())
    return (int(found[1]), int(found[2])) if found else (None, None)


def truth(value: Any) -> bool | None:
    text = "" if value is None else str(value).strip().lower()
    return True if text in TRUE_WORDS else False if text in FALSE_WORDS else None


def parse_field(entry: dict | str) -> Field:
    if isinstance(entry, str):
        return Field(entry)
    known, extra = {}, {}
    for key, value in entry.items():
        name = next((n for n, words in SPELLINGS.items() if str(key).strip().lower() in words), None)
        if name is None:
            extra[key] = value
        elif known.get(name) in (None, ""):
            known[name] = value
    precision, scale = precision_and_scale(known.get("length"))
    text = lambda k: str(known[k]) if known.get(k) not in (None, "") else None
    kind = str(known.get("kind") or "").strip()
    enum = known.get("enum")
    return Field(
        name=str(known.get("name") or ""),
        kind=KINDS.get(kind.lower(), kind),
        required=truth(known.get("required")) is True,
        length=whole_number(known.get("length")),
        precision=known.get("precision", precision),
        scale=known.get("scale", scale),
        format=text("format"),
        enum=None if enum is None else [str(v) for v in enum],
        foreign_key=text("foreign_key"),
        deprecated=truth(known.get("deprecated")),
        extra=extra,
    )


def is_field_list(data: Any) -> bool:
    return isinstance(data, list) and bool(data) and all(isinstance(x, dict) and "Campo" in x for x in data)


def parse_schema(data: Any, stem: str = "") -> TableSchema | None:
    """The one table of a parsed document, or None if its layout is none of those known; stem names it otherwise."""
    if is_field_list(data):
        data = {"table": stem.upper(), "fields": data}
    elif isinstance(data, dict) and "table" not in data:
        only = next(iter(data.items())) if len(data) == 1 else ("", None)
        if str(only[0]).isupper() and isinstance(only[1], dict):
            data = {"table": only[0], **only[1]}
        elif any(k in data for k in ("fields", "columns", "campos")):
            data = {"table": stem.upper(), **data}
        else:
            return None
    if not isinstance(data, dict) or not data.get("table"):
        return None
    entries = data.get("columns") or data.get("fields") or data.get("campos") or []
    return TableSchema(
        name=str(data["table"]),
        fields=[parse_field(e) for e in entries if isinstance(e, dict | str)],
        primary_key=list(data.get("primary_key") or []),
        unique=[list(u) if isinstance(u, list) else [u] for u in data.get("unique") or []],
        checks=list(data.get("checks") or []),
        extra={k: v for k, v in data.items() if k not in TABLE_KEYS},
    )


def parse_schemas(data: Any, stem: str = "") -> list[TableSchema]:
    """All tables of a document in any layout."""
    one = parse_schema(data, stem)
    if one is not None:
        return [one]
    if isinstance(data, dict) and isinstance(data.get("ficheros"), list):
        return [TableSchema(str(f.get("nombre") or f.get("tabla") or stem).upper(), [parse_field(e) for e in f.get("esquema") or []], extra={k: v for k, v in f.items() if k != "esquema"}) for f in data["ficheros"]]
    if isinstance(data, dict):
        return [TableSchema(str(k), [parse_field(e) for e in v]) for k, v in data.items() if is_field_list(v)]
    return []


def file_texts(path: str | Path, spark: SparkSession | None = None) -> dict[str, str]:
    """The texts by name of a file, or of a folder's YAML files; with a session from whatever store Spark reads."""
    if spark is None:
        path = Path(path)
        files = sorted(p for p in path.iterdir() if p.suffix in (".yaml", ".yml")) if path.is_dir() else [path]
        return {p.name: p.read_text(encoding="utf-8") for p in files}
    rows = spark.read.text(str(path), wholetext=True).select("_metadata.file_name", "value").collect()  # configuration: a few kilobytes
    found = {r["file_name"]: r["value"] for r in sorted(rows)}
    return found if len(found) == 1 else {n: t for n, t in found.items() if n.endswith((".yaml", ".yml"))}


def parse_text(text: str) -> Any:
    """A document's data; JSON, which long ones are written in, goes past the YAML reader, with the same values."""
    import yaml

    try:
        return json.loads(text, parse_float=yaml.safe_load, parse_constant=str)
    except ValueError:
        return yaml.safe_load(text)


def read_yaml(path: str | Path, spark: SparkSession | None = None) -> Any:
    return parse_text(next(iter(file_texts(path, spark).values())))


def load_schema(path: str | Path, spark: SparkSession | None = None) -> TableSchema | None:
    return parse_schema(read_yaml(path, spark), Path(path).stem)


def schemas_of(name: str, text: str) -> tuple[list[TableSchema], str | None]:
    """The tables of one file, or what is wrong with it; files named `metadatos` have neither."""
    import yaml

    stem = name.rpartition(".")[0]
    if "metadatos" in stem.lower():
        return [], None
    try:
        schemas = parse_schemas(parse_text(text), stem)
    except yaml.YAMLError as e:
        return [], str(e)
    return schemas, None if schemas else "layout not recognised"


def load_schemas(folder: str | Path, spark: SparkSession | None = None) -> tuple[list[TableSchema], dict[str, str]]:
    """All schemas of a folder, and what is wrong with each file that has none; files named `metadatos` don't count."""
    found, errors = [], {}
    for name, text in file_texts(folder, spark).items():
        schemas, error = schemas_of(name, text)
        found += schemas
        if error is not None:
            errors[name] = error
    return found, errors


def parse_contract(data: dict, schemas: dict[str, TableSchema | None]) -> Contract:
    """A contract whose tables name their schemas; entries whose schema is None are skipped."""
    info, found = data.get("contract") or {}, Contract(options=data.get("globals") or {})
    found.name, found.version, found.owner = (str(info.get(k, "")) for k in ("name", "version", "owner"))
    for entry in data.get("tables") or []:
        schema = schemas.get(entry["schema"])
        if schema is None:
            continue
        schema.primary_key = entry.get("primary_key") or schema.primary_key
        schema.unique = entry.get("unique") or schema.unique
        schema.checks = entry.get("checks") or schema.checks
        found.tables.append(ContractTable(entry["file"], schema, entry.get("description"), entry.get("notes") or []))
    return found


def load_contract(path: str | Path, spark: SparkSession | None = None) -> Contract:
    data = read_yaml(path, spark)
    return parse_contract(data, {e["schema"]: load_schema(e["schema"], spark) for e in data.get("tables") or []})


def steps_from_json(text: str) -> list[Step]:
    """Steps from a JSON list; `campo_salida`, `campo_entrada`, `tipo_transformacion`, `formula`, `descripcion`."""
    return [Step(e.get("campo_salida") or "", e.get("campo_entrada"), e.get("tipo_transformacion") or "mapping", e.get("formula"), e.get("descripcion")) for e in json.loads(text)]


def as_steps(steps: Iterable[Step | dict]) -> list[Step]:
    return [s if isinstance(s, Step) else Step(**s) for s in steps]
