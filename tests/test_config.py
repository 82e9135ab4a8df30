import json

import pytest
from pyspark.sql import types as T

from weftline.plans import config as C

yaml = pytest.importorskip("yaml")


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return path


def test_canonical_layout(tmp_path):
    s = C.load_schema(write(tmp_path, "x.yaml", "table: CLIENTES\ncolumns:\n  - {name: id, type: integer, length: 5}\n  - {name: fecha, type: date, format: '%Y-%m-%d'}\n"))
    assert s.name == "CLIENTES"
    assert [(f.name, f.kind, f.length, f.format) for f in s.fields] == [("id", "integer", 5, None), ("fecha", "date", None, "%Y-%m-%d")]


def test_all_attributes(tmp_path):
    text = "table: CUSTOM\ncolumns:\n  - {name: code, type: string, length: 10, precision: 20, scale: 5, required: Sí, enum: [A, B], foreign_key: Others.code, deprecated: false, format: '%Y', foo: bar}\nprimary_key: [code]\nunique: [[code]]\nchecks: ['code > 1']\n"
    s = C.load_schema(write(tmp_path, "x.yaml", text))
    f = s.fields[0]
    assert (f.length, f.precision, f.scale, f.required, f.enum, f.foreign_key, f.deprecated, f.format) == (10, 20, 5, True, ["A", "B"], "Others.code", False, "%Y")
    assert f.extra == {"foo": "bar"}
    assert s.primary_key == ["code"] and s.unique == [["code"]] and s.checks == ["code > 1"]


@pytest.mark.parametrize("word, wanted", [("Sí", True), ("Si", True), ("No", False), ("perhaps", None), (None, None)])
def test_truth(word, wanted):
    assert C.truth(word) is wanted


def test_lengths():
    assert C.whole_number("4GB") is None
    assert C.whole_number("5") == 5
    assert C.precision_and_scale("20,6") == (20, 6)
    f = C.parse_field({"Campo": "importe", "Tipo": "float", "Longitud": "20,6"})
    assert (f.precision, f.scale, f.length) == (20, 6, None)
    assert f.spark_type == T.DecimalType(20, 6)


def test_layouts(tmp_path):
    rows = "- {Campo: id, Tipo: integer, Formnato: X.X}\n- {Campo: obs, Tipo: ''}\n"
    s = C.load_schema(write(tmp_path, "clientes.yaml", rows))
    assert s.name == "CLIENTES" and [f.kind for f in s.fields] == ["integer", "string"]
    assert s.fields[0].format == "X.X"
    assert C.load_schema(write(tmp_path, "up.yaml", "T_X:\n  fields: [a, b]\n")).name == "T_X"
    assert C.load_schema(write(tmp_path, "bare.yaml", "fields: [a]\n")).name == "BARE"
    assert C.load_schema(write(tmp_path, "no.yaml", "foo: bar\n")) is None
    many = C.parse_schemas({"A": [{"Campo": "x"}], "B": [{"Campo": "y"}]})
    assert [s.name for s in many] == ["A", "B"]
    files = C.parse_schemas({"ficheros": [{"nombre": "a", "esquema": [{"nombre": "n", "tipo": "int", "max_length": 3, "required": True}]}]})
    assert (files[0].fields[0].kind, files[0].fields[0].length, files[0].fields[0].required) == ("integer", 3, True)


def test_folder_reports_bad_files(tmp_path):
    write(tmp_path, "good.yaml", "fields: [a]\n")
    write(tmp_path, "bad.yaml", "foo: [bar\n")
    write(tmp_path, "metadatos.yaml", "fields: [b]\n")
    schemas, errors = C.load_schemas(tmp_path)
    assert [s.name for s in schemas] == ["GOOD"] and set(errors) == {"bad.yaml"}


def test_contract_overrides(tmp_path):
    schema = write(tmp_path, "t.yaml", "table: T\ncolumns: [id]\nprimary_key: [x]\n")
    text = f"contract: {{name: demo, version: '2.0'}}\nglobals: {{enforce_column_order: true}}\ntables:\n  - {{file: T.csv, schema: '{schema}', primary_key: [id], unique: [[id]], notes: [n]}}\n  - {{file: U.csv, schema: '{write(tmp_path, 'u.yaml', 'foo: bar')}'}}\n"
    c = C.load_contract(write(tmp_path, "c.yaml", text))
    assert (c.name, c.version, len(c.tables)) == ("demo", "2.0", 1)
    assert c.tables[0].schema.primary_key == ["id"] and c.tables[0].schema.unique == [["id"]] and c.tables[0].notes == ["n"]


def test_steps_from_json():
    steps = C.steps_from_json(json.dumps([{"campo_salida": "x", "campo_entrada": "a"}]))
    assert steps == [C.Step("x", "a", "mapping")]


def test_struct_carries_constraints():
    s = C.TableSchema("T", [C.Field("a", "integer", True, 5)])
    assert s.struct()["a"].metadata == {"required": True, "length": 5}
    assert s.struct()["a"].dataType == T.LongType()
