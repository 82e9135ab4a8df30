import pytest
from pyspark.sql import functions as F

from weftline.operators import contract, quality, specmine
from weftline.plans import pipeline
from weftline.plans.config import Contract, ContractTable, Field, TableSchema
from weftline.sources import readers, writers
from weftline.streaming import checks
from weftline.streaming.run import run_to_table, stream_of


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_keys_and_sets(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None)], "k long, v string")
    assert rows(contract.duplicates(df, ["k", "v"])) == [(1, "a", 2)]
    assert rows(contract.null_keys(df, ["k", "v"])) == [("v", 2)]
    assert rows(contract.unique_sets(df, [["k"], ["k", "v"]])) == [("k", '["1"]', 2), ("k", '["2"]', 2), ("k,v", '["1","a"]', 2)]
    assert rows(contract.cross_unique(spark.createDataFrame([("a", "b"), ("c", "a"), ("", "")], "x string, y string"), ["x", "y"])) == [("a", 2)]


def test_references(spark):
    child, parent = spark.createDataFrame([(1,), (9,), (None,)], "p long"), spark.createDataFrame([(1,), (None,)], "id long")
    assert rows(contract.orphans(child, "p", parent, "id")) == [(9,)]
    found = contract.foreign_keys({"C": child, "P": parent}, {"C": TableSchema("C", [Field("p", foreign_key="p.ID")]), "P": TableSchema("P", [Field("id", foreign_key="Uduarios.x")])})
    assert {(r.table, r.problem, r.n) for r in found.collect()} == {("C", "orphans", 1), ("P", "unknown parent", None)}


def test_values_and_formats(spark):
    df = spark.createDataFrame([("SI",), ("x",), (None,)], "v string")
    assert rows(contract.enum_violations(df, "v", ["SI", "NO"])) == [("x", 1)]
    days = spark.createDataFrame([("31/12/2024",), ("31/12/2024 10:11:12",), ("2024-12-31",), ("",), (None,)], "d string")
    assert rows(contract.date_violations(days, "d", ["%d/%m/%Y", "dd/mm/yyyy hh:mm:ss"])) == [("2024-12-31",)]
    assert contract.number_format_pattern("[-XX.XX, XX.XX]") == r"^-?\d{1,2}(\.\d{1,2})?$"
    assert contract.number_format_pattern("[-XXX, XXX]") == r"^-?\d{1,3}$" and contract.number_format_pattern("dd/mm") is None
    numbers = spark.createDataFrame([("1.25",), ("-10.5",), ("100",)], "n string")
    assert rows(contract.format_violations(numbers, "n", "[X.XX]")) == [("-10.5",), ("100",)]


def test_column_order(spark):
    df = spark.createDataFrame([(1, 2, 3)], "b long, A long, extra long")
    schema = TableSchema("T", [Field("a"), Field("b")])
    assert [r.status for r in contract.column_order(df, schema).collect()] == ["missing", "moved", "extra"]
    assert [r.status for r in contract.column_order(df, schema, False).collect()] == ["moved", "moved", "extra"]


def test_contract_report(spark):
    t = TableSchema("T", [Field("id"), Field("old", deprecated=True), Field("p", foreign_key="P.id")], ["id"], [["old"]], ["id > 1"])
    c = Contract(options={"enforce_column_order": True}, tables=[ContractTable("t.csv", t), ContractTable("p.csv", TableSchema("P", [Field("id")]))])
    tables = {"T": spark.createDataFrame([(1, "x", 5), (1, "x", 6)], "id long, old string, p long"), "P": spark.createDataFrame([(5,)], "id long")}
    got = {(r.table, r.rule, r.n) for r in contract.contract_report(tables, c).collect()}
    assert got == {("T", "primary key", 1), ("T", "unique", 1), ("T", "deprecated", 2), ("T", "check", 2), ("T", "orphans", 1)}


def test_quality(spark):
    df = spark.createDataFrame([(1, "", None), (2, "x", None)], "a long, b string, c double")
    schema = TableSchema("T", [Field("a", required=True), Field("b", required=True), Field("c", required=True), Field("gone", required=True)])
    assert rows(quality.required_empty(df, schema)) == [("b", 1), ("c", 2)]
    assert rows(quality.required_empty(df, TableSchema("T"))) == []
    big = spark.range(1000)
    one, two = quality.sample_n(big, 5, ["id"]), quality.sample_n(big.repartition(7), 5, ["id"])
    assert rows(one) == rows(two) and one.count() == 5 and quality.sample_n(big.limit(3), 5, ["id"]).count() == 3


LINES = [
    ("f", 1, ["stray", "x"]), ("f", 2, ["Campo", "Tipo"]), ("f", 3, ["1. Usuarios (T_USUARIOS.csv)", ""]), ("f", 4, ["early"]),
    ("f", 5, ["Campo", "Tipo", "Longitud", "Obligatorio", "Descripción", "Formato", ""]), ("f", 6, [" ", ""]),
    ("f", 7, ["sexo ", "Alfanumérico", "1", "Sí", "M= Mujer, H= Hombre"]), ("f", 8, ["ok", "Booleano", "", "No", "SI/NO, ver Clientes.id", "a", "b", "c"]),
    ("f", 9, ["estado", "Numérico", "1", "Si", "Valores posibles: [A,  B] Deprecado", ""]), ("f", 10, ["La clave está compuesta por id + tienda"]),
    ("f", 11, ["cdgArt", " cdgBarras y cdgEdi deben ser UNIQUE"]), ("f", 12, ["2. Otra (t_otra.CSV)"]), ("f", 13, ["x", "y"]), ("f", 14, ["Son UNIQUE: a y b."]),
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(LINES, "file string, line_no long, cells array<string>").repartition(3)


def test_spec_fields(lines):
    got = {r.field: r for r in specmine.enriched(specmine.spec_fields(lines)).where("line_no < 10").collect()}
    assert set(got) == {"sexo", "ok", "estado"} and {r.table for r in got.values()} == {"USUARIOS"}
    assert got["sexo"].enum == ["M", "H"] and got["sexo"].kind == "string" and len(got["sexo"].cells) == 7
    assert got["ok"].enum == ["SI", "NO"] and got["ok"].foreign_key == "Clientes.id" and got["ok"].cells[-1] == "b,c"
    assert got["estado"].enum == ["A", "B"] and got["estado"].deprecated and got["estado"].kind == "integer"


def test_spec_metadata(lines):
    got = {r.table: r for r in pipeline.mine(lines).metadata.collect()}
    assert got["USUARIOS"].primary_key == ["id", "tienda"] and got["USUARIOS"].operation == "concat" and got["USUARIOS"].expression == "id + tienda"
    assert got["USUARIOS"].unique_fields == ["cdgArt", "cdgBarras y cdgEdi"]
    assert got["OTRA"].unique_fields == ["a", "b"] and got["OTRA"].primary_key is None
    assert got["OTRA"].notes == ["x,y", "Son UNIQUE: a y b."]


def test_single_tables_and_documents(spark, lines, tmp_path):
    one = lines.where("line_no BETWEEN 5 AND 9").withColumn("file", F.lit("/in/T_Mis_T_Usuarios.csv"))
    mined = pipeline.mine(one, single_tables=True)
    r = mined.metadata.collect()[0]
    assert (r.table, r.primary_key, r.fields) == ("MIS_USUARIOS", ["sexo", "estado"], ["sexo", "ok", "estado"])
    writers.write_schema_documents(mined.fields, str(tmp_path / "docs"))
    assert spark.read.text(str(tmp_path / "docs")).count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('code,name\n001,"x, y"\nNA,é\n', encoding="utf-8")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"), null_tokens=["NA"])
    assert [tuple(r) for r in df.collect()] == [("001", "x, y"), (None, "é")]
    assert readers.read_csv(spark, str(tmp_path / "a.csv"), header=False).columns == ["0", "1"]
    for text in ("code,name\n", ""):
        (tmp_path / "b.csv").write_text(text, encoding="utf-8")
        with pytest.raises(ValueError):
            readers.read_csv(spark, str(tmp_path / "b.csv"))
    schema = TableSchema("A", [Field("code", "integer"), Field("v", "float"), Field("d", "date", format="dd/mm/yyyy")])
    raw = spark.createDataFrame([("7", "1,5", "31/12/2024"), ("x", "y", "z")], "code string, v string, d string")
    got = [tuple(r) for r in readers.typed(raw, schema, decimal=",").withColumn("d", F.col("d").cast("string")).collect()]
    assert got == [(7, 1.5, "2024-12-31 00:00:00"), (None, None, None)]
    c = Contract(options={"csv_options": {"delimiter": ";"}}, tables=[ContractTable("c.csv", TableSchema("C", [Field("n", "integer")]))])
    (tmp_path / "c.csv").write_text("n;m\n1;2\n", encoding="utf-8")
    assert readers.read_contract(spark, c, str(tmp_path))["C"].collect()[0] == (1, "2")
    writers.write_csv(df, str(tmp_path / "out"))
    assert sorted(readers.read_csv(spark, str(tmp_path / "out")).select("name").toPandas()["name"]) == ["x, y", "é"]


def test_spec_files(spark, tmp_path):
    (tmp_path / "t_uno.csv").write_text('Campo,Tipo\n"a","x, ""y"""\n\nb,z\n', encoding="utf-8")
    (tmp_path / "other.csv").write_text("q\n", encoding="utf-8")
    got = {(r.line_no, tuple(r.cells)) for r in readers.table_files(spark, str(tmp_path)).collect()}
    assert {(1, ("Campo", "Tipo")), (2, ("a", 'x, "y"')), (4, ("b", "z"))} <= got and not any("q" in c for _, c in got)


def test_quoted_line_breaks(spark, tmp_path):
    text = 'Campo,Nota\r\n"a","one\n""two"", three"\r\nb, "x\ny" ,z\n5" pipe,"open\nc,d'
    (tmp_path / "T_X.csv").write_bytes(text.encode())
    got = [r.cells for r in readers.spec_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [["Campo", "Nota"], ["a", 'one\n"two", three'], ["b", "x\ny", "z"], ['5" pipe', '"open'], ["c", "d"]]


def test_schema_match(spark):
    files = spark.createDataFrame([("/in/Ventas_sample.csv",), ("/in/x.csv",)], "path string")
    schemas = spark.createDataFrame([("VENTAS.yaml",)], "schema string")
    assert rows(readers.match_schemas(files, schemas).where("matched IS NOT NULL")) == [("/in/Ventas_sample.csv", "VENTAS.yaml")]


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "", "2024-01-01 00:01:00"), (1, "x", "2024-01-01 00:02:00"), (2, None, "2024-01-01 00:03:00"), (3, "y", "2024-01-01 03:00:00")], "k long, s string, t string")
    path = str(tmp_path / "in")
    df.withColumn("t", F.col("t").cast("timestamp")).write.parquet(path)
    schema = TableSchema("T", [Field("s", required=True, length=1)])
    empty = run_to_table(checks.windowed_required_empty(stream_of(spark, path), schema, "t"))
    assert [(r.column_name, r.n_empty) for r in empty.collect()] == [("s", 2)]
    repeated = run_to_table(checks.repeated_keys(stream_of(spark, path), ["k"], "t"))
    assert [(r.k, r.n) for r in repeated.collect()] == [(1, 2)]
    assert run_to_table(checks.first_of_keys(stream_of(spark, path), ["k"], "t")).count() == 3
    assert run_to_table(checks.violation_stream(stream_of(spark, path), schema, "k")).count() == 1
