import random
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from weftline.functions.iri import BASE, token
from weftline.operators import entail, numbering, quality, shapes, triples
from weftline.plans import pipeline
from weftline.plans.config import Field, Step, TableSchema
from weftline.sources import shared, writers

XSD = triples.XSD


def test_token_equals_the_url_quoting(spark):
    texts = ["Foo Bar", "a*b~c", "ñandú é", "日本 語", "x\u00a0y", "a/b?c=d&e", "100%", "tab\tx", "-_.~", '"q"']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(token(F.col("t")), token(F.col("t"), True)).collect()]
    assert got == [(quote(t, safe=""), quote(t.split()[0], safe="")) for t in texts]
    assert spark.createDataFrame([(" ",), (None,)], "t string").select(token(F.col("t")).alias("x")).where("x IS NOT NULL").isEmpty()


def test_subjects(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "b c", 6), (None, None, 7)], "a long, b string, n long")
    s = lambda **o: [r[0] for r in df.select(triples.subject(df, TableSchema("Foo Bar", primary_key=["a", "b"]), **o)).collect()]
    assert s(row_id="n") == [f"{BASE}Foo%20Bar_1-", f"{BASE}Foo%20Bar_2-b%20c", f"{BASE}Foo%20Bar_7"]
    assert s(row_id="n", first_token=True, null_key="nan")[:2] == [f"{BASE}Foo_1-nan", f"{BASE}Foo_2-b"]
    assert s()[2] is None
    no_key = TableSchema("Foo Bar")
    assert [r[0] for r in df.select(triples.subject(df, no_key, row_id="n", first_token=True)).collect()] == [f"{BASE}Foo_5", f"{BASE}Foo_6", f"{BASE}Foo_7"]


def test_row_numbers_are_contiguous(spark):
    values = list(range(997))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v, f"x{v}") for v in values], "v long, other string").repartition(7)
    assert {(r.v, r.other, r.row_id) for r in numbering.with_row_number(df, ["v"]).collect()} == {(v, f"x{v}", v + 1) for v in range(997)}
    tied = numbering.with_row_number(df.withColumn("v", F.lit(1)), ["v"]).collect()
    assert sorted(r.row_id for r in tied) == list(range(1, 998)) and len({r.other for r in tied}) == 997
    back = numbering.with_row_number(df, [F.col("v").desc_nulls_last()]).where("row_id <= 2").collect()
    assert {(r.v, r.row_id) for r in back} == {(996, 1), (995, 2)}
    assert numbering.with_row_number(df.limit(0), ["v"]).count() == 0


def test_totals_and_ranks(spark, monkeypatch):
    monkeypatch.setattr(numbering, "CHUNK", 64)
    df = spark.createDataFrame([(i, i % 7, None if i % 3 else i) for i in range(500)], "i long, v long, w long")
    numbered = numbering.with_row_number(df, ["i"])
    got = numbering.with_running_total(numbering.with_shift(numbered, F.col("v"), 2, "back"), F.col("w"), "upto").collect()
    assert {(r.i, r.back, r.upto) for r in got} == {(i, (i - 2) % 7 if i > 1 else None, sum(range(0, i + 1, 3))) for i in range(500)}
    places = sorted(range(500), key=lambda i: i % 7)
    mean = {v: sum(k + 1 for k, i in enumerate(places) if i % 7 == v) / sum(i % 7 == v for i in range(500)) for v in range(7)}
    assert {r["__ranked"]: r.place for r in numbering.ranked_values(df, F.col("v"), "place").collect()} == mean


def test_shared_folders():
    class Session:
        """Just what new_folder() asks for: no checkpoint folder, and a cluster."""

        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared.new_folder(Session, "x")


def test_stored_tables_can_be_deleted(spark):
    path = shared.new_folder(spark, "test")
    assert shared.stored(spark.range(3), path).count() == 3
    shared.delete_folder(spark, path)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(path).count()


def test_tbox(spark):
    schema = TableSchema("clientes", [Field("id", "integer"), Field("name"), Field("day", "date"), Field("when", "datetime")])
    got = {(r.s, r.p, r.o) for r in triples.tbox(triples.schema_fields(spark, [schema, schema])).collect()}
    c = f"{BASE}CLIENTES"
    assert (c, triples.RDF_TYPE, triples.OWL + "Class") in got
    assert (f"{BASE}ID", triples.RDFS + "range", XSD + "integer") in got
    assert (f"{BASE}DAY", triples.RDFS + "range", XSD + "dateTime") in got
    assert len(got) == 1 + 4 * 2 + 2


def test_abox_types_and_nulls(spark):
    df = spark.createDataFrame([("k", 3, 1.5, True, "2024-01-02", None), ("m", None, float("nan"), None, "2024-01-02T10:00:00", "x")], "id string, n long, f double, b boolean, d string, s string")
    schema = TableSchema("T", [Field("id", required=True), Field("n", "integer"), Field("f", "float"), Field("b", "boolean"), Field("d", "date"), Field("s"), Field("absent")], ["id"])
    got = {(r.s[-1], r.p.removeprefix(BASE), r.o, r.datatype) for r in triples.abox(df, schema).where("o_kind = 'literal'").collect()}
    assert got == {
        ("k", "ID", "k", None), ("k", "N", "3", XSD + "integer"), ("k", "F", "1.5", XSD + "float"), ("k", "B", "true", XSD + "boolean"), ("k", "D", "2024-01-02T00:00:00", XSD + "dateTime"),
        ("m", "ID", "m", None), ("m", "D", "2024-01-02T10:00:00", XSD + "dateTime"), ("m", "S", "x", None),
    }


def test_wide_tables_are_split(spark):
    df = spark.range(2).select(F.col("id"), *(F.lit(i).alias(f"c{i}") for i in range(230)))
    schema = TableSchema("W", [Field(f"c{i}", "integer") for i in range(230)], ["id"])
    assert triples.abox(df, schema).count() == 2 * 231


def test_untyped_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None, "z")], "n long, a string, b string")
    got = [(r.p.removeprefix(BASE), r.o) for r in triples.untyped(df, [TableSchema("X", [Field("a")]), TableSchema("Y", [Field("other")])], "cls", "n").collect()]
    assert got[1:] == [("A", None)]


def test_union_is_a_set(spark):
    df = spark.createDataFrame([("a",), ("a",)], "id string")
    one = triples.abox(df, TableSchema("T", [Field("id")], ["id"]))
    assert triples.graph_union(one, one).count() == 2
    stats = {r.p: (r.n_triples, r.n_subjects) for r in quality.triple_statistics(one).collect()}
    assert stats == {triples.RDF_TYPE: (1, 1), f"{BASE}ID": (1, 1)}


@pytest.fixture(scope="module")
def shaped(spark):
    df = spark.createDataFrame([("1", "123456.789", None, "2024-01-02"), ("x", "12.5", "toolong", "2024/01/02"), ("3", "a", "ok", None)], "id string, amount string, name string, day string")
    schema = TableSchema("PAGOS", [Field("id", "integer", True), Field("amount", "float", precision=10, scale=2), Field("name", "string", True, 5), Field("day", "date", format="%Y-%m-%d"), Field("gone", required=True)], ["id"])
    return df, schema


def test_constraints(shaped):
    df, schema = shaped
    got = {(r.subject, r.path, r.constraint) for r in shapes.violations(df, shapes.constraints(df, schema), F.col("id")).collect()}
    assert got == {
        ("x", "id", "datatype"), ("1", "amount", "pattern"), ("3", "amount", "datatype"), ("3", "amount", "pattern"), ("1", "name", "minCount"), ("x", "name", "maxLength"),
        ("x", "day", "pattern"), ("1", "gone", "minCount"), ("x", "gone", "minCount"), ("3", "gone", "minCount"),
    }


def test_triples_break_the_same_constraints(shaped):
    df, schema = shaped
    table = {(r.subject, r.path, r.constraint) for r in shapes.violations(df, shapes.constraints(df, schema), F.col("id")).collect()}
    graph = {(r.subject.rpartition("_")[2], r.path, r.constraint) for r in shapes.validate_triples(triples.abox(df, schema), schema).collect()}
    assert graph == table


def test_digit_patterns():
    assert shapes.digit_pattern(Field("x", "float", precision=10, scale=2)) == r"^-?\d{1,8}(\.\d{1,2})?$"
    assert shapes.digit_pattern(Field("x", "decimal", precision=3)) == r"^-?\d{1,3}$"
    assert shapes.digit_pattern(Field("x", "string", precision=4)) == r"^-?\d{1,4}$"
    text = shapes.shapes_text(TableSchema("CLIENTES", [Field("id", "integer", True, 5, precision=3)]))
    assert "sh:minCount 1" in text and "sh:maxLength 5" in text and r"\\d{1,3}" in text and XSD + "integer" in text


def test_validate_summary(shaped):
    df, schema = shaped
    done = shapes.validate(df, schema)
    assert not done.conforms
    assert {(r.path, r.constraint): r.n for r in done.summary.collect()}[("gone", "minCount")] == 3
    assert shapes.validate(df, TableSchema("E")).conforms


def test_closure_and_domains(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "b")], "low string, high string")
    assert {tuple(r) for r in entail.closure(pairs).collect()} == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"), ("d", "b"), ("d", "c"), ("b", "b"), ("c", "b"), ("c", "c"), ("d", "d")}
    tbox = spark.createDataFrame([("q", triples.RDFS + "subPropertyOf", "p", "iri", None), ("p", triples.RDFS + "domain", "C", "iri", None), ("p", triples.RDFS + "range", "R", "iri", None), ("C", triples.RDFS + "subClassOf", "D", "iri", None)], triples.TRIPLE)
    data = spark.createDataFrame([("x", "q", "y", "iri", None), ("z", "other", "v", "literal", None)], triples.TRIPLE)
    got = {(r.s, r.p, r.o) for r in entail.rdfs_closure(data, tbox).collect()}
    assert got == {("x", "q", "y"), ("x", "p", "y"), ("z", "other", "v"), ("x", triples.RDF_TYPE, "C"), ("y", triples.RDF_TYPE, "R"), ("x", triples.RDF_TYPE, "D")}


def test_consistency(spark):
    users, clients = TableSchema("USUARIOS", [Field("tienda"), Field("n", "integer")], ["n"]), TableSchema("CLIENTES", [Field("tienda", "integer")])
    df = spark.createDataFrame([("north", "5"), ("south", "x")], "tienda string, n string")
    tbox = triples.tbox(triples.schema_fields(spark, [users, clients]))
    got = {(r.o, r.reason) for r in entail.inconsistencies(triples.abox(df, users), tbox).collect()}
    assert got == {("north", "datatype"), ("south", "datatype"), ("x", "lexical")}
    assert entail.consistent(triples.abox(df.where("n = '5'").drop("tienda"), users), tbox)
    with pytest.raises(pipeline.Inconsistent):
        pipeline.table_to_triples(df, users, [users, clients])


def test_lines_are_escaped(spark):
    df = spark.createDataFrame([("s", "p", 'a"b\\c\nd', "literal", None), ("s", "p", "1", "literal", XSD + "integer"), ("s", "p", None, "literal", None)], triples.TRIPLE)
    assert [r.value for r in writers.triple_lines(df).collect()] == ['<s> <p> "a\\"b\\\\c\\nd" .', f'<s> <p> "1"^^<{XSD}integer> .']


def test_larger_graphs_are_made_distinct_by_more_tasks(spark, monkeypatch):
    df = spark.range(3000).selectExpr("concat('s', id) AS s", "'p' AS p", "'o' AS o", "'iri' AS o_kind", "CAST(null AS string) AS datatype")
    for most, wanted in ((10000, 4), (100, 61)):
        monkeypatch.setattr(quality, "TRIPLES_PER_TASK", most)
        union = triples.graph_union(df, df)
        assert union.rdd.getNumPartitions() == wanted and union.count() == 3000
        assert [tuple(r) for r in quality.triple_statistics(union, is_set=True).collect()] == [("p", 3000, 3000)]


def test_csv_to_triples(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "schemas").mkdir()
    (tmp_path / "schemas" / "cli.yaml").write_text("table: CLI\ncolumns: [nombre]\n", encoding="utf-8")
    (tmp_path / "in.csv").write_text("nombre\nAlice\n", encoding="utf-8")
    pipeline.csv_to_triples(spark, tmp_path / "schemas" / "cli.yaml", str(tmp_path / "in.csv"), str(tmp_path / "out"), schema_folder=tmp_path / "schemas", order_by=["nombre"])
    lines = {r.value for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert f'<{BASE}CLI_1> <{BASE}NOMBRE> "Alice" .' in lines and len(lines) == 5


def test_transform_and_validate(spark):
    df = spark.createDataFrame([(1, ""), (2, "x")], "a long, s string")
    schema = TableSchema("T", [Field("k", "integer", True), Field("label", required=True)])
    done = pipeline.transform_and_validate(df, [Step("k", "a"), Step("label", "s")], schema)
    assert [tuple(r) for r in done.empty.collect()] == [("label", 1)] and done.validation.conforms
