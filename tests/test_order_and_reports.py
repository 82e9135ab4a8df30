"""File order, rejected records, long hierarchies, one-pass reports, stored graphs, streams of keys, total formulas."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from weftline import queries_reports
from weftline.functions.formula import FormulaError, compile_formula
from weftline.operators import contract, entail, numbering, specmine, triples
from weftline.operators.steps import apply_steps
from weftline.plans import config, pipeline
from weftline.plans.config import Contract, ContractTable, Field, Step, TableSchema
from weftline.sources import readers, writers
from weftline.streaming import keys
from weftline.streaming.run import run_to_table, stream_of


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_file_order_over_files_and_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "500")
    try:
        lines = [f"{i},{'x' * (i % 40)}" for i in range(2000)]
        for k, (a, b) in enumerate([(0, 900), (900, 901), (901, 2000)]):
            (tmp_path / f"part-{k}.csv").write_text("n,x\n" + "\n".join(lines[a:b]) + "\n")
        df = readers.read_csv(spark, str(tmp_path), multiLine=False)
        assert df.rdd.getNumPartitions() > 5
        numbered = numbering.with_file_order(df.withColumn("n", F.col("n").cast("long")))
        assert rows(numbered.select("n", "row_id")) == rows(spark.range(2000).selectExpr("id", "id + 1"))
        plan = final_plan(numbered)
        assert "SortMergeJoin" not in plan and "rangepartitioning" not in plan
        each = numbering.with_file_order(df, "k", per_file=True, file_col="file").groupBy("file").agg(F.min("k"), F.max("k"), F.count("*"))
        assert sorted(tuple(r)[1:] for r in each.collect()) == [(1, 1, 1), (1, 900, 900), (1, 1099, 1099)]
        whole = numbering.with_file_order(df.select("n"))
        done = apply_steps(whole.withColumn("n", F.col("n").cast("long")), [Step("n", "n"), Step("b", None, "formula", "n.shift(1)"), Step("t", None, "formula", "n.cumsum()")], row_id="row_id").df
        assert rows(done) == sorted(((i, i - 1 if i else None, i * (i + 1) // 2) for i in range(2000)), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


RAGGED = 'code,name\n001,"x, y"\n2\n3,a,b\n4,"one\ntwo ""q"""\n5,z,\n6,\n"7,open\n8,w\n'


def test_rejected_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text(RAGGED)
    (tmp_path / "b.csv").write_text("code,name\n9,ok\n10,a,b,c\n")
    found = readers.read_csv_checked(spark, str(tmp_path))
    assert rows(found.rows) == rows(spark.createDataFrame([("001", "x, y", 1), ("2", None, 2), ("4", 'one\ntwo "q"', 4), ("6", None, 6), ("9", "ok", 8)], "a string, b string, n long"))
    bad = [(r.file.rpartition("/")[2], r.record, r.reason, r.text.rstrip("\n")) for r in found.rejects.orderBy("file", "record").collect()]
    assert bad == [("a.csv", 3, "too many cells", "3,a,b"), ("a.csv", 5, "too many cells", "5,z,"), ("a.csv", 7, "quote not closed", '"7,open\n8,w'), ("b.csv", 2, "too many cells", "10,a,b,c")]
    for use in (lambda df: df.collect(), lambda df: df.count(), lambda df: df.select("name").collect()):
        with pytest.raises(Exception, match="cells|closed"):
            use(readers.read_csv(spark, str(tmp_path)))
    (tmp_path / "c.csv").write_text("code,name\n1,a\n2\n")
    good = readers.read_csv(spark, str(tmp_path / "c.csv"))
    assert good.count() == 2 and rows(good) == [("1", "a"), ("2", None)]
    assert rows(readers.read_csv(spark, str(tmp_path / "c.csv"), infer=True).where("code > 1")) == [(2, None)]


def test_rejected_records_of_a_contract(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id;v\n1;"a\nb"\n2;c;d\nx;e\n')
    c = Contract(options={"csv_options": {"delimiter": ";"}}, tables=[ContractTable("t.csv", TableSchema("T", [Field("id", "integer"), Field("v")]))])
    tables, rejects = readers.read_contract_checked(spark, c, str(tmp_path))
    assert rows(tables["T"]) == rows(spark.createDataFrame([(1, "a\nb", 1), (None, "e", 3)], "id long, v string, n long"))
    assert [(r.table, r.record, r.reason) for r in rejects.collect()] == [("T", 2, "too many cells")]


def plain_closure(pairs):
    found = set(pairs)
    while True:
        new = found | {(a, d) for a, b in found for c, d in pairs if b == c}
        if new == found:
            return found
        found = new


def test_closure_of_chains_trees_and_cycles(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(300)]
    got = {tuple(r) for r in entail.closure(spark.createDataFrame(chain, "low string, high string")).collect()}
    assert got == {(f"n{i}", f"n{j}") for i in range(301) for j in range(i + 1, 301)}
    random.seed(3)
    for _ in range(2):
        pairs = {(f"{random.randrange(12)}", f"{random.randrange(12)}") for _ in range(14)}  # cycles, loops and several ways
        assert {tuple(r) for r in entail.closure(spark.createDataFrame(sorted(pairs), "low string, high string")).collect()} == plain_closure(pairs)
    assert entail.closure(spark.createDataFrame([], "low string, high string")).collect() == []


def test_closure_joins_no_pair_again_in_later_rounds(spark, monkeypatch):
    kept, pairs = [], [(f"n{i}", f"n{i + 1}") for i in range(40)] + [(f"c{i}", f"c{(i + 1) % 3}") for i in range(3)] + [(f"leaf{i}", "c0") for i in range(200)]

    def counted(df, keep=entail.stored):
        kept.append(keep(df))
        return kept[-1]

    monkeypatch.setattr(entail, "stored", counted)
    got = rows(entail.closure(spark.createDataFrame(pairs, "low string, high string")))
    assert got == sorted(plain_closure(pairs), key=str)
    assert sum(df.count() for df in kept) <= len(got) + 2 * len(pairs)


def test_rdfs_closure_with_all_rules(spark):
    t, sub, prop, dom, ran = triples.RDF_TYPE, triples.RDFS + "subClassOf", triples.RDFS + "subPropertyOf", triples.RDFS + "domain", triples.RDFS + "range"
    tbox = spark.createDataFrame([(s, p, o, "iri", None) for s, p, o in [("A", sub, "B"), ("B", sub, "C"), ("p", prop, "q"), ("q", dom, "A"), ("q", ran, "D"), ("q", ran, triples.XSD + "integer")]], triples.TRIPLE)
    data = spark.createDataFrame([("x", "p", "y", "iri", None), ("x", "p", "1", "literal", None), ("x", "q", "y", "iri", None), ("z", t, "B", "iri", None), ("x", t, "A", "iri", None)], triples.TRIPLE)
    got = sorted((r.s, r.p, r.o) for r in entail.rdfs_closure(data, tbox).collect())
    assert got == sorted([("x", "p", "y"), ("x", "p", "1"), ("x", "q", "y"), ("z", t, "B"), ("x", t, "A"), ("x", "q", "1"), ("x", t, "B"), ("x", t, "C"), ("y", t, "D"), ("z", t, "C")])


def test_carry_over_runs(spark, monkeypatch):
    monkeypatch.setattr(specmine, "RUN", 4)
    random.seed(5)
    lines, want, table, header = [], [], None, None
    for n in range(1, 400):
        kind = random.random()
        if kind < 0.05:
            table, header = f"T{n}", None
            lines.append(("f", n, [f"{n}. Title (T_T{n}.csv)"]))
        elif kind < 0.1:
            header = ["Campo", f"H{n}"]
            lines.append(("f", n, header))
        else:
            lines.append(("f", n, [f"c{n}", "v"]))
            want.append((n, table, header))
    got = specmine.placed(spark.createDataFrame(lines, "file string, line_no long, cells array<string>").repartition(5)).where("title IS NULL AND NOT is_header")
    assert sorted(((r.line_no, r.table, r.header) for r in got.collect())) == want
    keys_of = re.findall(r"windowspecdefinition\((.*?) (?:ASC|DESC)", final_plan(got))
    assert keys_of and all("__run" in k for k in keys_of if "line_no" in k)


def test_export_reads_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "", None), (2, "abc", "x")], "a long, b string, c string")
    df.write.parquet(str(tmp_path / "in"))
    schema = TableSchema("T", [Field("a", "integer", True), Field("b", required=True, length=2), Field("c", required=True), Field("gone", required=True)])
    steps = [Step("a", "a"), Step("b", "b"), Step("c", "c")]
    done = pipeline.export_with_report(spark.read.parquet(str(tmp_path / "in")), steps, schema, lambda df: writers.write_parquet(df, str(tmp_path / "out")))
    assert done.n_rows == 2 and spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert rows(done.report) == [("broken", "b", "maxLength", 1), ("broken", "c", "minCount", 1), ("broken", "gone", "minCount", 2), ("empty", "b", "", 1), ("empty", "c", "", 1)]


def test_table_report_is_one_scan(spark):
    df = spark.createDataFrame([(1, "a", "1.5", "x"), (1, "a", "99", "y"), (None, "b", None, "1/1/2024"), (3, "", "7", None)], "k long, e string, n string, d string")
    schema = TableSchema("T", [Field("k", required=True), Field("e", required=True, enum=["a", ""]), Field("n", format="X.X"), Field("d", "date", format="d/M/yyyy", deprecated=True)], ["k"], [["e"], ["k", "e"]], ["k < 3"], {"cross_unique": [["e", "d"]]})
    found = contract.table_report(df, schema)
    assert rows(found) == sorted(
        [("primary key", "k", 1), ("null key", "k", 1), ("unique", "e", 1), ("unique", "k,e", 1), ("cross unique", "e,d", 1), ("required", "e", 1), ("enum", "e", 1), ("number format", "n", 1), ("date format", "d", 2), ("deprecated", "d", 3), ("check", "k < 3", 2)], key=str
    )
    plan = final_plan(found)
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("Generate") == 1
    assert contract.table_report(df, TableSchema("T")).collect() == []
    listed = spark.createDataFrame([("a",)], "v string")
    assert rows(contract.enum_violations(df, "e", listed)) == [("", 1), ("b", 1)]


def test_schema_documents_can_be_read(spark, tmp_path):
    fields = spark.createDataFrame([("f", "T", 2, "b", "integer", "5", "Sí", ["1", "2"], True, "P.id"), ("f", "T", 1, "a", "string", None, "No", None, False, None)], "file string, table string, line_no long, field string, kind string, length string, required string, enum array<string>, deprecated boolean, foreign_key string")
    writers.write_schema_documents(fields, str(tmp_path / "docs"))
    (path,) = (tmp_path / "docs" / "table=T").glob("*.txt")
    for schema in (config.load_schema(path), config.load_schema(path, spark)):
        assert schema.name == "T" and schema.fields == [Field("a", deprecated=False), Field("b", "integer", True, 5, enum=["1", "2"], foreign_key="P.id", deprecated=True)]


def test_untyped_graph(spark):
    schemas = [TableSchema("parts", [Field("a b")]), TableSchema("other", [Field("c")])]
    df = spark.createDataFrame([("x", None, 1, 1)], "`a b` string, c string, d long, row_id long")
    got = {(r.s.rpartition("#")[2] or r.s, r.p, r.o) for r in triples.untyped_graph(df, schemas, "parts").collect()}
    assert len(got) == 6 + 3 and any(o is None for _, _, o in got)
    assert triples.untyped_graph(None, schemas).count() == 6
    with pytest.raises(ValueError):
        triples.untyped_graph(df, schemas, "nope")


def graph(spark, *items):
    return spark.createDataFrame([(s, "p", o, kind, t) for s, o, kind, t in items], triples.TRIPLE)


def test_stored_graph(spark):
    one = graph(spark, ("a", "1", "literal", None), ("a", "1", "literal", "int"), ("a", "1", "iri", None), ("a", "1", "literal", None), ("b", None, "literal", None))
    kept = triples.StoredGraph.create(one, f"graph_test_{uuid.uuid4().hex}")
    assert kept.triples().count() == 4
    two = graph(spark, ("a", "1", "literal", "int"), ("a", "null", "literal", None), ("b", "null", "literal", None), ("c", "2", "iri", None), ("c", "2", "iri", None))
    missing = kept.missing(two)
    missing.collect()
    plan = final_plan(missing)
    scan = next(part for part in plan.split("Scan parquet")[1:] if "graph_test" in part or "Bucketed: true" in part)
    assert "Bucketed: true" in scan
    stored_side = plan[: plan.index("Scan parquet")].rsplit("SortMergeJoin", 1)[-1].rsplit("\n:", 1)[-1]
    assert plan.count("Exchange hashpartitioning") <= 2 and "Exchange" not in stored_side.splitlines()[-1]
    kept.append(two)
    kept.append(two)
    want = {tuple(r) for r in one.unionByName(two).collect()}
    assert sorted(map(str, (tuple(r) for r in kept.triples().collect()))) == sorted(map(str, want))
    assert rows(kept.statistics()) == [("p", len(want), 3)]


def test_streams_of_keys(spark, tmp_path):
    times = [f"2024-01-01 0{h}:0{m}:00" for h, m in ((0, 1), (0, 2), (0, 3), (3, 0), (6, 0))]
    df = spark.createDataFrame(list(zip([1, 1, 2, 1, 3], ["a", "a", None, "a", "a"], times, strict=True)), "k long, s string, t string").withColumn("t", F.col("t").cast("timestamp"))
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    every = run_to_table(keys.key_violations(stream_of(spark, path), ["k", "s"], "t"))
    assert max(r.n for r in every.collect()) == 3 and {r.k for r in every.collect()} == {1}
    # One file at a time: the third comes when the first two are forgotten.
    parts = str(tmp_path / "parts")
    for row in (0, 1, 3, 4):
        df.where(F.col("t") == times[row]).coalesce(1).write.mode("append").parquet(parts)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(parts)
    found = run_to_table(keys.key_violations(stream, ["k"], "t", keep="1 hour", late="1 minute"))
    assert [(r.k, r.n) for r in found.collect()] == [(1, 2)]
    parents = spark.createDataFrame([(1, "2024-01-01 00:00:30"), (9, "2024-01-01 07:00:00")], "id long, u string").withColumn("u", F.col("u").cast("timestamp"))
    parents.coalesce(1).write.parquet(str(tmp_path / "parents"))
    left = run_to_table(keys.orphan_stream(stream_of(spark, path), "k", "t", stream_of(spark, str(tmp_path / "parents")), "id", "u", within="1 hour"))
    assert sorted(str(r.t) for r in left.collect()) == ["2024-01-01 00:03:00", "2024-01-01 03:00:00"]  # the last is still open


def test_graphs_of_unique_subjects_are_not_shuffled(spark):
    schema = TableSchema("T", [Field("k", "integer"), Field("v")], ["k"])
    once = pipeline.table_to_triples(spark.createDataFrame([(1, "a"), (2, "a"), (None, "b")], "k long, v string"), schema, [schema])
    twice = pipeline.table_to_triples(spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "k long, v string"), schema, [schema])
    assert len(once.collect()) == len(set(once.collect())) == 6 + 6 and len(twice.collect()) == len(set(twice.collect())) == 6 + 6
    assert "REPARTITION" not in final_plan(once) and "REPARTITION" in final_plan(twice)
    both = TableSchema("T", [Field("k", "integer"), Field("V"), Field("v")], ["k"])
    clash = spark.createDataFrame([(1, "a", "x")], "k long, v string, w string")
    assert pipeline.table_to_triples(clash, both, [both]).where("o = 'a'").count() == 1


EXTREMES = [
    (-(1 << 63), float("nan"), "", None, True, "2024-01-01", "["), ((1 << 63) - 1, float("inf"), "abc", "x", False, "1900-01-01", "(("), (0, -0.0, "日本", "", None, None, None), (None, None, None, None, None, "2024-12-31", "12"), (-1, 1e308, "  ", "1", True, "2024-01-01", "abc"), (3, -2.5, "12", "12", False, "2024-02-29", "é"),
]


def random_formula(pick, depth):
    columns = ["i", "j", "x", "s", "t", "b", "d"]
    literals = ["0", "1", "-1", "7", "64", "9223372036854775807", "-9223372036854775808", "1e308", "0.5", "'a'", "''", "'2024-01-01'", "'['", "True", "99999999999999999999"]
    if depth == 0 or pick.random() < 0.15:
        return pick.choice(columns * 2 + literals)
    sub = lambda: random_formula(pick, depth - 1)
    make = [
        lambda: f"({sub()} {pick.choice(['+', '-', '*', '/', '//', '%', '**'])} {sub()})", lambda: f"({sub()} {pick.choice(['==', '!=', '<', '<=', '>', '>='])} {sub()})",
        lambda: f"({sub()} {pick.choice(['and', 'or', '&', '|'])} {sub()})", lambda: f"(not {sub()})", lambda: f"(-{sub()})", lambda: f"({sub()} {pick.choice(['in', 'not in'])} [{pick.choice(literals)}, {pick.choice(literals)}])",
        lambda: f"({pick.choice(columns)} in {pick.choice(columns)})", lambda: f"{pick.choice(['abs', 'log', 'log10', 'log1p', 'sqrt', 'exp', 'floor', 'ceil', 'sin', 'arccosh', 'arctanh', 'expm1'])}({sub()})",
        lambda: f"{sub()}.fillna({sub()})", lambda: f"{sub()}.clip({pick.choice(literals)}, {pick.choice(literals)})", lambda: f"{sub()}.round({pick.choice(['', '0', '2', '-1', '-18', '-19', '-30', '400'])})",
        lambda: f"{sub()}.astype('{pick.choice(['int', 'float', 'str', 'bool'])}')", lambda: f"{sub()}.abs()", lambda: f"{sub()}.isnull()", lambda: f"{pick.choice(columns)}.{pick.choice(['sum', 'mean', 'min', 'max', 'count'])}()",
        lambda: f"{pick.choice(['s', 't'])}.str.{pick.choice(['upper()', 'len()', 'strip()', 'slice(0, 2)', repr('x').join(['replace(', ', ' + repr('') + ')'])])}", lambda: f"{pick.choice(['s', 't'])}.str.contains({pick.choice(literals + [repr('a|b'), repr('(')])})",
    ]
    return pick.choice(make)()


def test_no_generated_formula_raises(spark):
    names = "i long, x double, s string, t string, b boolean, d string, j string"
    df = spark.createDataFrame(EXTREMES, names).withColumn("d", F.col("d").cast("timestamp")).withColumn("j", F.expr("try_cast(j as int)"))
    pick, told = random.Random(11), 0
    for _ in range(6):
        formulas = [random_formula(pick, 3) for _ in range(60)]
        done = apply_steps(df, [Step(f"f{k}", None, "formula", t) for k, t in enumerate(formulas)])
        assert len(done.df.collect()) == len(EXTREMES)
        told += len(done.generated)
    assert told > 60  # not all of them are refused


def test_stated_values(spark):
    df = spark.createDataFrame(EXTREMES, "i long, x double, s string, t string, b boolean, d string, j string")

    def values(text):
        return [r[0] for r in apply_steps(df, [Step("y", None, "formula", text)]).df.collect()]

    assert values("i.round(-1)") == [None, None, 0, None, 0, 0] and values("(i - i + 25).round(-1)")[2] == 20 and values("(i - i + 35).round(-1)")[2] == 40
    assert values("i.round(-18)")[:2] == [-9 * 10**18, 9 * 10**18] and values("i.round(-19)")[:2] == [None, None] and values("i.round(-25)")[0] == 0
    assert values("floor(x)")[1] == float("inf") and values("floor(x)")[4] == 1e308 and values("floor(x)")[5] == -3.0
    assert values("i ** 2")[5] == 9 and values("i ** 39")[5] == 3**39 and values("i ** 40")[5] is None and values("i ** 10 ** 9")[4] == 1 and values("i ** 1000000001")[4] == -1
    assert values("i in ['a', 3]") == [False] * 5 + [True] and values("s in i") == [False] * 6
    assert values("sql:1 / 0") == [None] * 6 and values("sql:cast(s as int)")[5] == 12
    assert values("s.str.contains('[')") == [None] * 6 and values("i.fillna('none')") == [None] * 6
    before = spark.conf.get("spark.sql.ansi.enabled")
    values("sql:cast(s as int)")
    assert spark.conf.get("spark.sql.ansi.enabled") == before
    for text in ("(" * 500 + "i" + ")" * 500, "i +", "99999999999999999999999", "'\ud800'"):
        with pytest.raises(FormulaError):
            compile_formula(text, df.schema)
            compile_formula("nope", df.schema)


def test_schema_files_are_read_in_tasks(spark, tmp_path, monkeypatch):
    files = {
        "a.yaml": '{"table": "A", "fields": [{"name": "x", "length": 1e1, "enum": [1, 1.50, 1E5, "b"], "precision": NaN}, {"name": "y", "type": "int", "required": "sí", "length": 3}]}',
        "b.yml": "- {Campo: z, Tipo: float, Longitud: '20,6'}\n", "bad.yaml": "foo: [bar\n", "no.yaml": '{"foo": 1}', "metadatos.yaml": "fields: [b]\n", "other.txt": "fields: [c]\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    schemas, errors = config.load_schemas(tmp_path)
    assert schemas[0].fields[0].enum == ["1", "1.5", "1E5", "b"] and schemas[0].fields[0].length is None  # as YAML reads them
    want = [(s.name, at, f.name, f.kind, f.required, f.length, config.whole_number(f.precision), f.enum) for s in schemas for at, f in enumerate(s.fields)]

    def on_driver(*_):
        raise AssertionError("documents on the driver")

    monkeypatch.setattr(config, "file_texts", on_driver)
    found = readers.read_schema_fields(spark, str(tmp_path))
    assert rows(found.where("error IS NULL").select("table", "place", "field", "kind", "required", "length", "precision", "enum")) == sorted(want, key=str)
    assert {r.file: r.error for r in found.where("error IS NOT NULL").collect()} == errors and set(errors) == {"bad.yaml", "no.yaml"}
    assert queries_reports.schema_documents_read(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()


def test_triples_of_numbered_rows_are_small_and_not_counted(spark, tmp_path, monkeypatch):
    (tmp_path / "schemas").mkdir()
    (tmp_path / "schemas" / "t.yaml").write_text("table: T\ncolumns: [{name: v, type: integer}]\n")
    (tmp_path / "in.csv").write_text("v\n" + "".join(f"{i % 7}\n" for i in range(20000)))
    monkeypatch.setattr(triples, "subjects_are_unique", lambda *_: pytest.fail("row numbers are counted"))
    pipeline.csv_to_triples(spark, str(tmp_path / "schemas" / "t.yaml"), str(tmp_path / "in.csv"), str(tmp_path / "out"), schema_folder=str(tmp_path / "schemas"))
    got = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) == 40000 + 4
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("part-*")) * 8 < sum(map(len, got))


def test_keys_of_streams_are_counted_without_python(spark, tmp_path):
    path = str(tmp_path / "in")
    for _ in range(3):
        spark.createDataFrame([(k, "t") for k in (1, 1, 2, 3, None)] , "k long, t string").where("k <> 3 OR k IS NULL").coalesce(1).write.mode("append").parquet(path)
    spark.range(50, 51).selectExpr("id AS k", "'t' AS t").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("k long, t string").option("maxFilesPerTrigger", 1).parquet(path)
    found = keys.key_violations(stream, ["k"], "t")
    assert "Python" not in found._jdf.queryExecution().analyzed().toString() and "Pandas" not in found._jdf.queryExecution().analyzed().toString()
    told = run_to_table(found)
    assert rows(told) == rows(spark.createDataFrame([(1, 2), (1, 4), (1, 6), (2, 2), (2, 3)], "k long, n long")) and told.columns == ["k", "n"]


def test_stored_graph_writes_each_part_once(spark):
    kept = triples.StoredGraph.create(graph(spark, ("a", "1", "literal", None)), f"graph_test_{uuid.uuid4().hex}")
    kept.append(graph(spark, ("a", "1", "literal", None), ("b", "1", "literal", None)))
    assert not hasattr(triples, "stored") and rows(spark.table(kept.name).groupBy("s").agg(F.count_distinct("part"))) == [("a", 1), ("b", 1)]
    assert spark.table(kept.name).select("part").distinct().count() == 2
