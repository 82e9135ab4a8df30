import math

import pytest

from weftline.functions.formula import FormulaError, compile_formula
from weftline.operators.steps import apply_steps
from weftline.plans.config import Step


def formula(out, text):
    return Step(out, None, "formula", text)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def ab(spark):
    return spark.createDataFrame([(1, 3), (2, 4)], "a long, b long")


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame([(1, 3, "x", 1.5), (-7, 3, "Y ", float("nan")), (4, 0, None, None)], "a long, b long, s string, f double")


def value(df, text, **options):
    return [r[0] for r in apply_steps(df, [formula("v", text)], **options).df.collect()]


def test_mapping_and_formula(ab):
    done = apply_steps(ab, [Step("x", "a"), Step("suma", None, "calculo", "a + b")])
    assert done.df.columns == ["x", "suma"] and rows(done.df) == [(1, 4), (2, 6)]
    assert (done.generated, done.overwritten, done.missing) == (["x", "suma"], [], [])


def test_audit_and_report(ab):
    done = apply_steps(ab, iter([Step("a", "b"), Step("z", "nope"), formula("q", "x = a"), Step("k", "a", "other"), Step("", "a")]))
    assert (done.generated, done.overwritten, done.missing) == ([], ["a"], ["z", "q", "k"])
    assert rows(done.report()) == [(1, "a", "overwritten"), (2, "z", "missing"), (3, "q", "missing"), (4, "k", "missing")]
    assert rows(done.df) == [(3, None, None, None), (4, None, None, None)]


def test_all_steps_missing_keep_the_rows(ab):
    assert apply_steps(ab, [Step("z", "nope")]).df.count() == 2


def test_fill_mode(spark):
    df = spark.createDataFrame([(None, "p", 1.0), ("x", "q", float("nan"))], "a string, b string, f double")
    assert rows(apply_steps(df, [Step("o", "a"), Step("o", "b")], overwrite=False).df) == [("p",), ("x",)]
    assert rows(apply_steps(df, [Step("o", "a"), Step("o", "b")]).df) == [("p",), ("q",)]
    # A missing input wipes what was there, in either mode.
    assert rows(apply_steps(df, [Step("o", "a"), Step("o", "nope")], overwrite=False).df) == [(None,), (None,)]


def test_repeated_output_keeps_its_first_place(ab):
    assert apply_steps(ab, [Step("o", "a"), Step("p", "a"), Step("o", "b")]).df.columns == ["o", "p"]


def test_formulas_read_the_input(ab):
    assert rows(apply_steps(ab, [formula("a", "a * 10"), formula("c", "a + 1")]).df) == [(10, 2), (20, 3)]


def test_integer_arithmetic(mixed):
    assert value(mixed, "a // b") == [0, -3, None]
    assert value(mixed, "a % b") == [1, 2, None]
    assert value(mixed, "-a ** 2") == [-1, -49, -16]
    assert value(mixed, "a / b") == [1 / 3, -7 / 3, None]
    assert value(mixed, "a / b", pandas_inf=True)[2] == math.inf
    assert value(mixed, "9223372036854775807 + a")[0] is None


def test_comparisons_are_two_valued(mixed):
    assert value(mixed, "f < 2") == [True, False, False]
    assert value(mixed, "f == f") == [True, False, False]
    assert value(mixed, "f != 1.5") == [False, True, True]
    assert value(mixed, "0 < a < 3 | s == 'Y '") == [True, True, False]
    assert value(mixed, "not (a > 0 & b > 0)") == [False, True, True]
    assert value(mixed, "~(a > 0)") == [False, True, False]


def test_membership(mixed):
    assert value(mixed, "a in [1, 4]") == [True, False, True]
    assert value(mixed, "s not in ['x']") == [False, True, True]
    assert value(mixed, "b in a") == [False, False, False]
    assert value(mixed, "a - 1 in b") == [True, False, True]


def test_texts(mixed):
    assert value(mixed, "s.str.upper().str.strip() + '!'") == ["X!", "Y!", None]
    assert value(mixed, "s.str.len()") == [1, 2, None]
    assert value(mixed, "s.str.contains('[xy]')") == [True, False, False]
    assert value(mixed, "`s`.str.replace('x', 'z')")[0] == "z"


def test_methods(mixed):
    assert value(mixed, "f.fillna(0)") == [1.5, 0, 0]
    assert value(mixed, "f.isnull()") == [False, True, True]
    assert value(mixed, "s.astype('int')") == [None, None, None]
    assert value(mixed, "a.clip(0, 2)") == [1, 0, 2]
    assert value(mixed, "f.round(0)")[0] == 2.0


def test_mathematics(mixed):
    assert value(mixed, "sqrt(a)")[0] == 1 and math.isnan(value(mixed, "sqrt(a)")[1])
    assert value(mixed, "log(b)")[2] is None and value(mixed, "log(b)", pandas_inf=True)[2] == -math.inf
    assert value(mixed, "arctan2(a, b)")[0] == pytest.approx(math.atan2(1, 3))


def test_reducers_and_order(mixed):
    assert value(mixed, "a - a.min()") == [8, 0, 11]
    assert value(mixed, "f.mean() + 0 * a") == [1.5, 1.5, 1.5]
    done = apply_steps(mixed, [Step("a", "a"), formula("c", "a.cumsum()"), formula("p", "a.shift(1)")], order_by=["a"])
    assert sorted(rows(done.df)) == [(-7, -7, None), (1, -6, -7), (4, -2, 1)]
    assert apply_steps(mixed, [formula("c", "a.cumsum()")]).missing == ["c"]


def test_powers_are_exact(spark):
    df = spark.createDataFrame([(3, 37), (-3, 37), (2, 62), (2, 63), (7, 0), (-1, 65), (-1, 66), (0, 5), (1, 9_000_000_000), (5, -1), (None, 0), (2, None)], "a long, n long")
    want = [3**37, -(3**37), 2**62, None, 1, -1, 1, 0, 1, None, None, None]
    assert value(df, "a ** n") == want
    assert value(df, "a ** 37")[:3] == [3**37, -(3**37), 2**37] and value(df, "a ** 0") == [1] * 10 + [None, 1] and value(df, "a ** 64")[:2] == [None, None]
    assert value(df, "a ** 1")[0] == 3 and value(df, "a ** -1")[0] == pytest.approx(1 / 3)


def test_ranks_are_those_of_pandas(spark):
    pandas = pytest.importorskip("pandas")
    values = [3.0, 1.0, None, 3.0, float("nan"), 2.0, 3.0, 1.0]
    df = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(values)], "i long, v double, g long")
    want = [None if r != r else r for r in pandas.Series(values, dtype=float).rank()]
    done = apply_steps(df, [Step("i", "i"), formula("r", "v.rank() + 0")])
    assert [r for _, r in sorted(rows(done.df))] == want
    within = apply_steps(df, [Step("i", "i"), formula("r", "v.rank()")], partition_by=["g"])
    frame = pandas.DataFrame({"v": pandas.Series(values, dtype=float), "g": [i % 2 for i in range(8)]})
    assert [r for _, r in sorted(rows(within.df))] == [None if r != r else r for r in frame.groupby("g").v.rank()]


def test_order_of_all_rows_is_that_of_pandas(spark):
    pandas = pytest.importorskip("pandas")
    values = [(i * 37) % 101 for i in range(101)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long").repartition(5)
    done = apply_steps(df, [Step("i", "i"), formula("b", "v.shift(2)"), formula("f", "v.shift(-1)"), formula("s", "v.cumsum()"), formula("d", "v.diff()")], order_by=["i"])
    v = pandas.Series(values)
    want = [[None if x != x else int(x) for x in c] for c in (v.shift(2), v.shift(-1), v.cumsum(), v.diff())]
    assert [list(c) for c in zip(*(r[1:] for r in sorted(rows(done.df))), strict=True)] == want


def test_exact_audit(spark):
    df = spark.createDataFrame([(None, "p"), (None, "q")], "a string, b string")
    steps = [Step("b", "a"), Step("b", "b"), Step("o", "a"), Step("o", "b")]
    done = apply_steps(df, steps, overwrite=False, exact_audit=True)
    assert [s for _, _, s in done.audit] == ["overwritten", "overwritten", "generated", "generated"] and done.overwritten == ["b", "b"]
    assert [s for _, _, s in apply_steps(df, steps, overwrite=False).audit] == ["overwritten", "generated", "generated", "generated"]
    assert rows(done.df) == [("p", "p"), ("q", "q")]


def test_sql_prefix(ab):
    assert value(ab, "sql: a * 2") == [2, 4]
    assert apply_steps(ab, [formula("x", "sql: nothing(a)")]).missing == ["x"]


@pytest.mark.parametrize("text", ["where(a > 1, a, b)", "a if a > 1 else b", "lambda: a", "{1: a}", "a is b", "a +", "zz", "a + s", "s * 2", "max(a)", "`a", "a.nope()", "__import__('os')"])
def test_refused(mixed, text):
    with pytest.raises(FormulaError):
        compile_formula(text, mixed.schema)


def test_one_projection(ab):
    plan = apply_steps(ab, [Step("x", "a"), formula("y", "a + b")]).df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") <= 1 and "Exchange" not in plan
