"""Formulas over a table's columns, translated from Python expression syntax to Column expressions.

The language is what pandas' `eval` accepts on a table: arithmetic, comparisons, boolean logic, membership,
element-wise mathematics and a set of methods. Whatever is outside raises FormulaError. A formula that
begins with `sql:` is a Spark SQL expression.

Differences from Spark's own expressions: comparisons with null or NaN are False (`!=` True), logic is
two-valued, `//` and `%` follow the divisor's sign, and errors at run time (division by zero, overflow,
logarithm of a negative) give null. With pandas_inf, division by zero and logarithms give inf and NaN.

A translated formula is total: whatever the rows hold, no node raises. Kinds are checked and patterns compiled at
translation; a value of another kind is in no list, and equals nothing; a text that is compared with a date is
read as one, and if it is none the comparison is False. A `sql:` expression is Spark's, outside ANSI mode: what
can't be computed is null, whole numbers overflow as Java's do, and only what raises on purpose raises.
"""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

INT, FLOAT, TEXT, BOOL, OTHER = "int", "float", "text", "bool", "other"
NUMERIC = (INT, FLOAT)
#: Somewhat more than the largest whole number of 64 bits.
LARGE = 2.0**63 * (1 + 1e-9)
INFINITY, NAN = float("inf"), float("nan")


class FormulaError(ValueError):
    """The formula is not in the language, or does not fit the table."""


@dataclass
class Value:
    column: Column
    kind: str
    literal: object = None
    is_column: bool = False
    data_type: T.DataType | None = None  # of a column


@dataclass
class Compiled:
    """A formula's column and what must be joined to the table before it can be selected.

    reducers: aggregates of the whole table by alias. members: (probe, values, alias) for membership of a
    column's values in another column's; the alias is true where a value is found. ranks: (values, alias) of
    ranks in the whole table. places: (method, values, n, alias) of what the order of all rows gives: the n-th
    row before (`shift`) or the sum so far (`cumsum`).
    """

    column: Column
    kind: str
    reducers: dict[str, Column] = field(default_factory=dict)
    members: list[tuple[Column, Column, str]] = field(default_factory=list)
    ranks: list[tuple[Column, str]] = field(default_factory=list)
    places: list[tuple[str, Column, int, str]] = field(default_factory=list)
    is_sql: bool = False


UNARY: dict[str, Callable[[Column], Column]] = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh,
    "exp": F.exp, "expm1": F.expm1, "log": F.log, "log10": F.log10, "log1p": F.log1p, "sqrt": F.sqrt,
}
LOGARITHMS = {"log": 0.0, "log10": 0.0, "log1p": -1.0}
REDUCERS: dict[str, Callable[[Column], Column]] = {"sum": F.try_sum, "mean": F.try_avg, "min": F.min, "max": F.max, "count": F.count}
CASTS = {"int": "bigint", "int64": "bigint", "float": "double", "float64": "double", "str": "string", "bool": "boolean"}


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.IntegralType):
        return INT
    if isinstance(data_type, T.FractionalType):
        return FLOAT
    return {T.StringType: TEXT, T.BooleanType: BOOL}.get(type(data_type), OTHER)


def prepared(text: str) -> tuple[str, dict[str, str]]:
    """The text with quoted names replaced by plain ones, and `&`, `|` given the precedence of and, or."""
    names: dict[str, str] = {}
    parts = text.split("`")
    if len(parts) % 2 == 0:
        raise FormulaError("unbalanced quotes of a name")
    for i in range(1, len(parts), 2):
        alias = f"__quoted_{i}"
        names[alias] = parts[i]
        parts[i] = alias
    try:
        tokens = list(tokenize.generate_tokens(io.StringIO("".join(parts).strip()).readline))
    except (tokenize.TokenError, SyntaxError) as e:
        raise FormulaError(str(e)) from e
    words = {"&": "and", "|": "or"}
    return " ".join(words.get(t.string, t.string) if t.type == tokenize.OP else t.string for t in tokens).strip(), names


def whole_power(x: Column, y: Column, literal: int | None) -> Column:
    """An exact integer power: null beyond 64 bits and for negative exponents.

    The double's power tells which ones are far beyond, so that they aren't multiplied: a product that overflows
    costs an exception. Small literal exponents are multiplied out. Others are taken by squaring in a fold, whose
    value holds the product, the square and what is left of the exponent. 65 factors are enough: a larger power
    of anything but 0, 1 and -1 has overflowed by then, and those three only alternate.
    """
    one = F.lit(1).cast("bigint")
    if literal is not None and literal < 8:
        found = F.when(x.isNotNull(), one)
        for i in range(literal):
            found = F.try_multiply(found, x) if i else x
        return F.when(F.abs(F.pow(x.cast("double"), F.lit(float(literal)))) < LARGE, found) if literal > 1 else found
    y = F.lit(literal if literal <= 64 else 64 + literal % 2) if literal is not None else F.when(y > 64, F.lit(64) + y % 2).otherwise(y)
    start = F.struct(F.when(x.isNotNull(), one).alias("total"), x.alias("square"), F.when(y >= 0, y.cast("bigint")).alias("left"))

    def fold(found: Column, _: Column) -> Column:
        half = F.shiftright(found["left"], 1)
        total = F.when(found["left"].bitwiseAND(F.lit(1).cast("bigint")) == 1, F.try_multiply(found["total"], found["square"])).otherwise(found["total"])
        square = F.when(half > 0, F.try_multiply(found["square"], found["square"])).otherwise(found["square"])
        return F.struct(total.alias("total"), square.alias("square"), half.alias("left"))

    def fits(found: Column) -> Column:
        return F.when((found["left"] >= 0) & (F.abs(F.pow(found["square"].cast("double"), found["left"].cast("double"))) < LARGE), found)

    # A list of one value, so that base and exponent are computed once.
    bound = F.transform(F.array(start), lambda found: F.aggregate(F.array(*map(F.lit, range(7))), fits(found), fold, lambda last: last["total"]))
    return bound[0]


def magnitude(x: Value) -> Column:
    """The absolute value; null for the least whole number."""
    return F.when(x.column < 0, F.try_subtract(F.lit(0).cast("bigint"), x.column.cast("bigint"))).otherwise(x.column.cast("bigint")) if x.kind == INT else F.abs(x.column)


def whole_part(round_: Callable[[Column], Column], x: Column) -> Column:
    """The floor or ceiling of a double as a double; beyond 2**53, and for NaN and infinities, the value itself."""
    return F.when((x > -(2.0**53)) & (x < 2.0**53), round_(x).cast("double")).otherwise(x)


def checked_pattern(pattern: str) -> str:
    """The pattern, compiled once on the driver as Spark will compile it."""
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(pattern)
        except (Py4JJavaError, IllegalArgumentException) as e:
            raise FormulaError(f"not a pattern: {pattern}") from e
    return pattern


class Translator:
    def __init__(self, schema: T.StructType, pandas_inf: bool, order_by: list[str] | None, partition_by: list[str] | None, prefix: str):
        self.schema, self.pandas_inf, self.order_by, self.partition_by, self.prefix = schema, pandas_inf, order_by, partition_by, prefix
        self.names: dict[str, str] = {}
        self.reducers: dict[str, Column] = {}
        self.members: list[tuple[Column, Column, str]] = []
        self.ranks: list[tuple[Column, str]] = []
        self.places: list[tuple[str, Column, int, str]] = []

    def value(self, node: ast.AST) -> Value:
        method = getattr(self, f"on_{type(node).__name__.lower()}", None)
        if method is None:
            raise FormulaError(f"not supported: {type(node).__name__}")
        return method(node)

    def on_name(self, node: ast.Name) -> Value:
        name = self.names.get(node.id, node.id)
        if name not in self.schema.names:
            raise FormulaError(f"unknown column: {name}")
        quoted = name.replace("`", "``")
        return Value(F.col(f"`{quoted}`"), kind_of(self.schema[name].dataType), is_column=True, data_type=self.schema[name].dataType)

    def on_constant(self, node: ast.Constant) -> Value:
        kind = {bool: BOOL, int: INT, float: FLOAT, str: TEXT}.get(type(node.value))
        if kind is None:
            raise FormulaError(f"literal not supported: {node.value!r}")
        if kind == INT and not -(1 << 63) <= node.value < 1 << 63:
            raise FormulaError("a whole number beyond 64 bits")
        return Value(F.lit(node.value), kind, node.value)

    def on_unaryop(self, node: ast.UnaryOp) -> Value:
        x = self.value(node.operand)
        if isinstance(node.op, ast.Not | ast.Invert):
            return Value(~self.truth(x), BOOL)
        if x.kind not in NUMERIC:
            raise FormulaError("a sign needs a number")
        if isinstance(node.op, ast.UAdd):
            return x
        if x.literal is not None:
            return Value(F.lit(-x.literal), x.kind, -x.literal)
        return Value(F.try_subtract(F.lit(0).cast("bigint"), x.column.cast("bigint")) if x.kind == INT else -x.column.cast("double"), x.kind)

    def on_binop(self, node: ast.BinOp) -> Value:
        a, b = self.value(node.left), self.value(node.right)
        if isinstance(node.op, ast.Add) and a.kind == b.kind == TEXT:
            return Value(F.concat(a.column, b.column), TEXT)
        if a.kind not in NUMERIC or b.kind not in NUMERIC:
            raise FormulaError("arithmetic needs numbers")
        both = INT if a.kind == b.kind == INT else FLOAT
        wide = (lambda c: c.cast("bigint")) if both == INT else (lambda c: c.cast("double"))
        x, y = wide(a.column), wide(b.column)
        match node.op:
            case ast.Add():
                return Value(F.try_add(x, y), both)
            case ast.Sub():
                return Value(F.try_subtract(x, y), both)
            case ast.Mult():
                return Value(F.try_multiply(x, y), both)
            case ast.Div():
                return Value(self.quotient(x.cast("double"), y.cast("double")), FLOAT)
            case ast.FloorDiv():
                if both == INT:  # floor of the exact quotient
                    rest = x % F.nullif(y, F.lit(0))
                    low = F.when((rest != 0) & ((rest < 0) != (y < 0)), 1).otherwise(0)
                    whole = F.when(y == -1, F.try_subtract(F.lit(0).cast("bigint"), x)).when(y != 0, F.call_function("div", x, F.when((y != 0) & (y != -1), y)))
                    return Value(F.try_subtract(whole, low), INT)
                return Value(whole_part(F.floor, F.try_divide(x, y)), FLOAT)
            case ast.Mod():
                rest = x % F.nullif(y, F.lit(0))
                return Value(F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest), both)
            case ast.Pow():
                if both == INT and a.literal is not None and b.literal is not None and b.literal >= 0:
                    known = a.literal ** min(b.literal, 64 + b.literal % 2)
                    return Value(F.lit(known), INT, known) if abs(known) < 1 << 63 else Value(F.lit(None).cast("bigint"), INT)
                if both == INT and (b.literal is None or b.literal >= 0):
                    return Value(whole_power(x, y, b.literal), INT)
                return Value(F.pow(x.cast("double"), y.cast("double")), FLOAT)
        raise FormulaError(f"operator not supported: {type(node.op).__name__}")

    def quotient(self, x: Column, y: Column) -> Column:
        if not self.pandas_inf:
            return F.try_divide(x, y)
        return F.when(y == 0, F.when(x > 0, INFINITY).when(x < 0, -INFINITY).when(x.isNotNull(), NAN)).otherwise(F.try_divide(x, y))

    def on_boolop(self, node: ast.BoolOp) -> Value:
        found, *rest = (self.truth(self.value(v)) for v in node.values)
        for x in rest:
            found = found & x if isinstance(node.op, ast.And) else found | x
        return Value(found, BOOL)

    def truth(self, x: Value) -> Column:
        if x.kind != BOOL:
            raise FormulaError("logic needs booleans")
        return F.coalesce(x.column, F.lit(False))

    def on_compare(self, node: ast.Compare) -> Value:
        found, left = None, self.value(node.left)
        for op, right in zip(node.ops, node.comparators, strict=True):
            if isinstance(op, ast.In | ast.NotIn):
                one = self.membership(left, right)
                one = ~one if isinstance(op, ast.NotIn) else one
            else:
                other = self.value(right)
                one = self.comparison(op, left, other)
                left = other
            found = one if found is None else found & one
        return Value(found, BOOL)

    def alike(self, a: Value, b: Value) -> tuple[Column, Column] | None:
        """Both sides as comparable columns, or None where their kinds never meet."""
        if a.kind == b.kind != OTHER or a.kind in NUMERIC and b.kind in NUMERIC:
            return a.column, b.column
        if OTHER not in (a.kind, b.kind):
            return None
        x, y = a.data_type, b.data_type
        if x is not None and y is not None and x == y:
            return a.column, b.column
        times = T.DateType | T.TimestampType | T.TimestampNTZType
        if isinstance(x, times) and isinstance(y, times):
            return a.column.cast("timestamp"), b.column.cast("timestamp")
        if isinstance(x, times) and b.kind == TEXT:
            return a.column, b.column.try_cast(x)
        if isinstance(y, times) and a.kind == TEXT:
            return a.column.try_cast(y), b.column
        return None

    def comparison(self, op: ast.cmpop, a: Value, b: Value) -> Column:
        unequal = F.lit(isinstance(op, ast.NotEq))
        both = self.alike(a, b)
        if both is None:
            if isinstance(op, ast.Eq | ast.NotEq):
                return unequal
            raise FormulaError("values of different kinds have no order")
        x, y = both
        plain = {ast.Eq: x == y, ast.NotEq: x != y, ast.Lt: x < y, ast.LtE: x <= y, ast.Gt: x > y, ast.GtE: x >= y}.get(type(op))
        if plain is None:
            raise FormulaError(f"comparison not supported: {type(op).__name__}")
        nan = None
        for v in (a, b):
            if v.kind == FLOAT and v.literal is None:
                nan = F.isnan(v.column) if nan is None else nan | F.isnan(v.column)
        known = F.coalesce(plain, unequal)
        return known if nan is None else F.when(nan, unequal).otherwise(known)

    def membership(self, x: Value, node: ast.AST) -> Column:
        if isinstance(node, ast.List | ast.Tuple):
            values = [self.value(e) for e in node.elts]
            if any(v.literal is None for v in values):
                raise FormulaError("a list holds literals")
            pairs = [both for v in values if (both := self.alike(x, v)) is not None]
            return F.coalesce(x.column.isin([y for _, y in pairs]), F.lit(False)) if pairs else F.lit(False)
        other = self.value(node)
        if not other.is_column:
            raise FormulaError("membership needs a list or a column")
        both = self.alike(x, other)
        if both is None:
            return F.lit(False)
        alias = f"{self.prefix}member_{len(self.members)}"
        self.members.append((*both, alias))
        return F.coalesce(F.col(alias), F.lit(False))

    def on_call(self, node: ast.Call) -> Value:
        if node.keywords:
            raise FormulaError("arguments by name are not supported")
        if isinstance(node.func, ast.Name):
            return self.function(node.func.id, [self.value(a) for a in node.args])
        if not isinstance(node.func, ast.Attribute):
            raise FormulaError("not callable")
        owner, name = node.func.value, node.func.attr
        if isinstance(owner, ast.Attribute) and owner.attr == "str":
            return self.text_method(self.value(owner.value), name, [self.literal(a) for a in node.args])
        return self.method(self.value(owner), name, node.args)

    def literal(self, node: ast.AST) -> object:
        try:
            return ast.literal_eval(node)
        except ValueError as e:
            raise FormulaError("a literal is needed") from e

    def function(self, name: str, args: list[Value]) -> Value:
        if any(a.kind not in NUMERIC for a in args):
            raise FormulaError("mathematics needs numbers")
        columns = [a.column.cast("double") for a in args]
        if name in UNARY and len(args) == 1:
            (x,) = columns
            found = UNARY[name](x)
            if self.pandas_inf and name in LOGARITHMS:
                least = LOGARITHMS[name]
                found = F.when(x == least, -INFINITY).when(x < least, NAN).otherwise(found)
            return Value(found, FLOAT)
        if name == "arctan2" and len(args) == 2:
            return Value(F.atan2(*columns), FLOAT)
        if name == "abs" and len(args) == 1:
            return Value(magnitude(args[0]), args[0].kind)
        if name in ("floor", "ceil") and len(args) == 1:
            return Value(whole_part(F.floor if name == "floor" else F.ceil, columns[0]), FLOAT)
        raise FormulaError(f"unknown function: {name}")

    def text_method(self, x: Value, name: str, args: list) -> Value:
        if x.kind != TEXT:
            raise FormulaError("text methods need a text")
        c = x.column
        match name, args:
            case "upper", []:
                return Value(F.upper(c), TEXT)
            case "lower", []:
                return Value(F.lower(c), TEXT)
            case "strip", []:
                return Value(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), TEXT)
            case "len", []:
                return Value(F.length(c).cast("bigint"), INT)
            case "replace", [str(old), str(new)]:
                return Value(F.replace(c, F.lit(old), F.lit(new)), TEXT)
            case "contains", [str(pattern)]:
                return Value(F.coalesce(c.rlike(checked_pattern(pattern)), F.lit(False)), BOOL)
            case "startswith", [str(start)]:
                return Value(F.coalesce(c.startswith(start), F.lit(False)), BOOL)
            case "slice", [int(a), int(b)] if 0 <= a <= b:
                return Value(F.substring(c, a + 1, b - a), TEXT)
        raise FormulaError(f"text method not supported: {name}")

    def method(self, x: Value, name: str, nodes: list[ast.AST]) -> Value:
        c = x.column
        if name in REDUCERS and not nodes:
            if name in ("sum", "mean") and x.kind not in NUMERIC:
                raise FormulaError(f"{name} needs numbers")
            clean = F.when(~F.isnan(c), c) if x.kind == FLOAT else c
            alias = f"{self.prefix}reduced_{len(self.reducers)}"
            self.reducers[alias] = REDUCERS[name](clean)
            return Value(F.col(alias), {"mean": FLOAT, "count": INT}.get(name, x.kind))
        if name in ("shift", "cumsum", "rank", "diff"):
            return self.ordered(x, name, [self.literal(a) for a in nodes])
        if name == "fillna" and len(nodes) == 1:
            other = self.value(nodes[0])
            both = self.alike(x, other)
            if both is None:
                raise FormulaError("a fill of another kind")
            clean = F.when(~F.isnan(both[0]), both[0]) if x.kind == FLOAT else both[0]
            return Value(F.coalesce(clean, both[1]), FLOAT if FLOAT in (x.kind, other.kind) else x.kind, data_type=x.data_type)
        if name == "astype" and len(nodes) == 1:
            wanted = nodes[0].id if isinstance(nodes[0], ast.Name) else self.literal(nodes[0])
            if wanted not in CASTS:
                raise FormulaError(f"unknown type: {wanted}")
            return Value(c.try_cast(CASTS[wanted]), {"bigint": INT, "double": FLOAT, "string": TEXT, "boolean": BOOL}[CASTS[wanted]])
        if name in ("isnull", "notnull", "isna", "notna") and not nodes:
            null = c.isNull() | F.isnan(c) if x.kind == FLOAT else c.isNull()
            return Value(null if name.startswith("is") else ~null, BOOL)
        args = [self.literal(a) for a in nodes]
        if x.kind in NUMERIC and name == "round" and len(args) <= 1:
            digits = args[0] if args else 0
            if type(digits) is not int or abs(digits) > 300:
                raise FormulaError("round needs a number of digits")
            if x.kind == INT:
                return Value(self.rounded(c.cast("bigint"), digits), INT)
            c = c.cast("double")  # beyond 2**53 there are no digits to round
            return Value(F.when((c > -(2.0**53)) & (c < 2.0**53), F.bround(c, digits)).otherwise(c) if digits >= 0 else F.bround(c, digits), FLOAT)
        if x.kind in NUMERIC and name == "clip" and len(args) == 2:
            if any(type(a) not in (int, float) for a in args):
                raise FormulaError("clip needs numbers")
            both = FLOAT if x.kind == FLOAT or float in map(type, args) else INT
            low, high = (self.on_constant(ast.Constant(a)).column for a in args)
            return Value(F.when(c < low, low).when(c > high, high).otherwise(c), both)
        if x.kind in NUMERIC and name == "abs" and not args:
            return Value(magnitude(x), x.kind)
        raise FormulaError(f"method not supported: {name}")

    @staticmethod
    def rounded(c: Column, digits: int) -> Column:
        """A whole number to tens, hundreds and so on, half to even; null where that doesn't fit in 64 bits."""
        if digits >= 0:
            return c
        if digits < -18:
            near = F.lit(True) if digits < -19 else c.between(-5 * 10**18, 5 * 10**18)
            return F.when(c.isNotNull() & near, F.lit(0).cast("bigint"))
        step, half = F.lit(10**-digits).cast("bigint"), 10**-digits // 2
        mod = lambda x, y: F.call_function("mod", x, y)
        rest = mod(mod(c, step) + step, step)  # from 0 on
        floor = F.call_function("div", c, step) - F.when((c < 0) & (rest != 0), 1).otherwise(0)
        down = (rest < half) | (rest == half) & (mod(floor, F.lit(2)) == 0)
        return F.when(down, F.try_subtract(c, rest)).otherwise(F.try_add(c, step - rest))

    def ordered(self, x: Value, name: str, args: list) -> Value:
        if name == "rank":
            return Value(self.rank(x), FLOAT)
        if not self.order_by:
            raise FormulaError(f"{name} depends on the rows' order: name order_by")
        c, n = x.column, args[0] if args else 1
        if type(n) is not int or not -(1 << 31) < n < 1 << 31:
            raise FormulaError(f"{name} needs a whole number")
        if name != "shift" and x.kind not in NUMERIC:
            raise FormulaError(f"{name} needs numbers")
        if name == "cumsum":
            return Value(F.when(c.isNotNull(), self.placed("cumsum", c, 0)), x.kind)
        earlier = self.placed("shift", c, n)
        return Value(earlier if name == "shift" else F.try_subtract(c, earlier), x.kind)

    def rank(self, x: Value) -> Column:
        """The mean place among equal values, of the values in ascending order; null for null and NaN."""
        clean = F.when(~F.isnan(x.column), x.column) if x.kind == FLOAT else x.column
        if not self.partition_by:
            alias = f"{self.prefix}ranked_{len(self.ranks)}"
            self.ranks.append((clean, alias))
            return F.col(alias)
        least = F.rank().over(Window.partitionBy(*self.partition_by).orderBy(clean.asc_nulls_last()))
        equal = F.count("*").over(Window.partitionBy(*self.partition_by, clean))
        return F.when(clean.isNotNull(), least + (equal - 1) / 2)

    def placed(self, method: str, c: Column, n: int) -> Column:
        if not self.partition_by:
            alias = f"{self.prefix}placed_{len(self.places)}"
            self.places.append((method, c, n, alias))
            return F.col(alias)
        w = Window.partitionBy(*self.partition_by).orderBy(*self.order_by)
        return F.lag(c, n).over(w) if method == "shift" else F.try_sum(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def compile_formula(text: str, schema: T.StructType, *, pandas_inf: bool = False, order_by: list[str] | None = None, partition_by: list[str] | None = None, prefix: str = "__") -> Compiled:
    """Translates a formula for a table of this schema.

    Methods that depend on the rows' order need order_by; without partition_by the whole table is numbered in
    that order, and ranks are those of the whole table.
    """
    if text.lstrip().startswith("sql:"):
        return Compiled(F.expr(text.lstrip()[4:]), OTHER, is_sql=True)
    translator = Translator(schema, pandas_inf, order_by, partition_by, prefix)
    try:
        source, translator.names = prepared(text)
        found = translator.value(ast.parse(source, mode="eval").body)
    except FormulaError:
        raise
    except (SyntaxError, ValueError, TypeError, OverflowError, RecursionError, MemoryError) as e:
        raise FormulaError(str(e)) from e
    return Compiled(found.column, found.kind, translator.reducers, translator.members, translator.ranks, translator.places)
