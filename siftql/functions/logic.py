"""Comparison, truth, conversion and arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftql.functions import function
from siftql.lang import tree as t
from siftql.plans.values import BINARY, BOOL, FLOAT, INT, STR, TIME, CompileProblem, Val, all_of, any_of, common, convert, nil, some, to_bool, to_float, to_int, to_str, to_time


@function("sqrt")
def sqrt(c, x):
    if x.kind not in ("int", "float"):
        return Val(F.lit(None).cast("double"), FLOAT)
    return Val(F.when(x.col >= 0, F.sqrt(x.col.cast("double"))), FLOAT)


@function("pow", least=2, most=2)
def power(c, x, y):
    return Val(F.nanvl(F.pow(to_float(x), to_float(y)), F.lit(None).cast("double")), FLOAT)


@function("count", most=1, least=0)
def count(c, *xs):
    return Val(F.when(~nil(xs[0]), F.lit(1).cast("long")) if xs else F.lit(1).cast("long"), INT)


def _numbers(args):
    """All arguments and elements of arrays as one array of doubles, and whether an element is no number."""
    parts, bad = [], F.lit(False)

    def numbers(a):
        return F.transform(F.coalesce(a.col, F.array().cast(a.type)), lambda e: to_float(Val(e, a.type.elementType)))

    for a in args:
        if a.kind == "array":
            x = numbers(a)
            bad = bad | F.exists(x, lambda e: e.isNull())
            parts.append(x)
        else:
            parts.append(F.array(to_float(a)))
    return F.filter(F.concat(*parts), lambda e: e.isNotNull()), bad


@function("sum", most=None)
def total(c, *xs):
    x, bad = _numbers(xs)
    s = F.aggregate(x, F.lit(0.0), lambda a, e: a + e)
    return Val(F.when(~bad & (s != 0), s), FLOAT)


@function("avg", most=None)
def mean(c, *xs):
    x, bad = _numbers(xs)
    return Val(F.when(~bad & (F.size(x) > 0), F.aggregate(x, F.lit(0.0), lambda a, e: a + e) / F.size(x)), FLOAT)


def _equal(a, b):
    if a.kind == "null" or b.kind == "null":
        return nil(a) & nil(b)
    a, b = some(a), some(b)
    if {a.kind, b.kind} <= {"int", "float"}:
        return a.col.cast("double").eqNullSafe(b.col.cast("double"))
    return a.col.eqNullSafe(b.col if a.type == b.type else convert(b, a.type))


@function("eq", least=2, most=2)
def eq(c, a, b):
    return Val(_equal(a, b), BOOL)


@function("ne", least=2, most=2)
def ne(c, a, b):
    return Val(~_equal(a, b), BOOL)


def _order(name, op):
    @function(name, least=2, most=2)
    def build(c, a, b):
        return Val(c.sign(op, to_float(a), to_float(b)), BOOL)


for _name, _op in (("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    _order(_name, _op)


@function("not")
def negate(c, x):
    return Val(~to_bool(x), BOOL)


def _exists(x):
    if x.missing or x.kind == "null":
        return F.lit(False)
    return ~nil(x) if x.kind in ("str", "time") else x.col.isNotNull()


@function("exists")
def exists(c, x):
    return Val(_exists(x), BOOL)


@function("any", most=None)
def any_(c, *xs):
    return Val(any_of([~nil(x) if x.kind != "null" else F.lit(False) for x in xs]), BOOL)


@function("all", most=None)
def all_(c, *xs):
    def one(x):
        if x.kind == "null":
            return F.lit(False)
        if x.kind in ("int", "float"):  # pinned: a number other than zero counts as false
            return F.coalesce(x.col == 0, F.lit(False))
        return ~nil(x) & x.col if x.kind == "bool" else ~nil(x)

    return Val(F.coalesce(all_of([one(x) for x in xs]), F.lit(False)), BOOL)


@function("oneof", least=2, most=None)
def one_of(c, *xs):
    kind = common(list(xs))
    return Val(F.coalesce(*[F.when(~nil(x), convert(x, kind)) for x in xs]), kind)


@function("cast", least=2, most=2, raw=True)
def cast(c, args):
    x = c(args[0])
    target = args[1]
    name = str(target.value if isinstance(target, t.Lit) else target.text).lower()
    if name in ("char", "[]byte", "bytes", "varchar", "string", "text"):
        return Val(to_str(x), STR)
    if name in ("int", "bigint", "integer"):
        return Val(to_int(x), INT)
    if name in ("number", "float", "double"):
        return Val(to_float(x), FLOAT)
    if name in ("time", "timestamp", "datetime", "date"):
        return Val(to_time(x, c.scope.now), TIME)
    if name in ("bool", "boolean"):
        return Val(to_bool(x), BOOL)
    if name == "binary":
        return Val(to_str(x).cast("binary"), BINARY)
    raise CompileProblem(f"cannot cast to {name!r}")


@function("tostring")
def tostring(c, x):
    return Val(F.coalesce(to_str(x), F.lit("")), STR)


@function("tobool")
def tobool(c, x):
    return Val(to_bool(x), BOOL)


@function("toint")
def toint(c, x):
    return Val(to_int(x), INT)


@function("tonumber")
def tonumber(c, x):
    return Val(to_float(x), FLOAT)


@function("unsign")
def unsign(c, x):
    return Val(F.conv(to_int(x).cast("string"), 10, 10), STR)


@function("typewriter")
def type_writer(c, x):
    """The MySQL name of a type name."""
    s = F.lower(to_str(x))
    return Val(F.when(s.isin("int", "integer", "bigint"), "bigint").when(s.isin("number", "double"), "float").when(s.isin("bool", "boolean"), "boolean").when(s.isin("time", "timestamp"), "datetime").when(s.isin("string"), "text").otherwise(s), STR)


ARRAY_OF_STR = T.ArrayType(STR)
