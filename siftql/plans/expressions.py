"""Syntax trees to Spark columns.

The rules of the language are compiled into ordinary expressions, so that Catalyst can push, prune and generate code for
them.  At the top of a filter a predicate that is NULL drops the row, so comparisons stay bare there and reach the scan;
``coalesce(.., false)`` stands only beneath NOT.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftql.lang import tree as t
from siftql.lang.parser import parse_expression
from siftql.plans.values import BOOL, FLOAT, INT, STR, CompileProblem, Val, all_of, any_of, array_of, convert, first_of, float_sum, lit, nil, nothing, some, to_bool, to_float, to_int, to_str, to_time

INCLUDE_DEPTH = 100
AGGREGATES = {"count", "sum", "avg", "min", "max", "approx_count_distinct"}


@dataclass
class Scope:
    """What names stand for: columns of a frame, under their own or a qualified name."""

    columns: dict[str, Val]
    #: Unknown names are missing values rather than errors.
    lenient: bool = False
    variables: dict[str, object] = field(default_factory=dict)
    params: tuple = ()
    filters: dict[str, t.Node] = field(default_factory=dict)
    functions: dict[str, Callable] = field(default_factory=dict)
    #: The column with the time of a row, which now() and the like refer to.
    time: Column | None = None
    aggregate: bool = False

    @classmethod
    def of(cls, df: DataFrame, alias: str | None = None, **more) -> Scope:
        own: dict[str, Val] = {}
        for f in df.schema.fields:
            v = Val(F.col(f"`{f.name}`"), f.dataType)
            own[f.name.lower()] = v
            if alias:
                own[f"{alias.lower()}.{f.name.lower()}"] = v
        return cls(own, **more)

    @property
    def now(self) -> Column:
        return F.current_timestamp() if self.time is None else self.time

    def find(self, parts: tuple[str, ...]) -> Val:
        """Exact name, then qualified name, then a step into a struct or map."""
        whole = ".".join(parts).lower()
        if whole in self.columns:
            return self.columns[whole]
        for cut in range(len(parts) - 1, 0, -1):
            if head := self.columns.get(".".join(parts[:cut]).lower()):
                if (got := self.step(head, parts[cut:])) is not None:
                    return got
        if len(parts) > 1 and (v := self.columns.get(parts[-1].lower())) is not None and not self.qualifiers:
            return v
        if self.lenient:
            return nothing(missing=True)
        raise CompileProblem(f"no column {whole!r}")

    @property
    def qualifiers(self) -> set[str]:
        return {k.split(".")[0] for k in self.columns if "." in k}

    @staticmethod
    def step(v: Val, rest: tuple[str, ...]) -> Val | None:
        for k, part in enumerate(rest):
            if v.kind == "map":
                key = ".".join(rest[k:])  # a key may hold points
                return Val(F.coalesce(F.try_element_at(v.col, F.lit(key)), F.try_element_at(v.col, F.lit(part))), v.type.valueType)
            if v.kind != "struct":
                return None
            f = next((f for f in v.type.fields if f.name.lower() == part.lower()), None)
            if f is None:
                return None
            v = Val(v.col.getField(f.name), f.dataType)
        return v


def glob_to_like(pattern: str) -> str:
    """A glob (``*`` and ``%`` match anything, a backslash escapes) as a LIKE pattern with ``\\`` as escape."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            k += 1
            out.append("\\" + pattern[k] if pattern[k] in "%_\\" else pattern[k])
        else:
            out.append("%" if c in "*%" else "\\" + c if c in "_\\" else c)
        k += 1
    return "".join(out)


def glob_match(text: Column, pattern: Val) -> Column:
    if isinstance(pattern.literal, str):
        return F.like(text, F.lit(glob_to_like(pattern.literal)), F.lit("\\"))
    p = F.regexp_replace(F.regexp_replace(to_str(pattern), r"([\\\\_])", r"\\$1"), r"\*", "%")
    return F.like(text, p, F.lit("\\"))


class Compiler:
    def __init__(self, scope: Scope):
        self.scope, self.depth = scope, 0

    def __call__(self, node: t.Node) -> Val:
        self.depth += 1
        if self.depth > 1000:
            raise CompileProblem("the expression is nested too deeply")
        out = getattr(self, f"_{type(node).__name__.lower()}")(node)
        self.depth -= 1
        return out

    # Leaves.
    def _lit(self, n: t.Lit) -> Val:
        return lit(n.value)

    def _name(self, n: t.Name) -> Val:
        return self.scope.find(n.parts)

    def _variable(self, n: t.Variable) -> Val:
        key = n.name.lower()
        if key not in self.scope.variables:
            if self.scope.lenient or key.startswith("@") and not key.startswith("@@"):
                return lit(None)
            raise CompileProblem(f"no variable {n.name}")
        return lit(self.scope.variables[key])

    def _param(self, n: t.Param) -> Val:
        if n.index >= len(self.scope.params):
            raise CompileProblem(f"no value for parameter {n.index + 1}")
        return lit(self.scope.params[n.index])

    def _everything(self, n: t.Everything) -> Val:
        return Val(F.lit(True), BOOL, predicate=True)

    def _items(self, n: t.Items) -> Val:
        return array_of([self(x) for x in n.items])

    def _include(self, n: t.Include) -> Val:
        return self(inline(n, self.scope.filters))

    def _call(self, n: t.Call) -> Val:
        from siftql.functions import REGISTRY

        name = n.name
        if is_aggregate(n) and self.scope.aggregate:
            return self.aggregate(name, n.args)
        spec = self.scope.functions.get(name) or REGISTRY.get(name)
        if spec is None:
            raise CompileProblem(f"no function {name!r}")
        return spec(self, n.args)

    # Logic.
    def truth(self, node: t.Node) -> Val:
        """A node as a condition."""
        v = self(node)
        if v.kind == "bool":
            return v
        if v.kind in ("int", "float"):
            return Val(v.col != 0, BOOL)
        if v.missing or v.kind == "null":
            return nothing(BOOL)
        if v.kind == "str":
            return Val(to_bool(v), BOOL)
        raise CompileProblem("a condition is neither true nor false")

    def condition(self, node: t.Node) -> Column:
        """For filters: rows where it is NULL are dropped by them."""
        v = self(node)
        if v.kind not in ("bool", "null"):
            raise CompileProblem("a filter is neither true nor false")
        return v.col.cast("boolean")

    @staticmethod
    def solid(v: Val) -> Column:
        """A predicate without NULL."""
        return F.coalesce(v.col, F.lit(False)) if v.predicate else v.col

    def _group(self, n: t.Group) -> Val:
        if not n.items:
            return Val(F.lit(True), BOOL, predicate=True)
        items = [self.truth(x) for x in n.items]
        if n.op == "and":
            return Val(all_of([i.col for i in items]), BOOL)
        return Val(any_of([i.col for i in items]), BOOL, predicate=True)

    def _unary(self, n: t.Unary) -> Val:
        if n.op == "-":
            return Val(-to_float(self(n.item)), FLOAT)
        if n.op == "exists":
            v = self(n.item)
            return Val(F.lit(False) if v.missing else ~nil(v), BOOL, predicate=True)
        if n.op in ("is null", "is not null"):
            v = self(n.item)
            if n.op == "is null":
                return Val(v.col.isNull(), BOOL, predicate=True)
            return Val(v.col.isNotNull() & (v.col != "") if v.kind == "str" else v.col.isNotNull(), BOOL, predicate=True)
        return Val(~self.solid(self.truth(n.item)), BOOL)

    def _between(self, n: t.Between) -> Val:
        """Both ends are excluded."""
        x, low, high = self(n.item), self(n.low), self(n.high)
        if x.kind == "time":
            out = Val(self.compare(">", x, low) & self.compare("<", x, high), BOOL, predicate=True)
            return Val(~self.solid(out), BOOL) if n.negated else out
        elif x.kind in ("int", "float") and {low.kind, high.kind} <= {"int", "float"}:
            x, low, high = x.col, low.col, high.col
        else:
            x, low, high = to_float(x), to_float(low), to_float(high)
        out = Val((x > low) & (x < high), BOOL, predicate=True)
        return Val(~self.solid(out), BOOL) if n.negated else out

    def _binary(self, n: t.Binary) -> Val:
        op = n.op
        if op in ("and", "or"):
            a, b = self.truth(n.left), self.truth(n.right)
            return Val(a.col & b.col, BOOL, predicate=a.predicate and b.predicate) if op == "and" else Val(a.col | b.col, BOOL, predicate=True)
        left = self(n.left)
        if op == "in" and isinstance(n.right, t.Select):
            raise CompileProblem("IN (SELECT ...) may only stand at the top of WHERE")
        right = self(n.right)
        if op in "+-*/%":
            return self.arithmetic(op, left, right)
        if op in ("in", "intersects", "contains", "like"):
            out = Val({"in": self.is_in, "intersects": self.intersects, "contains": self.contains, "like": self.like}[op](left, right), BOOL, predicate=True)
            return Val(~self.solid(out), BOOL) if n.negated else out
        return Val(self.compare(op, left, right), BOOL, predicate=True)

    def compare(self, op: str, a: Val, b: Val) -> Column:
        if a.missing and b.missing:
            return F.lit(False)
        if b.is_null_literal or a.is_null_literal:
            v = a if b.is_null_literal else b
            if v.missing:
                return F.lit(op == "=")
            if v.is_null_literal:
                return F.lit(op in ("=", "!="))
            return nil(v) if op == "=" else ~nil(v) if op == "!=" else F.lit(False)
        if a.missing or b.missing:
            return F.lit(op == "!=")
        if a.kind == "array" and b.kind == "time" or a.kind == "array" and isinstance(a.type.elementType, (T.TimestampType, T.TimestampNTZType)):
            at = F.unix_seconds(to_time(b, self.scope.now))
            return F.exists(a.col, lambda x: self.sign(op, F.unix_seconds(x.cast("timestamp")), at))
        if a.kind == "time" and b.is_literal and not a.is_literal:
            out = self.at_second(op, a, b)
        elif b.kind == "time" and a.is_literal and not b.is_literal:
            out = self.at_second({"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op), b, a)
        else:
            out = self.sign(op, *self.aligned(a, b))
        # A NULL differs from everything.
        return F.coalesce(out, F.lit(True)) if op == "!=" else out

    def at_second(self, op: str, x: Val, at: Val) -> Column:
        """A time against a literal by whole seconds, as bounds on the bare column, which reach the scan."""
        second = F.unix_seconds(to_time(at, self.scope.now))

        def bound(k: Column) -> Column:
            """The first value of the column's type that is not before second ``k``."""
            moment = F.timestamp_seconds(k)
            if isinstance(x.type, T.DateType):
                return F.date_add(F.to_date(moment - F.expr("INTERVAL 1 MICROSECOND")), 1)
            return moment.cast(x.type)

        low, high = bound(second), bound(second + 1)
        match op:
            case ">":
                return x.col >= high
            case ">=":
                return x.col >= low
            case "<":
                return x.col < low
            case "<=":
                return x.col < high
            case "=":
                return (x.col >= low) & (x.col < high)
        return (x.col < low) | (x.col >= high)

    @staticmethod
    def sign(op: str, x: Column, y: Column) -> Column:
        return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def aligned(self, a: Val, b: Val) -> tuple[Column, Column]:
        """Both sides in the type that the left one asks for."""
        kinds = {a.kind, b.kind}
        if a.kind == b.kind and a.kind not in ("time",) or kinds == {"int", "float"}:
            return a.col, b.col
        if "time" in kinds:
            return F.unix_seconds(to_time(a, self.scope.now)), F.unix_seconds(to_time(b, self.scope.now))
        if a.kind == "bool" or b.kind == "bool":
            return to_bool(a), to_bool(b)
        if kinds & {"int", "float"}:
            return to_float(a), to_float(b)
        return to_str(a), to_str(b)

    def arithmetic(self, op: str, a: Val, b: Val) -> Val:
        a, b = first_of(a), first_of(b)
        if a.kind == b.kind == "time" or "time" in (a.kind, b.kind):
            a, b = (Val(to_float(v), FLOAT) for v in (a, b))
        if a.kind == "int" and b.kind == "int":
            x, y = a.col.cast("long"), b.col.cast("long")
            if op == "/":
                zero = b.literal == 0 if b.is_literal else None
                whole = F.call_function("div", x, y) if b.is_literal and not zero else F.call_function("div", x, F.nullif(y, F.lit(0)))
                return Val(whole, INT)
            return Val({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "%": F.try_mod}[op](x, y), INT)
        if a.kind == "str" and b.kind == "str" and op == "+":
            both = to_float(a) + to_float(b)
            return Val(both, FLOAT)
        x, y = to_float(a), to_float(b)
        if op == "%":
            return Val(F.try_mod(x.try_cast("long"), y.try_cast("long")), INT)
        return Val(F.try_divide(x, y) if op == "/" else {"+": x + y, "-": x - y, "*": x * y}[op], FLOAT)

    def is_in(self, a: Val, b: Val) -> Column:
        if a.missing or b.missing or a.kind == "null":
            return F.lit(False)
        if a.kind == "array":
            return self.intersects(a, b)
        if b.kind == "map":
            return F.map_contains_key(b.col, to_str(a))
        if b.kind != "array":
            b = array_of([b])
        kind = b.type.elementType
        element = Val(F.lit(None), kind)
        if {a.kind, element.kind} <= {"int", "float"} or a.kind == element.kind:
            return F.array_contains(b.col.cast(T.ArrayType(a.type)) if a.type != kind and a.kind != "int" else b.col, a.col.cast(kind) if a.kind == "int" else a.col)
        if a.kind in ("int", "float"):
            return F.exists(b.col, lambda x: to_float(Val(x, kind)) == to_float(a))
        return F.exists(b.col, lambda x: to_str(Val(x, kind)) == to_str(a))

    def intersects(self, a: Val, b: Val) -> Column:
        if a.missing or b.missing:
            return F.lit(False)
        x = F.map_keys(a.col) if a.kind == "map" else a.col.cast("array<string>") if a.kind == "array" else F.array(to_str(a))
        y = F.map_keys(b.col) if b.kind == "map" else b.col.cast("array<string>") if b.kind == "array" else F.array(to_str(b))
        return F.arrays_overlap(x, y)

    def contains(self, a: Val, b: Val) -> Column:
        if a.missing or b.missing:
            return F.lit(False)
        if a.kind == "array":
            kind = a.type.elementType
            if b.kind in ("int", "float"):
                return F.exists(a.col, lambda x: to_float(Val(x, kind)) == to_float(b))
            return F.exists(a.col, lambda x: F.contains(to_str(Val(x, kind)), to_str(b)))
        if a.kind == "map":
            return F.map_contains_key(a.col, to_str(b))
        if b.kind == "array":
            kind = b.type.elementType
            return F.exists(b.col, lambda x: F.contains(to_str(a), to_str(Val(x, kind))))
        return F.contains(to_str(a), to_str(b))

    def like(self, a: Val, b: Val) -> Column:
        if a.missing or b.missing or a.kind == "null":
            return F.lit(False)
        if a.kind == "array":
            return F.exists(a.col.cast("array<string>"), lambda x: glob_match(x, b))
        if b.kind == "array":
            return F.exists(b.col.cast("array<string>"), lambda p: glob_match(to_str(a), Val(p, STR)))
        return glob_match(to_str(a), b)

    # Aggregates.
    def aggregate(self, name: str, args: tuple[t.Node, ...]) -> Val:
        inner = Compiler(Scope(**{**self.scope.__dict__, "aggregate": False}))
        if name == "count":
            if not args or isinstance(args[0], t.Everything):
                return Val(F.count(F.lit(1)), INT)
            if isinstance(args[0], t.Call) and args[0].name == "distinct":
                return Val(F.count_distinct(inner(args[0].args[0]).col), INT)
            return Val(F.count(inner(args[0]).col), INT)
        if len(args) != 1:
            raise CompileProblem(f"{name} takes one argument")
        v = inner(args[0])
        if name in ("sum", "avg"):
            if v.kind == "int" or isinstance(v.type, T.DecimalType):
                return Val(F.sum(v.col) if name == "sum" else F.avg(v.col), INT if name == "sum" and v.kind == "int" else FLOAT)
            x = v.col if v.kind == "float" else to_float(v)
            return Val(float_sum(x) if name == "sum" else F.try_divide(float_sum(x), F.count(x)), FLOAT)
        if name == "approx_count_distinct":
            return Val(F.approx_count_distinct(v.col), INT)
        return Val(F.min(v.col) if name == "min" else F.max(v.col), v.type)


def inline(node: t.Node, filters: dict[str, t.Node], depth: int = 0, inside: tuple[str, ...] = ()) -> t.Node:
    """The tree with every INCLUDE replaced by the filter that it names; cycles are refused."""

    def change(n):
        if not isinstance(n, t.Include):
            return n
        if n.name in inside or depth > INCLUDE_DEPTH:
            raise CompileProblem(f"the filter {n.name!r} includes itself")
        if n.name not in filters:
            raise CompileProblem(f"no filter {n.name!r}")
        return inline(filters[n.name], filters, depth + 1, (*inside, n.name))

    return t.rewrite(node, change)


def is_aggregate(node) -> bool:
    """Whether a call sums up rows; sum and avg of several arguments work within a row."""
    return isinstance(node, t.Call) and node.name in AGGREGATES and len(node.args) <= 1


def has_aggregate(node) -> bool:
    return any(is_aggregate(x) for x in t.walk(node))


def auto_name(node: t.Node) -> str:
    """The name of a column without one."""
    from siftql.lang.writer import write

    if isinstance(node, t.Name):
        return node.parts[-1]
    if isinstance(node, t.Call):
        if node.name == "count" and (not node.args or isinstance(node.args[0], t.Everything)):
            return "count(*)"
        if inner := next((n for a in node.args for n in t.names(a)), None):
            short = inner.split(".")[-1]
            prefix = {"count": "ct", "sum": "sum", "avg": "avg", "min": "min", "max": "max"}.get(node.name)
            return f"{prefix}_{short}" if prefix else short
        return node.name
    return re.sub(r"\s+", " ", write(node))


def compile_expression(text_or_node, df: DataFrame, **scope) -> Val:
    node = parse_expression(text_or_node) if isinstance(text_or_node, str) else text_or_node
    return Compiler(Scope.of(df, **({"lenient": True} | scope)))(node)


__all__ = ["BOOL", "FLOAT", "INT", "STR", "Compiler", "Scope", "Val", "auto_name", "compile_expression", "convert", "glob_to_like", "has_aggregate", "inline", "some", "to_float", "to_int"]
