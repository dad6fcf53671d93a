"""Arrays, maps, and filters over them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftql.functions import function
from siftql.lang import tree as t
from siftql.plans.values import STR, TIME, CompileProblem, Val, any_of, array_of, common, convert, nil, to_int, to_str, to_time

LIST = T.ArrayType(STR)


@function("array.index", least=2, most=2)
def array_index(c, a, i):
    """From 0 on, from -1 back; NULL out of bounds."""
    if a.kind != "array":
        return Val(F.lit(None).cast("string"), STR)
    k = to_int(i).cast("int")
    return Val(F.try_element_at(a.col, F.when(k >= 0, k + 1).otherwise(k)), a.type.elementType)


@function("array.slice", least=2, most=3)
def array_slice(c, a, start, *end):
    if a.kind != "array":
        return Val(F.lit(None).cast(LIST), LIST)
    n = F.size(a.col)
    place = lambda v: F.when(to_int(v) < 0, to_int(v) + n).otherwise(to_int(v)).cast("int")
    i = place(start)
    j = place(end[0]) if end else n
    return Val(F.when((i >= 0) & (i <= j) & (j <= n), F.slice(a.col, F.greatest(i + 1, F.lit(1)), F.greatest(j - i, F.lit(0)))), a.type)


@function("map", least=2, most=2)
def make_map(c, k, v):
    return Val(F.when(~nil(k) & ~nil(v), F.create_map(to_str(k), v.col)), T.MapType(STR, v.type))


@function("maptime", least=1, most=2)
def map_time(c, k, *at):
    when = to_time(at[0], c.scope.now) if at else c.scope.now
    return Val(F.when(~nil(k) & when.isNotNull(), F.create_map(F.lower(to_str(k)), when)), T.MapType(STR, TIME))


@function("match", most=None, raw=True)
def match(c, args):
    """A map of the row's columns whose name has a prefix, the prefix cut off."""
    pairs = []
    for a in args:
        prefix = str(a.value if isinstance(a, t.Lit) else a.text).lower()
        pairs += [(n[len(prefix) :], v) for n, v in c.scope.columns.items() if n.startswith(prefix)]
    if not pairs:
        return Val(F.lit(None).cast("map<string,string>"), T.MapType(STR, STR))
    kind = common([v for _, v in pairs])
    made = F.map_from_arrays(F.array(*[F.lit(n) for n in dict(pairs)]), F.array(*[convert(v, kind) for v in dict(pairs).values()]))
    kept = F.map_filter(made, lambda k, v: v.isNotNull())
    return Val(F.when(F.size(kept) > 0, kept), T.MapType(STR, kind))


@function("mapkeys", most=None)
def map_keys(c, *ms):
    parts = [F.coalesce(F.map_keys(m.col), F.array().cast(LIST)) for m in ms if m.kind == "map"]
    if not parts:
        return Val(F.lit(None).cast(LIST), LIST)
    return Val(F.array_sort(F.array_distinct(F.concat(*parts))), LIST)


@function("mapvalues", most=None)
def map_values(c, *ms):
    parts = [F.coalesce(F.transform(F.map_values(m.col), lambda x, k=m.type.valueType: to_str(Val(x, k))), F.array().cast(LIST)) for m in ms if m.kind == "map"]
    if not parts:
        return Val(F.lit(None).cast(LIST), LIST)
    return Val(F.array_sort(F.array_distinct(F.filter(F.concat(*parts), lambda x: x.isNotNull() & (x != "")))), LIST)


@function("mapinvert")
def map_invert(c, m):
    """Values to keys; of equal values the greatest key stays."""
    if m.kind != "map":
        return Val(F.lit(None).cast("map<string,string>"), T.MapType(STR, STR))
    kind = m.type.valueType
    entries = F.array_sort(F.transform(F.map_entries(m.col), lambda e: F.struct(to_str(Val(e["value"], kind)).alias("k"), e["key"].alias("v"))))
    last = F.filter(entries, lambda e, i: e["k"].isNotNull() & ~F.coalesce(F.get(entries, i + 1)["k"] == e["k"], F.lit(False)))
    return Val(F.map_from_entries(last), T.MapType(STR, STR))


def pattern_of(v: Val) -> str:
    """A literal pattern as an anchored regular expression: a glob if it has a wildcard, else a prefix."""
    if not isinstance(v.literal, str):
        raise CompileProblem("patterns must be literal strings")
    p = v.literal
    if "*" in p or "%" in p:
        return "(?s)^" + ".*".join(re.escape(x) for x in re.split(r"[*%]", p)) + "$"
    return "(?s)^" + re.escape(p)


def _fits(text, patterns):
    return any_of([F.coalesce(text.rlike(pattern_of(p)), F.lit(False)) for p in patterns])


def _patterns(args):
    out = []
    for a in args:
        if a.kind == "array" and a.literal is None:
            raise CompileProblem("patterns must be literal strings")
        out.append(a)
    return out


def _kept(x, args, keep):
    patterns = _patterns(args)
    test = lambda s: _fits(s, patterns) if keep else ~_fits(s, patterns)
    if x.kind == "map":
        got = F.map_filter(x.col, lambda k, v: test(k))
        return Val(F.when(F.size(got) > 0, got), x.type)
    if x.kind == "array":
        kind = x.type.elementType
        got = F.filter(x.col, lambda e: test(to_str(Val(e, kind))))
        return Val(F.when(F.size(got) > 0, got), x.type)
    return Val(F.when(test(to_str(x)), to_str(x)), STR)


@function("filter", least=2, most=None)
def filter_out(c, x, *patterns):
    return _kept(x, patterns, False)


@function("filtermatch", "filterin", least=2, most=None)
def filter_in(c, x, *patterns):
    return _kept(x, patterns, True)


@function("distinct")
def distinct(c, x):
    return Val(F.array_distinct(x.col), x.type) if x.kind == "array" else x


@function("array", least=0, most=None)
def make_array(c, *xs):
    return array_of(list(xs))
