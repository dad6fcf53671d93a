"""Strings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftql.functions import function
from siftql.plans.values import BOOL, INT, STR, Val, nil, some, to_int, to_str

LIST = T.ArrayType(STR)


def filled(v):
    """Text, NULL if empty."""
    return F.nullif(to_str(v), F.lit(""))


@function("contains", least=2, most=2)
def contains(c, s, sub):
    if s.missing or s.kind == "null":
        return Val(F.lit(False), BOOL)
    return Val(F.when(sub.col.isNull() | (to_str(sub) == "") | (to_str(s) == ""), F.lit(None).cast("boolean")).otherwise(F.coalesce(F.contains(to_str(s), to_str(sub)), F.lit(False))), BOOL)


@function("tolower", "string.lowercase", "lower")
def lower(c, s):
    return Val(F.lower(filled(s)), STR)


@function("string.uppercase", "toupper", "upper")
def upper(c, s):
    return Val(F.upper(filled(s)), STR)


@function("string.titlecase")
def title(c, s):
    """First letters of words in upper case, the rest as it is."""
    parts = F.transform(F.split(filled(s), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    return Val(F.array_join(parts, " "), STR)


@function("string.index", least=2, most=2)
def index(c, s, sub):
    """Bytes before the first occurrence."""
    at = F.instr(to_str(s), to_str(sub))
    return Val(F.when(at > 0, F.octet_length(F.substring(to_str(s), F.lit(1), at - 1))).cast("long"), INT)


@function("string.substr", least=2, most=3)
def substr(c, s, start, *end):
    """Bytes from ``start`` up to ``end``; NULL out of range."""
    raw = to_str(s).cast("binary")
    size = F.octet_length(to_str(s)).cast("long")
    i = to_int(start)
    j = to_int(end[0]) if end else size
    return Val(F.when((i >= 0) & (i <= j) & (j <= size) & (i < size), F.decode(F.substring(raw, (i + 1).cast("int"), (j - i).cast("int")), "UTF-8")), STR)


@function("split", "string.split", least=2, most=2)
def split(c, s, sep):
    quoted = F.concat(F.lit("\\Q"), F.replace(filled(sep), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return Val(F.split(filled(s), quoted), LIST)


@function("strip", "string.strip")
def strip(c, s):
    cut = lambda x: F.btrim(x, F.lit(" \n\t\r"))
    return Val(F.transform(s.col.cast("array<string>"), cut), LIST) if s.kind == "array" else Val(cut(to_str(s)), STR)


@function("replace", least=2, most=3)
def replace(c, s, old, *new):
    return Val(F.replace(to_str(s), to_str(old), to_str(new[0]) if new else F.lit("")), STR)


@function("join", least=2, most=None)
def join(c, *xs):
    *parts, sep = xs
    arrays = [p.col.cast("array<string>") if p.kind == "array" else F.array(to_str(p)) for p in parts]
    flat = F.filter(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]), lambda x: x.isNotNull() & (x != ""))
    return Val(F.when(F.size(flat) > 0, F.array_join(flat, str(sep.literal)) if sep.is_literal else F.aggregate(F.slice(flat, F.lit(2), F.size(flat)), F.get(flat, F.lit(0)), lambda a, x: F.concat(a, to_str(sep), x))), STR)


@function("hasprefix", least=2, most=2)
def has_prefix(c, s, p):
    return Val(F.startswith(to_str(s), filled(p)), BOOL)


@function("hassuffix", least=2, most=2)
def has_suffix(c, s, p):
    return Val(F.endswith(to_str(s), filled(p)), BOOL)


@function("len", "char_length")
def length(c, x):
    """Bytes of a string, items of an array or map, 0 for other scalars."""
    if x.kind == "null":
        return Val(F.lit(None).cast("long"), INT)
    if x.kind in ("array", "map"):
        return Val(F.when(x.col.isNotNull(), F.size(x.col)).cast("long"), INT)
    if x.kind in ("str", "binary"):
        return Val(F.octet_length(x.col).cast("long"), INT)
    return Val(F.when(x.col.isNotNull(), F.lit(0)).cast("long"), INT)


__all__ = ["filled", "nil", "some"]
