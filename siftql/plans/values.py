"""Typed column expressions and the coercions between them.

A value that cannot be had is NULL of its static type; only ``try_`` functions are used, so nothing raises at run time.
An empty string counts as nil wherever nil-ness matters.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STR, INT, FLOAT, BOOL, TIME, NULL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(), T.NullType()
BINARY = T.BinaryType()


class CompileProblem(ValueError):
    """A text that parses but cannot be compiled against the columns in scope."""


@dataclass(frozen=True)
class Val:
    col: Column
    type: T.DataType
    literal: object = None  # the value of a literal, else None
    is_literal: bool = False
    missing: bool = False  # a name that is no column
    predicate: bool = False  # NULL stands for false

    @property
    def is_null_literal(self) -> bool:
        return self.is_literal and self.literal is None

    @property
    def kind(self) -> str:
        t = self.type
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return "int"
        if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            return "float"
        if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return "time"
        for cls, name in ((T.StringType, "str"), (T.BooleanType, "bool"), (T.ArrayType, "array"), (T.MapType, "map"), (T.StructType, "struct"), (T.BinaryType, "binary")):
            if isinstance(t, cls):
                return name
        return "null"


def lit(value) -> Val:
    kind = NULL if value is None else BOOL if isinstance(value, bool) else INT if isinstance(value, int) else FLOAT if isinstance(value, float) else TIME if isinstance(value, dt.datetime) else STR
    column = F.lit(value) if value is None or kind is not INT else F.lit(value).cast("long")
    return Val(column, kind, value, True)


def nothing(kind: T.DataType = NULL, missing: bool = False) -> Val:
    return Val(F.lit(None).cast(kind), kind, missing=missing)


def first_of(v: Val) -> Val:
    """An array where a scalar is expected stands for its first element."""
    return Val(F.try_element_at(v.col, F.lit(1)), v.type.elementType) if v.kind == "array" else v


def to_str(v: Val) -> Column:
    v = first_of(v)
    if v.kind == "time":
        return F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if v.kind == "binary":
        return F.decode(v.col, "UTF-8")
    return v.col.cast("string")


_MONEY = "[$,£€ ]"


def to_float(v: Val) -> Column:
    v = first_of(v)
    if v.kind == "float":
        return F.nanvl(v.col.cast("double"), F.lit(None).cast("double"))
    if v.kind == "int":
        return v.col.cast("double")
    if v.kind == "bool":
        return v.col.cast("int").cast("double")
    if v.kind == "time":
        return F.unix_millis(v.col.cast("timestamp")).cast("double")
    if v.kind == "str":
        plain = F.regexp_replace(v.col, _MONEY, "")
        # Words like "nan" and "infinity" are no numbers.
        return F.when(plain.rlike(r"^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(plain, 3, 15), 16, 10).cast("double")).when(plain.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), plain.try_cast("double"))
    return F.lit(None).cast("double")


def to_int(v: Val) -> Column:
    v = first_of(v)
    if v.kind == "int":
        return v.col.cast("long")
    if v.kind == "str":
        plain = F.regexp_replace(v.col, _MONEY, "")
        return F.coalesce(F.when(plain.rlike(r"^[-+]?\d+$"), plain.try_cast("long")), to_float(v).try_cast("long"))
    if v.kind == "time":
        return F.unix_millis(v.col.cast("timestamp"))
    return to_float(v).try_cast("long")


_TRUE, _FALSE = ("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")


def to_bool(v: Val) -> Column:
    v = first_of(v)
    if v.kind == "bool":
        return v.col
    if v.kind == "str":
        return F.when(v.col.isin(*_TRUE), True).when(v.col.isin(*_FALSE), False)
    if v.kind in ("int", "float"):
        return F.when(v.col == 1, True).when(v.col == 0, False)
    return F.lit(None).cast("boolean")


#: Shapes of dates and the patterns that read them; the first that fits is used.
DATE_SHAPES = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}(:\d{2})?(\.\d{1,9})?$", "yyyy-M-d H:mm[:ss][.SSSSSSSSS][.SSSSSS][.SSS][.SS][.S]"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}(:\d{2})?$", "yyyy/M/d H:mm[:ss]"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}(:\d{2})?$", "M/d/yyyy H:mm[:ss]"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}(:\d{2})? [AP]M$", "M/d/yyyy h:mm[:ss] a"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} [-+]\d{4}$", "yyyy-MM-dd HH:mm:ss xx"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} [-+]\d{4} UTC$", "yyyy-MM-dd HH:mm:ss xx 'UTC'"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} UTC$", "yyyy-MM-dd HH:mm:ss 'UTC'"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4} \d{1,2}:\d{2}:\d{2} [AP]M$", "MMM d, yyyy h:mm:ss a"),
    (r"^[A-Z][a-z]{3,8} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}$", "d MMM yyyy HH:mm:ss"),
    (r"^[A-Z][a-z]{2} [A-Z][a-z]{2} \d{1,2} \d{2}:\d{2}:\d{2} \d{4}$", "MMM d HH:mm:ss yyyy"),
]
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[-+]\d{2}:?\d{2})?$"


def parse_time(s: Column) -> Column:
    """A timestamp from text of any known shape, in UTC; NULL for others."""
    got = F.when(s.rlike(_ISO), s.try_cast("timestamp"))
    for shape, pattern in DATE_SHAPES:
        text = F.substring(s, 5, 100) if pattern.startswith("MMM d HH") else s
        got = got.when(s.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)))
    number = s.try_cast("long")
    got = got.when(s.rlike(r"^\d{14}$"), F.try_to_timestamp(s, F.lit("yyyyMMddHHmmss"))).when(s.rlike(r"^\d{8}$"), F.try_to_timestamp(s, F.lit("yyyyMMdd")))
    got = got.when(s.rlike(r"^\d{10}$"), F.timestamp_seconds(number)).when(s.rlike(r"^\d{13}$"), F.timestamp_millis(number))
    return got.when(s.rlike(r"^\d{16}$"), F.timestamp_micros(number)).when(s.rlike(r"^\d{19}$"), F.timestamp_micros(F.floor(number / 1000).cast("long")))


DATE_MATH = re.compile(r"^now\s*(?:([-+])\s*(\d+)\s*([smhdwMy]))?$")
_UNITS = {"s": "secs", "m": "mins", "h": "hours", "d": "days", "w": "weeks", "M": "months", "y": "years"}


def date_math(text: str, now: Column) -> Column | None:
    """``now``, ``now-3d``, ``now+2M`` ...; None if the text is no date math."""
    if not (m := DATE_MATH.match(text)):
        return None
    if not m[1]:
        return now
    amount = F.make_interval(**{_UNITS[m[3]]: F.lit(int(m[2]))})
    return now + amount if m[1] == "+" else now - amount


def to_time(v: Val, now: Column | None = None) -> Column:
    v = first_of(v)
    if v.kind == "time":
        return v.col.cast("timestamp")
    if v.kind == "str":
        if isinstance(v.literal, str) and (got := date_math(v.literal, F.current_timestamp() if now is None else now)) is not None:
            return got
        return parse_time(v.col)
    if v.kind == "int":
        return parse_time(v.col.cast("string"))
    return F.lit(None).cast("timestamp")


def nil(v: Val) -> Column:
    """Whether a value is missing, NULL or empty."""
    if v.kind == "str":
        return v.col.isNull() | (v.col == "")
    if v.kind in ("array", "map"):
        return v.col.isNull() | (F.size(v.col) == 0)
    if v.kind == "float":
        return v.col.isNull() | F.isnan(v.col)
    return v.col.isNull()


def some(v: Val) -> Val:
    """The value, NULL if it is nil."""
    return Val(F.when(~nil(v), v.col), v.type) if v.kind in ("str", "array", "map", "float") else v


def convert(v: Val, kind: T.DataType) -> Column:
    """``v`` as another type by the rules above."""
    if v.type == kind:
        return v.col
    if isinstance(kind, T.StringType):
        return to_str(v)
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return to_int(v).try_cast(kind)
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return to_float(v).try_cast(kind)
    if isinstance(kind, T.BooleanType):
        return to_bool(v)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return to_time(v).cast(kind)
    return v.col.try_cast(kind)


def common(vals: list[Val]) -> T.DataType:
    """The type that several values share, text if they do not."""
    kinds = {v.kind for v in vals if v.kind != "null"}
    if not kinds:
        return STR
    if kinds == {"int"}:
        return INT
    if kinds <= {"int", "float"}:
        return FLOAT
    if len(kinds) == 1:
        return next(v.type for v in vals if v.kind != "null")
    return STR


def array_of(vals: list[Val]) -> Val:
    kind = common(vals)
    if not vals:
        return Val(F.array().cast("array<string>"), T.ArrayType(STR))
    return Val(F.array(*[convert(v, kind) for v in vals]), T.ArrayType(kind))


def float_sum(x: Column) -> Column:
    """The sum of a group's doubles, rounded when its parts are put together, so that it does not hang on the order of rows.

    Each number is split without loss into multiples of 2^20, 1, 2^-20 and 2^-40 and what is left. The middle parts have
    about 20 bits, so their sums are exact over 2^33 rows, and the first one's while it is below 2^73; beyond, and in what
    is left, parts add up like any doubles.
    """
    x = x.cast("double")
    # Adding and taking away 1.5 * 2^(52 + k) rounds to a multiple of 2^k.
    rounded = [x + F.lit(1.5 * 2.0 ** (52 + k)) - F.lit(1.5 * 2.0 ** (52 + k)) for k in (20, 0, -20, -40)] + [x]
    first, *rest = [F.sum(rounded[0])] + [F.sum(b - a) for a, b in zip(rounded, rounded[1:])]
    return F.when(F.abs(first) < F.lit(float("inf")), reduce(lambda a, b: a + b, [*reversed(rest), first])).otherwise(first)


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)
