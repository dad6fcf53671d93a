"""Dates and times; all in UTC as far as the session's zone is."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from siftql.functions import function
from siftql.plans.values import FLOAT, INT, STR, TIME, CompileProblem, Val, parse_time, to_float, to_str, to_time


def moment(c, args):
    return to_time(args[0], c.scope.now) if args else c.scope.now


@function("now", least=0, most=0)
def now(c):
    return Val(c.scope.now, TIME)


def _part(names, build, kind=INT):
    @function(*names, least=0, most=1)
    def made(c, *args):
        return Val(build(moment(c, args)).cast(kind), kind)


def _short_year(d):
    y = F.year(d)
    return F.when(y >= 2000, y - 2000).when(y >= 1900, y - 1900).otherwise(y)


_part(["yy"], _short_year)
_part(["mm", "monthofyear"], F.month)
_part(["dayofweek"], lambda d: F.dayofweek(d) - 1)
_part(["hourofday"], F.hour)
_part(["hourofweek"], lambda d: (F.dayofweek(d) - 1) * 24 + F.hour(d))
_part(["yymm"], lambda d: F.date_format(d, "yyMM"), STR)


@function("totimestamp")
def to_seconds(c, d):
    return Val(F.unix_seconds(to_time(d, c.scope.now)), INT)


#: Pieces of a reference-time layout and the letters of the same meaning.
LAYOUT = [("2006", "yyyy"), ("January", "MMMM"), ("Jan", "MMM"), ("Monday", "EEEE"), ("Mon", "EEE"), ("MST", "z"), ("Z07:00", "XXX"), ("-07:00", "xxx"), ("-0700", "xx"), ("01", "MM"), ("02", "dd"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("15", "HH"), ("PM", "a"), ("_2", "d"), (".000", ".SSS"), (".999", ".SSS"), ("1", "M"), ("2", "d"), ("3", "h"), ("4", "m"), ("5", "s")]
_LAYOUT = re.compile("|".join(re.escape(a) for a, _ in LAYOUT))


def layout_pattern(layout: str) -> str:
    """A layout such as ``02/01/2006`` as a date pattern."""
    out, at, of = [], 0, dict(LAYOUT)
    for m in _LAYOUT.finditer(layout):
        out += [_quoted(layout[at : m.start()]), of[m[0]]]
        at = m.end()
    return "".join([*out, _quoted(layout[at:])])


def _quoted(s: str) -> str:
    return re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", s)


@function("todate", least=1, most=2)
def to_date(c, *args):
    if len(args) == 1:
        return Val(to_time(args[0], c.scope.now), TIME)
    layout, d = args
    if not isinstance(layout.literal, str):
        raise CompileProblem("the layout must be a literal string")
    return Val(F.try_to_timestamp(to_str(d), F.lit(layout_pattern(layout.literal))), TIME)


@function("todatein", least=2, most=2)
def to_date_in(c, d, zone):
    import zoneinfo

    try:
        zoneinfo.ZoneInfo(zone.literal)
    except Exception as e:
        raise CompileProblem(f"no time zone {zone.literal!r}") from e
    got = to_time(d, c.scope.now)
    # A text that names its own offset is not moved.
    own = to_str(d).rlike(r"(Z|[-+]\d{2}:?\d{2}|UTC)$") if d.kind == "str" else F.lit(False)
    return Val(F.when(own, got).otherwise(F.to_utc_timestamp(got, zone.literal)), TIME)


@function("seconds")
def seconds(c, x):
    """``M10:30`` and ``10:30`` as minutes and seconds, ``M30`` as seconds, numbers as they are, dates as seconds since 1970."""
    if x.kind == "time":
        return Val(F.unix_seconds(x.col.cast("timestamp")).cast("double"), FLOAT)
    if x.kind in ("int", "float"):
        return Val(to_float(x), FLOAT)
    s = to_str(x)
    clock = r"^[A-Za-z]?(?:(\d+(?:\.\d+)?):)??(?:(\d+(?:\.\d+)?):)?(\d+(?:\.\d+)?)$"
    group = lambda k: F.coalesce(F.regexp_extract(s, clock, k).try_cast("double"), F.lit(0.0))
    by_clock = group(1) * 3600 + group(2) * 60 + group(3)
    return Val(F.when(s.rlike(r"^-?\d+(\.\d+)?$"), s.try_cast("double")).when(s.rlike(clock), by_clock).otherwise(F.unix_seconds(parse_time(s)).cast("double")), FLOAT)


#: Directives of strftime and the letters of the same meaning.
DIRECTIVES = {"a": "EEE", "A": "EEEE", "b": "MMM", "B": "MMMM", "c": "EEE MMM d HH:mm:ss yyyy", "d": "dd", "f": "SSSSSS", "H": "HH", "I": "hh", "j": "DDD", "L": "SSS", "m": "MM", "M": "mm", "p": "a", "S": "ss", "y": "yy", "Y": "yyyy", "z": "xx", "Z": "z", "D": "MM/dd/yy", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "e": "d", "%": "%"}


def directive_pattern(text: str) -> str:
    out, k = [], 0
    while k < len(text):
        if text[k] == "%" and k + 1 < len(text):
            if text[k + 1] not in DIRECTIVES:
                raise CompileProblem(f"no directive %{text[k + 1]}")
            out.append(DIRECTIVES[text[k + 1]])
            k += 2
        else:
            out.append(f"'{text[k]}'" if text[k].isalpha() else "''" if text[k] == "'" else text[k])
            k += 1
    return "".join(out)


@function("strftime", "extract", least=2, most=2)
def strftime(c, d, f):
    if not isinstance(f.literal, str):
        raise CompileProblem("the format must be a literal string")
    at = to_time(d, c.scope.now)
    if f.literal == "%w":
        return Val((F.dayofweek(at) - 1).cast("string"), STR)
    return Val(F.date_format(at, directive_pattern(f.literal)), STR)


@function("unixtrunc", least=1, most=2)
def unix_trunc(c, d, *precision):
    """Seconds, ``s`` seconds.milliseconds, ``ms`` milliseconds, ``sm`` seconds.microseconds, as text."""
    at = to_time(d, c.scope.now)
    p = str(precision[0].literal).lower() if precision else "seconds_only"
    if p == "seconds_only":
        return Val(F.unix_seconds(at).cast("string"), STR)
    if p in ("ms", "milliseconds"):
        return Val(F.unix_millis(at).cast("string"), STR)
    parts = {"s": ("unix_millis", 1000, "%d.%03d"), "seconds": ("unix_millis", 1000, "%d.%03d"), "sm": ("unix_micros", 1_000_000, "%d.%06d"), "secondsmicro": ("unix_micros", 1_000_000, "%d.%06d")}
    if p not in parts:
        raise CompileProblem(f"no precision {p!r}")
    f, unit, shape = parts[p]
    n = F.call_function(f, at)
    return Val(F.format_string(shape, F.call_function("div", n, F.lit(unit)), F.abs(n % unit)), STR)
