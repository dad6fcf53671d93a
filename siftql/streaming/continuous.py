"""The language over streams: the same columns on ``readStream`` frames, and windows for continuous views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from siftql.lang import tree as t
from siftql.lang.parser import parse_filter, parse_statement
from siftql.operators.select import Planner
from siftql.plans.expressions import Compiler, Scope


def filter_stream(engine, stream: DataFrame, text: str) -> DataFrame:
    """Rows of a stream that a filter keeps; a limit is refused, since a stream has no end."""
    f = parse_filter(text)
    if f.limit is not None:
        raise ValueError("a stream has no first rows")
    return Planner(engine).filter(f, stream)


def select_stream(engine, stream: DataFrame, text: str) -> DataFrame:
    """A SELECT without ORDER BY and LIMIT over a stream, under any table name."""
    s = parse_statement(text)
    if s.order or s.limit is not None or s.offset:
        raise ValueError("a stream has no order")
    return Planner(engine).select_from(s, stream)


def windowed(stream: DataFrame, time_col: str, length: str, aggregates: dict[str, str], *, keys: tuple[str, ...] = (), slide: str | None = None, gap: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Aggregates of expressions of the language in windows of event time: tumbling, sliding (``slide``) or sessions (``gap``).

    State is dropped once it is ``late`` behind the newest event.
    """
    kind = stream.schema[time_col].dataType
    if not isinstance(kind, TimestampType):  # watermarks are on times with a zone
        stream = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))
    marked = stream.withWatermark(time_col, late)
    span = F.session_window(time_col, gap) if gap else F.window(time_col, length, slide)
    comp = Compiler(Scope.of(stream, lenient=True, aggregate=True))
    made = [comp(t.Call(a.name, a.args)).col.alias(n) for n, a in ((n, _call(e)) for n, e in aggregates.items())]
    name = "session_window" if gap else "window"
    out = marked.groupBy(span, *keys).agg(*made)
    return out.select(F.col(f"{name}.start").cast(kind).alias("start"), F.col(f"{name}.end").cast(kind).alias("end"), *keys, *aggregates)


def _call(text: str) -> t.Call:
    from siftql.lang.parser import parse_expression

    node = parse_expression(text)
    if not isinstance(node, t.Call):
        raise ValueError(f"{text!r} is no aggregate")
    return node
