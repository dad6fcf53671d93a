"""The earliest instant at which a filter with date math may change its verdict for a row."""

from __future__ import annotations

import datetime as dt

from siftql.lang import tree as t
from siftql.lang.parser import parse_expression
from siftql.plans.values import DATE_MATH

_DAYS = {"s": 1 / 86400, "m": 1 / 1440, "h": 1 / 24, "d": 1, "w": 7}


def shift(now: dt.datetime, text: str) -> dt.datetime | None:
    if not (m := DATE_MATH.match(text)):
        return None
    if not m[1]:
        return now
    n = int(m[2]) * (1 if m[1] == "+" else -1)
    if m[3] in _DAYS:
        return now + dt.timedelta(days=n * _DAYS[m[3]])
    month = now.month - 1 + (n if m[3] == "M" else 12 * n)
    year, month = now.year + month // 12, month % 12 + 1
    last = (dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)).day
    return now.replace(year=year, month=month, day=min(now.day, last))


def next_change(text_or_node, row: dict, now: dt.datetime, filters: dict | None = None) -> dt.datetime | None:
    """The first time after ``now`` when a date comparison in the filter changes for ``row``; None if none does."""
    from siftql.plans.expressions import inline

    node = inline(parse_expression(text_or_node) if isinstance(text_or_node, str) else text_or_node, filters or {})
    found: list[dt.datetime] = []

    def consider(name, literal) -> None:
        if isinstance(name, t.Name) and isinstance(literal, t.Lit) and isinstance(literal.value, str) and (edge := shift(now, literal.value)) is not None:
            value = row.get(name.text)
            for v in value if isinstance(value, (list, tuple)) else [value]:
                if isinstance(v, dt.datetime):
                    at = now + (v - edge)  # when the moving edge meets the value
                    if at > now:
                        found.append(at)

    for n in t.walk(node):
        if isinstance(n, t.Binary) and n.op in ("=", "!=", "<", "<=", ">", ">="):
            consider(n.left, n.right)
            consider(n.right, n.left)
        elif isinstance(n, t.Between):
            consider(n.item, n.low)
            consider(n.item, n.high)
    return min(found, default=None)
