"""SQLite tables as a Python data source, read in ranges of row ids; comparisons with literals run in SQLite."""

from __future__ import annotations

import sqlite3

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

_KINDS = (("INT", "bigint"), ("CHAR", "string"), ("TEXT", "string"), ("CLOB", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("NUM", "double"), ("BOOL", "bigint"))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def condition(f, names: list[str]) -> tuple[str, list] | None:
    """A filter as SQL and its parameters; None where SQLite might judge otherwise than Spark."""
    if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in names:
        return None
    name = quoted(f.attribute[0])
    if isinstance(f, (IsNull, IsNotNull)):
        return f"{name} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []
    values = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
    if not values or not all(type(v) in (int, float, str) for v in values):
        return None
    # Values that are stored under another type than the column's are left to Spark.
    kind = "'text'" if isinstance(values[0], str) else "'integer', 'real'"
    test = f"{name} IN ({', '.join('?' * len(values))})" if isinstance(f, In) else f"{name} {_SIGNS[type(f)]} ?" if type(f) in _SIGNS else None
    return (f"({test} OR typeof({name}) NOT IN ({kind}))", values) if test else None


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table, self.names = options["path"], options["table"], schema.fieldNames()
        self.parts = int(options.get("partitions", 4))
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters):
        """Rows are narrowed in SQLite; Spark applies every filter again, so a looser condition is enough."""
        for f in filters:
            if got := condition(f, self.names):
                self.where.append(got)
            yield f

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition):
        low, high = partition.value
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            tests = " AND ".join(["rowid >= ? AND rowid < ?", *[test for test, _ in self.where]])
            yield from con.execute(f"SELECT {', '.join(map(quoted, self.names))} FROM {quoted(self.table)} WHERE {tests}", (low, high, *[v for _, values in self.where for v in values]))


class SqliteSource(DataSource):
    @classmethod
    def name(cls):
        return "siftql_sqlite"

    def schema(self):
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            rows = con.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        return ", ".join(f"`{r[1]}` {next((k for part, k in _KINDS if part in r[2].upper()), 'string')}" for r in rows)

    def reader(self, schema):
        return SqliteReader(self.options, schema)
