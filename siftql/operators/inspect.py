"""SHOW and DESCRIBE: the catalogue as small frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siftql.lang import tree as t
from siftql.plans.expressions import Compiler, Scope, glob_match
from siftql.plans.values import CompileProblem, lit

MYSQL_TYPES = {"long": "bigint", "integer": "int(4)", "short": "int(4)", "byte": "int(4)", "double": "float", "float": "float", "string": "varchar(255)", "boolean": "bool", "timestamp": "datetime", "timestamp_ntz": "datetime", "date": "datetime", "binary": "text"}
INDEX_COLUMNS = ("Table", "Non_unique", "Key_name", "Seq_in_index", "Column_name", "Collation", "Cardinality", "Sub_part", "Packed", "Null", "Index_type", "Comment", "Index_comment")
ROUTINE_COLUMNS = ("Db", "Name", "Type", "Definer", "Modified", "Created", "Security_type", "Comment", "character_set_client", "collation_connection", "Database_Collation")
ENGINE_COLUMNS = ("Engine", "Support", "Comment", "Transactions", "XA", "Savepoints")


def mysql_type(kind: T.DataType) -> str:
    return MYSQL_TYPES.get(kind.typeName(), "text")


def frame(engine, columns, rows) -> DataFrame:
    return engine.spark.createDataFrame(rows, T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def create_text(engine, name: str) -> str:
    lines = []
    for f in engine.table(name).schema.fields:
        lines.append(f"    `{f.name}` {mysql_type(f.dataType)} {'DEFAULT NULL' if f.nullable else 'NOT NULL'}")
    if key := engine.key_of(name):
        lines.append(f"    PRIMARY KEY (`{key}`)")
    return f"CREATE TABLE `{name}` (\n" + ",\n".join(lines) + "\n) ENGINE=InnoDB DEFAULT CHARSET=utf8;"


def describe(engine, name: str, full: bool = False) -> DataFrame:
    key = engine.key_of(name)
    columns = ("Field", "Type", "Collation", "Null", "Key", "Default", "Extra", "Privileges", "Comment") if full else ("Field", "Type", "Null", "Key", "Default", "Extra")
    rows = []
    for f in engine.table(name).schema.fields:
        row = {"Field": f.name, "Type": mysql_type(f.dataType), "Null": "YES" if f.nullable else "NO", "Key": "PRI" if f.name == key else "", "Default": "", "Extra": "", "Collation": "", "Privileges": "", "Comment": f.metadata.get("comment", "")}
        rows.append(tuple(row[c] for c in columns))
    return frame(engine, columns, rows)


def show(engine, c: t.Command) -> DataFrame:
    what = c.what
    if what == "tables":
        schema = c.args[0] if c.args else None
        names = [(n, "BASE TABLE") for n in engine.tables(schema)]
        out = frame(engine, ("Table", "Table_Type"), names)
        out = out if c.full else out.select("Table")
    elif what == "create table":
        out = frame(engine, ("Table", "Create Table"), [(c.name, create_text(engine, c.name))])
    elif what in ("databases", "schemas"):
        out = frame(engine, ("Database",), [(s,) for s in engine.schemas()])
    elif what in ("columns", "fields"):
        out = describe(engine, c.name, c.full)
    elif what in ("keys", "index", "indexes"):
        out = frame(engine, INDEX_COLUMNS, [])
    elif what in ("variables", "status"):
        rows = sorted((k.lstrip("@"), str(v)) for k, v in engine.variables.items() if k.startswith("@@")) if what == "variables" else []
        out = frame(engine, ("Variable_name", "Value"), rows)
    elif what == "engines":
        out = frame(engine, ENGINE_COLUMNS, [("spark", "DEFAULT", "DataFrames", "NO", "NO", "NO")])
    elif what in ("procedure status", "function status"):
        out = frame(engine, ROUTINE_COLUMNS, [])
    else:
        raise CompileProblem(f"cannot show {what!r}")
    scope = Scope.of(out)
    if c.like is not None:
        return out.filter(glob_match(scope.columns[out.columns[0].lower()].col, lit(c.like)))
    if c.where is not None:
        return out.filter(Compiler(scope).condition(c.where))
    return out
