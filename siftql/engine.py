"""The engine: tables, named filters, functions, variables, and the three languages over them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftql.functions import Function
from siftql.lang import tree as t
from siftql.lang.parser import parse_expression, parse_filter, parse_statement, parse_statements
from siftql.operators import inspect, mutate
from siftql.operators.select import Planner
from siftql.plans.expressions import Compiler, Scope
from siftql.plans.values import BOOL, CompileProblem, Val
from siftql.sources import readers

#: Session variables that clients of MySQL ask for, under MySQL's names.
VARIABLES = {"@@max_allowed_packet": 4194304, "@@session.auto_increment_increment": 1, "@@session.tx_isolation": "REPEATABLE-READ", "@@character_set_client": "utf8", "@@character_set_connection": "utf8", "@@character_set_results": "utf8", "@@character_set_server": "utf8", "@@init_connect": "", "@@interactive_timeout": 28800, "@@auto_increment_increment": 1, "@@session.tx_read_only": 0, "@@lower_case_table_names": 0, "@@net_buffer_length": 16384, "@@net_write_timeout": 600, "@@query_cache_size": 1048576, "@@query_cache_type": "OFF", "@@sql_mode": "STRICT_TRANS_TABLES,NO_ENGINE_SUBSTITUTION", "@@system_time_zone": "UTC", "@@time_zone": "SYSTEM", "@@tx_isolation": "REPEATABLE-READ", "@@version_comment": "siftql", "@@wait_timeout": 28800, "@@autocommit": 1}


@dataclass
class Table:
    df: DataFrame
    key: str | None = None
    #: The engine may replace it by DML.
    own: bool = False
    #: Folders of an own table's files.
    paths: tuple[str, ...] = ()


@dataclass
class Schema:
    tables: dict[str, Table] = field(default_factory=dict)


class Engine:
    def __init__(self, spark: SparkSession, schema: str = "main", time_column: str | None = None):
        self.spark, self.current, self.time_column = spark, schema, time_column
        self.catalog: dict[str, Schema] = {schema: Schema()}
        self.filters: dict[str, t.Node] = {}
        self.functions: dict[str, Function] = {}
        self.variables: dict[str, object] = dict(VARIABLES)
        self.prepared: dict[str, str] = {}
        #: Folders that DML has superseded.
        self.stale: set[str] = set()

    # Catalogue.
    def register(self, name: str, df: DataFrame, key: str | None = None, own: bool = False, schema: str | None = None) -> Engine:
        self.catalog.setdefault(schema or self.current, Schema()).tables[name.lower()] = Table(df, key, own)
        return self

    def register_files(self, name: str, kind: str, path: str, schema: str | None = None, **options) -> Engine:
        return self.register(name, readers.read_files(self.spark, kind, path, options), schema=schema)

    def register_folder(self, folder: str, kind: str, schema: str | None = None, **options) -> Engine:
        """Every table of a folder, its files together, and ``<schema>_files``."""
        files = readers.files_of(self.spark, folder)
        by: dict[str, list[str]] = {}
        for r in files.orderBy("path").collect():
            if r.table:
                by.setdefault(r.table, []).append(r.path)
        for name, paths in by.items():
            self.register(name, readers.read_files(self.spark, kind, paths, options), schema=schema)
        return self.register(f"{schema or self.current}_files", files, schema=schema)

    def register_function(self, name: str, build: Callable[..., Column], returns: str = "string", least: int = 1, most: int | None = 1) -> Engine:
        """A function of columns, such as a pandas UDF."""
        from pyspark.sql.types import _parse_datatype_string

        kind = _parse_datatype_string(returns)
        self.functions[name.lower()] = Function(name.lower(), lambda c, *xs: Val(build(*[x.col for x in xs]), kind), least, most)
        return self

    def find(self, name: str) -> Table:
        schema, _, short = name.lower().rpartition(".")
        places = [schema] if schema else [self.current, *self.catalog]
        for s in places:
            if s in self.catalog and short in self.catalog[s].tables:
                return self.catalog[s].tables[short]
        raise CompileProblem(f"no table {name!r}")

    def table(self, name: str) -> DataFrame:
        return self.find(name).df

    def own(self, name: str) -> Table:
        table = self.find(name)
        if not table.own:
            raise CompileProblem(f"{name!r} is read-only; copy it with SELECT ... INTO")
        return table

    def key_of(self, name: str) -> str | None:
        return self.find(name).key

    def tables(self, schema: str | None = None) -> list[str]:
        if schema and schema.lower() not in self.catalog:
            raise CompileProblem(f"no schema {schema!r}")
        return sorted(self.catalog[(schema or self.current).lower()].tables)

    def schemas(self) -> list[str]:
        return sorted(self.catalog)

    def time_of(self, columns: dict[str, Val]) -> Column | None:
        v = columns.get(self.time_column.lower()) if self.time_column else None
        return v.col if v is not None and v.kind == "time" else None

    def write(self, df: DataFrame) -> str:
        """Write a frame to the warehouse; its folder."""
        path = f"{self.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/siftql/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def settle(self, df: DataFrame) -> DataFrame:
        """Write a frame to the warehouse and read it back, for the length of a statement."""
        path = self.write(df)
        self.stale.add(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _have(self, table: Table, paths: tuple[str, ...], schema) -> None:
        table.paths, table.df = paths, self.spark.read.schema(schema).parquet(*paths)

    def replace(self, name: str, df: DataFrame) -> None:
        table = self.own(name)
        path = self.write(df)
        self.stale.update(table.paths)
        self._have(table, (path,), df.schema)

    def append(self, name: str, df: DataFrame) -> None:
        table = self.own(name)
        self._have(table, (*table.paths, self.write(df)), table.df.schema)

    def save(self, name: str, df: DataFrame, key: str | None = None) -> None:
        """A table of the engine's own."""
        self.register(name, df, key, own=True)
        table = self.catalog[self.current].tables[name.lower()]
        self._have(table, (self.write(df),), df.schema)

    def vacuum(self) -> int:
        """Delete what statements have superseded; frames that were read before and not yet used lose their rows."""
        for path in self.stale:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        n = len(self.stale)
        self.stale.clear()
        return n

    # Languages.
    def sql(self, text: str, *params) -> DataFrame:
        """The result of the last of the statements; DML gives one row with the number of rows touched."""
        out = None
        for s in parse_statements(text):
            out = self.run(s, params)
        if out is None:
            raise CompileProblem("no statement")
        return out

    def run(self, s: t.Node, params: tuple = ()) -> DataFrame:
        match s:
            case t.Select():
                return Planner(self, params).select(s)
            case t.Filter():
                if s.alias:
                    self.filters[s.alias] = s.expr
                return Planner(self, params).filter(s) if s.source else self._affected(0)
            case t.Insert():
                return self._affected(mutate.insert(self, s, params))
            case t.Update():
                return self._affected(mutate.update(self, s, params))
            case t.Delete():
                return self._affected(mutate.delete(self, s, params))
            case t.Command():
                return getattr(self, f"_{s.verb}")(s)
        raise CompileProblem(f"cannot run {type(s).__name__}")

    def _affected(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "affected long")

    def _set(self, s):
        comp = Compiler(Scope({}, variables=self.variables))
        for name, node in s.args:
            v = node.text if isinstance(node, t.Name) else comp(node).literal
            key = name.lower() if name.startswith("@") else f"@@{name.lower()}"
            self.variables[key] = v
        return self._affected(0)

    def _use(self, s):
        if s.name.lower() not in self.catalog:
            raise CompileProblem(f"no schema {s.name!r}")
        self.current = s.name.lower()
        return self._affected(0)

    def _commit(self, s):
        return self._affected(0)

    _rollback = _commit

    def _show(self, s):
        return inspect.show(self, s)

    def _describe(self, s):
        return inspect.describe(self, s.name)

    def _explain(self, s):
        text = self.run(s.statement)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended" if s.full else "formatted"))
        return self.spark.createDataFrame([(text,)], "plan string")

    def _prepare(self, s):
        parse_statements(s.args[0])
        self.prepared[s.name.lower()] = s.args[0]
        return self._affected(0)

    def execute(self, name: str, *params) -> DataFrame:
        """A prepared statement with its parameters."""
        return self.sql(self.prepared[name.lower()], *params)

    _KINDS = {"int": "long", "bigint": "long", "integer": "long", "float": "double", "double": "double", "number": "double", "bool": "boolean", "boolean": "boolean", "time": "timestamp", "datetime": "timestamp", "timestamp": "timestamp", "date": "timestamp"}

    def _create(self, s):
        if s.what in ("source", "schema"):
            kind, path = s.options.get("type", ""), s.options.get("path") or s.options.get("settings", {}).get("path")
            name = str(s.options.get("schema") or s.name).lower()
            self.catalog.setdefault(name, Schema())
            if path:
                rest = {k: v for k, v in s.options.items() if k not in ("type", "path", "schema", "settings")}
                self.register_folder(path, s.options.get("format") or kind, schema=name, **rest)
        elif s.what == "database":
            self.catalog.setdefault(s.name.lower(), Schema())
        elif s.what == "table":
            if not s.args:
                raise CompileProblem("a table needs columns")
            schema = ", ".join(f"`{c}` {self._KINDS.get(k, 'string')}" for c, k, _ in s.args)
            key = next((c for c, _, notes in s.args if "PRIMARY" in notes), s.args[0][0])
            self.save(s.name, self.spark.createDataFrame([], schema), key)
        elif s.what in ("view", "continuousview"):
            self.register(s.name, self.run(s.statement))
        else:
            raise CompileProblem(f"cannot create a {s.what}")
        return self._affected(0)

    def _drop(self, s):
        name = s.name.lower()
        if s.what in ("source", "schema", "database"):
            if name not in self.catalog or name == self.current:
                raise CompileProblem(f"cannot drop {s.name!r}")
            del self.catalog[name]
        else:
            self.find(name)
            for schema in self.catalog.values():
                if gone := schema.tables.pop(name, None):
                    self.stale.update(gone.paths)
                    break
        return self._affected(0)

    def _alter(self, s):
        raise CompileProblem("ALTER is not supported")

    def expression(self, df: DataFrame, text: str) -> Column:
        """A column for an expression; unknown names are missing values."""
        comp = self._compiler(df)
        return comp.solid(comp(parse_expression(text)))

    def _compiler(self, df: DataFrame) -> Compiler:
        columns = Scope.of(df).columns
        return Compiler(Scope(columns, lenient=True, variables=self.variables, filters=self.filters, functions=self.functions, time=self.time_of(columns)))

    def define_filter(self, text: str, name: str | None = None) -> Engine:
        """A filter under its alias, for INCLUDE."""
        for f in [parse_filter(text)] if name else parse_statements(text):
            alias = name or f.alias
            if not alias:
                raise CompileProblem("the filter has no alias")
            self.filters[alias.lower()] = f.expr if isinstance(f, t.Filter) else f.where
        return self

    def filter(self, text: str, df: DataFrame | None = None) -> DataFrame:
        """Rows that a filter keeps, of its own table or of ``df``."""
        return Planner(self).filter(parse_filter(text), df)

    def filter_select(self, text: str, df: DataFrame) -> DataFrame:
        """``SELECT ... FILTER ...`` over a frame."""
        return Planner(self).select_from(parse_statement(text), df)

    def matches(self, df: DataFrame, text: str) -> Column:
        """Whether a filter holds for each row, never NULL."""
        v = self._compiler(df).truth(parse_filter(text).expr)
        return F.coalesce(v.col.cast(BOOL), F.lit(False))

    def window(self, df: DataFrame, text: str, partition_by: list[str], order_by: list[str]) -> Column:
        """An aggregate expression over a window; an extension."""
        from pyspark.sql import Window

        comp = self._compiler(df)
        comp.scope.aggregate = True
        return comp(parse_expression(text)).col.over(Window.partitionBy(*partition_by).orderBy(*order_by))
