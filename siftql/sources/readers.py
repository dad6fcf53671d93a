"""Tables from files: one reader for each format, folders of tables, and the list of files as a table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftql.plans.values import CompileProblem

FORMATS: dict[str, Callable] = {}


def file_format(name: str):
    """Register a reader: (spark, path, options) -> DataFrame."""

    def add(build):
        FORMATS[name] = build
        return build

    return add


def _lowered(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


@file_format("csv")
def read_csv(spark: SparkSession, path, options: dict) -> DataFrame:
    """Header in lower case, every column text unless a schema is given; rows of another width are dropped.

    ``typed=True`` casts columns to the narrowest types that hold all their values.
    """
    opts = {"header": "true", "mode": "DROPMALFORMED", "sep": options.get("delimiter", ",")}
    reader = spark.read.options(**opts)
    header = reader.csv(path)  # types none, so only the header is read
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header.columns])
    # Without pruning, ragged rows are dropped whichever columns a query needs.
    previous = reader.option("columnPruning", "false").schema(schema).csv(path)
    df = _lowered(previous)
    return typed(df) if options.get("typed") else df


@file_format("json")
def read_json(spark: SparkSession, path, options: dict) -> DataFrame:
    """JSON lines; ``root`` names a nested object whose fields are the columns."""
    df = spark.read.json(path)
    if root := options.get("root"):
        df = df.select(F.col(root).alias("_root")).where("_root is not null").select("_root.*")
    return df


@file_format("parquet")
def read_parquet(spark: SparkSession, path, options: dict) -> DataFrame:
    return spark.read.parquet(path)


@file_format("orc")
def read_orc(spark: SparkSession, path, options: dict) -> DataFrame:
    return spark.read.orc(path)


@file_format("text")
def read_text(spark: SparkSession, path, options: dict) -> DataFrame:
    return spark.read.text(path)


@file_format("jdbc")
def read_jdbc(spark: SparkSession, path, options: dict) -> DataFrame:
    """A table of a database whose driver is on the class path; filters and columns are pushed to it."""
    return spark.read.format("jdbc").options(url=path, **options).load()


@file_format("sqlite")
def read_sqlite(spark: SparkSession, path, options: dict) -> DataFrame:
    """A table of an SQLite file by a Python data source; executors must see the file."""
    from siftql.sources.sqlite import SqliteSource

    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("siftql_sqlite").options(path=path, table=options["table"]).load()


_TYPES = [("bigint", r"^[-+]?\d{1,18}$"), ("boolean", r"^(?:true|false|TRUE|FALSE|True|False)$"), ("double", r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$"), ("timestamp", r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[-+]\d{2}:?\d{2})?)?$")]


def declared_types(df: DataFrame) -> dict[str, str]:
    """The narrowest type that every value of a text column has, empty ones aside; one pass over all rows, so no value is lost by the cast."""
    made = []
    for c in df.columns:
        v = F.nullif(F.col(f"`{c}`"), F.lit(""))
        made += [F.min(v.rlike(shape)).alias(f"{c}#{kind}") for kind, shape in _TYPES]
    found = df.agg(*made).first() if made else None
    return {c: next((kind for kind, _ in _TYPES if found[f"{c}#{kind}"]), "string") for c in df.columns}


def typed(df: DataFrame) -> DataFrame:
    kinds = declared_types(df)
    return df.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if kinds[c] != "string" else F.col(f"`{c}`") for c in df.columns])


def table_of_path(path: str) -> str | None:
    """The table a file belongs to: ``tables/<t>/<file>`` or ``<t>.<ending>``, in lower case."""
    parts = [p for p in path.split("/") if p]
    if "tables" in parts[:-2]:
        return parts[len(parts) - 1 - parts[::-1].index("tables") + 1].lower()
    m = re.match(r"(.+?)\.(?:csv|json|jsonl|parquet|orc|txt)(?:\.gz)?$", parts[-1]) if parts else None
    return m[1].lower() if m else None


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """The files below a folder: name, table, path, size, modified."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    it = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(fs_path, True)
    rows = []
    while it.hasNext():
        f = it.next()
        path = f.getPath().toString()
        name = path.rsplit("/", 1)[-1]
        if not name.startswith((".", "_")):
            rows.append((name, table_of_path(path), path, f.getLen(), f.getModificationTime() / 1000))
    df = spark.createDataFrame(rows, "name string, table string, path string, size long, modified double")
    return df.withColumn("modified", F.timestamp_seconds("modified"))


def read_files(spark: SparkSession, kind: str, path, options: dict | None = None) -> DataFrame:
    if kind not in FORMATS:
        raise CompileProblem(f"no file format {kind!r}")
    return FORMATS[kind](spark, path, options or {})


def with_path_columns(df: DataFrame, pattern: str) -> DataFrame:
    """Columns from the named groups of a regular expression over the path of a row's file."""
    names = re.findall(r"\(\?P<(\w+)>", pattern)
    plain = re.sub(r"\(\?P<\w+>", "(", pattern)
    return df.select("*", *[F.nullif(F.regexp_extract(F.col("_metadata.file_path"), plain, k + 1), F.lit("")).alias(n) for k, n in enumerate(names)])
