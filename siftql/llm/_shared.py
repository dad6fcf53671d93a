"""What the operators of this folder have in common: shared storage, worker-side caches, column checks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII blanks, in every operator of this folder.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is set, a local session takes a folder of its own; on a cluster it is the warehouse, which is shared too.
    """
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siftql-"))
    else:
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/siftql-shared")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends there, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._siftql_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, once no later plan reads it."""
    if path := getattr(df, "_siftql_path", None):
        remove_path(df.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def crc_of_id(name: str = "doc_id"):
    """crc32 of the identifier as decimal text, the fold function of the learning operators."""
    return F.crc32(F.col(name).cast("string").cast("binary"))


class TwoGenerations:
    """A bounded cache: what was used since the last turn-over survives the next one."""

    __slots__ = ("young", "old", "limit")

    def __init__(self, limit: int):
        self.young: dict = {}
        self.old: dict = {}
        self.limit = limit

    def turn(self) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}

    def fetch(self, keys, make) -> dict:
        """The dict to look ``keys`` up in, after ``make(missing keys) -> values`` has filled the gaps.

        The size is checked before a fetch, so a dict outgrows ``limit`` by the keys of one fetch at most.
        """
        self.turn()
        young, old = self.young, self.old
        missing = keys.difference(young) if isinstance(keys, set) else [k for k in keys if k not in young]
        if missing and old:
            new = []
            for k in missing:
                if k in old:
                    young[k] = old[k]
                else:
                    new.append(k)
            missing = new
        if missing:
            new = list(missing)
            young.update(zip(new, make(new)))
        return young
