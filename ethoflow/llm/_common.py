"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ethoflow.session import scratch_path

#: Prefix of every helper column an operator adds to a caller's rows.
OWN = "__ethoflow_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard tables, read by Spark (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables of one call, written to the shared folder.

    A written table cuts the lineage: a lost executor costs the running stage
    only.  ``drop`` deletes a table that nothing reads any more, ``release``
    those of a thread's calls.
    """

    #: Folders of this thread's calls.
    _made = threading.local()

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = scratch_path(spark, label)
        self._n = 0
        self.made().append(self.root)

    @classmethod
    def made(cls) -> list[str]:
        if not hasattr(cls._made, "roots"):
            cls._made.roots = []
        return cls._made.roots

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        at = self.path(name)
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._ethoflow_path = at
        return out

    def drop(self, df: DataFrame) -> None:
        at = getattr(df, "_ethoflow_path", None)
        if at:
            _delete(self.spark, at)


def _delete(spark: SparkSession, at: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(at)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the intermediate tables and models of this thread's calls, all or those after the first ``since``; for when their results have been written."""
    while len(Scratch.made()) > since:
        _delete(spark, Scratch.made().pop())


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bounds the bytes of an Arrow batch, so that long texts fit in a worker; a lower bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().removesuffix("b")
    if not (now.isdigit() and int(now) <= size):
        spark.conf.set(key, str(size))


_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """What a worker process keeps for its next tasks: the tables of one operator; those of the operator before go."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """For operators that keep nothing: what the worker kept for the operator before goes."""
    _held.clear()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the rows do not have."""
    while name in df.columns:
        name += "_"
    return name


def crc_of_id(col: str = "doc_id") -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))
