"""Intermediate tables in the folder that all executors share, and shipping of this package to workers."""

from __future__ import annotations

import atexit
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


class Scope:
    """The tables that an operator or a pipeline stage left, deleted when it is closed; what read them must have been written by then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        name = spark.sparkContext.applicationId
        if name not in _sessions:
            _sessions[name] = []
            atexit.register(_leave, name)
        _sessions[name].append(self)

    def close(self) -> None:
        while self.paths:
            delete(self.spark, self.paths.pop())
        if self in _sessions.get(name := self.spark.sparkContext.applicationId, ()):
            _sessions[name].remove(self)

    @contextmanager
    def entered(self) -> Iterator[Scope]:
        """Tables written within belong to this scope; those of other scopes and threads are left alone."""
        token = _current.set(self)
        try:
            yield self
        finally:
            _current.reset(token)


_current: ContextVar[Scope | None] = ContextVar("scope", default=None)
#: The open scopes of each application, closed when the program ends; `_own` has those of callers that entered none.
_sessions: dict[str, list[Scope]] = {}
_own: dict[str, Scope] = {}


def scope(spark: SparkSession) -> Scope:
    """The scope entered last; without one, that of the session, which ends with the program."""
    name = spark.sparkContext.applicationId
    if _current.get() is None and name not in _own:
        _own[name] = Scope(spark)
    return _current.get() or _own[name]


def _leave(name: str) -> None:
    active = SparkContext._active_spark_context
    for own in list(_sessions.pop(name)):
        if active is not None and active.applicationId == name:
            own.close()


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset: a temporary folder on a master of one machine, an error on any other."""
    at = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {SETTING} to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set(SETTING, at)
    return at.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    at = f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    scope(spark).paths.append(at)
    return at


def saved(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and returns the table as read from it: its lineage ends there, and it outlives any executor."""
    spark, at = df.sparkSession, path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def delete(spark: SparkSession, at: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(at)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    at = os.path.join(tempfile.mkdtemp(prefix="lodestone-zip-"), "lodestone_pkg.zip")
    with zipfile.ZipFile(at, "w") as z:
        for f in (root / "lodestone").rglob("*.py"):
            z.write(f, f.relative_to(root))
    sc.addPyFile(at)
    _shipped.add(sc.applicationId)


def tidy(spark: SparkSession) -> None:
    """Lets go of shuffle files whose queries have ended; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
