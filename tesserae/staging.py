"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local session gets one of its own where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends: its result is a written table, so nothing reads them again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that lost executors and later steps cost no upstream work."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(out)
    return out


@contextmanager
def tables_dropped() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Inside, staged tables are noted; at the end they go, but for those that the given function is called with."""
    made, kept = [], []
    before = _MADE.set(made)
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _MADE.reset(before)
    discard(*[df for df in made if not any(df is k for k in kept)])


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and its Path class."""
    cls = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return cls(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), cls


def discard(*tables: DataFrame) -> None:
    """Remove the files of staged tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            fs, path = file_system(df.sparkSession, folder)
            fs.delete(path(folder), True)
