"""Cutting lineage by written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders written since each ``scratch`` of this thread or task began, the innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open_scratch", default=())


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``. A local one only where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the result survives lost executors. ``keep``: also the end of ``scratch``."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    if _open.get() and not keep:
        _open.get()[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path`` that hold a finished write; none if it isn't there."""
    folder, files = _folder(spark, path)
    inside = files.listStatus(folder) if files.exists(folder) else []
    done = lambda x: files.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))
    return sorted(x.getPath().getName() for x in inside if x.isDirectory() and done(x))


def remove(spark: SparkSession, path: str) -> None:
    folder, files = _folder(spark, path)
    files.delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what ``materialize`` writes inside; results to be read later have ``keep`` or are written elsewhere."""
    mine: list[str] = []
    before = _open.set((*_open.get(), mine))
    try:
        yield
    finally:
        _open.reset(before)
        for path in mine:
            remove(spark, path)
