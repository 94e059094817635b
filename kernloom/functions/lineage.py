"""Cutting the lineage of iterated tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """While it lasts, the files of a query's shuffles are removed when it is done, not at some later garbage collection."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(rows: DataFrame) -> DataFrame:
    """``rows``, computed now and read from the checkpoint folder from here on: ``spark.checkpoint.dir``,
    else the context's own, else (local masters only) a temporary one. The files of its shuffles are removed."""
    spark = rows.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="kernloom-")
        context.setCheckpointDir(folder)
    with shuffles_removed(spark):
        return rows.checkpoint()


def release(rows: DataFrame) -> None:
    """Remove the files of a result of ``cut`` that nothing reads any more."""
    file = rows._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
