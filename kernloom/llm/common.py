"""Helpers that the operators share: stage tables in the shared folder, range lookup in sorted arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else the context's
    checkpoint folder, else (local masters only) a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="kernloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/kernloom/{spark.sparkContext.applicationId}"


def release_staged(spark: SparkSession) -> None:
    """Remove the tables that this application has staged. Results are read lazily from them: call
    it when they have been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str, row_group_mb: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the stages before.
    The schema is given on reading, so that empty tables keep it. ``row_group_mb`` bounds what a
    writer gathers and a reader decodes at once, for tables of very large values.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if row_group_mb is not None:
        writer = writer.option("parquet.block.size", row_group_mb << 20)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of two or three numbers that may be broadcast; beyond it both sides are shuffled.
FEW = 500_000


def broadcast_if_few(df: DataFrame, most: int = FEW) -> DataFrame:
    """A staged table of narrow rows, marked for broadcast if it has ``most`` rows at most."""
    return F.broadcast(df) if df.count() <= most else df


#: Rows and bytes in an Arrow batch: texts of documents are long, staged segments of texts longer, and
#: each task holds several copies of a batch. A batch ends with the row that reaches either.
BATCH_ROWS = 1000
BATCH_MB = 16


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session sends ``BATCH_ROWS`` rows or ``BATCH_MB`` at a time to Python; fewer rows or
    a limit of bytes that the session has set stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, f"{BATCH_MB}m")


@contextmanager
def smaller_batches(spark: SparkSession, mb: int) -> Iterator[None]:
    """While it lasts, the session sends ``mb`` MB at a time to Python, or the fewer that it has set."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    # a limit of the caller's own in other units stays
    if before is None or before == f"{BATCH_MB}m":
        spark.conf.set(name, f"{min(mb, BATCH_MB)}m")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of a column's text form, modulo ``modulus`` (null if the column is)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def long_array(values: list[int]) -> Column:
    """A foldable array<bigint>, so that the plan holds one literal instead of many."""
    if not values:
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def count_not_after(key: Column, ordered: Column, size: int) -> Column:
    """How many entries of the ascending array ``ordered`` (of ``size``) are <= ``key``: a
    binary search in log2(size) steps, inside the JVM."""
    if size == 0:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << b) for b in range(size.bit_length() - 1, -1, -1)])

    def step(found: Column, width: Column) -> Column:
        at = found + width
        fits = at <= F.lit(size)
        return F.when(fits & (F.get(ordered, F.least(at, F.lit(size)) - 1) <= key), at).otherwise(found)

    return F.aggregate(steps, F.lit(0), step)
