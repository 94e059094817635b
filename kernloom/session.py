"""Session helper used by tests, the bench and interactive runs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(cores: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session; on a cluster the caller passes its own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kernloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
