"""Sources and sinks: annotation files, gene-set files, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GTF_SCHEMA = "chr string, source string, feature string, start bigint, end bigint, score string, strand string, frame string, attribute string"


def read_gtf(spark: SparkSession, path: str, filter_to_coding: bool = False) -> DataFrame:
    """Nine tab-separated columns (gz by suffix), comment lines skipped, plus ``gene_name``: the
    attribute's gene_name, else its gene_id up to the first dot, else "NA". ``filter_to_coding`` keeps
    genes whose attributes say protein_coding and that have a name."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=GTF_SCHEMA, quote="", ignoreLeadingWhiteSpace=False)
    name = F.nullif(F.regexp_extract("attribute", 'gene_name "([A-Za-z0-9_\\-\\[\\]^`\\\\]+)', 1), F.lit(""))
    gene = F.nullif(F.regexp_extract("attribute", 'gene_id "([A-Za-z0-9_\\-\\[\\]^`\\\\]+)', 1), F.lit(""))
    if filter_to_coding:
        rows = rows.where(F.col("attribute").contains("protein_coding") & (F.col("feature") == "gene"))
    rows = rows.withColumn("gene_name", F.coalesce(name, gene, F.lit("NA")))
    return rows.where("gene_name <> 'NA'") if filter_to_coding else rows


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """(group, gene): one row per member; the second column of the file is skipped."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(parts[0].alias("group"), F.explode(F.slice(parts, F.lit(3), F.greatest(F.size(parts), F.lit(1)))).alias("gene")).where("gene <> ''")


def read_matrix(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """A long matrix from Parquet, CSV or TSV by suffix: cell_id (of ``id_type``; barcodes are
    ``string``), feature, value."""
    schema = f"cell_id {id_type}, feature string, value double"
    for suffix, sep in ((".csv", ","), (".tsv", "\t")):
        if path.rstrip("/").endswith((suffix, suffix + ".gz")):
            return spark.read.csv(path, sep=sep, header=True, schema=schema)
    return spark.read.schema(schema).parquet(path)


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """A matrix-market coordinate file: (cell_id from 0, column from 0, value)."""
    lines = spark.read.text(path).withColumns({"_at": F.input_file_block_start(), "_i": F.monotonically_increasing_id()})
    lines = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    # the size line is the first of the file that is no comment, in whatever order its parts are read
    first = lines.agg(F.min(F.struct("_at", "_i")).alias("m")).first()["m"]
    if first is not None:
        lines = lines.where((F.col("_at") != first["_at"]) | (F.col("_i") != first["_i"]))
    parts = F.split(F.trim("value"), "\\s+")
    return lines.select((parts[0].cast("bigint") - 1).alias("cell_id"), (parts[1].cast("bigint") - 1).alias("column"), parts[2].cast("double").alias("value"))


def write_results(frame: DataFrame, path: str, key: str) -> None:
    """Results of one run under ``path``, kept apart by ``key``."""
    frame.drop("key").write.mode("overwrite").parquet(f"{path.rstrip('/')}/key={key}")


def read_results(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """All results under ``path`` with their ``key``; ``pattern`` is a regex on keys."""
    rows = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(path)
    return rows.where(F.col("key").rlike(pattern)) if pattern else rows
