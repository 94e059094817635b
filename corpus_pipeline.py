"""A corpus pipeline: five stages, each written as Parquet and read again by the next.

Language ID, SimHash near-dedup, benchmark decontamination, secret scans, best-fit packing.
Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernloom.llm import copies, decontaminate, language_id, packing, secrets
from kernloom.llm.common import bounded_batches, documents, staged


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column's name needs."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go."""
    bounded_batches(spark)
    lang, score = unused(docs, "language"), unused(docs, "likeness")
    named = language_id.identify(docs, language_id.learn_profiles(docs), lang_out=lang, score_out=score)
    return named.where(F.col(lang) != language_id.UNKNOWN).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least id. Groups are linked by SimHash and
    a Jaccard similarity of five-word shingles of 0.8 at least."""
    bounded_batches(spark)
    return copies.near_copies(docs).where("stays").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    bounded_batches(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced."""
    bounded_batches(spark)
    names = docs.columns
    clean = secrets.redact(docs.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(names)])).toDF(*names)
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens; null texts are empty, null ids stay."""
    bounded_batches(spark)
    return packing.op8_packing(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Profiles, fingerprints, alignments and tokens aren't expressible in SQL; tests/llm holds the
#: run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
