"""Queries of the operators in this subpackage, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kernloom.llm import alignment, centroids, decontaminate, fingerprints, language_id, language_model, packing, pieces, secrets, sharding, simhash, toxicity, urls
from kernloom.llm.common import documents


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op10_url_filter": lambda spark, d: urls.op10_url_filter(spark.read.parquet(f"{d}/pages.parquet")),
        "op11_alignment": lambda spark, d: alignment.op11_alignment(documents(spark, d)),
        "op12_sentencepiece": lambda spark, d: pieces.op12_sentencepiece(documents(spark, d)),
        "op13_centroids": lambda spark, d: centroids.op13_centroids(spark.read.parquet(f"{d}/embeddings.parquet")),
        "op1_toxicity": lambda spark, d: toxicity.op1_toxicity(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
        "op2_sharding": lambda spark, d: sharding.op2_sharding(documents(spark, d)),
        "op3_decontamination": lambda spark, d: decontaminate.op3_decontamination(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
        "op4_language_id": lambda spark, d: language_id.op4_language_id(documents(spark, d)),
        "op5_document_fingerprints": lambda spark, d: fingerprints.op5_document_fingerprints(documents(spark, d)),
        "op6_lm_scoring": lambda spark, d: language_model.op6_lm_scoring(documents(spark, d)),
        "op7_simhash": lambda spark, d: simhash.op7_simhash(documents(spark, d)),
        "op8_packing": lambda spark, d: packing.op8_packing(documents(spark, d)),
        "op9_secret_scan": lambda spark, d: secrets.op9_secret_scan(documents(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op13_centroids": centroids.oracle_op13(),
        "op9_secret_scan": secrets.oracle_op9(),
    }
