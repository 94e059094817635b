"""Driver tables as matrices, cells and groups, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernloom.operators import prep, splitting


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Dense: embeddings, two classes (label < 5) or ten; groups are blocks of eight places, and the
# even and odd places.
def a_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.posexplode("embedding").alias("i", "v"))
    return rows.select("cell_id", F.concat(F.lit("f"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("feature"), F.col("v").cast("double").alias("value"))


def a_cells(spark: SparkSession, d: str, multi: bool = False) -> DataFrame:
    label = F.col("label").cast("string") if multi else F.when(F.col("label") < 5, "a").otherwise("b")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), label.alias("label"))


def a_groups(spark: SparkSession, overlapping: bool = False) -> DataFrame:
    i = F.col("id").cast("int")
    name = F.concat(F.lit("f"), F.lpad(i.cast("string"), 2, "0"))
    blocks = spark.range(64).select(F.concat(F.lit("b"), F.floor(i / 8).cast("string")).alias("group"), F.floor(i / 8).cast("int").alias("group_ord"), name.alias("feature"))
    if not overlapping:
        return blocks
    halves = spark.range(64).select(F.when(i % 2 == 0, "even").otherwise("odd").alias("group"), (i % 2 + 8).cast("int").alias("group_ord"), name.alias("feature"))
    return blocks.unionByName(halves)


def a_split(spark: SparkSession, d: str, multi: bool = False) -> DataFrame:
    return splitting.stratified_split(a_cells(spark, d, multi))


def a_vectors(spark: SparkSession, d: str, multi: bool = False, lo: int = 0, hi: int = 8) -> DataFrame:
    groups = a_groups(spark).where(F.col("group_ord").between(lo, hi - 1)).withColumn("group_ord", F.col("group_ord") - lo)
    return prep.group_vectors(a_matrix(spark, d), a_split(spark, d, multi), groups)


A_SQL = """mA AS (SELECT vec_id AS cell_id, 'f' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature, i, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, range(0, 64) t(i)),
cells2 AS (SELECT vec_id AS cell_id, CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS label FROM embeddings),
cellsm AS (SELECT vec_id AS cell_id, CAST(label AS VARCHAR) AS label FROM embeddings),
split2 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('split1:' || cell_id), cell_id) <= floor(count(*) OVER (PARTITION BY label) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM cells2),
splitm AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('split1:' || cell_id), cell_id) <= floor(count(*) OVER (PARTITION BY label) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM cellsm),
stats2 AS (SELECT feature, avg(value) AS mean, sqrt(avg(value * value) - avg(value) * avg(value)) AS sd FROM mA JOIN split2 USING (cell_id) WHERE split = 'train' GROUP BY feature),
vec2 AS (SELECT cell_id, split, 'b' || (i // 8) AS "group", i % 8 AS i, (value - mean) / sd AS x FROM mA JOIN stats2 USING (feature) JOIN split2 USING (cell_id)),
batch2 AS (SELECT cell_id, (rn - 1) // 20 AS batch FROM (SELECT cell_id, row_number() OVER (ORDER BY md5('batch1:' || cell_id), cell_id) AS rn FROM split2 WHERE split = 'train') WHERE rn <= 80)"""


# Counts: customers by brand and type of what they ordered.
def b_matrix(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    rows = lines.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    feature = F.concat_ws(":", "p_brand", "p_type")
    return rows.groupBy(F.col("o_custkey").alias("cell_id"), feature.alias("feature")).agg(F.sum("l_quantity").alias("value"))


def b_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("label"))


def b_features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.concat_ws(":", "p_brand", "p_type").alias("feature")).distinct()


def b_groups(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_brand", "p_type").distinct()
    feature = F.concat_ws(":", "p_brand", "p_type")
    brand = parts.select(F.col("p_brand").alias("group"), F.lit(0).alias("group_ord"), feature.alias("feature"))
    kind = parts.where("p_brand <> 'Brand#1'").select(F.col("p_type").alias("group"), F.lit(1).alias("group_ord"), feature.alias("feature"))
    lone = parts.where("p_type = 'ECONOMY'").select(F.concat(F.lit("lone "), "p_brand").alias("group"), F.lit(2).alias("group_ord"), feature.alias("feature"))
    return brand.unionByName(kind).unionByName(lone)


B_SQL = """mB AS (SELECT o_custkey AS cell_id, p_brand || ':' || p_type AS feature, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
cellsb AS (SELECT c_custkey AS cell_id, c_mktsegment AS label FROM customer),
splitb AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('split1:' || cell_id), cell_id) <= floor(count(*) OVER (PARTITION BY label) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM cellsb),
fB AS (SELECT DISTINCT p_brand || ':' || p_type AS feature FROM part),
gB AS (SELECT DISTINCT p_brand AS "group", p_brand || ':' || p_type AS feature FROM part
  UNION SELECT DISTINCT p_type, p_brand || ':' || p_type FROM part WHERE p_brand <> 'Brand#1'
  UNION SELECT DISTINCT 'lone ' || p_brand, p_brand || ':' || p_type FROM part WHERE p_type = 'ECONOMY')"""


# Presence: users by event type and a number of 24.
def c_matrix(spark: SparkSession, d: str) -> DataFrame:
    feature = F.concat_ws(":", "event_type", (F.col("event_id") % 24).cast("string"))
    return table(spark, d, "events").select(F.col("user_id").alias("cell_id"), feature.alias("feature"), F.lit(1.0).alias("value")).distinct()


def c_split(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "events").select(F.col("user_id").alias("cell_id")).distinct().withColumn("label", (F.col("cell_id") % 2).cast("string"))
    return splitting.stratified_split(cells)


C_SQL = """mC AS (SELECT DISTINCT user_id AS cell_id, event_type || ':' || (event_id % 24) AS feature, CAST(1 AS DOUBLE) AS value FROM events),
cellsc AS (SELECT DISTINCT user_id AS cell_id, CAST(user_id % 2 AS VARCHAR) AS label FROM events),
splitc AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('split1:' || cell_id), cell_id) <= floor(count(*) OVER (PARTITION BY label) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM cellsc)"""


# Intervals: order lines as regions, parts as genes, brands as gene sets.
def e_features(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("l_partkey") * 100 + F.col("l_suppkey")
    name = F.concat(F.lit("chr"), F.col("l_linenumber").cast("string"), F.lit(":"), a.cast("string"), F.lit("-"), (a + (F.col("l_quantity") * 10).cast("bigint")).cast("string"))
    return table(spark, d, "lineitem").select(name.alias("feature")).distinct()


def e_annotation(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("p_partkey") * 100
    return table(spark, d, "part").select(
        F.concat(F.lit("chr"), (F.col("p_partkey") % 7 + 1).cast("string")).alias("chr"),
        start.alias("start"),
        (start + F.col("p_size") * 20).alias("end"),
        F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene_name"),
    )


def e_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("group"), F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene"))


E_SQL = """pk AS (SELECT DISTINCT 'chr' || l_linenumber || ':' || (l_partkey * 100 + l_suppkey) || '-' || (l_partkey * 100 + l_suppkey + CAST(l_quantity * 10 AS BIGINT)) AS feature FROM lineitem),
reg AS (SELECT feature, split_part(feature, ':', 1) AS chr, CAST(split_part(split_part(feature, ':', 2), '-', 1) AS BIGINT) AS s, CAST(split_part(split_part(feature, ':', 2), '-', 2) AS BIGINT) AS e FROM pk),
anno AS (SELECT 'chr' || (p_partkey % 7 + 1) AS chr, p_partkey * 100 AS s, p_partkey * 100 + p_size * 20 AS e, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, 'g' || p_partkey AS gene_name, p_brand AS "group" FROM part),
prom AS (SELECT chr, strand, gene_name, "group", CASE WHEN strand = '+' THEN s ELSE e END AS tss,
  CASE WHEN strand = '+' THEN s - 60 ELSE e - 40 END AS ps, CASE WHEN strand = '+' THEN s + 40 ELSE e + 60 END AS pe FROM anno)"""


def library(spark: SparkSession, d: str) -> DataFrame:
    """Part types as libraries, names as groups, brands as genes."""
    return table(spark, d, "part").select(F.col("p_type").alias("library"), F.col("p_name").alias("group"), F.col("p_brand").alias("gene")).distinct()


L_SQL = "lib AS (SELECT DISTINCT p_type AS library, p_name AS \"group\", p_brand AS gene FROM part)"
