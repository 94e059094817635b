"""Document fingerprints: canonical exact digests, in SQL functions only.

Canonical form: NFKC, full case folding, NFKC again, runs of white space as one space, ends
trimmed. Texts of ASCII alone need lower case only. The fingerprint is four chained lanes of
xxhash64 over the canonical form (256 bits, hex). Documents with equal fingerprints form a
bucket, and bytes are compared inside: the least and the greatest canonical form of a bucket
are taken (with partial aggregation, so a bucket of any size leaves one row per task) and
must be equal; a bucket where they differ is divided by the canonical form itself.

Nulls are empty texts. Repeated rows are documents of their own. Null doc_ids come after all
others in descending order, equal ones in descending order of text. An empty table gives an
empty result; a single document is its own next one. Clashing columns are left out of what
these functions read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernloom.llm.common import broadcast_if_few, count_not_after, long_array, staged

_FIRST = -(1 << 63)
#: Rows of one bucket of neighbours; there are at most MOST_BUCKETS of them.
BUCKET_ROWS, MOST_BUCKETS = 500, 20_000
#: Ids (8 bytes each) that may be broadcast; beyond it the join shuffles.
BROADCAST_KEYS = 1_000_000


def _icu(method: str, of: str, text: Column) -> Column:
    return F.reflect(F.lit(of), F.lit(method), text, F.lit(True))


def canonical(text: Column) -> Column:
    """The canonical form of a text column (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    composed = _icu("compose", "com.ibm.icu.text.Normalizer", text)
    folded = _icu("foldCase", "com.ibm.icu.lang.UCharacter", composed)
    other = _icu("compose", "com.ibm.icu.text.Normalizer", folded)
    plain = F.octet_length(text) == F.char_length(text)
    out = F.when(plain, F.lower(text)).otherwise(other)
    return F.trim(F.regexp_replace(out, "[\\s\\u0085\\u1680\\u2028\\u2029]+", " "))


def digest(canon: Column) -> Column:
    """256 bits of xxhash64 in hex."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(lane), canon))), 16, "0") for lane in range(4)])


def exact_groups(docs: DataFrame, prints: DataFrame, text_col: str = "text") -> DataFrame:
    """``prints`` (doc_id, fingerprint, ...) with class_id (least doc_id of equal canonical
    forms) and copies. ``docs`` is read once more; only documents whose id is in a shared bucket
    are brought to their canonical form again."""
    shared = (
        prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("class_id")).where("copies > 1")
    )
    shared = staged(shared, "fingerprint-buckets")
    ids = prints.join(shared.select("fingerprint"), "fingerprint", "left_semi").select("doc_id").distinct()
    ids = staged(ids.withColumnRenamed("doc_id", "_shared"), "fingerprint-ids")
    ids = broadcast_if_few(ids, BROADCAST_KEYS)
    texts = docs.select("doc_id", text_col).join(ids, F.col("doc_id").eqNullSafe(F.col("_shared")), "left_semi")
    texts = texts.select("doc_id", canonical(F.col(text_col)).alias("canon")).withColumn("fingerprint", digest(F.col("canon")))
    compared = texts.groupBy("fingerprint").agg(
        (F.min(F.col("canon").cast("binary")) == F.max(F.col("canon").cast("binary"))).alias("same")
    )
    compared = staged(compared, "fingerprint-compared")
    differing = compared.where("not same").select("fingerprint")
    out = prints.join(shared, "fingerprint", "left").withColumns(
        {"copies": F.coalesce("copies", F.lit(1).cast("bigint")), "class_id": F.coalesce("class_id", "doc_id")}
    )
    if differing.isEmpty():
        return out
    split = texts.join(differing, "fingerprint", "left_semi")
    split = split.groupBy("fingerprint", "canon").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("c"))
    member = texts.join(split, ["fingerprint", "canon"]).select("doc_id", "fingerprint", "n", "c").distinct()
    return (
        out.join(member, ["doc_id", "fingerprint"], "left")
        .withColumns({"copies": F.coalesce("n", "copies"), "class_id": F.coalesce("c", "class_id")})
        .drop("n", "c")
    )


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the next document's text in descending doc_id, circular.

    The ids are cut into buckets at their quantiles. Each bucket also gets a copy of the first
    document of the bucket after it, so no window spans more than a bucket and each text is
    shuffled once.
    """
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(_FIRST)).alias("_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    wanted = min(max(n // BUCKET_ROWS, 1), MOST_BUCKETS)
    cuts: list[int] = []
    if wanted > 1:
        shares = [i / wanted for i in range(1, wanted)]
        found = rows.agg(F.percentile_approx("_id", shares, max(10_000, 20 * wanted))).first()[0]
        cuts = sorted(set(found))
    bucket = count_not_after(F.col("_id"), long_array(cuts), len(cuts))
    rows = rows.withColumn("_b", bucket)
    heads = {r["_b"]: r["h"] for r in rows.groupBy("_b").agg(F.max("_id").alias("h")).collect()}
    order = sorted(heads, reverse=True)
    before = {b: order[i - 1] for i, b in enumerate(order)}  # the first bucket's head follows the last one
    size = len(cuts) + 1
    head = F.get(long_array([heads.get(b, _FIRST) for b in range(size)]), F.col("_b"))
    prior = F.get(long_array([before.get(b, 0) for b in range(size)]), F.col("_b")).cast("int")
    own = F.struct(F.col("_b").alias("b"), F.lit(0).alias("o"))
    sent = F.struct(prior.alias("b"), F.lit(1).alias("o"))
    dealt = rows.withColumn("_to", F.explode(F.when(F.col("_id") == head, F.array(own, sent)).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", "_id", "text", F.col("_to.b").alias("_b"), F.col("_to.o").alias("_o"))
    window = Window.partitionBy("_b").orderBy("_o", F.desc("_id"), F.desc("text"))
    return dealt.withColumn("next_text", F.lead("text").over(window)).where("_o = 0").select("doc_id", "text", "next_text")


def op5_document_fingerprints(docs: DataFrame) -> DataFrame:
    near = with_next(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)
    )
    near = near.withColumn("edited", edited).withColumns(
        {"c": canonical(F.col("text")), "e": canonical(F.col("edited")), "x": canonical(F.col("next_text"))}
    )
    prints = near.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest(F.col("c")).alias("fingerprint"),
        digest(F.col("e")).alias("edited_fingerprint"),
        F.when(F.col("c") == F.col("e"), 1.0).otherwise(0.0).alias("near_edited"),
        F.when(F.col("c") == F.col("x"), 1.0).otherwise(0.0).alias("near_next"),
    )
    return exact_groups(docs, staged(prints, "fingerprints"))
