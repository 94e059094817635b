"""Sharding by sampled splitters, in SQL functions only.

Records are ordered by (xxhash64 of the text, crc32 of the text, doc_id) and dealt into contiguous
ranges of that order:

1. Key samples are drawn with a chance in proportion to a record's size (a record is drawn
   if a hash of its key falls under size * samples / total; expected number: ``samples``).
2. The samples' distinct texts are the quantile boundaries. A text is heavy if its records
   together have more than ``HEAVY`` of a shard; its own samples bound it by doc_id too, so that
   a text which half the records share still makes many ranges. Where records of one text and
   one id (null, say) are that many, their range is parted by a hash of the row. All other
   texts stay whole within a range, and within a shard.
3. The bytes of each range are counted. Overfull ranges (over 16 samples' shares, which
   chance can leave) are subdivided: they are sampled once more at a higher rate.
4. A record's place in the whole order is the range's offset plus a running sum inside the
   range; the shard is that place (a whole group's middle, for texts that aren't heavy) times
   ``shards`` over the total. So sizes differ from equal by ``HEAVY`` of a shard at most.

Only samples and range sums reach the driver; their number is ``samples`` (a parameter that
does not depend on the rows) and at most a few times that. No step gathers a whole group.

Null texts count as empty, size 16. Null doc_ids come first. Repeated rows are separate
records, drawn together. An empty table gives an empty result. Columns of the input that clash with the
added ones are replaced.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernloom.llm.common import count_not_after, long_array, staged

SHARDS = 40
SAMPLES = 6000
HEAVY = 0.05  # of a shard
_LEAST = -(1 << 63)
_WORK = ("_k", "_i", "_u", "_w", "_r", "_at", "_mid", "_n")


def _key_rank(low: Column, second: Column, keys: list[tuple[int, int]]) -> Column:
    """Number of the ascending ``keys`` (pairs) at or before (low, second)."""
    if not keys:
        return F.lit(0)
    firsts = sorted({k for k, _ in keys})
    by_first: dict[int, list[int]] = {}
    for k, i in keys:
        by_first.setdefault(k, []).append(i)
    # all boundaries of smaller first parts, then a search among those of an equal one
    sizes, total = [0], 0
    for k in firsts:
        total += len(by_first[k])
        sizes.append(total)
    ids = long_array([i for k in firsts for i in sorted(by_first[k])])
    at = F.struct(low.alias("low"), count_not_after(low, long_array(firsts), len(firsts)).alias("n"), second.alias("i"))

    def search(x: Column) -> Column:
        n = x["n"]
        before = F.get(long_array(sizes), F.greatest(n - 1, F.lit(0)))
        upto = F.get(long_array(sizes), n)
        here = (n > 0) & (F.get(long_array(firsts), F.greatest(n - 1, F.lit(0))) == x["low"])
        most = max(len(v) for v in by_first.values())
        steps = F.array(*[F.lit(1 << b).cast("bigint") for b in range(most.bit_length() - 1, -1, -1)])
        inside = F.aggregate(
            steps,
            before,
            lambda found, w: F.when(
                (found + w <= upto) & (F.get(ids, (F.least(found + w, upto) - 1).cast("int")) <= x["i"]), found + w
            ).otherwise(found),
        )
        return F.when(here, inside).otherwise(upto)

    return F.get(F.transform(F.array(at), search), F.lit(0)).cast("int")


def _sampled(rows: DataFrame, rate: Column) -> list[tuple[int, int]]:
    """Keys drawn with chance size * rate; the draw is a hash, the same in every attempt."""
    drawn = rows.where(F.col("_u") < F.col("size") * rate).select("_k", "_i").distinct()
    return sorted((r[0], r[1]) for r in drawn.collect())


def _heavy(rows: DataFrame, samples: list[tuple[int, int]], rate: float, most: float) -> tuple[set[int], dict[tuple[int, int], int]]:
    """First parts whose records have more than ``most`` bytes together; and keys that do for
    themselves, with the number of parts to make of each. The samples are looked at, and samples
    that draw each of several equal rows for itself."""
    each = rows.where(F.col("_w") < F.col("size") * rate).select("_k").distinct().collect()
    firsts = sorted({k for k, _ in samples} | {r["_k"] for r in each})
    if not firsts:
        return set(), {}

    def own(firsts: list[int]) -> Column:
        place = count_not_after(F.col("_k"), long_array(firsts), len(firsts))
        return (place > 0) & (F.get(long_array(firsts), F.greatest(place - 1, F.lit(0))) == F.col("_k"))

    # at most total / most rows pass each
    heavy = sorted(r["_k"] for r in rows.where(own(firsts)).groupBy("_k").agg(F.sum("size").alias("b")).where(F.col("b") > most).collect())
    if not heavy:
        return set(), {}
    keys = rows.where(own(heavy)).groupBy("_k", "_i").agg(F.sum("size").alias("b")).where(F.col("b") > most).collect()
    return set(heavy), {(r["_k"], r["_i"]): int(4 * r["b"] / most) for r in keys}


def _boundaries(samples: list[tuple[int, int]], heavy: set[int], parted: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    found = {(k, _LEAST) for k, _ in samples} | {(k, i) for k, i in samples if k in heavy}
    return sorted(found | set(parted) | {(k, i + 1) for k, i in parted})


def _ranged(rows: DataFrame, keys: list[tuple[int, int]], parted: dict[tuple[int, int], int]) -> DataFrame:
    """``rows`` with their range ``_r``: the number of the boundary, then that of the part."""
    of = _key_rank(F.col("_k"), F.col("_i"), keys).cast("bigint")
    if not parted:
        return rows.withColumn("_r", F.shiftleft(of, 24))
    ranks = {bisect_right(keys, key): n for key, n in parted.items()}
    where = sorted(ranks)
    rows = rows.withColumn("_r", of)
    place = count_not_after(F.col("_r"), long_array(where), len(where))
    here = (place > 0) & (F.get(long_array(where), F.greatest(place - 1, F.lit(0))) == F.col("_r"))
    parts = F.get(long_array([ranks[r] for r in where]), F.greatest(place - 1, F.lit(0)))
    part = F.when(here, F.floor(F.col("_w") * parts)).otherwise(F.lit(0)).cast("bigint")
    return rows.withColumn("_r", F.shiftleft(F.col("_r"), 24) + part)


def shard_by_bytes(
    records: DataFrame,
    shards: int = SHARDS,
    samples: int = SAMPLES,
    text_col: str = "text",
    id_col: str = "doc_id",
    keep_text: bool = True,
) -> DataFrame:
    """``records`` with size, text_crc32, law, shard, slot and grown_shard (null under this law).

    With ``keep_text`` false the text is left out, and the rows that move stay narrow.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = text.cast("binary")
    rows = records.withColumns(
        {
            "size": (F.octet_length(text) + 16).cast("bigint"),
            "text_crc32": F.crc32(raw),
            "_k": F.xxhash64(text),
            "_i": F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LEAST)),
            "_w": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 40)) / F.lit(float(1 << 40)),
        }
    )
    if not keep_text:
        rows = rows.drop(text_col)
    rows = rows.withColumn("_u", F.pmod(F.xxhash64("_k", "_i", F.lit("draw")), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    rows = staged(rows, "shard-keys")
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    rate = samples / total if total else 0.0
    drawn = _sampled(rows, F.lit(rate))
    heavy, parted = _heavy(rows, drawn, rate, HEAVY * total / shards)
    keys = _boundaries(drawn, heavy, parted)
    ranged = _ranged(rows, keys, parted)
    sums = ranged.groupBy("_r").agg(F.sum("size").alias("b"), F.max("size").alias("m")).collect()
    share = total / max(samples, 1)
    overfull = [r["_r"] for r in sums if r["b"] > max(16 * share, 2 * r["m"])]
    if overfull:
        again = ranged.where(F.col("_r").isin(overfull))
        extra = again.where(F.pmod(F.xxhash64("_i", "_k", F.lit("again")), F.lit(1 << 40)) / F.lit(float(1 << 40)) < F.col("size") * rate * 8)
        drawn = sorted(set(drawn) | {(r[0], r[1]) for r in extra.select("_k", "_i").distinct().collect()})
        keys = _boundaries(drawn, heavy, parted)
        ranged = _ranged(rows, keys, parted)
        sums = ranged.groupBy("_r").agg(F.sum("size").alias("b")).collect()
    offset, at = {}, 0
    for r in sorted(sums, key=lambda r: r["_r"]):
        offset[r["_r"]] = at
        at += r["b"]
    codes = sorted(offset)
    in_order = F.greatest(count_not_after(F.col("_r"), long_array(codes), len(codes)) - 1, F.lit(0))
    heavy_col = F.lit(False)
    if heavy:
        firsts = sorted(heavy)
        place = count_not_after(F.col("_k"), long_array(firsts), len(firsts))
        heavy_col = (place > 0) & (F.get(long_array(firsts), F.greatest(place - 1, F.lit(0))) == F.col("_k"))
    order = Window.partitionBy("_r").orderBy("_k", "text_crc32", "_i", "_w")
    group = Window.partitionBy("_r").orderBy("_k", "text_crc32")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # all rows of a text see the sums before it and through it
    through = F.sum("size").over(group.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.sum("size").over(Window.partitionBy("_r", "_k", "text_crc32"))
    placed = ranged.withColumns({"_at": upto, "_mid": through})
    placed = placed.withColumn("_n", own)
    middle = F.when(heavy_col, F.col("_at") - F.col("size") / 2).otherwise(F.col("_mid") - F.col("_n") / 2)
    shard = F.floor((F.get(long_array([offset[c] for c in codes]), in_order) + middle) * F.lit(float(shards)) / F.lit(float(max(total, 1))))
    placed = placed.withColumn("shard", F.least(F.greatest(shard, F.lit(0)), F.lit(shards - 1)).cast("int"))
    in_piece = Window.partitionBy("_r", "shard").orderBy("_k", "text_crc32", "_i", "_w")
    placed = staged(placed.withColumn("_at", F.row_number().over(in_piece).cast("bigint") - 1).drop("_mid", "_n", "_u", "_w"), "shard-places")
    pieces = placed.groupBy("shard", "_r").agg(F.count(F.lit(1)).alias("n")).collect()
    starts, at_shard = [], {}
    for r in sorted(pieces, key=lambda r: (r["shard"], r["_r"])):
        starts.append((r["shard"] << 48 | r["_r"], at_shard.get(r["shard"], 0)))
        at_shard[r["shard"]] = at_shard.get(r["shard"], 0) + r["n"]
    code = F.shiftleft(F.col("shard").cast("bigint"), 48).bitwiseOR(F.col("_r"))
    start = F.get(long_array([s for _, s in starts]), count_not_after(code, long_array([c for c, _ in starts]), len(starts)) - 1)
    out = placed.withColumns(
        {
            "slot": (start + F.col("_at")).cast("bigint"),
            "law": F.lit("bytes"),
            "grown_shard": F.lit(None).cast("int"),
        }
    )
    return out.drop(*_WORK)


def op2_sharding(docs: DataFrame) -> DataFrame:
    rows = shard_by_bytes(docs.select("doc_id", "text"), keep_text=False)
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
