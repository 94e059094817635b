"""Regions grouped by the gene sets whose promoters they overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernloom.functions.lineage import cut


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Closed intervals share a point."""
    return F.greatest(s1, s2) <= F.least(e1, e2)


def tss(strand: Column, start: Column, end: Column) -> Column:
    """Start of transcription by strand; any other strand is an error."""
    return F.when(strand == "+", start).when(strand == "-", end).otherwise(F.raise_error(F.lit("strand must be + or -")))


def promoters(annotation: DataFrame, len_up: int = 5000, len_down: int = 5000) -> DataFrame:
    """chr, start, end, strand, gene_name, tss with start and end set to the promoter."""
    rows = annotation.select("chr", "start", "end", "strand", "gene_name").withColumn("tss", tss(F.col("strand"), F.col("start"), F.col("end")))
    plus = F.col("strand") == "+"
    return rows.withColumns(
        {
            "start": F.when(plus, F.col("tss") - len_up).otherwise(F.col("tss") - len_down),
            "end": F.when(plus, F.col("tss") + len_down).otherwise(F.col("tss") + len_up),
        }
    )


def parse_regions(features: DataFrame, col: str = "feature") -> DataFrame:
    """``features`` with chr, start, end from chr:start-end or chr-start-end."""
    parts = F.split(F.col(col), ":|-")
    return features.withColumns({"chr": parts[0], "start": parts[1].cast("bigint"), "end": parts[2].cast("bigint")})


#: Widths of bins are the narrowest times 8, 64, ...; so many levels hold any interval of bigints.
LEVELS, STEP = 18, 8


def _level(start: Column, end: Column, width: int) -> Column:
    """The level of the narrowest bins that are as wide as the interval is long."""
    length = end - start + 1
    level = F.lit(0)
    for k in range(LEVELS):
        level = level + (length > F.lit(float(width) * STEP**k)).cast("int")
    return level


def overlap_join(regions: DataFrame, genes: DataFrame, width: int = 1000) -> DataFrame:
    """(feature, gene_name) of overlapping pairs, each once, through bins of several widths.

    An interval lies in the one or two bins that it touches at the level of its own length, however
    long it is. Of an overlapping pair the shorter one's bins at the longer one's level hold a bin
    of the longer one; so each side also goes to the levels above its own that the other side has,
    and the pair counts in the bin where its overlap starts. (chr, level, bin) is the key: no
    chromosome is one task. Empty intervals (start after end) overlap nothing."""

    def own(df: DataFrame) -> DataFrame:
        return df.where(F.col("start") <= F.col("end")).withColumn("_own", _level(F.col("start"), F.col("end"), width))

    def placed(df: DataFrame, levels: list[int]) -> DataFrame:
        """At the levels given, from the interval's own up."""
        every = F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x >= F.col("_own"))
        df = df.withColumn("_level", F.explode(every))
        size = F.pow(F.lit(float(STEP)), F.col("_level")).cast("bigint") * F.lit(width)
        low, high = F.floor(F.col("start") / size), F.floor(F.col("end") / size)
        return df.withColumns({"_size": size, "_bin": F.explode(F.sequence(low, high))})

    left = own(regions.select("feature", "chr", "start", "end"))
    right = own(genes.select("gene_name", "chr", "start", "end"))
    # a handful of numbers: the levels that occur on each side
    on_left, on_right = ([r[0] for r in df.select("_own").distinct().orderBy("_own").collect()] for df in (left, right))
    levels = sorted({*on_left, *on_right})
    right = placed(right, levels).select("gene_name", "chr", "_level", "_bin", F.col("_own").alias("g_own"), F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    pairs = placed(left, levels).join(right, ["chr", "_level", "_bin"]).where(F.col("_level") == F.greatest("_own", "g_own"))
    pairs = pairs.where(overlaps(F.col("start"), F.col("end"), F.col("g_start"), F.col("g_end")))
    return pairs.where(F.floor(F.greatest("start", "g_start") / F.col("_size")) == F.col("_bin")).select("feature", "gene_name")


#: Stretches that the genes' range of positions is cut into at most, for running totals.
STRETCHES = 1 << 16


def overlap_totals(regions: DataFrame, genes: DataFrame, value: str) -> DataFrame:
    """(gene_name, n, total) of the genes that any region overlaps: in how many pairs of ``overlap_join``
    they are, and the sum of the regions' ``value`` (whole numbers; null counts as 0) over these.

    No pair is formed, so the work grows with the intervals, however many overlap. A region overlaps
    a gene if it starts at or before the gene's end, less those that end before the gene's start: the
    difference of two running totals along the chromosome. Values are summed by position first; then
    positions are cut into stretches, each carrying the totals before it, so that (chr, stretch)
    is the key. Empty intervals (start after end) overlap nothing."""
    exact = "decimal(38,0)"  # all regions' totals may not fit a long where each gene's do
    there = (F.col("start") <= F.col("end")) & F.col("chr").isNotNull()
    genes = genes.where(there)
    low, high = genes.agg(F.min("start"), F.max("end")).first()
    low, high = (0, 0) if low is None else (low, high)

    def entry(kind: int, pos: Column, sign: int) -> Column:
        return F.struct(F.lit(kind).alias("_kind"), pos.alias("_pos"), F.lit(sign).alias("_sign"))

    # starts (0) and ends (1); all before the first gene is one place, and nothing after the last counts
    first = F.lit(low) - 1
    ends = F.explode(F.array(*[entry(k, F.greatest(F.col(c), first), 0) for k, c in enumerate(("start", "end"))]))
    rows = regions.where(there).select("chr", F.coalesce(F.col(value).cast("bigint"), F.lit(0)).cast(exact).alias("_v"), ends.alias("e")).where(F.col("e._pos") <= high)
    rows = rows.groupBy("chr", "e._kind", "e._pos", "e._sign").agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").cast(exact).alias("_v"))
    rows = rows.withColumn("gene_name", F.lit(None).cast(genes.schema["gene_name"].dataType))
    asked = genes.select("chr", "gene_name", F.explode(F.array(entry(0, F.col("end"), 1), entry(1, F.col("start") - 1, -1))).alias("e"))
    asked = asked.select("chr", "gene_name", "e.*", F.lit(0).cast("bigint").alias("_n"), F.lit(0).cast(exact).alias("_v"))
    both = rows.unionByName(asked).withColumn("_s", F.floor((F.col("_pos") - first) / F.lit((high - low + 1) // STRETCHES + 1)))

    before = Window.partitionBy("chr", "_kind").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sums = both.groupBy("chr", "_kind", "_s").agg(F.sum("_n").alias("_n"), F.sum("_v").cast(exact).alias("_v"))
    sums = sums.select("chr", "_kind", "_s", *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast(t).alias(f"{c}0") for c, t in (("_n", "bigint"), ("_v", exact))])
    # regions' entries come before the genes' of the same place
    inner = Window.partitionBy("chr", "_kind", "_s").orderBy("_pos", F.abs("_sign")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.select("chr", "_kind", "_s", "_sign", "gene_name", F.sum("_n").over(inner).alias("_n"), F.sum("_v").over(inner).cast(exact).alias("_v"))
    found = found.where("_sign <> 0").join(sums, ["chr", "_kind", "_s"])
    n = F.sum(F.col("_sign") * (F.col("_n") + F.col("_n0"))).alias("n")
    total = F.sum(F.when(F.col("_sign") > 0, F.col("_v") + F.col("_v0")).otherwise(-F.col("_v") - F.col("_v0")).cast(exact)).cast("bigint").alias("total")
    return found.groupBy("gene_name").agg(n, total).where("n > 0")


def region_groupings(annotation: DataFrame, gene_sets: DataFrame, features: DataFrame, len_up: int = 5000, len_down: int = 5000, distinct: bool = True) -> DataFrame:
    """(group, feature): regions overlapping the promoter of a member of the group; groups without
    any have one row with a null feature. ``distinct=False`` keeps one row per overlap. The rows are
    checkpointed, to see which groups they leave out; no task takes a group's rows together."""
    sets = gene_sets.where(F.col("gene").isNotNull()).select("group", "gene").distinct()
    wanted = annotation.join(sets.select(F.col("gene").alias("gene_name")).distinct(), "gene_name", "left_semi")
    found = overlap_join(parse_regions(features.select("feature")), promoters(wanted, len_up, len_down))
    member = sets.join(found.withColumnRenamed("gene_name", "gene"), "gene").select("group", "feature")
    if distinct:
        member = member.distinct()
    member = cut(member)
    without = gene_sets.select("group").distinct().join(member.select("group").distinct(), "group", "left_anti")
    return member.unionByName(without.withColumn("feature", F.lit(None).cast("string")))
