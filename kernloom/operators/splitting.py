"""Feature filtering, stratified splits and samples. All draws are functions of (seed, id)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kernloom.functions.rand import draw, hash_rank


def filter_groups(features: DataFrame, groups: DataFrame, least: int = 2) -> DataFrame:
    """(group, group_ord, feature): members that are features, of groups with ``least`` of them."""
    rows = groups.select("group", "group_ord", "feature").distinct().join(features.select("feature"), "feature", "left_semi")
    big = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return rows.join(big.select("group"), "group", "left_semi")


def kept_features(features: DataFrame, groups: DataFrame) -> DataFrame:
    """Features in any group, dropped ones included, in their own order."""
    return features.join(groups.select("feature").distinct(), "feature", "left_semi")


def _share(n: Column, ratio: float) -> Column:
    return F.floor(n.cast("double") * F.lit(float(ratio)))


def stratified_split(cells: DataFrame, ratio: float = 0.8, seed: str = "1") -> DataFrame:
    """``cells`` with split: the first int(n * ratio) of each label in random order train."""
    sizes = cells.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    ranked = hash_rank(cells, f"split{seed}", "cell_id", ["label"])
    # as many rows as labels
    joined = ranked.join(F.broadcast(sizes), "label")
    return joined.withColumn("split", F.when(F.col("rn") <= _share(F.col("_n"), ratio), "train").otherwise("test")).select(*cells.columns, "split")


def multiclass_split(cells: DataFrame, ratio: float = 0.8, seed: str = "1", class_threshold: int | str | None = None, with_replacement: bool = False) -> DataFrame:
    """As ``stratified_split``; training rows over ``class_threshold`` per class (a number, or the
    median class's training size) lose their split. ``with_replacement`` draws them with
    repeats instead, a row appearing as often as drawn."""
    split = stratified_split(cells, ratio, seed)
    if class_threshold is None:
        return split
    train = split.where("split = 'train'")
    cap = class_threshold
    if cap == "median":
        cap = int(train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.median("n")).first()[0])
    ranked = hash_rank(train, f"cap{seed}", "cell_id", ["label"])
    if not with_replacement:
        return ranked.where(F.col("rn") <= cap).drop("rn").unionByName(split.where("split = 'test'"))
    from kernloom.functions.rand import uniform

    sizes = ranked.groupBy("label").agg(F.max("rn").alias("n"))
    draws = sizes.select("label", "n", F.explode(F.sequence(F.lit(1), F.least(F.lit(cap), F.col("n")).cast("int"))).alias("i"))
    key = F.concat_ws(":", "label", "i")
    picked = draws.withColumn("rn", F.when(F.col("n") > cap, F.floor(uniform(f"again{seed}", key) * F.col("n")) + 1).otherwise(F.col("i")))
    chosen = picked.select("label", "rn").join(ranked, ["label", "rn"]).select(*split.columns)
    return chosen.unionByName(split.where("split = 'test'"))


def complement_split(cells: DataFrame, train: DataFrame) -> DataFrame:
    """Rows with ids in ``train`` train, all others test."""
    marks = train.select("cell_id", F.lit("train").alias("split")).distinct()
    return cells.join(marks, "cell_id", "left").withColumn("split", F.coalesce("split", F.lit("test")))


def train_first(cells: DataFrame) -> DataFrame:
    """Rows with a split and their new position, training rows first, then by id. Offsets per
    bucket of ids keep the numbering out of a single task: of 4,096 numbers, or, where ids are
    texts (barcodes), between 255 of them drawn at random."""
    rows = cells.where(F.col("split").isin("train", "test")).withColumn("_t", (F.col("split") == "test").cast("int"))
    if isinstance(cells.schema["cell_id"].dataType, StringType):
        bounds = sorted({r[0] for r in sample_cells(cells.where("cell_id IS NOT NULL").select("cell_id"), 255, "bounds").collect()})
        bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("cell_id")))
    else:
        bucket = F.floor(F.col("cell_id") / 4096)
    rows = rows.withColumn("_b", bucket)
    counts = rows.groupBy("_t", "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_t", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inner = Window.partitionBy("_t", "_b").orderBy("cell_id")
    ranked = rows.withColumn("_r", F.row_number().over(inner)).join(offsets, ["_t", "_b"])
    return ranked.withColumn("pos", (F.col("_o") + F.col("_r") - 1).cast("bigint")).select(*cells.columns, "pos")


def calculate_d(n: Column | float):
    """Number of random features for ``n`` samples: max(100, int(sqrt(n) * ln(ln n)))."""
    if isinstance(n, Column):
        return F.greatest(F.lit(100), F.floor(F.sqrt(n) * F.log(F.log(n.cast("double"))))).cast("bigint")
    return max(100, int(math.sqrt(n) * math.log(math.log(n)))) if n > math.e else 100


def median_run_size(cells: DataFrame, other_factor: float = 1.5) -> DataFrame:
    """One row: median over training classes of n_test + other_factor * n_train of the class."""
    test = cells.where("split = 'test'").agg(F.count(F.lit(1)).alias("t"))
    per = cells.where("split = 'train'").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    # both sides are sums: one row, and one row per class
    return per.join(F.broadcast(test)).agg(F.median(F.col("t") + F.lit(float(other_factor)) * F.col("n")).alias("median_size"))


def choose_d(cells: DataFrame, d: int | None, allow_multiclass: bool, other_factor: float = 1.5) -> int:
    if d is not None:
        if d <= 0:
            raise ValueError("d must be positive")
        return d
    n = median_run_size(cells, other_factor).first()[0] if allow_multiclass else cells.count()
    return calculate_d(n or 0)


def small_classes(cells: DataFrame, least: int = 10) -> DataFrame:
    return cells.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)


def sample_cells(cells: DataFrame, k: int, seed: str = "1") -> DataFrame:
    """min(n, k) rows in random order, by a top-k of the draws."""
    return cells.orderBy(draw(f"sample{seed}", F.col("cell_id")), "cell_id").limit(k)


def batches(cells: DataFrame, n_batches: int, batch_size: int, seed: str = "1") -> DataFrame:
    """Rows of ``n_batches`` disjoint random batches of ``batch_size``, with ``batch``."""
    ranked = hash_rank(cells, f"batch{seed}", "cell_id")
    return ranked.where(F.col("rn") <= n_batches * batch_size).withColumn("batch", F.floor((F.col("rn") - 1) / batch_size).cast("int")).drop("rn")


def class_train(cells: DataFrame, other_factor: float = 1.5, seed: str = "1") -> DataFrame:
    """(class, cell_id): for each class all its training rows and int(factor * n) others at most.

    The others of every class come in the same random order, so counts by label and the draws' first
    digits tell where a class's share ends: rows before that bucket belong to it as they are, and
    only those of that one bucket are ranked."""
    train = cells.where("split = 'train'").select("cell_id", "label")
    target = train.select(F.col("label").alias("class"), "cell_id")
    drawn = train.where(F.col("label").isNotNull()).withColumn("_d", draw(f"others{seed}", F.col("cell_id"))).withColumn("_b", F.substring("_d", 1, 3))
    # 4,096 buckets a label at most
    own = drawn.groupBy("label", "_b").agg(F.count(F.lit(1)).alias("_own"))
    sizes = own.groupBy(F.col("label").alias("class")).agg(F.sum("_own").alias("n"))
    grid = F.broadcast(sizes).crossJoin(own.groupBy("_b").agg(F.sum("_own").alias("_all")))
    grid = grid.join(own.select(F.col("label").alias("class"), "_b", "_own"), ["class", "_b"], "left")
    grid = grid.withColumn("_k", F.col("_all") - F.coalesce("_own", F.lit(0)))
    upto = F.sum("_k").over(Window.partitionBy("class").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    over = grid.withColumn("_over", upto - _share(F.col("n"), other_factor))
    # a row per class: the bucket in which its share ends, and how many rows of that it takes; none: it takes all
    ends = over.groupBy("class").agg(F.min(F.when(F.col("_over") > 0, F.struct("_b", (F.col("_k") - F.col("_over")).alias("room")))).alias("end"))
    others = drawn.withColumnRenamed("_b", "_at").join(F.broadcast(ends), (F.col("label") != F.col("class")) & (F.col("end").isNull() | (F.col("_at") <= F.col("end._b"))))
    last = F.col("end").isNotNull() & (F.col("_at") == F.col("end._b"))
    whole = others.where(~last).select("class", "cell_id")
    ranked = others.where(last).withColumn("_r", F.row_number().over(Window.partitionBy("class").orderBy("_d", "cell_id")))
    return target.unionByName(whole).unionByName(ranked.where(F.col("_r") <= F.col("end.room")).select("class", "cell_id"))


def folds(cells: DataFrame, k: int, seed: str = "1") -> DataFrame:
    """Training rows with ``fold`` in 0..k-1, stratified by label."""
    if k < 2:
        raise ValueError("k must be at least 2")
    ranked = hash_rank(cells.where("split = 'train'"), f"fold{seed}", "cell_id", ["label"])
    return ranked.withColumn("fold", ((F.col("rn") - 1) % k).cast("int")).drop("rn")


def fold_cells(cells: DataFrame, folded: DataFrame, fold: int) -> DataFrame:
    """Cells of one fold: its rows test, the other training rows train, the rest dropped."""
    rows = folded.withColumn("split", F.when(F.col("fold") == fold, "test").otherwise("train"))
    return rows.select(*cells.columns)


def labels_in_both(cells: DataFrame) -> DataFrame:
    train = cells.where("split = 'train'").select("label")
    return train.intersect(cells.where("split = 'test'").select("label")).orderBy("label")


def consistency(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (cell_id, split, label) that only one of two modalities has; none if they agree."""
    a, b = left.select("cell_id", "split", "label"), right.select("cell_id", "split", "label")
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
