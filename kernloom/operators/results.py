"""Result relations: tidy metrics and weights, summaries, and the tables behind plots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernloom.functions.lineage import cut
from kernloom.operators.evaluate import METRICS


def result_kind(frame: DataFrame) -> tuple[bool, bool]:
    """(multiclass, many): whether the rows carry a class, and a key."""
    return "class" in frame.columns, "key" in frame.columns


def flag_alpha_star(frame: DataFrame, alpha_star: float) -> DataFrame:
    return frame.withColumn("alpha_star", F.col("alpha") == F.lit(float(alpha_star)))


def metrics_long(wide: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row per metric of a frame with one column per metric."""
    kept = [c for c in wide.columns if c not in metrics]
    return wide.unpivot(kept, [m for m in metrics if m in wide.columns], "metric", "value")


def weights_long(arrays: DataFrame) -> DataFrame:
    """(..., group, kernel_weight) of rows with arrays ``groups`` and ``norms``."""
    kept = [c for c in arrays.columns if c not in ("groups", "norms")]
    return arrays.select(*kept, F.explode(F.arrays_zip("groups", "norms")).alias("x")).select(*kept, F.col("x.groups").alias("group"), F.col("x.norms").alias("kernel_weight"))


def many(results: dict[str, DataFrame]) -> DataFrame:
    """Results of several runs in one frame, by ``key``."""
    frames = [f.withColumn("key", F.lit(k)) for k, f in results.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _by_class(frame: DataFrame) -> list[str]:
    return ["class"] if "class" in frame.columns else []


def selection(weights: DataFrame, order_groups: bool = False) -> DataFrame:
    """(alpha, group[, class], selection): runs in which the group has weight; with an order of
    the groups by their total if asked."""
    by = ["alpha", "group", *_by_class(weights)]
    out = weights.groupBy(*by).agg(F.sum((F.col("kernel_weight") > 0).cast("bigint")).alias("selection"))
    if not order_groups:
        return out
    total = out.groupBy("group").agg(F.sum("selection").alias("_t"))
    ranked = total.withColumn("group_rank", F.row_number().over(Window.orderBy(F.desc("_t"), "group")))  # one row per group
    return out.join(ranked.drop("_t"), "group")


def groups_per_alpha(selected: DataFrame) -> DataFrame:
    """(alpha, mean_selection, n_selected): the mean over groups, and the sum."""
    return selected.groupBy("alpha").agg(F.avg("selection").alias("mean_selection"), F.sum("selection").alias("n_selected"))


def summary(metrics: DataFrame, weights: DataFrame, metric: str = "AUROC") -> DataFrame:
    """(alpha[, class], metric, n_selected, top_group): equal weights go to the first group."""
    by = ["alpha", *_by_class(weights)]
    if "group_ord" not in weights.columns:
        weights = weights.withColumn("group_ord", F.col("group"))
    top = F.min_by("group", F.struct((-F.col("kernel_weight")).alias("w"), "group_ord"))
    per = weights.groupBy(*by).agg(F.sum((F.col("kernel_weight") != 0).cast("bigint")).alias("n_selected"), top.alias("top_group"))
    per = per.withColumn("top_group", F.when(F.col("n_selected") > 0, F.col("top_group")).otherwise("No groups selected"))
    value = metrics.where(F.col("metric") == metric).select(*by, F.col("value").alias(metric.lower().replace("-", "_")))
    return value.join(per, by)


def sort_groups(weights: DataFrame) -> DataFrame:
    return weights.orderBy(F.desc("kernel_weight"), "group")


def format_group_names(name: Column, rm_words: list[str] = ()) -> Column:
    """Words of a name split at '_' and blanks; alphabetic words over three letters capitalised;
    ``rm_words`` dropped in any case; joined by blanks."""
    words = F.filter(F.split(name, "[_\\s]+"), lambda w: w != "")
    if rm_words:
        drop = F.array(*[F.lit(w.lower()) for w in rm_words])
        words = F.filter(words, lambda w: ~F.array_contains(drop, F.lower(w)))
    shown = F.transform(words, lambda w: F.when(w.rlike("^[A-Za-z]+$") & (F.char_length(w) > 3), F.initcap(F.lower(w))).otherwise(w))
    return F.array_join(shown, " ")


def plot_alpha(weights: DataFrame, alpha: float | None = None, alpha_star: float | None = None) -> float:
    """The alpha to show: the one given, else alpha star, else the least."""
    for a in (alpha, alpha_star):
        if a is not None:
            return float(a)
    return weights.agg(F.min("alpha")).first()[0]


def confusion_matrix(predictions: DataFrame, normalize: bool = False) -> DataFrame:
    """(observed, predicted, n): all pairs of observed labels; predictions of other labels are left
    out. Normalised by row if asked."""
    labels = predictions.select("observed").where("observed is not null").distinct()
    grid = labels.join(F.broadcast(labels.withColumnRenamed("observed", "predicted")))  # labels by labels: the result's shape
    counts = predictions.groupBy("observed", "predicted").agg(F.count(F.lit(1)).alias("n"))
    out = grid.join(counts, ["observed", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double" if normalize else "bigint"))
    if not normalize:
        return out
    row = F.sum("n").over(Window.partitionBy("observed"))
    return out.withColumn("n", F.when(row > 0, F.col("n") / row).otherwise(0.0))


def accuracy(matrix: DataFrame) -> DataFrame:
    hit = F.sum(F.when(F.col("observed") == F.col("predicted"), F.col("n")).otherwise(0))
    return matrix.agg((hit / F.sum("n")).alias("accuracy"))


def metric_plot(summary_frame: DataFrame, value: str = "auroc") -> DataFrame:
    """Value by alpha with the floor of the axis: 0 if any value is under a half, else 0.6."""
    low = summary_frame.agg((F.min(value) < 0.5).alias("_l"))
    return summary_frame.join(F.broadcast(low)).select("alpha", F.col(value).alias("value"), F.when(F.col("_l"), 0.0).otherwise(0.6).alias("y_floor"))


def top_groups(weights: DataFrame, n: int = 1, alpha: float | None = None) -> DataFrame:
    """The n heaviest groups at an alpha, per class if there are classes."""
    rows = weights.where(F.col("alpha") == plot_alpha(weights, alpha))
    order = Window.partitionBy(*_by_class(weights)).orderBy(F.desc("kernel_weight"), "group")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def weights_heatmap(weights: DataFrame, n_groups: int | None = None, scale_weights: bool = False) -> DataFrame:
    """Weights of the groups with the largest totals (in that order); per class as a share of the
    class's largest if scaled."""
    total = weights.groupBy("group").agg(F.sum("kernel_weight").alias("_t"))
    ranked = total.withColumn("group_rank", F.row_number().over(Window.orderBy(F.desc("_t"), "group"))).drop("_t")
    if n_groups is not None:
        ranked = ranked.where(F.col("group_rank") <= n_groups)
    out = weights.join(F.broadcast(ranked), "group")
    if scale_weights:
        most = F.max("kernel_weight").over(Window.partitionBy(*_by_class(weights)))
        out = out.withColumn("kernel_weight", F.when(most > 0, F.col("kernel_weight") / most).otherwise(0.0))
    return out


def weights_dotplot(weights: DataFrame, n_groups: int | None = None, scale_weights: bool = False) -> DataFrame:
    """As the heatmap; scaling needs classes."""
    return weights_heatmap(weights, n_groups, scale_weights and "class" in weights.columns)


def group_embedding(matrix: DataFrame, cells: DataFrame, groups: DataFrame, names: list[str], is_binary: bool = False, k: int = 2) -> DataFrame:
    """(cell_id, split, coords): the union of the groups' features, TF-IDF (binary data) or
    totals of 10,000 and log1p, on the first axes: the input of a two-dimensional layout."""
    from kernloom.operators import prep

    used = groups.where(F.col("group").isin(names)).select("feature").distinct()
    rows = cut(matrix.join(used, "feature", "left_semi"))  # read five times: statistics, totals, entries
    if is_binary:
        rows = prep.tfidf(rows, cells)
    else:
        total = rows.groupBy("cell_id").agg(F.sum("value").alias("_t")).where("_t <> 0")
        rows = rows.join(total, "cell_id").select("cell_id", "feature", F.log1p(F.col("value") * 10_000 / F.col("_t")).alias("value"))
    one = used.select(F.lit("all").alias("group"), F.lit(0).alias("group_ord"), "feature")
    vectors = cut(prep.group_vectors(rows, cells, one, scale_data=is_binary))
    reduced = prep.reduce_vectors(vectors, "svd" if is_binary else "pca", k + is_binary)
    return reduced.select("cell_id", "split", F.col("x").alias("coords"))
