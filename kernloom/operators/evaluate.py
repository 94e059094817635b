"""Prediction, metrics, runs over alphas, one-versus-rest and hyper-parameter search."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kernloom.operators import lasso, splitting

METRICS = ("AUROC", "Accuracy", "F1-Score", "Precision", "Recall")
DEFAULT_ALPHAS = [round(a, 2) for a in np.linspace(1.9, 0.05, 10)]


def linear_scores(z: DataFrame, models: list[tuple[np.ndarray, float]], groups: list[str], width: int) -> DataFrame:
    """(cell_id, model, p): sigmoid of the intercept plus the blocks' products, for every model in
    one pass over Z: a matrix product per batch and group, then one sum by cell. Groups without
    weight in all models are not read, but the first, which every cell has."""
    heavy = [i for i in range(len(groups)) if i == 0 or any(w[i * width : (i + 1) * width].any() for w, _ in models)]
    coef = {groups[i]: np.stack([w[i * width : (i + 1) * width] for w, _ in models], axis=1) for i in heavy}
    sent = z.sparkSession.sparkContext.broadcast(coef)  # the size of the models
    names = [f"s{k}" for k in range(len(models))]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for g, rows in pdf.groupby("group", sort=False):
                s = np.stack(rows["z"].to_numpy()) @ sent.value[g]
                yield pd.concat([rows[["cell_id"]].reset_index(drop=True), pd.DataFrame(s, columns=names)], axis=1)

    schema = f"cell_id {z.schema['cell_id'].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names)
    parts = z.where(F.col("group").isin(list(coef))).select("cell_id", "group", "z").mapInPandas(run, schema)
    sums = parts.groupBy("cell_id").agg(*[F.sum(n).alias(n) for n in names])
    each = F.array(*[F.struct(F.lit(k).alias("model"), (1 / (1 + F.exp(-(F.col(n) + F.lit(float(models[k][1])))))).alias("p")) for k, n in enumerate(names)])
    return sums.select("cell_id", F.explode(each).alias("m")).select("cell_id", "m.model", "m.p")


def predict(scores: DataFrame, cells: DataFrame, classes: tuple[str, str], by: list[str] = ()) -> DataFrame:
    """(cell_id, observed, predicted, prob): the first class where p > 0.5."""
    rows = scores.join(cells.select("cell_id", F.col("label").alias("observed")), "cell_id")
    return rows.select(*by, "cell_id", "observed", F.when(F.col("p") > 0.5, classes[0]).otherwise(classes[1]).alias("predicted"), F.col("p").alias("prob"))


def auroc(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, auroc) of (by, prob in [0, 1], pos boolean) by mid-ranks. Rows with equal prob are one
    count first; buckets of prob carry offsets, so no task sorts them all."""
    by = list(by)
    counts = rows.groupBy(*by, "prob").agg(F.sum(F.col("pos").cast("bigint")).alias("p"), F.sum((~F.col("pos")).cast("bigint")).alias("n"))
    counts = counts.withColumn("_b", F.floor(F.col("prob") * 4096))
    sums = counts.groupBy(*by, "_b").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_o", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inner = Window.partitionBy(*by, "_b").orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n").over(inner), F.lit(0)) + F.col("_o")
    each = counts.join(offsets, [*by, "_b"]).withColumn("_w", F.col("p") * (below + F.col("n") / 2))
    total = F.sum("p").cast("double") * F.sum("n")
    return each.groupBy(*by).agg(F.when(total > 0, F.sum("_w") / total).alias("auroc"))


def _ratio(top: Column, below: Column) -> Column:
    return F.when(below > 0, top / below).otherwise(0.0)


def binary_metrics(predictions: DataFrame, positive: str | Column, by: list[str] = ()) -> DataFrame:
    """(by, metric, value) of the five metrics, ``positive`` being the positive class; rows
    without an observed label are left out, and give no metrics alone."""
    by = list(by)
    known = predictions.where(F.col("observed").isNotNull())
    obs, pred = F.col("observed") == positive, F.col("predicted") == positive
    count = lambda c: F.sum(c.cast("bigint"))
    sums = known.groupBy(*by).agg(count(obs & pred).alias("tp"), count(~obs & pred).alias("fp"), count(obs & ~pred).alias("fn"), F.count(F.lit(1)).alias("n"))
    sums = sums.where("n > 0")
    area = auroc(known.select(*by, "prob", obs.alias("pos")), by)
    rows = sums.join(area, by) if by else sums.join(F.broadcast(area))  # one row each
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    values = {
        "AUROC": F.col("auroc"),
        "Accuracy": (F.col("n") - fp - fn) / F.col("n"),
        "F1-Score": _ratio(2 * tp, 2 * tp + fp + fn),
        "Precision": _ratio(tp, tp + fp),
        "Recall": _ratio(tp, tp + fn),
    }
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()]))
    return rows.select(*by, stacked.alias("m")).select(*by, "m.metric", "m.value")


def macro_f1(predictions: DataFrame) -> DataFrame:
    """One row: mean F1 over the labels that are observed or predicted."""
    both = predictions.select(F.explode(F.array(F.struct(F.col("observed").alias("label"), F.lit(1).alias("o"), F.lit(0).alias("p"), (F.col("observed") == F.col("predicted")).cast("int").alias("t")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("o"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("x")).select("x.*")
    per = both.groupBy("label").agg(F.sum("o").alias("o"), F.sum("p").alias("p"), F.sum("t").alias("t"))
    return per.agg(F.avg(_ratio(2 * F.col("t"), F.col("o") + F.col("p"))).alias("macro_f1"))


def classes_of(cells: DataFrame) -> tuple[str, str]:
    """The two labels; the first by name is the positive one."""
    found = [r[0] for r in cells.where(F.col("label").isNotNull()).select("label").distinct().orderBy("label").collect()]
    if len(found) != 2:
        raise ValueError("two classes are needed")
    return found[0], found[1]


#: What one-versus-rest calls all other classes.
OTHER = "other"


def run(z: DataFrame, cells: DataFrame, alphas: list[float], metrics: tuple[str, ...] = METRICS, norm_mode: str = "reference", sums: lasso.Sums | None = None) -> dict[str, DataFrame]:
    """Metrics, weights (with the duality gap of the model), predictions and seconds of the solve for
    each alpha, from one pass of sums where Z is narrow and one pass of scores; the alphas are
    solved from the largest down, each from the one before."""
    classes = classes_of(cells)
    if sums is None:
        y = F.array(F.when(F.col("label") == classes[0], 1.0).otherwise(-1.0))
        todo = lasso.problem(z, cells.where("split = 'train'").select("cell_id", y.alias("y")))
    else:
        todo = lasso.Problem(sums.groups, sums.width, 1, sums=[sums])
    models, weights, timing = fit_path(todo, alphas, [None], norm_mode)
    todo.release()
    predictions = binary_predictions(z, cells, models, todo, classes)
    values = binary_metrics(predictions, classes[0], ["alpha"]).where(F.col("metric").isin(*metrics))
    return {"metrics": values, "weights": weights.drop("class"), "predictions": predictions, "timing": timing.drop("class")}


def fit_path(todo: lasso.Problem, alphas: list[float], names: list[str | None], norm_mode: str) -> tuple[list[tuple], DataFrame, DataFrame]:
    """([(class, alpha, coefficients, intercept)], weights, seconds) of every target at every alpha."""
    spark = SparkSession.active()
    models, weights, timing, starts = [], [], [], {}
    for alpha in sorted(map(float, alphas), reverse=True):
        began = time.time()
        found = todo.fit(alpha, starts=starts)
        took = (time.time() - began) / len(found)
        for t, (w, b, gap) in sorted(found.items()):
            starts[t] = w
            models.append((names[t], alpha, w, b))
            norms = lasso.group_norms(w, todo.width, norm_mode)
            weights += [(names[t], alpha, g, i, float(x), float(gap)) for i, (g, x) in enumerate(zip(todo.groups, norms))]
            timing.append((names[t], alpha, took))
    shape = "class string, alpha double, group string, group_ord int, kernel_weight double, gap double"
    return models, spark.createDataFrame(weights, shape), spark.createDataFrame(timing, "class string, alpha double, seconds double")


def selected_groups(weights: DataFrame) -> DataFrame:
    return weights.where("kernel_weight <> 0")


def binary_predictions(z: DataFrame, cells: DataFrame, models: list[tuple], todo: lasso.Problem, classes: tuple[str, str]) -> DataFrame:
    """(alpha, cell_id, observed, predicted, prob) of test cells by all models in one pass."""
    scores = linear_scores(z.where("split = 'test'"), [m[2:] for m in models], todo.groups, todo.width)
    alpha_of = F.element_at(F.array(*[F.lit(a) for _, a, *_ in models]), F.col("model") + 1)
    return predict(scores.withColumn("alpha", alpha_of), cells.where("split = 'test'"), classes, ["alpha"])


def class_targets(cells: DataFrame, labels: list[str], chosen: DataFrame | None = None) -> DataFrame:
    """(cell_id, y, s) of training cells: 1 for a class's own cells, -1 for others; with ``chosen``
    (class, cell_id) only the cells chosen for a class count for it."""
    train = cells.where("split = 'train'")
    y = F.array(*[F.when(F.col("label") == c, 1.0).otherwise(-1.0) for c in labels])
    if chosen is None:
        return train.select("cell_id", y.alias("y"))
    of = chosen.groupBy("cell_id").agg(F.collect_set("class").alias("_of"))
    s = F.array(*[F.array_contains("_of", c).cast("double") for c in labels])
    return train.join(of, "cell_id").select("cell_id", y.alias("y"), s.alias("s"))


def class_predictions(z: DataFrame, cells: DataFrame, models: list[tuple], todo: lasso.Problem) -> DataFrame:
    """(class, alpha, cell_id, observed, predicted, prob) of test cells by all models in one pass. Of
    equal chances the one later by name wins, as in the binary case."""
    scores = linear_scores(z.where("split = 'test'"), [m[2:] for m in models], todo.groups, todo.width)
    at = F.element_at(F.array(*[F.struct(F.lit(c).alias("class"), F.lit(a).alias("alpha")) for c, a, *_ in models]), F.col("model") + 1)
    rows = scores.withColumn("_m", at).select("cell_id", "p", "_m.class", "_m.alpha")
    rows = rows.join(cells.where("split = 'test'").select("cell_id", F.col("label").alias("_l")), "cell_id")
    observed = F.when(F.col("_l") == F.col("class"), F.col("class")).when(F.col("_l").isNotNull(), OTHER)
    mine = F.when(F.col("class") > OTHER, F.col("p") >= 0.5).otherwise(F.col("p") > 0.5)
    return rows.select("class", "alpha", "cell_id", observed.alias("observed"), F.when(mine, F.col("class")).otherwise(OTHER).alias("predicted"), F.col("p").alias("prob"))


def class_metrics(predictions: DataFrame) -> DataFrame:
    """(class, alpha, metric, value); the label that is first by name is the positive one."""
    first = F.when(F.col("class") > OTHER, 1 - F.col("prob")).otherwise(F.col("prob"))
    return binary_metrics(predictions.withColumn("prob", first), F.least(F.col("class"), F.lit(OTHER)), ["class", "alpha"])


def one_v_rest(z: DataFrame, cells: DataFrame, alphas: list[float], force_balance: bool = False, other_factor: float = 1.0, seed: str = "1", final_alpha: float | dict | None = None, norm_mode: str = "reference") -> dict[str, DataFrame]:
    """One model per class against all others over one Z: one pass sums for all classes (balanced or
    not), one pass scores all classes and alphas."""
    labels = [r[0] for r in splitting.labels_in_both(cells).collect()]
    if not labels:
        raise ValueError("no label is in both splits")
    chosen = splitting.class_train(cells, other_factor, seed) if force_balance else None
    todo = lasso.problem(z, class_targets(cells, labels, chosen))
    models, weights, timing = fit_path(todo, alphas, labels, norm_mode)
    todo.release()
    predictions = class_predictions(z, cells, models, todo)
    out = {"metrics": class_metrics(predictions), "weights": weights, "predictions": predictions, "timing": timing}
    final = min(alphas) if final_alpha is None else final_alpha
    last = out["predictions"]
    if isinstance(final, dict):
        keep = None
        for c, a in final.items():
            this = (F.col("class") == c) & (F.col("alpha") == float(a))
            keep = this if keep is None else keep | this
        last = last.where(keep)
    else:
        last = last.where(F.col("alpha") == float(final))
    table = prob_table(last.select("cell_id", "class", F.col("prob").alias("p")))
    out["multiclass"] = table.join(cells.select("cell_id", F.col("label").alias("observed")), "cell_id")
    out["macro_f1"] = macro_f1(out["multiclass"].select("observed", F.col("prediction").alias("predicted")))
    return out


def prob_table(p: DataFrame) -> DataFrame:
    """(cell_id, prediction, p_max, low_conf) of (cell_id, class, p): the likeliest class, ties
    joined by ' and '; low confidence where no class is over a half."""
    best = p.groupBy("cell_id").agg(F.max("p").alias("p_max"), F.collect_list(F.struct("class", "p")).alias("all"))
    ties = F.array_sort(F.transform(F.filter("all", lambda x: x["p"] == F.col("p_max")), lambda x: x["class"]))
    return best.select("cell_id", F.array_join(ties, " and ").alias("prediction"), "p_max", (F.col("p_max") <= 0.5).alias("low_conf"))


def per_model_summary(metrics: DataFrame, alpha: float | dict) -> DataFrame:
    """One row per class at its alpha, a column per metric."""
    if isinstance(alpha, dict):
        own = metrics.sparkSession.createDataFrame([(c, float(a)) for c, a in alpha.items()], "class string, alpha double")
        metrics = metrics.join(F.broadcast(own), ["class", "alpha"])
    else:
        metrics = metrics.where(F.col("alpha") == float(alpha))
    return metrics.groupBy("class").pivot("metric", list(METRICS)).agg(F.first("value"))


def stop_early(values: list[float]) -> bool:
    """Whether the last value is below the one before."""
    return len(values) > 1 and values[-1] < values[-2]


def best_alpha(table: DataFrame) -> DataFrame:
    """One row of (fold, alpha, value): the alpha with the best mean, the smallest of equals."""
    return table.groupBy("alpha").agg(F.avg("value").alias("mean")).orderBy(F.desc("mean"), "alpha").limit(1)


def optimize_alpha(make_z: Callable[[DataFrame], DataFrame], cells: DataFrame, alphas: list[float] | None = None, k: int = 4, metric: str = "AUROC", early_stopping: bool = False, seed: str = "1", force_balance: bool = True) -> float | dict[str, float]:
    """The best alpha by k-fold cross-validation over training cells, or one per class where
    there are more than two. ``make_z`` makes Z of a fold's cells, so widths and scaling are
    refit in each fold. One pass scores all classes and alphas of a fold; with early stopping the value
    that falls and those after it are neither in the means nor, after it, solved for."""
    alphas = sorted(alphas or DEFAULT_ALPHAS)
    labels = [r[0] for r in cells.where("split = 'train'").select("label").distinct().orderBy("label").collect()]
    if len(labels) < 2:
        raise ValueError("two classes are needed")
    folded = splitting.folds(cells, k, seed).persist()
    rows: list[tuple] = []
    for fold in range(k):
        own = splitting.fold_cells(cells, folded, fold).persist()
        z = make_z(own).persist()
        rows += [(c, fold, a, v) for c, a, v in fold_values(z, own, alphas, labels, metric, early_stopping, seed, force_balance)]
        z.unpersist()
        own.unpersist()
    folded.unpersist()
    table = cells.sparkSession.createDataFrame(rows, "class string, fold int, alpha double, value double")
    if len(labels) <= 2:
        return best_alpha(table).first()["alpha"]
    return {c: best_alpha(table.where(F.col("class") == c)).first()["alpha"] for c in labels}


def fold_values(z: DataFrame, cells: DataFrame, alphas: list[float], labels: list[str], metric: str, early_stopping: bool, seed: str, force_balance: bool, solved: list | None = None) -> list[tuple[str, float, float]]:
    """[(class, alpha, value)] of one fold: one problem for all classes (the first label alone where
    there are two). With early stopping the alphas come in waves, smallest first; a class leaves when
    its value falls, and is solved no more. ``solved`` gets the number of solves of each wave."""
    names = labels if len(labels) > 2 else labels[:1]
    chosen = splitting.class_train(cells, 1.5, seed) if len(labels) > 2 and force_balance else None
    todo = lasso.problem(z, class_targets(cells, names, chosen))
    waves = [[a] for a in sorted(alphas)] if early_stopping else [sorted(alphas)]
    running, seen, out = list(range(len(names))), {t: [] for t in range(len(names))}, []
    for wave in waves:
        models, starts, before = [], {}, todo.solves
        for alpha in sorted(wave, reverse=True):
            found = todo.fit(float(alpha), running, starts)
            starts = {t: m[0] for t, m in found.items()}
            models += [(names[t], float(alpha), *m[:2]) for t, m in found.items()]
        if solved is not None:
            solved.append(todo.solves - before)
        # metrics read the predictions several times; Z is scored once
        if len(labels) == 2:
            scored = binary_predictions(z, cells, models, todo, (labels[0], labels[1])).persist()
            values = binary_metrics(scored, labels[0], ["alpha"]).withColumn("class", F.lit(labels[0]))
        else:
            scored = class_predictions(z, cells, models, todo).persist()
            values = class_metrics(scored)
        got = {(r["class"], r["alpha"]): r["value"] for r in values.where(F.col("metric") == metric).collect()}
        scored.unpersist()
        for alpha in wave:
            for t in list(running):
                seen[t].append(got.get((names[t], float(alpha))) or 0.0)
                if early_stopping and stop_early(seen[t]):
                    running.remove(t)
                else:
                    out.append((names[t], float(alpha), seen[t][-1]))
        if not running:
            break
    todo.release()
    return out


def optimize_sparsity(sums: lasso.Sums, starting_alpha: float = 1.9, increment: float = 0.2, target: int = 1, n_iter: int = 10, norm_mode: str = "reference") -> tuple[dict[float, int], float]:
    """({alpha: number of groups}, best alpha): steps down while too few groups are selected, up
    while too many; the step halves when the direction turns."""
    if not 0 < target:
        raise ValueError("target must be positive")
    alpha, found, turned, w = starting_alpha, {}, None, None
    for _ in range(n_iter):
        w, _ = lasso.solve(sums, alpha, start=w)
        n = int((lasso.group_norms(w, sums.width, norm_mode) != 0).sum())
        found[round(alpha, 4)] = n
        if n == target:
            break
        way = -1 if n < target else 1
        if turned is not None and way != turned:
            increment /= 2
        turned = way
        alpha = max(alpha + way * increment, 1e-3)
    return found, min(found, key=lambda a: abs(found[a] - target))
