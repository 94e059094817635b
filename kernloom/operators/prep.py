"""Preprocessing of long matrices (cell_id, feature, value; absent is 0): variance, TF-IDF,
log and z-score scaling, dense vectors per group, reductions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernloom.functions.rand import hash_rank
from kernloom.functions.sums import summed

LEAST_VARIANCE = 1e-5
ONE = "__one__"


def zero_filled(value: Column, n: Column | int) -> tuple[Column, Column]:
    """(mean, population variance) of ``value`` and as many zeros as there are rows too few for ``n``.
    The deviations of the rows that there are come merged from (n, mean, M2), so large values with a
    small variance lose nothing; the zeros are merged the same way."""
    n = (n if isinstance(n, Column) else F.lit(n)).cast("double")
    m, mean = F.count(value), F.avg(value)
    return mean * m / n, (F.var_pop(value) + mean * mean * (n - m) / n) * m / n


def feature_variance(matrix: DataFrame, n: Column | int) -> DataFrame:
    """(feature, variance): population variance, absent entries as zeros."""
    return matrix.groupBy("feature").agg(zero_filled(F.col("value"), n)[1].alias("variance"))


def cell_variance(matrix: DataFrame, cells: DataFrame, n_features: int) -> DataFrame:
    """(cell_id, variance) over ``n_features`` columns; cells without entries have 0."""
    per = matrix.groupBy("cell_id").agg(zero_filled(F.col("value"), n_features)[1].alias("variance"))
    return cells.select("cell_id").join(per, "cell_id", "left").withColumn("variance", F.coalesce("variance", F.lit(0.0)))


def zero_variance_cells(matrix: DataFrame, cells: DataFrame, n_features: int) -> DataFrame:
    return cell_variance(matrix, cells, n_features).where(F.abs("variance") < 1e-12)


def add_ones(matrix: DataFrame, cells: DataFrame) -> DataFrame:
    """The matrix with a feature that is 1 in every cell."""
    return matrix.unionByName(cells.select("cell_id", F.lit(ONE).alias("feature"), F.lit(1.0).alias("value")))


def train_stats(matrix: DataFrame, cells: DataFrame, transform_data: bool = False) -> DataFrame:
    """(feature, mean, sd) on training cells: the mean is of the data as scaled (log1p if asked),
    the deviation of the raw data. Features of raw variance up to 1e-5 go."""
    train = cells.where("split = 'train'").select("cell_id")
    n = train.count()
    rows = matrix.join(train, "cell_id", "left_semi")
    shown = F.log1p("value") if transform_data else F.col("value")
    stats = rows.groupBy("feature").agg((F.sum(shown) / n).alias("mean"), zero_filled(F.col("value"), n)[1].alias("var"))
    return stats.where(F.col("var") > LEAST_VARIANCE).select("feature", "mean", F.sqrt("var").alias("sd"))


def process(matrix: DataFrame, cells: DataFrame, scale_data: bool = True, transform_data: bool = False) -> DataFrame:
    """Present entries, filtered by training variance, log'd and scaled by training statistics."""
    rows = matrix.join(train_stats(matrix, cells, transform_data), "feature")
    value = F.log1p("value") if transform_data else F.col("value")
    if scale_data:
        value = (value - F.col("mean")) / F.col("sd")
    return rows.select("cell_id", "feature", value.alias("value"))


def idf(matrix: DataFrame, n: int) -> DataFrame:
    """(feature, idf): log1p((1 + n) / (1 + df))."""
    df = F.sum((F.col("value") > 0).cast("bigint"))
    return matrix.groupBy("feature").agg(F.log1p(F.lit(1.0 + n) / (1 + df)).alias("idf"))


def tfidf(matrix: DataFrame, cells: DataFrame, mode: str = "normalize") -> DataFrame:
    """Raw value times idf; mode ``filter``: the features whose column sum is positive."""
    if mode not in ("normalize", "filter"):
        raise ValueError("mode must be normalize or filter")
    rows = matrix.join(idf(matrix, cells.count()), "feature").select("cell_id", "feature", (F.col("value") * F.col("idf")).alias("value"))
    if mode == "normalize":
        return rows
    return rows.groupBy("feature").agg(F.sum("value").alias("s")).where("s > 0").select("feature")


def tfidf_train_test(matrix: DataFrame, cells: DataFrame) -> DataFrame:
    """Both splits by the training cells' idf."""
    train = cells.where("split = 'train'").select("cell_id")
    weights = idf(matrix.join(train, "cell_id", "left_semi"), train.count())
    rows = matrix.join(cells.select("cell_id"), "cell_id", "left_semi")
    return rows.join(weights, "feature").select("cell_id", "feature", (F.col("value") * F.col("idf")).alias("value"))


def cells_without_weight(matrix: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell_id) of the cells whose values don't sum to more than 0; those without entries sum to 0."""
    sums = matrix.groupBy("cell_id").agg(F.sum("value").alias("_s"))
    return cells.select("cell_id").join(sums.where("_s > 0"), "cell_id", "left_anti")


def tfidf_dataset(matrix: DataFrame, cells: DataFrame, binarize: bool = False, check: bool = False) -> DataFrame:
    """Training cells by the training idf, test cells by the idf of all cells. With ``check``, ValueError
    if the values of a cell don't sum to more than 0."""
    if check and not cells_without_weight(matrix, cells).isEmpty():
        raise ValueError("TF-IDF needs a positive sum of every cell's values")
    if binarize:
        matrix = matrix.withColumn("value", F.when(F.col("value") > 0, 1.0).otherwise(0.0))
    train = cells.where("split = 'train'").select("cell_id")
    own = idf(matrix.join(train, "cell_id", "left_semi"), train.count()).withColumnRenamed("idf", "own")
    rows = matrix.join(cells.select("cell_id", "split"), "cell_id")
    rows = rows.join(idf(matrix, cells.count()), "feature").join(own, "feature", "left")
    weight = F.when(F.col("split") == "train", F.col("own")).otherwise(F.col("idf"))
    return rows.select("cell_id", "feature", (F.col("value") * weight).alias("value"))


def sample_features(groups: DataFrame, n_features: int = 5000, seed: str = "1") -> DataFrame:
    """At most ``n_features`` members of each group, at random."""
    keyed = groups.withColumn("_key", F.concat_ws(":", "group", "feature"))
    return hash_rank(keyed, f"features{seed}", "_key", ["group"]).where(F.col("rn") <= n_features).drop("rn", "_key")


def group_vectors(matrix: DataFrame, cells: DataFrame, groups: DataFrame, scale_data: bool = True, transform_data: bool = False, ones: bool = False) -> DataFrame:
    """(cell_id, split, group, group_ord, x): dense processed vectors, features by name."""

    def value(v: Column, s: Column) -> Column:
        v = F.log1p(v) if transform_data else v
        return (v - s["mean"]) / s["sd"] if scale_data else v

    return _dense(matrix, cells, groups, train_stats(matrix, cells, transform_data), value, ones)


def shared_vectors(matrix: DataFrame, cells: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((cell_id, split, x), (group, group_ord, places)): scaled vectors of the features of all groups, each once,
    and where the features of a group are in them: ``group_vectors`` are x at these places. Where groups
    overlap, this spares their copies."""
    one = groups.select(F.lit("all").alias("group"), F.lit(0).alias("group_ord"), "feature").distinct()
    stats = train_stats(matrix, cells).persist()  # a row a feature
    rows = _dense(matrix, cells, one, stats, lambda v, s: (v - s["mean"]) / s["sd"])
    order = one.join(stats, "feature").agg(F.array_sort(F.collect_list("feature")).alias("all"))  # one row of names
    at = order.select(F.posexplode("all").alias("i", "feature"))
    places = groups.join(at, "feature").groupBy("group", "group_ord").agg(F.array_sort(F.collect_list("i")).alias("places"))
    return rows.select("cell_id", "split", "x"), places


def scaled_vectors(raw: DataFrame, cells: DataFrame) -> DataFrame:
    """``group_vectors`` of ``cells`` from ``raw_vectors`` that hold them: where the same cells are scaled by one
    fold's statistics after another, their entries are gathered once. Statistics come from the places."""
    rows = raw.drop("split").join(cells.select("cell_id", "split"), "cell_id")
    each = rows.where("split = 'train'").select("group", F.posexplode("x").alias("i", "v"))
    stats = each.groupBy("group", "i").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var")).where(F.col("var") > LEAST_VARIANCE)
    per = stats.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("i", "mean", F.sqrt("var").alias("sd")))).alias("stats"))
    x = F.transform("stats", lambda s: (F.get("x", s["i"]) - s["mean"]) / s["sd"])
    return rows.join(per, "group").select("cell_id", "split", "group", "group_ord", x.alias("x"))


def _dense(matrix: DataFrame, cells: DataFrame, groups: DataFrame, stats: DataFrame, value: Callable[[Column, Column], Column], ones: bool = False) -> DataFrame:
    """A group's statistics are arrays of its features, one row per group; each cell's entries are
    a map that those arrays look up. The join deals by group where the arrays are too large to
    send whole, as Spark sees their size at run time."""
    per = groups.select("group", "group_ord", "feature").join(stats, "feature")
    per = per.groupBy("group", "group_ord").agg(F.array_sort(F.collect_list(F.struct("feature", "mean", "sd"))).alias("stats"))
    names = groups.select("group").distinct().agg(F.collect_set("group").alias("all"))  # one row of names
    entries = matrix.join(groups.select("group", "feature").distinct(), "feature").groupBy("cell_id", "group").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m")
    )
    grid = cells.select("cell_id", "split").join(F.broadcast(names)).select("cell_id", "split", F.explode("all").alias("group"))  # the result's own shape
    rows = grid.join(entries, ["cell_id", "group"], "left").join(per, "group")
    x = F.transform("stats", lambda s: value(F.coalesce(F.try_element_at("m", s["feature"]), F.lit(0.0)), s))
    if ones:
        x = F.concat(x, F.array(F.lit(1.0)))
    return rows.select("cell_id", "split", "group", "group_ord", x.alias("x"))


#: Groups of at most this many features are fit with as many directions, which is exact in one pass.
WHOLE = 512
#: The search for the axes of wider groups ends when no wanted singular value has changed by more
#: than this share of the largest in a pass, or after ``PASSES`` of them.
TOLERANCE, PASSES = 1e-8, 40
#: Numbers in the directions of the groups that are fit at once: 33 MB on the driver and in a task.
TOGETHER = 1 << 22


def _directions(p: int, k: int) -> int:
    """How many directions a group of ``p`` features is fit with: half as many again as wanted, so that
    the wanted ones converge sooner."""
    return p if p <= WHOLE else min(p, k + k // 2 + 10)


def train_moments(rows: DataFrame) -> dict[str, tuple[int, np.ndarray]]:
    """By group: (n, sums) of the vectors ``x``."""

    def of(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        return {g: np.concatenate([[len(own)], np.stack(own["x"].to_numpy()).sum(0)]) for g, own in pdf.groupby("group", sort=False)}

    return {g: (int(flat[0]), flat[1:]) for g, flat in summed(rows.select("group", "x"), of).items()}


def _pieces(rows: pd.DataFrame, mean: np.ndarray) -> Iterator[np.ndarray]:
    """The centred vectors of a batch, some 32 MB at a time."""
    x = rows["x"].to_numpy()
    step = max(1, (1 << 22) // max(len(mean), 1))
    for at in range(0, len(x), step):
        yield np.stack(x[at : at + step]) - mean


def _power(rows: DataFrame, sent) -> dict[str, np.ndarray]:
    """By group, X'(XV) of the training vectors: as large as V, summed in Spark."""

    def of(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        out = {}
        for g, own in pdf.groupby("group", sort=False):
            if g in sent.value:
                mean, v = sent.value[g]
                out[g] = sum(x.T @ (x @ v) for x in _pieces(own, mean))
        return out

    return {g: flat.reshape(sent.value[g][1].shape) for g, flat in summed(rows.select("group", "x"), of).items()}


def _factors(rows: DataFrame, sent) -> dict[str, np.ndarray]:
    """By group, R of the tall and narrow XV = QR: each task folds its rows into a small triangle,
    triangles of one group meet by sixteenths, then once more."""

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for pdf in parts:
            for g, own in pdf.groupby("group", sort=False):
                if g in sent.value:
                    mean, v = sent.value[g]
                    for x in _pieces(own, mean):
                        y = x @ v
                        held[g] = np.linalg.qr(np.vstack([held[g], y]) if g in held else y, mode="r")
        yield from triangles(held)

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for pdf in parts:
            for g, r in zip(pdf["group"], pdf["r"]):
                own = np.frombuffer(r).reshape(-1, sent.value[g][1].shape[1])
                held[g] = np.linalg.qr(np.vstack([held[g], own]), mode="r") if g in held else own
        yield from triangles(held)

    def triangles(held: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        if held:
            yield pd.DataFrame({"group": list(held), "r": [np.ascontiguousarray(r).tobytes() for r in held.values()]})

    schema = "group string, r binary"
    small = rows.select("group", "x").mapInPandas(fold, schema).withColumn("salt", F.spark_partition_id() % 16)
    small = small.repartition("group", "salt").select("group", "r").mapInPandas(meet, schema)
    return {r["group"]: np.frombuffer(r["r"]).reshape(-1, sent.value[r["group"]][1].shape[1]) for r in small.repartition("group").mapInPandas(meet, schema).collect()}


def leading_axes(rows: DataFrame, moments: dict[str, tuple[int, np.ndarray]], k: int, centred: bool) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By group: (mean, axes[p, k'], singular values) of its training vectors, largest first; k' is k,
    or the number of features if smaller. The mean is 0 where not ``centred``.

    A randomised range finder: ``_directions`` random directions, multiplied by X'X in one pass over
    the rows and made orthogonal, until the singular values stand still; those come from the
    triangles of XV, never from squares. Beyond ``WHOLE`` features no p x p matrix is made: the
    driver and a task hold p times ``_directions`` numbers of the groups given, some copies of them.
    Groups without features are left out.
    """
    spark = rows.sparkSession
    found, now = {}, {}
    for g in sorted(moments):
        n, sums = moments[g]
        p = len(sums)
        if not p:
            continue
        start = np.random.default_rng(p).normal(size=(p, _directions(p, k)))
        now[g] = (sums / n if centred else np.zeros(p)), np.linalg.qr(start)[0]
    before: dict[str, np.ndarray] = {}
    for turn in range(PASSES + 1):
        if not now:
            break
        sent = spark.sparkContext.broadcast(now)
        for g, r in _factors(rows, sent).items():
            _, s, w = np.linalg.svd(r)
            mean, v = now[g]
            s = np.concatenate([s, np.zeros(v.shape[1] - len(s))])
            wanted = min(k, v.shape[1])
            whole = v.shape[0] == v.shape[1]  # all directions: nothing is left to find
            still = g in before and np.all(np.abs(s - before[g])[:wanted] <= TOLERANCE * max(s[0], 1e-300))
            before[g] = s
            if whole or still or turn == PASSES:
                found[g] = mean, (v @ w.T)[:, :wanted], s[:wanted]
        now = {g: x for g, x in now.items() if g not in found}
        if now:
            left = spark.sparkContext.broadcast(now)
            now = {g: (now[g][0], np.linalg.qr(y)[0]) for g, y in _power(rows, left).items()}
            left.unpersist()
        sent.unpersist()
    return found


def pca_axes(rows: DataFrame, moments: dict, k: int = 50) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By group (mean, axes[p, min(k, p)]) of training vectors, largest variance first."""
    return {g: (mean, axes) for g, (mean, axes, _) in leading_axes(rows, moments, k, True).items()}


def svd_axes(rows: DataFrame, moments: dict, k: int = 50) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By group (zeros, axes) of the uncentred vectors, the first axis dropped."""
    return {g: (mean, axes[:, 1:]) for g, (mean, axes, _) in leading_axes(rows, moments, k, False).items()}


REDUCTIONS = {"pca": pca_axes, "svd": svd_axes, None: None, "None": None}


def get_reduction(name: str | None):
    """The axes function of a reduction, None for identity; ValueError for others."""
    if name not in REDUCTIONS:
        raise ValueError(f"reduction must be one of {list(REDUCTIONS)}")
    return REDUCTIONS[name]


def reduce_vectors(vectors: DataFrame, name: str | None, k: int = 50) -> DataFrame:
    """Each group's vectors on the axes fit on its training rows; axes have at most k columns.
    Groups are fit in shares whose directions have ``TOGETHER`` numbers (one group may have more).
    Vectors of a group without training rows or features give no rows; a single feature under ``svd`` gives
    empty ones."""
    fit = get_reduction(name)
    if fit is None:
        return vectors
    train = vectors.where("split = 'train'")
    moments = train_moments(train)
    shares: list[dict] = [{}]
    room = TOGETHER
    for g in sorted(moments):
        need = len(moments[g][1]) * _directions(len(moments[g][1]), k)
        if shares[-1] and need > room:
            shares.append({})
            room = TOGETHER
        shares[-1][g] = moments[g]
        room -= need
    out = None
    for share in shares:
        own = vectors.where(F.col("group").isin(list(share)))
        axes = fit(own.where("split = 'train'"), share, k)
        sent = vectors.sparkSession.sparkContext.broadcast(axes)  # p x k numbers per group of a share

        def run(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                for g, rows in pdf.groupby("group", sort=False):
                    if g in sent.value:
                        mean, at = sent.value[g]
                        yield rows.assign(x=[row for x in _pieces(rows, mean) for row in x @ at])

        part = own.mapInPandas(run, vectors.schema)
        out = part if out is None else out.unionByName(part)
    return out


def long_form(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matrix, groups) whose features are the places of each group's vectors, in their order."""
    name = F.concat_ws(":", "group", F.lpad(F.col("i").cast("string"), 7, "0"))
    rows = vectors.select("cell_id", "group", "group_ord", F.posexplode("x").alias("i", "value"))
    sizes = vectors.groupBy("group", "group_ord").agg(F.max(F.size("x")).alias("n")).where("n > 0")
    places = sizes.select("group", "group_ord", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return rows.select("cell_id", name.alias("feature"), "value"), places.select("group", "group_ord", name.alias("feature"))


def raw_vectors(matrix: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(cell_id, split, group, group_ord, x): dense raw vectors, features by name, none left out."""
    return _dense(matrix, cells, groups, groups.select("feature").distinct().select("feature", F.lit(0.0).alias("mean"), F.lit(1.0).alias("sd")), lambda v, s: v)
