"""The data model: long tables with fixed schemas, and the parameters of a run."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernloom.operators import kernel, prep, splitting


@dataclass(frozen=True)
class Params:
    """Run parameters; checked on construction."""

    d: int | None = None
    kernel: str = "gaussian"
    distance: str = "euclidean"
    scale_data: bool = True
    transform_data: bool = False
    reduction: str | None = None
    tfidf: bool = False
    add_ones: bool = False
    train_ratio: float = 0.8
    seed: str = "1"
    other_factor: float = 1.5
    allow_multiclass: bool = False
    class_threshold: int | str | None = None
    sigma_mode: str = "single"
    with_replacement: bool = False

    def __post_init__(self) -> None:
        if self.d is not None and (not isinstance(self.d, int) or self.d <= 0):
            raise ValueError("d must be a positive integer")
        if self.kernel.lower() not in kernel.KERNELS:
            raise ValueError(f"kernel must be one of {sorted(kernel.KERNELS)}")
        if self.distance not in kernel.DISTANCES:
            raise ValueError(f"distance must be one of {sorted(kernel.DISTANCES)}")
        prep.get_reduction(self.reduction)
        if not 0 < self.train_ratio < 1:
            raise ValueError("train_ratio must lie between 0 and 1")
        if self.sigma_mode not in ("single", "reference"):
            raise ValueError("sigma_mode must be single or reference")
        if self.class_threshold is not None and self.class_threshold != "median" and not isinstance(self.class_threshold, int):
            raise ValueError("class_threshold must be an integer or 'median'")


@dataclass(frozen=True)
class Dataset:
    """matrix(cell_id, feature, value; absent is 0), cells(cell_id, label, split),
    features(feature, ord), groups(group, group_ord, feature). Never changed in place."""

    matrix: DataFrame
    cells: DataFrame
    features: DataFrame
    groups: DataFrame
    params: Params = field(default_factory=Params)
    sigma: DataFrame | None = None
    z: DataFrame | None = None

    def with_(self, **changes) -> Dataset:
        return replace(self, **changes)


def build_dataset(
    matrix: DataFrame, cells: DataFrame, features: DataFrame, groups: DataFrame, params: Params = Params(), remove_features: bool = True
) -> Dataset:
    """Filter groups and features, split the cells if they have no split, choose D.

    Cells whose ``split`` is neither train nor test are dropped. Multiclass labels need
    ``allow_multiclass``.
    """
    kept = splitting.filter_groups(features, groups, least=1 if params.add_ones else 2)
    used = splitting.kept_features(features, groups) if remove_features else features
    if remove_features:
        matrix = matrix.join(used.select("feature"), "feature", "left_semi")
    labels = cells.where(F.col("label").isNotNull()).select("label").distinct().count()
    if labels < 2:
        raise ValueError("labels need two classes at least")
    if labels > 2 and not params.allow_multiclass:
        raise ValueError("more than two classes need allow_multiclass")
    if "split" not in cells.columns:
        if labels > 2:
            cells = splitting.multiclass_split(cells, params.train_ratio, params.seed, params.class_threshold, params.with_replacement)
        else:
            cells = splitting.stratified_split(cells, params.train_ratio, params.seed)
    cells = cells.where(F.col("split").isin("train", "test"))
    d = params.d or splitting.choose_d(cells, None, params.allow_multiclass, params.other_factor)
    return Dataset(matrix, cells, used, kept, replace(params, d=d))


def from_table(df: DataFrame, id_col: str, label_col: str, array_col: str, groups: DataFrame, params: Params = Params()) -> Dataset:
    """A dataset from a table with one array of values per row (features f00, f01, ...)."""
    long = df.select(F.col(id_col).alias("cell_id"), F.posexplode(array_col).alias("i", "value"))
    name = F.concat(F.lit("f"), F.lpad(F.col("i").cast("string"), 2, "0"))
    matrix = long.select("cell_id", name.alias("feature"), F.col("value").cast("double").alias("value"))
    features = long.select(name.alias("feature"), F.col("i").alias("ord")).distinct()
    cells = df.select(F.col(id_col).alias("cell_id"), F.col(label_col).cast("string").alias("label"))
    return build_dataset(matrix, cells, features, groups, params)
