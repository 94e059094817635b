"""Kernel widths, random Fourier features and the combination of modalities."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernloom.functions import rand
from kernloom.operators import prep
from kernloom.operators.splitting import batches

SIGMA_FLOOR = 0.1
SIGMA_CELLS = 2000


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _pair(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda x, y: _sum(F.zip_with(x, y, f))


def _cosine(x: Column, y: Column) -> Column:
    dot = _pair(lambda a, b: a * b)
    return 1 - dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def _centred(x: Column) -> Column:
    mean = _sum(x) / F.size(x)
    return F.transform(x, lambda a: a - mean)


def _ratio(x: Column, y: Column, top: Callable, below: Callable) -> Column:
    d = _pair(below)(x, y)
    return F.when(d == 0, 0.0).otherwise(_pair(top)(x, y) / d)


#: Distances by name, each an expression over two arrays; more may be added.
DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "euclidean": lambda x, y: F.sqrt(_pair(lambda a, b: (a - b) * (a - b))(x, y)),
    "sqeuclidean": _pair(lambda a, b: (a - b) * (a - b)),
    "cityblock": _pair(lambda a, b: F.abs(a - b)),
    "chebyshev": lambda x, y: F.array_max(F.zip_with(x, y, lambda a, b: F.abs(a - b))),
    "cosine": _cosine,
    "correlation": lambda x, y: _cosine(_centred(x), _centred(y)),
    "canberra": _pair(lambda a, b: F.when((a == 0) & (b == 0), 0.0).otherwise(F.abs(a - b) / (F.abs(a) + F.abs(b)))),
    "braycurtis": lambda x, y: _ratio(x, y, lambda a, b: F.abs(a - b), lambda a, b: F.abs(a + b)),
    "hamming": lambda x, y: _pair(lambda a, b: (a != b).cast("double"))(x, y) / F.size(x),
    "jaccard": lambda x, y: _ratio(
        x, y, lambda a, b: ((a != b) & ((a != 0) | (b != 0))).cast("double"), lambda a, b: ((a != 0) | (b != 0)).cast("double")
    ),
    "minkowski": lambda x, y: F.sqrt(_pair(lambda a, b: (a - b) * (a - b))(x, y)),
}


def pair_distances(vectors: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(group, batch, a, b, distance) of all pairs a < b within a batch (batches are of a fixed
    small size, so their pairs are too)."""
    left = vectors.select("group", "batch", F.col("cell_id").alias("a"), F.col("x").alias("xa"))
    right = vectors.select("group", "batch", F.col("cell_id").alias("b"), F.col("x").alias("xb"))
    pairs = left.join(right, ["group", "batch"]).where("a < b")
    return pairs.select("group", "batch", "a", "b", DISTANCES[metric](F.col("xa"), F.col("xb")).alias("distance"))


def batch_sigma(vectors: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(group, sigma): mean over batches of the mean pair distance."""
    per = pair_distances(vectors, metric).groupBy("group", "batch").agg(F.avg("distance").alias("d"))
    return per.groupBy("group").agg(F.avg("d").alias("sigma"))


def group_sigma(vectors: DataFrame, group_sizes: DataFrame, metric: str = "euclidean", n_features: int = 5000) -> DataFrame:
    """``batch_sigma`` with the floor and the factor for groups of more than ``n_features``.
    ``group_sizes``: group, group_ord, n."""
    raw = batch_sigma(vectors, metric).join(group_sizes, "group")
    floored = F.when(F.col("sigma") == 0, F.lit(SIGMA_FLOOR)).otherwise(F.greatest("sigma", F.lit(SIGMA_FLOOR)))
    factor = F.when(F.col("n") > n_features, F.col("n") / F.lit(float(n_features))).otherwise(1.0)
    return raw.select("group", "group_ord", (floored * factor).alias("sigma"))


def estimate_sigma(vectors: DataFrame, metric: str = "euclidean", n_batches: int = 10, batch_size: int = 100, seed: str = "1", n_features: int = 5000, group_sizes: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Widths of all groups from the same batches of at most 2000 training cells. ``cells`` (the training
    cells, each once) spares a pass over all vectors."""
    train = vectors.where("split = 'train'")
    cells = train.select("cell_id").distinct() if cells is None else cells.select("cell_id")
    n = min(cells.count(), SIGMA_CELLS)
    size = min(batch_size, n // n_batches)
    if size < 2:
        raise ValueError("too few training cells for the batches")
    picked = batches(cells, n_batches, size, seed)
    if group_sizes is None:
        group_sizes = train.groupBy("group", "group_ord").agg(F.max(F.size("x")).cast("bigint").alias("n"))
    return group_sigma(train.join(F.broadcast(picked), "cell_id"), group_sizes, metric, n_features)


#: Directions by kernel: draw of (seed, key), the same draws of a grid of keys in numpy, and the
#: function of sigma (of its column or of its value) that they are multiplied by.
KERNELS: dict[str, tuple[Callable[[str, Column], Column], Callable[..., np.ndarray], Callable]] = {
    "gaussian": (rand.normal, rand.grid_normal, lambda sigma: 1 / (2 * sigma)),
    "laplacian": (rand.cauchy, rand.grid_cauchy, lambda sigma: 1 / (2 * sigma)),
    "cauchy": (rand.laplace, rand.grid_laplace, lambda sigma: 0.5 * (1 / (2 * sigma * sigma)) ** 0.5),
}


def directions(sigma: DataFrame, sizes: DataFrame, d: int, kernel: str = "gaussian", seed: str = "1") -> DataFrame:
    """(group, i, j, w): direction j < d for place i of the group's vector. ``sizes``: group, n."""
    draw, _, scale = KERNELS[kernel.lower()]
    grid = sigma.join(sizes.select("group", "n"), "group")
    grid = grid.withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(d - 1))))
    key = F.concat_ws(":", "group", "i", "j")
    return grid.select("group", "i", "j", (draw(f"w{seed}", key) * scale(F.col("sigma"))).alias("w"))


class Directions:
    """Draws of groups' directions inside a task: blocks of ``places`` rows, kept while they fit in
    ``most_mb`` together, else drawn again."""

    def __init__(self, kernel: str, sigma: dict[str, float], d: int, seed: str, most_mb: int) -> None:
        _, self.draw, self.scale = KERNELS[kernel.lower()]
        self.sigma, self.d, self.seed = sigma, d, seed
        self.places = max(1, (32 << 20) // (8 * d))
        self.room = most_mb * 1_000_000
        self.kept: dict[tuple[str, int], np.ndarray] = {}

    def block(self, group: str, at: int, stop: int) -> np.ndarray:
        """Directions of places ``at`` to ``stop`` of a group, as ``directions`` gives them."""
        w = self.kept.get((group, at))
        if w is None or len(w) < stop - at:
            w = self.draw(f"w{self.seed}", group, np.arange(at, stop), self.d) * self.scale(self.sigma[group])
            if w.nbytes <= self.room:
                self.room -= w.nbytes
                self.kept[group, at] = w
        return w[: stop - at]

    def times(self, group: str, x: np.ndarray) -> np.ndarray:
        """``x`` times the group's directions."""
        out = np.zeros((len(x), self.d))
        for at in range(0, x.shape[1], self.places):
            own = x[:, at : at + self.places]
            out += own @ self.block(group, at, at + own.shape[1])
        return out


#: Rows of vectors that a task multiplies at once.
ROWS = 4096


def project(vectors: DataFrame, sigma: DataFrame, d: int, kernel: str = "gaussian", seed: str = "1", most_mb: int = 256) -> DataFrame:
    """(cell_id, split, group, group_ord, z): sqrt(1/d) [cos(xW) | sin(xW)], length 2d, in one pass over
    the vectors of all groups that have a width.

    W is never shipped: it is a function of (seed, group, i, j), so each task draws what its rows
    need and keeps up to ``most_mb`` of it. Only ``sigma`` (a number per group) is sent. A null
    group has no rows in the result, nor has a group without a width.
    """
    widths = {r["group"]: float(r["sigma"]) for r in sigma.where("group IS NOT NULL").collect()}
    schema = f"cell_id {vectors.schema['cell_id'].dataType.simpleString()}, split string, group string, group_ord int, z array<double>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn = Directions(kernel, widths, d, seed, most_mb)
        for pdf in parts:
            for g, rows in pdf.groupby("group", sort=False):
                if g not in widths:
                    continue
                for at in range(0, len(rows), ROWS):
                    own = rows.iloc[at : at + ROWS]
                    a = drawn.times(g, np.stack(own["x"].to_numpy()))
                    z = np.hstack([np.cos(a), np.sin(a)]) * math.sqrt(1.0 / d)
                    yield own.drop(columns="x").assign(z=list(z))

    return vectors.select("cell_id", "split", "group", F.col("group_ord").cast("int").alias("group_ord"), "x").mapInPandas(run, schema)


class Maker:
    """Whole rows of Z from whole rows of shared vectors, in a task: the groups' blocks side by side."""

    def __init__(self, kernel: str, sigma: dict[str, float], d: int, seed: str, places: dict[str, np.ndarray], most_mb: int = 256) -> None:
        self.of = kernel, sigma, d, seed, most_mb
        self.places = places
        self.drawn: Directions | None = None  # made where it is used, never sent

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.drawn is None:
            self.drawn = Directions(*self.of)
        d = self.of[2]
        z = np.empty((len(x), 2 * d * len(self.places)))
        for k, (g, at) in enumerate(self.places.items()):
            a = self.drawn.times(g, x[:, at])
            np.cos(a, out=z[:, 2 * d * k : 2 * d * k + d])
            np.sin(a, out=z[:, 2 * d * k + d : 2 * d * (k + 1)])
        z *= math.sqrt(1.0 / d)
        return z


@dataclass(frozen=True)
class Unmade:
    """Z that is never stored: tasks make it from ``rows`` (cell_id, split, x) each time they read it. It is
    larger than these by the number of its columns over that of the features."""

    rows: DataFrame
    places: dict[str, np.ndarray]  # in the order of the groups
    sigma: dict[str, float]
    d: int
    kernel: str = "gaussian"
    seed: str = "1"

    @property
    def groups(self) -> list[str]:
        return list(self.places)

    @property
    def width(self) -> int:
        return 2 * self.d

    def maker(self) -> Maker:
        return Maker(self.kernel, self.sigma, self.d, self.seed, self.places)


def unmade_z(rows: DataFrame, places: DataFrame, d: int, kernel: str = "gaussian", metric: str = "euclidean", n_batches: int = 10, batch_size: int = 100, seed: str = "1", n_features: int = 5000, cells: DataFrame | None = None) -> Unmade:
    """``calculate_z`` of ``prep.shared_vectors``, with the same widths and directions, as Z to be made in tasks.
    The groups' places (as many numbers as they have features) come to the driver."""
    x = F.transform("places", lambda i: F.get("x", i))
    vectors = rows.join(F.broadcast(places)).select("cell_id", "split", "group", "group_ord", x.alias("x"))  # read for the cells of the batches only
    sizes = places.select("group", "group_ord", F.size("places").cast("bigint").alias("n"))
    sigma = {r["group"]: float(r["sigma"]) for r in estimate_sigma(vectors, metric, n_batches, batch_size, seed, n_features, sizes, cells).collect()}
    if any(s <= 0 for s in sigma.values()):
        raise ValueError("sigma must be positive")
    found = {r["group"]: np.array(r["places"], int) for r in places.orderBy("group_ord", "group").collect() if r["group"] in sigma}
    return Unmade(rows, found, sigma, d, kernel, seed)


def bad_rows(z: DataFrame) -> DataFrame:
    """Rows of Z that hold a NaN or an infinite value."""
    return z.where(F.exists("z", lambda v: F.isnan(v) | (F.abs(v) == F.lit(float("inf")))))


def check_finite(z: DataFrame) -> None:
    """ValueError if any row is bad."""
    if not bad_rows(z).isEmpty():
        raise ValueError("Z holds NaN or infinite values")


def calculate_z(vectors: DataFrame, d: int, kernel: str = "gaussian", metric: str = "euclidean", n_batches: int = 10, batch_size: int = 100, seed: str = "1", sigma: DataFrame | None = None, n_features: int = 5000, group_sizes: DataFrame | None = None, widths_of: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(z, sigma) of all groups; sigma is reused if given. ``group_sizes`` (group, group_ord, n) holds
    sizes before any sampling of features; widths come from ``widths_of`` if given."""
    if sigma is None:
        if group_sizes is None:
            group_sizes = vectors.groupBy("group", "group_ord").agg(F.max(F.size("x")).cast("bigint").alias("n"))
        sigma = estimate_sigma(vectors if widths_of is None else widths_of, metric, n_batches, batch_size, seed, n_features, group_sizes)
    sigma = sigma.persist()  # a row per group, read by the check, the directions and the caller
    if not sigma.where("sigma <= 0").isEmpty():
        raise ValueError("sigma must be positive")
    return project(vectors, sigma, d, kernel, seed), sigma


def non_empty_cells(matrices: list[DataFrame], cells: DataFrame) -> DataFrame:
    """Cells with a positive variance in every modality (each: its entries and features)."""
    out = cells
    for m in matrices:
        p = m.select("feature").distinct().count()
        good = m.groupBy("cell_id").agg(prep.zero_filled(F.col("value"), p)[1].alias("v")).where("v > 1e-12")
        out = out.join(good.select("cell_id"), "cell_id", "left_semi")
    return out


def combine(zs: list[DataFrame], names: list[str], combination: str = "concatenate") -> DataFrame:
    """Z of several modalities: all blocks, named ``{name}-{group}``, or the sums of blocks of
    equal order, named by the first modality."""
    if len({n.lower() for n in names}) < len(names) or len(names) != len(zs):
        raise ValueError("modalities need distinct names")
    named = [z.withColumn("group", F.concat(F.lit(f"{n}-"), "group")) for z, n in zip(zs, names)]
    out = named[0]
    if combination == "concatenate":
        offset = 0
        for before, z in zip(zs, named[1:]):
            offset += (before.agg(F.max("group_ord")).first()[0] or 0) + 1
            out = out.unionByName(z.withColumn("group_ord", (F.col("group_ord") + offset).cast("int")))
        return out
    if combination != "sum":
        raise ValueError("combination must be concatenate or sum")
    for z in zs[1:]:
        right = z.select("cell_id", "group_ord", F.col("z").alias("_z"))
        out = out.join(right, ["cell_id", "group_ord"]).withColumn("z", F.zip_with("z", "_z", lambda a, b: a + b)).drop("_z")
    return out.select("cell_id", "split", "group", "group_ord", "z")
