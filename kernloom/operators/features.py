"""From a dataset to Z by its parameters: sampling, reduction, TF-IDF, scaling, widths,
projection; and the same for several modalities and for folds."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernloom.operators import kernel, prep, splitting

if TYPE_CHECKING:
    from kernloom.model import Dataset

#: Axes of a reduction.
AXES = 50


def prepare(data: Dataset, n_features: int = 5000) -> DataFrame:
    """(cell_id, split, group, group_ord, x): each group's vectors as ``data.params`` say. In this
    order: at most ``n_features`` members of a group, the reduction, TF-IDF by the training
    cells, the variance filter, log1p and z-scores, a column of ones."""
    p = data.params
    groups = prep.sample_features(data.groups, n_features, p.seed).persist()
    matrix = data.matrix
    if prep.get_reduction(p.reduction) is not None:
        reduced = prep.reduce_vectors(prep.raw_vectors(matrix, data.cells, groups).persist(), p.reduction, AXES)
        matrix, groups = prep.long_form(reduced.persist())
    if p.tfidf:
        matrix = prep.tfidf_train_test(matrix, data.cells)
    return prep.group_vectors(matrix, data.cells, groups, p.scale_data, p.transform_data, p.add_ones)


def width_vectors(data: Dataset, vectors: DataFrame) -> DataFrame:
    """The training vectors that widths are taken from: the prepared ones, or, where
    ``sigma_mode`` is ``reference``, those prepared once more (TF-IDF, log1p, z-scores)."""
    p = data.params
    train = vectors.where("split = 'train'")
    if p.sigma_mode == "single":
        return train
    matrix, groups = prep.long_form(train)
    cells = data.cells.where("split = 'train'")
    if p.tfidf:
        matrix = prep.tfidf(matrix, cells)
    return prep.group_vectors(matrix, cells, groups, p.scale_data, p.transform_data)


def calculate_z(data: Dataset, n_features: int = 5000, n_batches: int = 10, batch_size: int = 100) -> Dataset:
    """``data`` with ``z`` and ``sigma``; widths that it has already are used again. ValueError if Z
    holds NaN or infinite values.

    The vectors stay cached, since sizes, widths and projection read them."""
    p = data.params
    vectors = prepare(data, n_features).persist()
    sizes = data.groups.groupBy("group", "group_ord").agg(F.countDistinct("feature").alias("n"))
    d = splitting.choose_d(data.cells, p.d, p.allow_multiclass, p.other_factor)
    z, sigma = kernel.calculate_z(vectors, d, p.kernel, p.distance, n_batches, batch_size, p.seed, data.sigma, n_features, sizes, width_vectors(data, vectors))
    z = z.persist()
    kernel.check_finite(z)
    return data.with_(z=z, sigma=sigma)


def estimate_sigma(data: Dataset, n_features: int = 5000, n_batches: int = 10, batch_size: int = 100) -> Dataset:
    """``data`` with ``sigma``, for ``calculate_z`` to use."""
    sizes = data.groups.groupBy("group", "group_ord").agg(F.countDistinct("feature").alias("n"))
    p = data.params
    vectors = width_vectors(data, prepare(data, n_features)).persist()
    return data.with_(sigma=kernel.estimate_sigma(vectors, p.distance, n_batches, batch_size, p.seed, n_features, sizes))


def shared_cells(datasets: list[Dataset]) -> DataFrame:
    """The first dataset's cells that vary in every modality. ValueError if cells, splits or labels
    differ between modalities."""
    cells = datasets[0].cells
    for i, other in enumerate(datasets[1:], 1):
        if not splitting.consistency(cells, other.cells).isEmpty():
            raise ValueError(f"cells, splits or labels of modality {i} differ from those of the first")
    for data in datasets:
        flat = prep.zero_variance_cells(data.matrix, data.cells, data.features.count())
        cells = cells.join(flat.select("cell_id"), "cell_id", "left_anti")
    return cells


def multimodal_processing(datasets: list[Dataset], names: list[str], tfidf: list[bool], combination: str = "concatenate", n_batches: int = 10, batch_size: int = 100) -> Dataset:
    """One dataset with the combined Z of several modalities: cells that are flat in any of them
    are dropped, modalities are weighted by TF-IDF where asked, and each has its own widths.
    ``matrix`` and ``features`` are the first modality's, groups those of the blocks."""
    if len(names) != len(datasets) or len(tfidf) != len(datasets):
        raise ValueError("names and tfidf need one entry per dataset")
    cells = shared_cells(datasets).persist()
    done = []
    for data, weigh in zip(datasets, tfidf):
        own = data.with_(cells=cells, matrix=data.matrix.join(cells.select("cell_id"), "cell_id", "left_semi"))
        if weigh:
            own = own.with_(matrix=prep.tfidf_dataset(own.matrix, cells, check=True))
        done.append(calculate_z(own, n_batches=n_batches, batch_size=batch_size))
    z = kernel.combine([x.z for x in done], names, combination)
    groups = z.select("group", "group_ord").distinct()
    return done[0].with_(z=z, sigma=None, groups=groups)


def process_fold(datasets: list[Dataset], names: list[str], tfidf: list[bool], combination: str = "concatenate", n_batches: int = 10, batch_size: int = 100) -> Dataset:
    """A fold's Z: of several modalities as ``multimodal_processing``; of one alone with TF-IDF of
    its presences where asked, cells without entries included."""
    if len(datasets) > 1:
        return multimodal_processing(datasets, names, tfidf, combination, n_batches, batch_size)
    data = datasets[0]
    if tfidf[0]:
        data = data.with_(matrix=prep.tfidf_dataset(data.matrix, data.cells, binarize=True))
    return calculate_z(data, n_batches=n_batches, batch_size=batch_size)


def fold_maker(datasets: list[Dataset], names: list[str], tfidf: list[bool], combination: str = "concatenate", n_batches: int = 10, batch_size: int = 100) -> Callable[[DataFrame], DataFrame]:
    """``make_z`` of ``evaluate.optimize_alpha``: Z of a fold's cells, widths fit anew."""
    return lambda cells: process_fold([d.with_(cells=cells, sigma=None) for d in datasets], names, tfidf, combination, n_batches, batch_size).z
