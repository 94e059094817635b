"""From datasets to Z: each option against numpy, modalities, folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernloom.model import Dataset, Params
from kernloom.operators import evaluate, features, kernel, lasso, prep

N, P = 60, 6


@pytest.fixture(scope="module")
def data(spark):
    """Counts of 60 cells and six features in two groups; cell 7 is empty."""
    rng = np.random.default_rng(4)
    x = rng.poisson(1.2, (N, P)).astype(float)
    x[: N // 2, 0] += 3
    x[7] = 0
    matrix = spark.createDataFrame([(i, f"f{j}", float(x[i, j])) for i in range(N) for j in range(P) if x[i, j]], "cell_id long, feature string, value double").persist()
    cells = spark.createDataFrame([(i, "a" if i < N // 2 else "b", "test" if i % 5 == 0 else "train") for i in range(N)], "cell_id long, label string, split string").persist()
    places = spark.createDataFrame([(f"f{j}", j) for j in range(P)], "feature string, ord int")
    groups = spark.createDataFrame([(f"g{j // 3}", j // 3, f"f{j}") for j in range(P)], "group string, group_ord int, feature string").persist()
    return Dataset(matrix, cells, places, groups, Params(d=4)), x, np.array([i % 5 != 0 for i in range(N)])


def arrays(vectors, column="x"):
    out = {}
    for r in vectors.orderBy("cell_id").collect():
        out.setdefault(r["group"], []).append(r[column])
    return {g: np.array(v) for g, v in out.items()}


def processed(x, train, scale, log):
    t = x[train]
    keep = t.var(0) > 1e-5
    x, t = x[:, keep], t[:, keep]
    shown = np.log1p(x) if log else x
    return (shown - shown[train].mean(0)) / t.std(0) if scale else shown


def idf(x):
    return np.log1p((1 + len(x)) / (1 + (x > 0).sum(0)))


@pytest.mark.parametrize("scale,log,tfidf,ones", [(True, False, False, False), (False, True, True, True), (True, True, True, False)])
def test_prepared_vectors(data, scale, log, tfidf, ones):
    own, x, train = data
    p = Params(d=4, scale_data=scale, transform_data=log, tfidf=tfidf, add_ones=ones)
    got = arrays(features.prepare(own.with_(params=p)))
    for g, cols in (("g0", slice(0, 3)), ("g1", slice(3, 6))):
        part = x[:, cols] * idf(x[train][:, cols]) if tfidf else x[:, cols]
        want = processed(part, train, scale, log)
        want = np.hstack([want, np.ones((N, 1))]) if ones else want
        assert np.allclose(got[g], want)


@pytest.mark.parametrize("name", ["pca", "svd"])
def test_reduction_comes_before_scaling(data, name):
    own, x, train = data
    got = arrays(features.prepare(own.with_(params=Params(d=4, reduction=name, scale_data=False))))
    for g, cols in (("g0", slice(0, 3)), ("g1", slice(3, 6))):
        part = x[:, cols] - (x[train][:, cols].mean(0) if name == "pca" else 0)
        axes = np.linalg.svd(part[train], full_matrices=False)[2]
        assert np.allclose(np.abs(got[g]), np.abs(part @ (axes if name == "pca" else axes[1:]).T), atol=1e-8)


def test_sampled_features_widen_sigma(data):
    own, _, _ = data
    assert {len(v[0]) for v in arrays(features.prepare(own, n_features=2)).values()} == {2}
    plain = features.calculate_z(own, n_features=2, n_batches=2, batch_size=10)
    same = prep.sample_features(own.groups, 2)
    bare = features.calculate_z(own.with_(groups=same), n_features=2, n_batches=2, batch_size=10)
    a, b = ({r["group"]: r["sigma"] for r in x.sigma.collect()} for x in (plain, bare))
    assert all(np.isclose(a[g], b[g] * 1.5) for g in a)
    again = features.calculate_z(plain.with_(z=None), n_features=2)  # widths are used again
    assert arrays(again.z, "z").keys() == {"g0", "g1"}
    assert all(np.allclose(u, v) for u, v in zip(arrays(again.z, "z").values(), arrays(plain.z, "z").values()))


def test_widths_of_twice_prepared_vectors(data):
    own, x, train = data
    one, two = (features.width_vectors(own.with_(params=p), features.prepare(own.with_(params=p))) for p in (Params(d=4, scale_data=False, transform_data=True, sigma_mode=m) for m in ("single", "reference")))
    want = np.log1p(x[train][:, :3])
    assert np.allclose(arrays(one)["g0"], want)
    assert np.allclose(arrays(two)["g0"], np.log1p(want))


@pytest.mark.parametrize("option", [{"kernel": "cauchy"}, {"distance": "cityblock"}, {"seed": "2"}])
def test_options_reach_z(data, option):
    own, _, _ = data
    plain = arrays(features.calculate_z(own, n_batches=2, batch_size=10).z, "z")["g0"]
    other = arrays(features.calculate_z(own.with_(params=Params(d=4, **option)), n_batches=2, batch_size=10).z, "z")["g0"]
    assert plain.shape == other.shape == (N, 8) and not np.allclose(plain, other)


def test_modalities(data):
    own, x, train = data
    second = own.with_(matrix=own.matrix.withColumn("value", F.col("value") * 2 + 1))
    out = features.multimodal_processing([own, second], ["u", "v"], [False, True], n_batches=2, batch_size=10)
    assert out.cells.count() == N - 1 and out.z.where("cell_id = 7").isEmpty()  # flat in a modality
    assert {(r["group"], r["group_ord"]) for r in out.groups.collect()} == {("u-g0", 0), ("u-g1", 1), ("v-g0", 2), ("v-g1", 3)}
    assert evaluate.run(out.z, out.cells, [0.3])["metrics"].count() == 5
    moved = own.with_(cells=own.cells.withColumn("split", F.lit("train")))
    with pytest.raises(ValueError):
        features.multimodal_processing([own, moved], ["u", "v"], [False, False])
    with pytest.raises(ValueError):
        features.multimodal_processing([own, own], ["u", "v"], [False])


def test_folds(data):
    own, _, _ = data
    single = features.process_fold([own], ["u"], [True], n_batches=2, batch_size=10)
    weighted = own.with_(matrix=prep.tfidf_dataset(own.matrix, own.cells, binarize=True))
    want = features.calculate_z(weighted, n_batches=2, batch_size=10)
    assert all(np.allclose(u, v) for u, v in zip(arrays(single.z, "z").values(), arrays(want.z, "z").values()))
    made = features.fold_maker([own], ["u"], [True], n_batches=2, batch_size=10)(own.cells)
    assert np.allclose(arrays(made, "z")["g0"], arrays(want.z, "z")["g0"])


def test_empty_inputs_have_named_errors(data):
    own, _, _ = data
    z = kernel.calculate_z(features.prepare(own).persist(), 4, n_batches=2, batch_size=10)[0]
    y = own.cells.where("split = 'train'").select("cell_id", F.array(F.lit(1.0)).alias("y"))
    for zf, targets in ((z.limit(0), y), (z, y.limit(0))):
        with pytest.raises(ValueError):
            lasso.gather_sums(zf, targets)
    with pytest.raises(ValueError):
        lasso.problem(z, y.limit(0))
    with pytest.raises(ValueError):
        Params(distance="x")
    with pytest.raises(ValueError):
        Params(reduction="x")


def test_tfidf_needs_positive_sums(spark):
    cells = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "cell_id long, split string")
    matrix = spark.createDataFrame([(1, "a", 2.0), (2, "a", 1.0), (2, "b", -1.0)], "cell_id long, feature string, value double")
    assert sorted(r[0] for r in prep.cells_without_weight(matrix, cells).collect()) == [2, 3]
    assert prep.tfidf_dataset(matrix, cells).count() == 3  # unchecked
    with pytest.raises(ValueError):
        prep.tfidf_dataset(matrix, cells, check=True)
    prep.tfidf_dataset(matrix, cells.where("cell_id = 1"), check=True)
