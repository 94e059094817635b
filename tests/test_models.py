import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernloom.functions import rand
from kernloom.functions.rand import hash_rank
from kernloom.model import Params, build_dataset, from_table
from kernloom.operators import evaluate, kernel, lasso, prep, results, splitting
from kernloom.plans import registry
from kernloom.streaming.scoring import score_stream


@pytest.fixture(scope="module")
def toy(spark):
    """Two groups of random features; only the first tells the classes apart."""
    rng = np.random.default_rng(3)
    n, d = 120, 4
    label = np.arange(n) % 2
    z = rng.normal(0, 0.3, (n, 2, d))
    z[:, 0, 0] += label * 0.8
    rows = [(int(i), "test" if i % 5 == 3 else "train", f"g{g}", g, [float(v) for v in z[i, g]]) for i in range(n) for g in range(2)]
    zf = spark.createDataFrame(rows, "cell_id long, split string, group string, group_ord int, z array<double>").persist()
    cells = spark.createDataFrame([(int(i), "pos" if label[i] else "neg", "test" if i % 5 == 3 else "train") for i in range(n)], "cell_id long, label string, split string").persist()
    return zf, cells, z, label


def sums_of(zf, cells):
    y = F.array(F.when(F.col("label") == "neg", 1.0).otherwise(-1.0))
    return lasso.gather_sums(zf, cells.where("split = 'train'").select("cell_id", y.alias("y")))


def test_sums_and_optimality(toy):
    zf, cells, z, label = toy
    s = sums_of(zf, cells)
    train = np.arange(len(label)) % 5 != 3
    a, y = z[train].reshape(train.sum(), -1), np.where(label[train] == 0, 1.0, -1.0)
    assert np.allclose(s.zz, a.T @ a) and np.allclose(s.zy[:, 0], a.T @ y) and s.n == train.sum()
    for alpha in (0.05, 0.4, 1.5):
        w, b = lasso.solve(s, alpha)
        assert lasso.kkt_residual(s, w, alpha) < 1e-4

        def loss(w, b, alpha=alpha):
            r = y - b - a @ w
            return r @ r / 2 / s.n + s.lambda_of(alpha) * np.linalg.norm(w.reshape(-1, 4), axis=1).sum()

        rng = np.random.default_rng(0)
        assert all(loss(w, b) <= loss(w + rng.normal(0, 0.01, len(w)), b + rng.normal(0, 0.01)) + 1e-9 for _ in range(200))
    assert not lasso.solve(s, 50.0)[0].any()
    with pytest.raises(ValueError):
        lasso.solve(s, 0.0)


def targets_of(cells):
    y = F.array(F.when(F.col("label") == "neg", 1.0).otherwise(-1.0))
    return cells.where("split = 'train'").select("cell_id", y.alias("y"))


@pytest.mark.parametrize("most", [4, 8])
def test_passes_over_blocks_agree_with_sums(toy, monkeypatch, most):
    zf, cells, _, _ = toy
    exact = lasso.problem(zf, targets_of(cells))
    monkeypatch.setattr(lasso, "MOST_COLUMNS", most)
    if most == 8:  # all columns fit, but the problem is still one of blocks
        monkeypatch.setattr(lasso, "problem", None)
        wide = lasso.Problem(["g0", "g1"], 4, 1, blocks=lasso.row_blocks(zf, targets_of(cells), 8))
    else:
        wide = lasso.problem(zf, targets_of(cells))
    assert exact.sums is not None and wide.blocks is not None
    for alpha in (1.5, 0.4, 0.05):
        w, b, gap = wide.fit(alpha)[0]
        v, b0, gap0 = exact.fit(alpha)[0]
        assert np.abs(w - v).max() < 5e-3 and abs(b - b0) < 5e-3 and gap <= lasso.WIDE_GAP and gap0 <= lasso.GAP
        assert lasso.kkt_residual(exact.sums[0], w, alpha) < 1e-3
    assert not wide.fit(50.0)[0][0].any()
    wide.release()


def test_blocks_of_a_batch_are_summed_together(toy, monkeypatch):
    """One product a batch: sums of a block each cost more than its rows where Z is wide."""
    zf, cells, _, _ = toy
    monkeypatch.setattr(lasso, "BLOCK", 16)  # two rows a block
    todo = lasso.Problem(["g0", "g1"], 4, 1, blocks=lasso.row_blocks(zf, targets_of(cells), 8))
    rows, blocks = cells.where("split = 'train'").count(), todo.blocks.count()
    found = todo._sum(lambda m, y, s: {"calls": np.ones(1), "rows": np.array([len(m)])})
    assert found["rows"][0] == rows and blocks >= rows / 2
    assert found["calls"][0] <= todo.blocks.rdd.getNumPartitions() < blocks
    todo.release()


def wide_z(spark, cells, groups, width):
    """Blocks of unit rows; the label shows in the first three groups."""
    g = spark.range(groups).select(F.col("id").cast("int").alias("group_ord"))
    u = lambda i: F.xxhash64("cell_id", "group_ord", i) / F.lit(2.0**63)
    shift = F.when((F.col("group_ord") < 3) & (F.col("label") == "neg"), 0.4).otherwise(0.0)
    z = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (u(i) + F.when(i < 5, shift).otherwise(0.0)) * (3 / width) ** 0.5)
    return cells.join(g).select("cell_id", "split", F.concat(F.lit("g"), "group_ord").alias("group"), "group_ord", z.alias("z"))


@pytest.mark.parametrize("n, groups, width", [(300, 50, 200), (60, 200, 400)])
def test_models_of_any_width(spark, n, groups, width):
    label = F.when(F.col("id") % 2 == 0, "neg").otherwise("pos")
    cells = spark.range(n).select(F.col("id").alias("cell_id"), label.alias("label"), F.when(F.col("id") % 5 == 3, "test").otherwise("train").alias("split")).persist()
    zf = wide_z(spark, cells, groups, width).persist()
    out = evaluate.run(zf, cells, [2.0, 0.5])
    rows = out["weights"].collect()
    assert len(rows) == 2 * groups and max(r["gap"] for r in rows) <= lasso.WIDE_GAP
    heavy = [{r["group"] for r in rows if r["alpha"] == a and r["kernel_weight"] > 0} for a in (2.0, 0.5)]
    assert heavy[0] and len(heavy[1]) >= len(heavy[0]) and (n < 100 or heavy[0] <= {"g0", "g1", "g2"})
    assert out["metrics"].count() == 10
    todo = lasso.problem(zf, targets_of(cells))
    w, b, _ = todo.fit(0.5)[0]
    a = np.stack([np.concatenate([r["z"] for r in sorted(rows, key=lambda r: r["group_ord"])]) for _, rows in sorted(groups_of(zf.where("split = 'train'").collect()).items())])
    y = np.array([1.0 if i % 2 == 0 else -1.0 for i in range(n) if i % 5 != 3])
    r = y - b - a @ w
    q, lam = (a - a.mean(0)).T @ r / len(y), 0.5 * np.abs(a.T @ y).max() / len(y)
    assert abs(r.mean()) < 1e-9 and lasso.violations(w, q, lam, width).max() < 1e-3
    assert todo.passes <= 40  # first sums, then two a round at most


def groups_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r["cell_id"], []).append(r)
    return out


def test_gap_bounds_the_loss_and_screening_is_safe():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n, g, k = 60, 6, 3
        a, y = rng.normal(size=(n, g * k)), rng.normal(size=n)
        a, y = a - a.mean(0), y - y.mean()
        gram, c, yy = a.T @ a / n, a.T @ y / n, y @ y / n
        lam = 0.4 * np.linalg.norm(c.reshape(g, k), axis=1).max()
        loss = lambda w: ((y - a @ w) ** 2).sum() / 2 / n + lam * np.linalg.norm(w.reshape(g, k), axis=1).sum()
        best = np.zeros(g * k)
        lasso._descend(gram, c, best, lam, yy, k, 1e-14, 1e-8, 5000)
        assert lasso.violations(best, c - gram @ best, lam, k).max() < 1e-6
        for scale in (0.0, 0.5, 0.99):
            w = best * scale
            gap, scaled = lasso.gap_of(w, c - gram @ w, c, yy, lam, k)
            assert loss(w) - loss(best) <= gap + 1e-12
            out = [i for i in range(g) if scaled[i] + (2 * lasso._largest(gram, k)[i] * gap) ** 0.5 < lam]
            assert not any(best[i * k : i * k + k].any() for i in out)


def test_run_and_search(toy):
    zf, cells, _, _ = toy
    out = evaluate.run(zf, cells, [1.5, 0.3])
    values = {(r["alpha"], r["metric"]): r["value"] for r in out["metrics"].collect()}
    assert len(values) == 10 and values[0.3, "AUROC"] > 0.85
    assert results.summary(out["metrics"], out["weights"]).where("alpha = 0.3").first()["top_group"] == "g0"
    found, best = evaluate.optimize_sparsity(sums_of(zf, cells), 1.9, 0.4, target=1, n_iter=8)
    assert found[best] == 1
    assert evaluate.stop_early([0.7, 0.6]) and not evaluate.stop_early([0.6])
    # labels unknown in the test split: predictions without metrics
    blind = cells.withColumn("label", F.when(F.col("split") == "train", F.col("label")))
    out = evaluate.run(zf, blind, [0.3])
    assert out["predictions"].count() == 24 and out["metrics"].count() == 0


def test_one_versus_rest(spark, toy):
    zf, cells, _, _ = toy
    three = cells.withColumn("label", F.when(F.col("cell_id") % 3 == 0, "zeta").otherwise(F.col("label")))
    for balance in (False, True):
        out = evaluate.one_v_rest(zf, three, [0.3], force_balance=balance)
        assert out["multiclass"].count() == 24
        assert {r["class"] for r in out["metrics"].select("class").distinct().collect()} == {"neg", "pos", "zeta"}
        assert 0 <= out["macro_f1"].first()[0] <= 1


def test_classes_share_one_pass(toy):
    zf, cells, z, label = toy
    three = cells.withColumn("label", F.when(F.col("cell_id") % 3 == 0, "zeta").otherwise(F.col("label"))).persist()
    for balance in (False, True):
        chosen = splitting.class_train(three, 1.0, "1").persist() if balance else None
        todo = lasso.problem(zf, evaluate.class_targets(three, ["neg", "pos", "zeta"], chosen))
        found = todo.fit(0.3)
        assert todo.passes == 1 and todo.solves == 3
        for t, c in enumerate(["neg", "pos", "zeta"]):
            mine = three if chosen is None else three.join(chosen.where(F.col("class") == c), "cell_id", "left_semi")
            y = F.array(F.when(F.col("label") == c, 1.0).otherwise(-1.0))
            alone = lasso.gather_sums(zf, mine.where("split = 'train'").select("cell_id", y.alias("y")))
            w, b = lasso.solve(alone, 0.3)
            assert np.allclose(w, found[t][0], atol=1e-6) and abs(b - found[t][1]) < 1e-6


def test_early_stopping_solves_less(toy):
    zf, cells, _, _ = toy
    three = cells.withColumn("label", F.when(F.col("cell_id") % 3 == 0, "zeta").otherwise(F.col("label"))).persist()
    alphas, plain, waves = [0.05, 0.3, 1.0, 3.0], [], []
    full = evaluate.fold_values(zf, three, alphas, ["neg", "pos", "zeta"], "AUROC", False, "1", False, plain)
    early = evaluate.fold_values(zf, three, alphas, ["neg", "pos", "zeta"], "AUROC", True, "1", False, waves)
    assert sum(plain) == 12 and sum(waves) < 12 and waves[0] == 3
    full, early = ({(c, a): v for c, a, v in rows} for rows in (full, early))
    for c in ("neg", "pos", "zeta"):
        kept = []
        for a in alphas:
            kept.append(full[c, a])
            if evaluate.stop_early(kept):
                assert (c, a) not in early
                break
            assert early[c, a] == pytest.approx(full[c, a], abs=1e-6)


def test_optimize_alpha(toy):
    zf, cells, _, _ = toy
    make = lambda own: zf.drop("split").join(own.select("cell_id", "split"), "cell_id")
    assert evaluate.optimize_alpha(make, cells, [0.3, 3.0], k=2, early_stopping=True) == 0.3
    with pytest.raises(ValueError):
        splitting.folds(cells, 1)


def test_optimize_alpha_of_three_classes(toy):
    zf, cells, _, _ = toy
    three = cells.withColumn("label", F.when(F.col("cell_id") % 3 == 0, "zeta").otherwise(F.col("label")))
    make = lambda own: zf.drop("split").join(own.select("cell_id", "split"), "cell_id")
    best = evaluate.optimize_alpha(make, three, [0.3, 3.0], k=2, force_balance=False)
    assert set(best) == {"neg", "pos", "zeta"} and set(best.values()) <= {0.3, 3.0}


def test_features_have_unit_norm_and_approximate_the_kernel(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "train" if i < 40 else "test", "g", 0, [float(v) for v in rng.normal(0, 1, 5)]) for i in range(50)]
    vectors = spark.createDataFrame(rows, "cell_id long, split string, group string, group_ord int, x array<double>")
    sigma = spark.createDataFrame([("g", 0, 2.0)], "group string, group_ord int, sigma double")
    z, _ = kernel.calculate_z(vectors, 400, sigma=sigma)
    got = {r["cell_id"]: np.array(r["z"]) for r in z.collect()}
    x = {r[0]: np.array(r[4]) for r in rows}
    for i in range(0, 50, 7):
        assert np.isclose(got[i] @ got[i], 1.0)
        for j in range(3):
            # directions have deviation 1 / (2 sigma)
            assert abs(got[i] @ got[j] - np.exp(-((x[i] - x[j]) ** 2).sum() / 32)) < 0.15
    kernel.check_finite(z)
    with pytest.raises(ValueError):
        kernel.check_finite(z.withColumn("z", F.array(F.lit(float("inf")))))
    with pytest.raises(ValueError):
        kernel.combine([z, z], ["A", "a"])


def test_reductions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (30, 4)) * [4, 2, 1, 0.5]
    rows = [(i, "train" if i < 20 else "test", "g", 0, [float(v) for v in x[i]]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "cell_id long, split string, group string, group_ord int, x array<double>")
    got = np.array([r["x"] for r in prep.reduce_vectors(vectors, "pca", 2).orderBy("cell_id").collect()])
    centred = x - x[:20].mean(0)
    _, _, vt = np.linalg.svd(centred[:20], full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(centred @ vt[:2].T))
    got = np.array([r["x"] for r in prep.reduce_vectors(vectors, "svd").orderBy("cell_id").collect()])
    _, _, vt = np.linalg.svd(x[:20], full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(x @ vt[1:].T))
    assert prep.reduce_vectors(vectors, None) is vectors
    with pytest.raises(ValueError):
        prep.get_reduction("linear")


def test_dataset(spark):
    # the index toy: 500 rows of three features that all hold the row's number, labels 3 to 2
    rows = [(i, [float(i)] * 3, "a" if i % 5 < 3 else "b") for i in range(500)]
    df = spark.createDataFrame(rows, "cell_id long, x array<double>, label string")
    groups = spark.createDataFrame([("p", 0, "f00"), ("p", 0, "f02"), ("q", 1, "f00"), ("q", 1, "f01"), ("r", 2, "f00"), ("r", 2, "zz")], "group string, group_ord int, feature string")
    data = from_table(df, "cell_id", "label", "x", groups)
    assert data.params.d == splitting.calculate_d(500) == 100
    sizes = {(r["label"], r["split"]): r["count"] for r in data.cells.groupBy("label", "split").count().collect()}
    assert sizes == {("a", "train"): 240, ("a", "test"): 60, ("b", "train"): 160, ("b", "test"): 40}
    assert {r[0] for r in data.groups.select("group").distinct().collect()} == {"p", "q"}
    assert data.features.count() == 3
    with pytest.raises(ValueError):
        build_dataset(data.matrix, data.cells.withColumn("label", F.col("cell_id").cast("string")), data.features, groups)
    for bad in ({"d": 0}, {"kernel": "x"}, {"train_ratio": 1.0}, {"class_threshold": "mean"}, {"sigma_mode": "x"}):
        with pytest.raises(ValueError):
            Params(**bad)
    assert splitting.calculate_d(1000) == 100 and splitting.calculate_d(6000) == 167 and splitting.calculate_d(10000) == 222


def test_capped_split_with_replacement(spark):
    cells = spark.range(200).select(F.col("id").alias("cell_id"), F.when(F.col("id") < 150, "a").otherwise("b").alias("label"))
    out = splitting.multiclass_split(cells, class_threshold=30, with_replacement=True)
    assert out.where("split = 'train'").groupBy("label").count().collect()[0]["count"] == 30
    assert out.where("split = 'train' and label = 'a'").select("cell_id").distinct().count() < 30


def test_hash_rank_with_null_groups(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "x") for i in range(30)], "cell_id long, label string")
    got = hash_rank(df, "s", "cell_id", ["label"]).collect()
    assert sorted(r["rn"] for r in got if r["label"] is None) == list(range(1, 21))


def test_stream_scores_as_a_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    w, coef = {"g": rng.normal(0, 1, (3, 2))}, {"g": rng.normal(0, 1, 4)}
    batch = spark.createDataFrame([(i, {"g": [float(i), 1.0, -0.5]}) for i in range(9)], "cell_id long, x map<string, array<double>>")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = score_stream(stream, w, coef, 0.1).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["cell_id"]: r["prob"] for r in spark.table("scored").collect()}
    want = {r["cell_id"]: r["prob"] for r in score_stream(batch, w, coef, 0.1).collect()}
    assert got == want and len(got) == 9


def test_flagship(spark):
    df = registry.flagship(spark, "/root/testdata/sf0.001")
    assert df.columns == ["alpha", "auroc", "n_selected", "top_group"] and df.count() == 3


@pytest.mark.parametrize("name", list(kernel.KERNELS))
def test_directions_drawn_in_tasks_equal_the_column_draws(spark, name):
    """Names of any length and script, places and directions over several digit counts."""
    groups = [("g", 0, 0.7), ("ein längerer Name: Gruppe Nr. 7, 漢字, mehr als ein Block", 1, 3.0), ("x" * 120, 2, 1.5)]
    sigma = spark.createDataFrame(groups, "group string, group_ord int, sigma double")
    sizes = spark.createDataFrame([(g, 103) for g, _, _ in groups], "group string, n long")
    want = {g: np.zeros((103, 12)) for g, _, _ in groups}
    for r in kernel.directions(sigma, sizes, 12, name, "5").collect():
        want[r["group"]][r["i"], r["j"]] = r["w"]
    widths = {g: s for g, _, s in groups}
    for most_mb in (0, 256):  # drawn again, kept
        drawn = kernel.Directions(name, widths, 12, "5", most_mb)
        drawn.places = 40
        x = np.random.default_rng(1).normal(size=(5, 103))
        for g in want:
            blocks = [drawn.block(g, at, min(at + 40, 103)) for at in (0, 40, 80)]
            assert np.allclose(np.vstack(blocks), want[g], rtol=1e-9)
            assert np.allclose(drawn.times(g, x), x @ want[g], rtol=1e-9)
        assert bool(drawn.kept) == (most_mb > 0)


def test_grid_uniform_follows_md5():
    rows = np.array([0, 9, 10, 12345, 10**9])
    got = rand.grid_uniform("s", "group", rows, 101)
    for i in range(len(rows)):
        for j in (0, 9, 10, 100):
            head = int(hashlib.md5(f"s:group:{rows[i]}:{j}".encode()).hexdigest()[:8], 16)
            assert got[i, j] == (head + 0.5) / 4294967296.0
    assert rand.grid_uniform("s", "group", [], 3).shape == (0, 3)


def test_projection_of_groups_without_width_and_empty_vectors(spark):
    schema = "cell_id long, split string, group string, group_ord int, x array<double>"
    sigma = spark.createDataFrame([("g", 0, 1.0)], "group string, group_ord int, sigma double")
    rows = [(1, "train", "g", 0, [1.0, 2.0]), (1, "train", "h", 1, [1.0]), (2, None, None, None, [3.0]), (3, "test", "g", 0, [1.0, 2.0])]
    got = {(r["cell_id"], r["group"]): r["z"] for r in kernel.project(spark.createDataFrame(rows, schema), sigma, 3).collect()}
    assert set(got) == {(1, "g"), (3, "g")} and got[1, "g"] == got[3, "g"] and len(got[1, "g"]) == 6
    assert kernel.project(spark.createDataFrame([], schema), sigma, 3).count() == 0


def test_leading_axes_of_wide_vectors(spark):
    """More features than rows, a decaying spectrum, ties and constant features: the subspace and the
    singular values of numpy, without a matrix of features times features."""
    rng = np.random.default_rng(4)
    left, _ = np.linalg.qr(rng.normal(size=(120, 40)))
    right, _ = np.linalg.qr(rng.normal(size=(3000, 40)))
    x = (left * (50 * 0.7 ** np.arange(40))) @ right.T + 3.0
    rows = [(i, "train" if i < 100 else "test", "wide", 0, x[i].tolist()) for i in range(120)]
    rows += [(i, "train", "same", 1, [2.0, 5.0]) for i in range(4)]  # no variance at all
    rows += [(200, "test", "unfit", 2, [1.0])]
    vectors = spark.createDataFrame(rows, "cell_id long, split string, group string, group_ord int, x array<double>").repartition(5).persist()
    train = vectors.where("split = 'train'")
    moments = prep.train_moments(train)
    for centred in (True, False):
        found = prep.leading_axes(train, moments, 8, centred)
        mean, axes, s = found["wide"]
        _, want_s, want = np.linalg.svd(x[:100] - (x[:100].mean(0) if centred else 0), full_matrices=False)
        assert axes.shape == (3000, 8) and np.allclose(s, want_s[:8], rtol=1e-6)
        assert np.allclose(np.abs((axes * want[:8].T).sum(0)), 1, atol=1e-5)
        assert np.allclose(axes.T @ axes, np.eye(8), atol=1e-9)
        assert found["same"][1].shape == (2, 2)
    got = prep.reduce_vectors(vectors, "pca", 8).collect()
    assert sorted({r["group"] for r in got}) == ["same", "wide"] and len(got) == 124
    assert all(np.allclose(r["x"], 0) for r in got if r["group"] == "same")
    assert prep.reduce_vectors(vectors.where("group = 'unfit'"), "svd").count() == 0


def test_class_train_takes_the_first_of_the_draws(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), "abcd"[int(x)], "train") for i, x in enumerate(rng.choice(4, 6000, p=[0.6, 0.3, 0.0995, 0.0005]))]
    rows += [(9000, "a", "test"), (9001, None, "train")]
    cells = spark.createDataFrame(rows, "cell_id long, label string, split string")
    got = sorted((r["class"] or "", r["cell_id"]) for r in splitting.class_train(cells, 0.7, "5").collect())
    want = [("", 9001)]
    for c in "abcd":
        mine = [i for i, x, s in rows if x == c and s == "train"]
        others = sorted((hashlib.md5(f"others5:{i}".encode()).hexdigest(), i) for i, x, s in rows if x not in (c, None) and s == "train")
        want += [(c, i) for i in mine] + [(c, i) for _, i in others[: int(len(mine) * 0.7)]]
    assert got == sorted(want)


def test_scaled_vectors_equal_group_vectors(spark):
    cells = spark.createDataFrame([(i, "test" if i % 4 == 3 else "train") for i in range(12)], "cell_id long, split string")
    matrix = spark.createDataFrame([(i, f"f{j}", 1.0 if j == 4 else float(i * j % 7)) for i in range(12) for j in range(5) if (i + j) % 3 or j == 4], "cell_id long, feature string, value double")
    groups = spark.createDataFrame([("g", 0, "f1"), ("g", 0, "f3"), ("g", 0, "f4"), ("h", 1, "f2"), ("h", 1, "f3"), ("k", 2, "f4")], "group string, group_ord int, feature string")
    raw = prep.raw_vectors(matrix, cells, groups).persist()
    for own in (cells, cells.where("cell_id < 9").withColumn("split", F.when(F.col("cell_id") % 2 == 0, "train").otherwise("test"))):
        got, want = ({(r["cell_id"], r["split"], r["group"], r["group_ord"]): r["x"] for r in x.collect()} for x in (prep.scaled_vectors(raw, own), prep.group_vectors(matrix, own, groups)))
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    raw.unpersist()


def test_a_fold_scores_its_rows_once(spark, toy, monkeypatch):
    zf, cells, _, _ = toy
    rows = spark.sparkContext.accumulator(0)
    plain = evaluate.linear_scores

    def counted(*args):
        def run(parts):
            for pdf in parts:
                rows.add(len(pdf))
                yield pdf

        scores = plain(*args)
        return scores.mapInPandas(run, scores.schema)

    monkeypatch.setattr(evaluate, "linear_scores", counted)
    evaluate.fold_values(zf, cells, [0.3, 0.6], ["neg", "pos"], "AUROC", False, "1", False)
    assert rows.value == 2 * cells.where("split = 'test'").count()


def test_half_a_gram_matrix_travels():
    a = np.random.default_rng(0).normal(size=(9, 5))
    flat = lasso._upper(a.T @ a)
    assert flat.shape == (15,) and np.array_equal(lasso._whole(flat, 5), np.where(np.tri(5, k=-1), (a.T @ a).T, a.T @ a))


def test_unmade_z_is_that_of_calculate_z(spark, monkeypatch):
    """Overlapping groups, one feature without variance and a group of it alone; blocks keep vectors, not Z."""
    n, names = 60, [f"f{i}" for i in range(5)]
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(n, 5)), 3)
    x[:, 3] = 2.0
    matrix = spark.createDataFrame([(c, f, float(v)) for c in range(n) for f, v in zip(names, x[c])], "cell_id long, feature string, value double")
    cells = spark.createDataFrame([(c, "neg" if x[c, 0] > 0 else "pos", "test" if c % 5 == 3 else "train") for c in range(n)], "cell_id long, label string, split string").persist()
    members = [("b", 1, [0, 2, 3]), ("a", 2, [2, 4]), ("c", 0, [1, 4, 0]), ("none", 3, [3])]
    groups = spark.createDataFrame([(g, o, names[i]) for g, o, own in members for i in own], "group string, group_ord int, feature string")
    z, _ = kernel.calculate_z(prep.group_vectors(matrix, cells, groups).persist(), 6, n_batches=2, batch_size=10)
    rows, places = prep.shared_vectors(matrix, cells, groups)
    own = kernel.unmade_z(rows.persist(), places, 6, n_batches=2, batch_size=10)
    assert own.groups == ["c", "b", "a"] and own.width == 12
    held = {r["cell_id"]: r["z"] for r in z.select("cell_id", F.struct("group", "z").alias("z")).groupBy("cell_id").agg(F.map_from_entries(F.collect_list("z")).alias("z")).collect()}
    made = own.maker()
    for r in rows.collect():
        assert np.allclose(made(np.array([r["x"]]))[0], np.concatenate([held[r["cell_id"]][g] for g in own.groups]), atol=1e-12)
    monkeypatch.setattr(lasso, "MOST_COLUMNS", 24)
    stored, lazy = lasso.problem(z.where("group <> 'none'"), targets_of(cells)), lasso.problem(own, targets_of(cells))
    for alpha in (1.0, 0.3):
        (w, b, gap), (v, c, _) = stored.fit(alpha)[0], lazy.fit(alpha)[0]
        assert np.allclose(w, v, atol=1e-9) and abs(b - c) < 1e-9 and gap <= lasso.WIDE_GAP
    size = lambda todo: sum(len(r["m"]) for r in todo.blocks.collect())
    assert size(stored) == 48 * 36 * 8 and size(lazy) == 48 * 4 * 8
    stored.release()
    lazy.release()
