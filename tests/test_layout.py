"""Neighbour graphs against brute force, fuzzy weights against their definition, layouts by trustworthiness."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernloom.operators import layout

FOLDER = "/root/testdata/sf0.001"


def frame(spark, ids, x):
    kind = "string" if isinstance(ids[0], str) else "bigint"
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, x)], f"cell_id {kind}, x array<double>").repartition(5)


def exact(x):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return d


def blobs(n, seed=0, dim=8, kinds=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(kinds, dim)) * 4
    label = rng.integers(0, kinds, n)
    return centres[label] + rng.normal(size=(n, dim)), label


@pytest.mark.parametrize("n,k", [(2, 15), (9, 15), (60, 5)])
def test_small_sets_are_exact(spark, n, k):
    x, _ = blobs(n)
    rows = layout.neighbours(frame(spark, list(range(n)), x), k).collect()
    d = exact(x)
    for i in range(n):
        own = sorted(r["distance"] for r in rows if r["cell_id"] == i)
        assert np.allclose(own, np.sort(d[i])[: min(k, n - 1)])
    assert all(math.isclose(r["distance"], d[r["cell_id"], r["other"]]) for r in rows)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "cell_id bigint, x array<double>")
    assert layout.neighbours(empty).count() == 0
    assert layout.layout(empty, layout.fuzzy_links(layout.neighbours(empty))).count() == 0
    one = frame(spark, [7], [[1.0, 2.0]])
    assert layout.neighbours(one).count() == 0
    assert [r["cell_id"] for r in layout.layout(one, layout.fuzzy_links(layout.neighbours(one)), rounds=1, steps=2).collect()] == [7]


def test_descent_recall(spark):
    """On whole tables, started from blocks of 64, with text ids."""
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], float)
    ids = [f"c{r['vec_id']}" for r in rows]
    place = {c: i for i, c in enumerate(ids)}
    found = layout.neighbours(frame(spark, ids, x), 15, block=64).collect()
    truth = np.argsort(exact(x), 1, kind="stable")[:, :15]
    hits = sum(place[r["other"]] in truth[place[r["cell_id"]]] for r in found)
    assert len(found) == 15 * len(ids)
    assert hits / len(found) >= 0.9


def test_a_third_of_equal_points(spark):
    """Equal points aren't all linked to the same few of them."""
    x, _ = blobs(600)
    x[:200] = x[0]
    rows = layout.neighbours(frame(spark, list(range(600)), x), 8, block=100).collect()
    assert len(rows) == 8 * 600 and all(r["cell_id"] != r["other"] for r in rows)
    zero = [r for r in rows if r["cell_id"] < 200]
    assert all(r["distance"] == 0 for r in zero)
    assert max(np.bincount([r["other"] for r in zero])) < 60


def test_fuzzy_weights():
    rng = np.random.default_rng(1)
    d = np.sort(rng.random((50, 15)) + 0.1, 1)
    w = layout.fuzzy_weights(d, 15)
    assert np.allclose(w.sum(1), math.log2(15), atol=1e-6) and np.allclose(w[:, 0], 1)
    assert (layout.fuzzy_weights(np.zeros((2, 4)), 4) == 1).all()
    assert layout.fuzzy_weights(np.array([[0.5, np.nan, np.nan]]), 3).tolist() == [[1.0, 0.0, 0.0]]


def test_links_join_both_directions(spark):
    x, _ = blobs(40)
    graph = layout.neighbours(frame(spark, list(range(40)), x), 5)
    one = {}
    per = {}
    for r in graph.collect():
        per.setdefault(r["cell_id"], []).append((r["distance"], r["other"]))
    for i, near in per.items():
        near.sort()
        for (_, j), w in zip(near, layout.fuzzy_weights(np.array([[d for d, _ in near]]), 5)[0]):
            one[i, j] = w
    links = {(r["a"], r["b"]): r["weight"] for r in layout.fuzzy_links(graph, 5).collect()}
    assert set(links) == {(min(p), max(p)) for p in one}
    for (i, j), w in links.items():
        p, q = one.get((i, j), 0.0), one.get((j, i), 0.0)
        assert math.isclose(w, p + q - p * q)


def test_curve():
    """The published values for a least distance of 0.1 and 0.5."""
    assert np.allclose(layout.curve(0.1), (1.577, 0.895), atol=0.01)
    assert np.allclose(layout.curve(0.5), (0.583, 1.334), atol=0.01)


def trust(x, y, k=10):
    """Share of what the layout's neighbours could be too far in the data, from 1 (none)."""
    n = len(x)
    rank = np.argsort(np.argsort(exact(x), 1), 1) + 1
    near = np.argsort(exact(y), 1)[:, :k]
    lost = np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum()
    return 1 - 2 * lost / (n * k * (2 * n - 3 * k - 1))


def test_layout_keeps_neighbours(spark):
    """Blocks of 100 that see one another once a round; the first two axes do worse."""
    x, label = blobs(700, dim=10)
    x = (x - x.mean(0)) @ np.linalg.svd(x - x.mean(0), full_matrices=False)[2].T
    points = frame(spark, list(range(700)), x)
    links = layout.fuzzy_links(layout.neighbours(points, 15, block=100), 15)
    rows = sorted(layout.layout(points, links, 15, block=100).collect())
    y = np.array([(r["y0"], r["y1"]) for r in rows])
    assert [r["cell_id"] for r in rows] == list(range(700)) and np.isfinite(y).all()
    assert trust(x, y) > max(trust(x, x[:, :2]), 0.85)
    near = np.argsort(exact(y), 1)[:, :10]
    assert (label[near] == label[:, None]).mean() > 0.95


def test_group_layout(spark):
    from kernloom.plans import registry

    rows = registry.queries()["group_layout"](spark, FOLDER)
    assert rows.columns == ["cell_id", "label", "y0", "y1"]
    cells = spark.read.parquet(f"{FOLDER}/customer.parquet")
    assert rows.count() == cells.count() and rows.where(F.isnan("y0") | F.isnan("y1") | F.isnull("y0")).count() == 0


def test_lists_without_a_new_member_stay_home(spark, monkeypatch):
    rows = [(1, 2, 0), (1, 3, 1), (1, 3, 0), (2, 1, 0), (2, 3, 0)]
    members = spark.createDataFrame(rows, "centre long, member long, new int")
    assert sorted(map(tuple, layout._with_news(members).collect())) == [(1, 2, 0), (1, 3, 1)]
    # floats aren't widened to travel, and give the distances of doubles
    seen = []
    monkeypatch.setattr(layout, "cut", lambda rows, own=layout.cut: seen.append(rows.schema) or own(rows))
    points = spark.range(40).select(F.col("id").alias("cell_id"), F.array(F.rand(1), F.rand(2)).cast("array<float>").alias("x"))
    wide = points.withColumn("x", F.col("x").cast("array<double>"))
    found = [sorted(map(tuple, layout.neighbours(p, 3).collect())) for p in (points, wide)]
    assert seen[0]["x"].dataType.simpleString() == "array<float>" and found[0] == found[1]


def recall(found, x, k):
    """Share of the found links that are as near as the k nearest are."""
    farthest = np.sort(exact(x), 1)[:, k - 1]
    return sum(r["distance"] <= farthest[r["cell_id"]] * (1 + 1e-9) for r in found) / (k * len(x))


def test_few_dimensions_need_no_descent(spark, monkeypatch):
    """A point's vector travels once a tree, not to every list it is on; an earlier state's files don't stay."""
    kept = []
    monkeypatch.setattr(layout, "_descent", None)
    monkeypatch.setattr(layout, "release", lambda rows, own=layout.release: kept.append(rows) or own(rows))
    x, _ = blobs(2500)
    found = layout.neighbours(frame(spark, list(range(2500)), x), 10, block=64).collect()
    assert len(found) == 25000 and recall(found, x, 10) >= 0.9
    assert 1 < len(kept) < layout.TREES
    with pytest.raises(Exception, match="does not exist|No such file"):
        kept[-1].count()


def test_descent_goes_on_from_trees(spark, monkeypatch):
    monkeypatch.setattr(layout, "TREES", 2)
    x = np.random.default_rng(4).normal(size=(900, 24))
    found = layout.neighbours(frame(spark, list(range(900)), x), 10, block=30).collect()
    assert len(found) == 9000 and recall(found, x, 10) >= 0.9
    assert all(math.isclose(r["distance"], np.linalg.norm(x[r["cell_id"]] - x[r["other"]])) for r in found[::97])


@pytest.mark.parametrize("drawn", [5000, 100])
def test_leaves_are_bounded(drawn):
    """With half of the points equal and some NaN, and where the sample is too small for small leaves."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5000, 3))
    x[:2500] = x[0]
    tree = layout.Tree(x[rng.permutation(5000)[:drawn]], 5000, 200, rng)
    x[2500:2600, 1] = np.nan
    sizes = np.bincount(tree.leaf(x, rng.integers(0, 2**63, 5000)), minlength=tree.leaves)
    assert len(sizes) == tree.leaves >= 5000 / 400 and sizes.max() <= 600
