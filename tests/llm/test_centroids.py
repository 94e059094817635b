"""k-means by kd-tree filtering against plain loops over all pairs."""

import hashlib
import math
import random

import numpy as np
import pytest

from kernloom.llm import centroids as C


def plain(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * v) for v in map(float, x)]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(at))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        at = [[sum(v) // own.count(n) for v in zip(*[x for (_, x), o in zip(kept, own) if o == n])] if n in own else c for n, c in enumerate(at)]
    out = [(i, *near(x)[::-1]) for i, x in kept]
    fits = lambda v: v if v < 1 << 63 else None
    inertia = [fits(sum(d for _, n, d in out if n == c)) for c in range(len(at))]
    total = fits(sum(d for *_, d in out)) if out else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return [(i, n, fits(d), inertia[n], total, digest[n]) for i, n, d in out]


def compared(spark, rows, kind="array<float>"):
    df = spark.createDataFrame([(i, x, "c", 5) for i, x in rows], f"vec_id long, embedding {kind}, cluster string, id int")
    found = C.op13_centroids(df.repartition(3))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain(rows), key=str)


def vectors(n, spread=1.0, seed=1, levels=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64)) * spread + rng.integers(0, 3, (n, 1))
    x = np.float32(x if levels is None else np.round(x * levels) / levels)
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def test_many_with_odd_ones(spark):
    rows = vectors(400)
    odd = [(1000, None), (1001, [1.0] * 63), (1002, [1.0] * 65), (1003, [float("nan")] * 64), (1004, [float("inf")] + [0.0] * 63), (1005, [None] + [0.0] * 63), (1006, []), (None, [0.5] * 64), (7, rows[7][1]), (7, [0.25] * 64)]
    compared(spark, rows + odd)


def test_ties_and_copies(spark):
    compared(spark, [(i, [float((i * j) % 2) for j in range(64)]) for i in range(60)] + [(100 + i, [1.0] * 64) for i in range(150)])


def test_fewer_vectors_than_centroids_and_none(spark):
    compared(spark, vectors(5))
    compared(spark, [])
    compared(spark, [(1, None)])


@pytest.mark.parametrize("scale", [3e4, 4e6, 1e20])
def test_large_components(spark, scale):
    rows = [(i, [v * scale for v in x]) for i, x in vectors(60, seed=3)]
    compared(spark, rows, "array<double>")


def test_trees_hold_all_points_and_prune(spark):
    rng = np.random.default_rng(5)
    middle = rng.integers(-500, 500, (8, 6))
    points = middle[rng.integers(0, 8, 3000)] + rng.integers(-9, 10, (3000, 6))
    order, tree = C.build_tree(points, 16)
    assert sorted(order.tolist()) == list(range(3000)) and (tree.points == points[order]).all()
    for n in range(len(tree.start)):
        own = tree.points[tree.start[n] : tree.stop[n]]
        assert (own.min(0) == tree.low[n]).all() and (own.max(0) == tree.high[n]).all() and (own.sum(0) == tree.sums[n]).all()
    walked = list(C.filtered(tree, middle))
    assert sum(tree.stop[n] - tree.start[n] for n, _ in walked) == 3000
    assert sum(tree.stop[n] - tree.start[n] for n, some in walked if len(some) == 1) > 2000  # given whole
    d = ((points[order][:, None] - middle) ** 2).sum(2)
    nearest, distance = C.tree_nearest(tree, middle)
    assert (nearest == d.argmin(1)).all() and (distance == d.min(1)).all()
    counts, sums = C.tree_sums(tree, middle)
    assert (counts == np.bincount(d.argmin(1), minlength=8)).all()
    assert all((sums[k] == points[order][d.argmin(1) == k].sum(0)).all() for k in range(8))


def test_random_trees_against_all_pairs():
    rng = np.random.default_rng(6)
    random.seed(6)
    for _ in range(60):
        n, dims, k = random.randrange(1, 200), random.randrange(1, 5), random.randrange(1, 9)
        points, at = rng.integers(-6, 7, (n, dims)), rng.integers(-6, 7, (k, dims))
        order, tree = C.build_tree(points, random.choice([1, 4, 16]))
        d = ((points[order][:, None] - at) ** 2).sum(2)
        nearest, distance = C.tree_nearest(tree, at)
        assert (nearest == d.argmin(1)).all() and (distance == d.min(1)).all()
        assert (C.tree_sums(tree, at)[0] == np.bincount(d.argmin(1), minlength=k)).all()


def test_blocks_are_cut(spark):
    df = spark.createDataFrame([(i, [float(i % 7)] * 4) for i in range(100)], "id long, x array<double>").coalesce(1)
    trees = C.grow_trees(df, 64, 30).collect()
    assert [len(r["ids"]) for r in trees] == [30, 30, 30, 10] and sorted(i for r in trees for i in r["ids"]) == list(range(100))
