"""Exact integer k-means by kd-tree filtering.

Vectors with exactly ``dims`` components, none null, NaN or infinite, become the integers
floor(scale * x). Each task builds kd-trees over blocks of its vectors, one row per block, kept
in the shared folder for all rounds; a node holds its count, its integer sums and its box. In a
round every tree is walked from the root with the centroids that may be the nearest: one that is
farther than the one nearest to the box's middle, from every point of the box, goes (strictly
farther, so that ties reach the leaves). A node with one centroid left gives its count and sums
as a whole; leaves compute all distances. A round moves count and sums per centroid and task;
they are added in Spark, and only the centroids reach the driver.

All is exact: integers of 64 bits where no square sum can overflow, Python's own beyond.
Distances and inertias that don't fit a long are null. Null and repeated ids are vectors of
their own (a null id hashes as the text ``null``; equal hashes go by components). With fewer
vectors than ``k`` each is a centroid. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernloom.llm.common import staged

BLOCK = 4096  # vectors in a tree
LEAF = 32
SMALL = 1 << 22  # components below it: sums of 64 products are exact in doubles
WHOLE = 1 << 27  # components below it: squared distances fit 64 bits
LIMB = 40  # bits; sums travel in parts of so many


def kept_vectors(df: DataFrame, dims: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): the vectors that take part."""
    sound = F.forall(vec_col, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    return df.where(F.col(vec_col).isNotNull() & (F.size(vec_col) == dims) & sound).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("x"))


def _integers(floats: np.ndarray) -> np.ndarray:
    """Whole doubles as int64, or as Python's integers where they are large."""
    if not floats.size or np.abs(floats).max() < WHOLE:
        return floats.astype(np.int64)
    return np.array([[int(v) for v in row] for row in floats.tolist()], dtype=object)


@dataclass
class Tree:
    """Nodes in preorder: ``start`` to ``stop`` of the points, ``right`` child (0: a leaf; the left one
    is next), box and sums."""

    points: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray


def build_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Tree]:
    """(order, tree) of integer vectors: halves at the median of the widest side of the box, down to
    ``leaf`` points or equal ones."""
    order = np.arange(len(points))
    start, stop, right = [], [], []
    low, high, sums = [], [], []
    todo = [(0, len(points), -1)]
    while todo:
        a, b, parent = todo.pop()
        me = len(start)
        if parent >= 0:
            right[parent] = me
        own = points[order[a:b]]
        lo, hi = own.min(axis=0), own.max(axis=0)
        start.append(a)
        stop.append(b)
        right.append(0)
        low.append(lo)
        high.append(hi)
        sums.append(own.sum(axis=0))
        wide = hi - lo
        if b - a > leaf and wide.any():
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argsort(own[:, int(np.argmax(wide))], kind="stable")]
            todo.append((a + middle, b, me))
            todo.append((a, a + middle, -1))
    return order, Tree(points[order], np.array(start), np.array(stop), np.array(right), np.array(low), np.array(high), np.array(sums))


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact."""
    most = max(abs(points).max(), abs(centroids).max())
    if most < SMALL:
        p, c = points.astype(float), centroids.astype(float)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    if most >= WHOLE:
        points, centroids = points.astype(object), centroids.astype(object)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def filtered(tree: Tree, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(node, centroids that may be the nearest), the nodes covering all points once: one centroid
    for a whole node, or several for a leaf."""
    most = max(abs(tree.low).max(), abs(tree.high).max(), abs(centroids).max())
    kind = np.int64 if most < WHOLE // 2 else object
    low, high, all_ = tree.low.astype(kind), tree.high.astype(kind), centroids.astype(kind)
    stack = [(0, np.arange(len(centroids)))]
    while stack:
        node, some = stack.pop()
        lo, hi = low[node], high[node]
        c = all_[some]
        best = c[np.argmin(((2 * c - (lo + hi)) ** 2).sum(axis=1))]
        corner = np.where(c > best, hi, lo)  # the point of the box where c does best against it
        some = some[((c - corner) ** 2).sum(axis=1) <= ((best - corner) ** 2).sum(axis=1)]
        if len(some) > 1 and tree.right[node]:
            stack.append((int(tree.right[node]), some))
            stack.append((node + 1, some))
        else:
            yield node, some


def tree_sums(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) of the points nearest to each centroid; ties go to the smaller number."""
    counts = np.zeros(len(centroids), np.int64)
    sums = np.zeros(centroids.shape, tree.sums.dtype)
    for node, some in filtered(tree, centroids):
        a, b = tree.start[node], tree.stop[node]
        if len(some) == 1:
            counts[some[0]] += b - a
            sums[some[0]] += tree.sums[node]
            continue
        own = tree.points[a:b]
        nearest = some[np.argmin(distances(own, centroids[some]), axis=1)]
        for k in np.unique(nearest):
            here = nearest == k
            counts[k] += here.sum()
            sums[k] += own[here].sum(axis=0)
    return counts, sums


def tree_nearest(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest, squared distance) of each point."""
    nearest = np.zeros(len(tree.points), np.int32)
    distance = np.zeros(len(tree.points), np.int64 if max(abs(tree.points).max(), abs(centroids).max()) < WHOLE else object)
    for node, some in filtered(tree, centroids):
        a, b = tree.start[node], tree.stop[node]
        d = distances(tree.points[a:b], centroids[some])
        at = np.argmin(d, axis=1)
        nearest[a:b], distance[a:b] = some[at], d[np.arange(b - a), at]
    return nearest, distance


TREES = "ids array<long>, kind string, points binary, start binary, stop binary, right binary, low binary, high binary, sums binary"
_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("kind", pa.string()), *[(n, pa.binary()) for n in ("points", "start", "stop", "right", "low", "high", "sums")]])


def _packed(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


def grow_trees(vectors: DataFrame, scale: int, block: int = BLOCK) -> DataFrame:
    """``vectors`` (id, x) as trees, a row per block of a task. Numbers are kept in the shortest integers
    that hold them; large ones as doubles, which hold them whole, and their sums are made anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def grown() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            flat = table.column("x").combine_chunks().flatten().to_numpy()
            floats = np.floor(flat.reshape(n, -1) * float(scale))
            order, tree = build_tree(_integers(floats))
            most = np.abs(floats).max()
            kind = "<i2" if most < 1 << 15 else "<i4" if most < WHOLE else "<f8"
            ids = table.column("id").combine_chunks().take(pa.array(order))
            row = [_packed(x, kind) for x in (tree.points,)] + [_packed(x, "<i4") for x in (tree.start, tree.stop, tree.right)]
            row += [_packed(tree.low, kind), _packed(tree.high, kind), b"" if kind == "<f8" else _packed(tree.sums, "<i8")]
            return pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([kind]), *[pa.array([x], pa.binary()) for x in row]], schema=_ARROW)

        for batch in batches:
            while len(batch):
                part = batch.slice(0, block - n)
                batch = batch.slice(len(part))
                held.append(part)
                n += len(part)
                if n == block:
                    yield grown()
                    held, n = [], 0
        if n:
            yield grown()

    return vectors.select(F.col("id").cast("long").alias("id"), "x").mapInArrow(run, TREES)


def _tree(batch: pa.RecordBatch, i: int, dims: int) -> Tree:
    get = {n: batch.column(n)[i].as_py() for n in _ARROW.names if n != "ids"}
    start, stop, right = (np.frombuffer(get[n], "<i4") for n in ("start", "stop", "right"))
    points, low, high = (_integers(np.frombuffer(get[n], get["kind"]).reshape(-1, dims).astype(float)) for n in ("points", "low", "high"))
    if get["sums"]:
        sums = np.frombuffer(get["sums"], "<i8").reshape(-1, dims)
    else:
        sums = np.stack([points[a:b].sum(axis=0) for a, b in zip(start, stop)])
    return Tree(points, start, stop, right, low, high, sums)


def first_centroids(vectors: DataFrame, k: int, scale: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors of the least sha256 of ``seed:id``, in this order."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    top = vectors.select(F.sha2(name, 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return [[int(v) for v in np.floor(np.array(r["x"]) * float(scale))] for r in top]


def _array(centroids: list[list[int]]) -> np.ndarray:
    return np.array(centroids, dtype=object if max(abs(v) for c in centroids for v in c) >= WHOLE else np.int64)


def next_centroids(trees: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floors of the means of the vectors nearest to each; a centroid without any stays."""
    dims, at = len(centroids[0]), _array(centroids)
    names = ["cluster", "place", "limb", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(at), np.int64), np.zeros(at.shape, dtype=object)
        for batch in batches:
            for i in range(len(batch)):
                c, s = tree_sums(_tree(batch, i, dims), at)
                counts += c
                sums = sums + s
        rows = []
        for k in np.flatnonzero(counts).tolist():
            rows.append((k, -1, 0, int(counts[k])))
            for place, v in enumerate(map(int, sums[k])):
                limb = 0
                while not -(1 << LIMB) <= v < 1 << LIMB:
                    rows.append((k, place, limb, v & (1 << LIMB) - 1))
                    v, limb = v >> LIMB, limb + 1
                rows.append((k, place, limb, v))
        columns = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names)

    parts = trees.drop("ids").mapInArrow(run, "cluster int, place int, limb int, value long")
    total: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "place", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("v")).collect():
        key = r["cluster"], r["place"]
        total[key] = total.get(key, 0) + (int(r["v"]) << LIMB * r["limb"])
    return [[total[k, i] // total[k, -1] for i in range(dims)] if (k, -1) in total else c for k, c in enumerate(centroids)]


def assigned(trees: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance); a distance beyond a long is null."""
    dims, at = len(centroids[0]), _array(centroids)
    names = ["vec_id", "cluster", "distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                nearest, distance = tree_nearest(_tree(batch, i, dims), at)
                if distance.dtype == object:
                    distance = [d if d < 1 << 63 else None for d in distance.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(nearest), pa.array(distance, pa.int64())], names)

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def kd_means(df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of all vectors kept, and the final centroids."""
    vectors = kept_vectors(df, dims, id_col, vec_col)
    centroids = first_centroids(vectors, k, scale, seed)
    if not centroids:
        return df.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), []
    trees = staged(grow_trees(vectors, scale), "kd-trees")
    for _ in range(rounds):
        centroids = next_centroids(trees, centroids)
    return assigned(trees, centroids), centroids


def op13_centroids(df: DataFrame) -> DataFrame:
    """The assignment with each cluster's and the whole inertia and the digest of the final centroid."""
    rows, centroids = kd_means(df)
    rows = staged(rows, "kd-assigned")
    whole = F.sum(F.col("distance").cast("decimal(38,0)")).alias("v")
    # null if any distance is
    missing = F.max(F.col("distance").isNull()).alias("m")
    sums = {r["cluster"]: None if r["m"] else int(r["v"]) for r in rows.groupBy("cluster").agg(whole, missing).collect()}
    total = None if None in sums.values() else sum(sums.values())

    def fits(v: int | None) -> int | None:
        return v if v is not None and v < 1 << 63 else None

    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    at = F.col("cluster") + 1
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), at) if values else F.lit(None).cast(kind)
    return rows.select(
        "vec_id",
        "cluster",
        "distance",
        of([fits(sums.get(k)) for k in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(fits(total)).cast("long").alias("inertia"),
        of(digest, "string").alias("centroid_sha256"),
    )


def oracle_op13(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """DuckDB SQL of the same rows."""
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {dims}),
v AS MATERIALIZED (SELECT r, i, CAST(floor({scale} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {dims + 1}) t(i)),
c0 AS MATERIALIZED (SELECT CAST(k AS INT) AS k, i, x AS c FROM (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), r) - 1 AS k FROM kept) JOIN v USING (r) WHERE k < {k})"""
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} AS MATERIALIZED (SELECT r, k, sum((x - c) * (x - c)) AS d FROM v JOIN c{n} USING (i) GROUP BY r, k)")
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, k, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, k) AS o FROM d{n}) WHERE o = 1)")
        if n < rounds:
            steps.append(
                f"m{n} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM a{n} JOIN v USING (r) GROUP BY k, i), "
                f"c{n + 1} AS MATERIALIZED (SELECT c.k, c.i, CAST(coalesce((s - ((s % n) + n) % n) // n, c.c) AS BIGINT) AS c FROM c{n} c LEFT JOIN m{n} m ON m.k = c.k AND m.i = c.i)"
            )
    steps.append(f"h AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, k AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN h USING (k)"""
