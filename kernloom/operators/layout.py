"""Neighbour graphs, fuzzy links and two-dimensional layouts of cells' vectors.

Points are (cell_id, x): ids of any type that sorts, not null and not repeated; vectors of one length.
No step holds more than a block of points, or one point's bounded lists, in a task; the driver sees
counts and a bounded sample of positions.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kernloom.functions import rand
from kernloom.functions.lineage import cut, release
from kernloom.operators import results

#: A fourth of the points that a tree's leaf compares with one another, and points that move together.
COMPARED, MOVED = 512, 4096
#: Positions of other points that a block is repelled by in a round.
REPELLED = 2000
#: Points that the splits of a search tree are drawn from; a leaf has ``LEAF`` times ``block`` points, and at
#: least ``FEWEST`` of those drawn (larger leaves are dealt into parts at random).
SAMPLE, LEAF, FEWEST = 50_000, 4, 8
#: Trees at most, and the share of links estimated to be missing at which no more are tried.
TREES, MISSING = 12, 0.02


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _graph_schema(points: DataFrame) -> str:
    kind = points.schema["cell_id"].dataType.simpleString()
    return f"u {kind}, v {kind}, d double"


class Tree:
    """Splits of a bounded sample of ``n`` points, down to leaves of about ``size`` of these: the normal of a split
    is drawn towards the directions in which its points vary most, its cut is their median."""

    def __init__(self, sample: np.ndarray, n: int, size: int, rng: np.random.Generator) -> None:
        share = n / max(len(sample), 1)
        normals, cuts, ties, below, parts = [], [], [], [], []
        todo = [(np.arange(len(sample)), -1, 0)]
        while todo:
            own, above, side = todo.pop()
            at = len(below)
            if above >= 0:
                below[above][side] = at
            below.append([-1, -1])
            x = sample[own]
            leaf = len(own) * share <= size or len(own) < 2 * FEWEST
            normal, cut_at, near, tie = np.zeros(sample.shape[1]), 0.0, 0.0, None
            if not leaf:
                from_mean = x - x.mean(0)
                r = rng.normal(size=x.shape[1])
                normal = from_mean.T @ (from_mean @ r)
                length = np.linalg.norm(normal)
                normal = normal / length if length > 0 and np.isfinite(length) else r / np.linalg.norm(r)
                y = x @ normal
                cut_at, near = float(np.median(y)), 1e-9 * float(np.abs(y).max())
                tie = np.abs(y - cut_at) <= near
                right = np.where(tie, rng.random(len(y)) < 0.5, y > cut_at)
                todo += [(own[~right], at, 0), (own[right], at, 1)]
            normals.append(normal)
            cuts.append(cut_at)
            ties.append(near)
            parts.append(max(1, math.ceil((len(own) * share if len(sample) else n) / size / 1.5)) if leaf else 0)
        self.normals, self.cuts, self.ties = np.array(normals), np.array(cuts), np.array(ties)
        self.below, self.parts = np.array(below), np.array(parts)
        self.first = np.cumsum(self.parts) - self.parts
        self.leaves = int(self.parts.sum())

    def leaf(self, x: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """The leaf of each row; points on a cut (or with a NaN) fall to either side by their ``draw``, one bit a split."""
        node, bits = np.zeros(len(x), int), draw.astype(np.uint64)
        while True:
            at = np.flatnonzero(self.parts[node] == 0)
            if not len(at):
                break
            own = node[at]
            y = np.einsum("ij,ij->i", x[at], self.normals[own]) - self.cuts[own]
            side = np.where(np.abs(y) > self.ties[own], y > 0, bits[at] & np.uint64(1) == 1)
            bits[at] >>= np.uint64(1)
            node[at] = self.below[own, side.astype(int)]
        return self.first[node] + (bits % self.parts[node].astype(np.uint64)).astype(int)


def _with_leaf(points: DataFrame, tree: Tree, seed: str) -> DataFrame:
    """``points`` with ``_b``, their leaf; the tree is broadcast."""
    sent = points.sparkSession.sparkContext.broadcast(tree)

    @F.arrow_udf("bigint")
    def leaf(x: pa.Array, draw: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.int64())
        return pa.array(sent.value.leaf(_vectors(x), draw.to_numpy(zero_copy_only=False)), pa.int64())

    # bits that are as random as a draw for each point: the same wherever it is read again
    return points.withColumn("_b", leaf("x", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("cell_id").cast("string")), 1)))


def _sample(points: DataFrame, n: int, seed: str) -> np.ndarray:
    """About ``SAMPLE`` finite vectors, or all if they are fewer."""
    most = 1 << 30
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col("cell_id").cast("string")), F.lit(most)) < int(most * min(1.0, SAMPLE / max(n, 1)))
    rows = _vectors(points.where(drawn).select("x").toArrow()["x"]) if n else np.zeros((0, 1))
    return rows[np.isfinite(rows).all(1)]


def _tasks(points: DataFrame, n: int, blocks: int) -> int:
    """Partitions for ``blocks`` blocks of ``n`` points: explicit, as the work in a block is far more than its bytes."""
    return max(1, min(blocks, max(3 * points.sparkSession.sparkContext.defaultParallelism, n // 50_000)))


def _nearest(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(places, squared distances) of each row's ``k`` nearest others, nearest first. Ties go to others at random, so
    that of many equal points none is everyone's."""
    m = len(x)
    about = x - x.mean(0)
    squares = (about**2).sum(1)
    noise = rng.random(2 * m) * (1e-12 * max(float(squares.max()), 1e-300))
    shifted = np.lib.stride_tricks.sliding_window_view(noise, m)
    near, found = np.empty((m, k), int), np.empty((m, k))
    step = max(1, (1 << 20) // m)
    for at in range(0, m, step):
        own = about[at : at + step]
        d = own @ about.T
        d *= -2
        d += squares
        d += shifted[rng.integers(0, m, len(own))]
        d[np.arange(len(own)), at + np.arange(len(own))] = np.inf
        some = np.argpartition(d, k - 1, axis=1)[:, :k]
        # distances themselves from differences, without the products' rounding
        exact = ((x[at : at + step, None] - x[some]) ** 2).sum(-1)
        order = np.argsort(exact, axis=1, kind="stable")
        near[at : at + step] = np.take_along_axis(some, order, 1)
        found[at : at + step] = np.take_along_axis(exact, order, 1)
    return near, found


def _within_leaf(k: int, seed: str):
    """Lists of one leaf's points: the k nearest of those they have and those in the leaf. ``fresh`` counts links that
    are nearer than the farthest before."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, x = _ids(table["cell_id"]), _vectors(table["x"])
        m, fresh = len(ids), np.zeros(len(ids), int)
        sizes = pa.compute.list_value_length(table["others"].combine_chunks()).to_numpy(zero_copy_only=False).astype(int)
        held = np.repeat(np.arange(m), sizes)
        others, ds = _ids(table["others"].combine_chunks().flatten()), table["ds"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        worst = np.full(m, np.inf)
        full = sizes >= k
        worst[full] = ds[np.cumsum(sizes)[full] - 1]  # lists are sorted
        good = np.flatnonzero(np.isfinite(x).all(1))
        heads, tails, far = held, others, ds
        if len(good) > 1:
            most = min(k, len(good) - 1)
            near, d = _nearest(x[good], most, np.random.default_rng([zlib.crc32(seed.encode()), int(key[0].as_py())]))
            a, b, d = np.repeat(good, most), good[near.ravel()], d.ravel()
            order = np.argsort(ids, kind="stable")
            at = order[np.minimum(np.searchsorted(ids, others, sorter=order), m - 1)]
            inside = ids[at] == others if len(others) else np.zeros(0, bool)
            new = ~np.isin(a * m + b, held[inside] * m + at[inside]) & (d < worst[a])
            fresh = np.bincount(a[new], minlength=m)
            # a link inside the leaf is among those just found, or as many are as near
            heads, tails, far = np.concatenate([held[~inside], a]), np.concatenate([others[~inside], ids[b]]), np.concatenate([ds[~inside], d])
            order = np.lexsort((far, heads))
            heads, tails, far = heads[order], tails[order], far[order]
            rank = np.arange(len(heads)) - np.searchsorted(heads, heads)
            heads, tails, far = heads[rank < k], tails[rank < k], far[rank < k]
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(heads, minlength=m))]), pa.int32())
        kind = table.schema.field("cell_id").type
        lists = pa.ListArray.from_arrays(ends, pa.array(tails, kind)), pa.ListArray.from_arrays(ends, pa.array(far, pa.float64()))
        return pa.table({"cell_id": table["cell_id"], "x": table["x"], "others": lists[0], "ds": lists[1], "fresh": pa.array(fresh, pa.int64())})

    return run


def _local_joins():
    """Rows sorted by ``centre``: the members of one list are tried as neighbours of one another, where
    one of the two is new to it and the pair is nearer than the member's farthest neighbour."""

    def tried(table: pa.Table) -> Iterator[pa.RecordBatch]:
        centre, ids, x = _ids(table["centre"]), _ids(table["member"]), _vectors(table["x"])
        worst, new = table["worst"].to_numpy(), table["new"].to_numpy() > 0
        cuts = np.concatenate([[0], np.flatnonzero(centre[1:] != centre[:-1]) + 1, [len(centre)]])
        heads, tails, found = [], [], []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            part = x[lo:hi]
            d = ((part[:, None] - part[None]) ** 2).sum(-1)
            fine = (new[lo:hi, None] | new[None, lo:hi]) & (d < worst[lo:hi, None])
            np.fill_diagonal(fine, False)
            a, b = np.nonzero(fine)
            heads.append(lo + a)
            tails.append(lo + b)
            found.append(d[a, b])
        a, b, d = np.concatenate(heads), np.concatenate(tails), np.concatenate(found)
        if len(a):
            once = pd.DataFrame({"u": ids[a], "v": ids[b], "d": d}).drop_duplicates(["u", "v"])
            yield from pa.Table.from_pandas(once, preserve_index=False).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            centre = _ids(table["centre"])
            whole = int(np.flatnonzero(centre != centre[-1])[-1] + 1) if (centre != centre[-1]).any() else 0
            held = table.slice(whole)  # the last list may go on in the next batch
            if whole:
                yield from tried(table.slice(0, whole))
        if held is not None:
            yield from tried(held)

    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    """Each pair once, the k nearest of each point; ties in a random order, so that of many equal points none is everyone's."""
    pairs = rows.repartition("u").groupBy("u", "v").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    nearest = Window.partitionBy("u").orderBy("d", F.xxhash64("u", "v"), "v")
    return pairs.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= k).drop("_n")


def _with_news(members: DataFrame) -> DataFrame:
    """Lists (centre, member, new) with each member once, where any is new: the others have no pair to
    try, so their vectors need not travel."""
    lists = members.repartition("centre").groupBy("centre", "member").agg(F.max("new").alias("new"))
    return lists.withColumn("_any", F.max("new").over(Window.partitionBy("centre"))).where("_any > 0").drop("_any")


def _by_trees(points: DataFrame, n: int, k: int, block: int, seed: str) -> tuple[DataFrame, bool]:
    """((cell_id, x, others, ds: squared), whether as good as all links are there). One tree after another: points travel
    once a tree, with their lists, to be compared within a leaf. What a tree finds anew falls by some factor from one to
    the next, which tells what is still missing."""
    kind = points.schema["cell_id"].dataType.simpleString()
    empty = [F.array().cast(t).alias(c) for c, t in (("others", f"array<{kind}>"), ("ds", "array<double>"))]
    lists = points.select("cell_id", "x", *empty, F.lit(0).cast("bigint").alias("fresh"))
    schema = lists.schema
    whole = n <= LEAF * block
    sample = np.zeros((0, 1)) if whole else _sample(points, n, f"tree{seed}")
    before = None
    for turn in range(TREES):
        if whole:
            dealt = lists.withColumn("_b", F.lit(0).cast("bigint"))
        else:
            tree = Tree(sample, n, LEAF * block, np.random.default_rng([zlib.crc32(seed.encode()), turn]))
            dealt = _with_leaf(lists, tree, f"{seed}:{turn}").repartition(_tasks(points, n, tree.leaves), "_b")
        found = dealt.groupBy("_b").applyInArrow(_within_leaf(k, f"{seed}:{turn}"), schema)
        earlier, lists = lists, cut(found)
        if turn:
            release(earlier)
        if whole:
            return lists, True
        fresh = lists.agg(F.sum("fresh")).first()[0] or 0
        if turn > 1:
            fall = fresh / before if before else 0.0
            missing = fresh * fall / (1 - fall) / (k * n) if fall < 1 else 1.0
            if missing <= MISSING:
                return lists, True
            if fall >= 1 or turn + math.log(MISSING / missing) / math.log(fall) > TREES:
                return lists, False
        before = fresh
    return lists, False


def _near(points: DataFrame, k: int, wider: int, rounds: int, settled: float, block: int, seed: str) -> DataFrame:
    """(cell_id, others, ds): the links of ``neighbours`` as a list for each point that has any, nearest first; ds are squares."""
    if points.schema["x"].dataType.simpleString() != "array<float>":  # floats travel as such, to be doubles in tasks
        points = points.withColumn("x", F.col("x").cast("array<double>"))
    points = cut(points.select("cell_id", "x"))
    n = points.count()
    lists, done = _by_trees(points, n, k, block, seed)
    lists = lists.where(F.size("others") > 0)
    if done:
        return lists.select("cell_id", "others", "ds")
    graph = _descent(points, n, lists.select(F.col("cell_id").alias("u"), F.explode(F.arrays_zip("others", "ds")).alias("p")).select("u", F.col("p.others").alias("v"), F.col("p.ds").alias("d")), wider * k, rounds, settled)
    near = _best(graph, k).groupBy("u").agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("near"))
    return near.select(F.col("u").alias("cell_id"), F.col("near.v").alias("others"), F.col("near.d").alias("ds"))


def neighbours(points: DataFrame, k: int = 15, wider: int = 2, rounds: int = 15, settled: float = 0.001, block: int = COMPARED, seed: str = "1") -> DataFrame:
    """(cell_id, other, distance): the k nearest others of each point (all others, if fewer), Euclidean.

    Points are compared within the leaves of random trees, of ``LEAF`` times ``block`` points, and keep the nearest that
    any tree found; a tree moves each vector once. Up to one leaf the result is exact. Beyond it, trees follow until
    the links still missing are estimated at ``MISSING`` of all; where ``TREES`` of them wouldn't do (many dimensions),
    neighbour descent goes on from their links: each round joins every point's neighbours, and as many of
    those that have it as theirs, with one another, until fewer than ``settled`` of the links change. It keeps
    ``wider`` times k neighbours of each point; a list holds 2 * ``wider`` * k members at most, so a round's
    shuffle is as many vectors a point, whatever the number of points near one hub. Tests measure the recall.
    Points with a NaN have no neighbours.
    """
    lists = _near(points, k, wider, rounds, settled, block, seed)
    each = lists.select("cell_id", F.explode(F.arrays_zip("others", "ds")).alias("p"))
    return each.select("cell_id", F.col("p.others").alias("other"), F.sqrt("p.ds").alias("distance"))


def _descent(points: DataFrame, n: int, start: DataFrame, kept: int, rounds: int, settled: float) -> DataFrame:
    """(u, v, d, new): neighbour descent from the links ``start``."""
    schema = _graph_schema(points)
    graph = cut(_best(start.withColumn("new", F.lit(1)), kept))
    for turn in range(rounds):
        back = Window.partitionBy("centre").orderBy(F.xxhash64(F.lit(turn), "centre", "member"))
        ahead = graph.select(F.col("u").alias("centre"), F.col("v").alias("member"), "new")
        behind = graph.select(F.col("v").alias("centre"), F.col("u").alias("member"), "new")
        behind = behind.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= kept).drop("_n")
        lists = _with_news(ahead.unionByName(behind))
        far = graph.groupBy(F.col("u").alias("member")).agg(F.when(F.count("*") < kept, math.inf).otherwise(F.max("d")).alias("worst"))
        held = points.withColumnRenamed("cell_id", "member").join(far, "member", "left").withColumn("worst", F.coalesce("worst", F.lit(math.inf)))
        rows = lists.join(held, "member").select("centre", "member", "x", "worst", "new")
        tried = rows.repartition("centre").sortWithinPartitions("centre").mapInArrow(_local_joins(), schema)
        earlier, graph = graph, cut(_best(graph.withColumn("new", F.lit(0)).unionByName(tried.withColumn("new", F.lit(1))), kept))
        release(earlier)
        if (graph.agg(F.sum("new")).first()[0] or 0) < settled * kept * n:
            break
    return graph


def fuzzy_weights(distances: np.ndarray, k: int) -> np.ndarray:
    """Membership of each row's neighbours (NaN: none there): exp(-(d - least) / s), where least is the
    smallest distance above 0 and s makes a row's sum log2(k)."""
    there = np.isfinite(distances)
    least = np.where(there & (distances > 0), distances, np.inf).min(1, initial=np.inf)
    beyond = np.where(there, np.maximum(distances - np.where(np.isfinite(least), least, 0.0)[:, None], 0), np.inf)
    lo, hi = np.zeros(len(distances)), np.full(len(distances), np.inf)
    s = np.ones(len(distances))
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        for _ in range(64):
            big = np.exp(-beyond / s[:, None]).sum(1) > math.log2(max(k, 2))
            hi, lo = np.where(big, s, hi), np.where(big, lo, s)
            s = np.where(np.isfinite(hi), (lo + hi) / 2, s * 2)
    mean = np.where(there, distances, 0).sum(1) / np.maximum(there.sum(1), 1)
    s = np.maximum(s, np.maximum(1e-3 * mean, 1e-12))
    return np.exp(-beyond / s[:, None])


def fuzzy_links(graph: DataFrame, k: int = 15) -> DataFrame:
    """(a, b, weight), a < b: memberships p and q of either direction joined to p + q - pq."""
    near = graph.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("distance", "other"))).alias("near"))
    return _links_of(near.select("cell_id", F.col("near.other").alias("others"), F.col("near.distance").alias("ds")), k)


def _links_of(near: DataFrame, k: int) -> DataFrame:
    """``fuzzy_links`` of lists (cell_id, others, ds: distances)."""
    kind = near.schema["cell_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            sizes = pdf["ds"].map(len).to_numpy()
            table = np.full((len(pdf), k), np.nan)
            table[np.arange(k) < sizes[:, None]] = np.concatenate(pdf["ds"].to_list()) if len(pdf) else []
            weights = fuzzy_weights(table, k)
            yield pdf[["cell_id", "others"]].assign(ws=[w[:s] for w, s in zip(weights, sizes)])

    rows = near.mapInPandas(run, f"cell_id {kind}, others array<{kind}>, ws array<double>")
    rows = rows.select("cell_id", F.explode(F.arrays_zip("others", "ws")).alias("p")).select("cell_id", F.col("p.others").alias("other"), F.col("p.ws").alias("w"))
    pairs = rows.groupBy(F.least("cell_id", "other").alias("a"), F.greatest("cell_id", "other").alias("b"))
    both = F.when(F.count("*") > 1, F.min("w") * F.max("w")).otherwise(0.0)
    return pairs.agg((F.sum("w") - both).alias("weight"))


def curve(min_dist: float = 0.5, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^(2b)), least squares against 1 up to ``min_dist`` and
    exp(-(d - min_dist) / spread) beyond, over distances to three times ``spread``."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    target = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    p, damping = np.zeros(2), 1e-3  # logarithms of a and b

    def residual(p: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(p[0]) * d ** (2 * np.exp(p[1]))) - target

    for _ in range(200):
        r = residual(p)
        j = np.stack([(residual(p + h) - residual(p - h)) / 2e-6 for h in np.eye(2) * 1e-6], 1)
        move = np.linalg.solve(j.T @ j + damping * np.eye(2), -j.T @ r)
        better = (residual(p + move) ** 2).sum() < (r**2).sum()
        p, damping = (p + move, damping / 3) if better else (p, damping * 3)
    return float(np.exp(p[0])), float(np.exp(p[1]))


def _moves(sample: np.ndarray, n: int, a: float, b: float, turn: int, rounds: int, steps: int, seed: str):
    """One round of a block: its points move ``steps`` times, others stand where they were at its start."""

    def run(key: tuple[pa.Scalar, ...], mine: pa.Table, there: pa.Table) -> pa.Table:
        head, links = _ids(mine["cell_id"]), mine["others"].combine_chunks()
        own = np.sort(head)
        m = len(own)
        sizes = pa.compute.list_value_length(links).to_numpy(zero_copy_only=False).astype(int)
        of = np.repeat(np.searchsorted(own, head), sizes)
        tail, w = _ids(links.flatten()), mine["ws"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        order = np.lexsort((tail, of))
        tail, w, of = tail[order], w[order], of[order]
        spots, at = np.unique(_ids(there["cell_id"]), return_index=True)
        where = np.stack([there["y0"].to_numpy()[at], there["y1"].to_numpy()[at]], 1)
        y = where[np.searchsorted(spots, own)]
        at = np.minimum(np.searchsorted(spots, tail), len(spots) - 1)
        fine = spots[at] == tail
        tail, w, of, stand = tail[fine], w[fine], of[fine], where[at[fine]]
        at = np.minimum(np.searchsorted(own, tail), m - 1)
        inside = own[at] == tail
        place = np.where(inside, at, m + np.arange(len(tail)))
        sums = np.concatenate([[0.0], np.cumsum(w)])
        lo, hi = np.searchsorted(of, np.arange(m)), np.searchsorted(of, np.arange(m), "right")
        movers = np.flatnonzero(sums[hi] > sums[lo])
        rng = np.random.default_rng([zlib.crc32(seed.encode()), turn, int(key[0].as_py())])
        for step in range(steps):
            rate = 1 - (turn * steps + step) / (rounds * steps)
            now = np.concatenate([y, stand])
            move = np.zeros_like(y)
            for _ in range(2):  # a link pulls at both of its ends
                pick = np.searchsorted(sums, sums[lo[movers]] + rng.random(len(movers)) * (sums[hi] - sums[lo])[movers], "right") - 1
                pick = np.clip(pick, lo[movers], hi[movers] - 1)
                apart = y[movers] - now[place[pick]]
                d2 = np.maximum((apart**2).sum(1), 1e-12)
                move[movers] += np.clip((-2 * a * b * d2 ** (b - 1) / (1 + a * d2**b))[:, None] * apart, -4, 4)
            for _ in range(5):
                pool = np.where(rng.random(m) * n < m, rng.integers(0, m, m), m + rng.integers(0, len(sample), m))
                apart = y - np.concatenate([y, sample])[pool]
                d2 = (apart**2).sum(1)
                move += np.clip((2 * b / ((0.001 + d2) * (1 + a * d2**b)))[:, None] * apart, -4, 4)
            y = y + rate * move
        return pa.table({"cell_id": pa.array(own, mine.schema.field("cell_id").type), "_b": pa.array(np.full(m, key[0].as_py()), pa.int64()), "y0": y[:, 0], "y1": y[:, 1]})

    return run


def layout(points: DataFrame, links: DataFrame, k: int = 15, rounds: int = 10, steps: int = 30, block: int = MOVED, min_dist: float = 0.5, seed: str = "1") -> DataFrame:
    """(cell_id, y0, y1): linked points near one another, all others apart.

    Points start at the first two places of x. In each round every block of points draws two links and
    five other points for each of its own, ``steps`` times; then blocks see one another's
    new positions. A point reached by more than 4k links is pulled by its strongest 4k.
    """
    start = points.select("cell_id", *[F.coalesce(F.get("x", F.lit(i)), F.lit(0.0)).cast("double").alias(f"y{i}") for i in (0, 1)])
    n, most = start.agg(F.count("*"), F.max(F.greatest(F.abs("y0"), F.abs("y1")))).first()
    scale = 10 / most if most else 1.0
    noise = [(rand.uniform(f"layout{seed}{i}", F.col("cell_id")) - 0.5) * 0.001 for i in (0, 1)]
    if not n:
        return start
    # points that are near in x move together, so that most links stay within a block
    tree = Tree(_sample(points, n, f"move{seed}"), n, block, np.random.default_rng(zlib.crc32(seed.encode())))
    many = _tasks(points, n, tree.leaves)
    blocks = cut(_with_leaf(points.select("cell_id", "x"), tree, f"move{seed}").drop("x"))
    at = cut(start.join(blocks, "cell_id").select("cell_id", "_b", (F.col("y0") * scale + noise[0]).alias("y0"), (F.col("y1") * scale + noise[1]).alias("y1")))
    strongest = Window.partitionBy("cell_id").orderBy(F.desc("weight"), "other")
    ends = links.select(F.col("a").alias("cell_id"), F.col("b").alias("other"), "weight").unionByName(links.select(F.col("b").alias("cell_id"), F.col("a").alias("other"), "weight"))
    ends = ends.withColumn("_n", F.row_number().over(strongest)).where(F.col("_n") <= 4 * k)
    lists = ends.groupBy("cell_id").agg(F.collect_list("other").alias("others"), F.collect_list("weight").alias("ws"))
    none = [F.coalesce(c, F.array().cast(lists.schema[c].dataType)).alias(c) for c in ("others", "ws")]
    # both stay where they are in all rounds: a block's links, and the blocks that wait for a point's position
    held = cut(blocks.join(lists, "cell_id", "left").select("_b", "cell_id", *none).repartition(many, "_b"))
    wanted = held.select(F.explode("others").alias("cell_id"), F.col("_b").alias("_to")).distinct().join(blocks, "cell_id").where("_b <> _to")
    wanted = cut(wanted.select("cell_id", "_to").repartition(many, "cell_id"))
    a, b = curve(min_dist)
    for turn in range(rounds):
        drawn = at.orderBy(F.xxhash64(F.lit(turn), F.col("cell_id").cast("string")), "cell_id").limit(REPELLED)
        sample = np.array([(r["y0"], r["y1"]) for r in drawn.select("y0", "y1").collect()])
        sent = wanted.join(at.drop("_b"), "cell_id").select("cell_id", F.col("_to").alias("_b"), "y0", "y1")
        there = at.unionByName(sent)
        there = there.select(*[F.col(c).alias(c) for c in there.columns]).repartition(many, "_b")  # columns of its own, as both come from ``blocks``
        moved = held.groupBy("_b").cogroup(there.groupBy("_b")).applyInArrow(_moves(sample, n, a, b, turn, rounds, steps, seed), at.schema)
        earlier, at = at, cut(moved)
        release(earlier)
    return at.select("cell_id", "y0", "y1")


def group_layout(matrix: DataFrame, cells: DataFrame, groups: DataFrame, names: list[str], is_binary: bool = False) -> DataFrame:
    """(cell_id, label, y0, y1): the table behind a plot of cells by the features of the named groups.
    Binary data: TF-IDF, 30 axes, 10 neighbours; other: totals, log1p, 50 axes, 15 neighbours."""
    axes, k = (30, 10) if is_binary else (50, 15)
    reduced = results.group_embedding(matrix, cells, groups, names, is_binary, axes)
    points = cut(reduced.select("cell_id", F.col("coords").alias("x")))
    lists = _near(points, k, 2, 15, 0.001, COMPARED, "1")
    links = _links_of(lists.withColumn("ds", F.transform("ds", F.sqrt)), k)
    return cells.select("cell_id", "label").join(layout(points, links, k), "cell_id")
