"""Group lasso: min 1/(2n) |y - b - Zw|^2 + lambda * sum_g |w_g|, at any width.

Up to ``MOST_COLUMNS`` columns the data are read once, for the sums ZtZ, Zty and column sums of
every target and membership mask (summed in Spark, a block of rows per task); every alpha, warm
start and class after that is a solve of the size of the model on the driver.

Beyond it, Z stays in Spark as blocks of whole rows with their targets. A pass forms the residuals
of all models where the rows are, and brings back their products with Z: p numbers a model. From
these the duality gap follows exactly. The groups that break the optimality conditions most, as
many as a Gram matrix on the driver may hold, are then solved for with all others fixed (one pass
for that Gram matrix, unless a kept one holds the groups), until the gap is closed. Where all
groups with weight fit at once, this is a working-set method; where they don't, it is block
coordinate descent with large blocks. Passes are counted (``Problem.passes``).

All solves end by the duality gap, as a share of the null model's loss, and by the optimality
conditions; groups that the gap proves to be zero are left out of further rounds.

Z may also be one that tasks make from vectors (``kernel.Unmade``): then the vectors are what is kept,
and each pass makes its rows of Z, a batch of blocks at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernloom.functions.sums import summed
from kernloom.operators.kernel import Unmade

MOST_COLUMNS = 4096
#: Gap and violation of the optimality conditions at which a solve on sums ends, and one by passes.
GAP, KKT = 1e-10, 1e-5
WIDE_GAP, WIDE_KKT = 1e-6, 5e-4
#: Numbers in a block of rows, and in the Gram matrices that are kept between rounds.
BLOCK, KEPT = 1 << 17, 1 << 25


@dataclass
class Sums:
    """Sums over the training rows; ``zy`` has one column per target."""

    n: int
    z: np.ndarray
    y: np.ndarray
    zz: np.ndarray
    zy: np.ndarray
    groups: list[str]
    width: int
    yy: np.ndarray

    def lambda_of(self, alpha: float, target: int = 0) -> float:
        """alpha times the largest |Zty| / n, not centred."""
        return alpha * float(np.abs(self.zy[:, target]).max()) / self.n


@contextmanager
def small_batches(spark: SparkSession, numbers: int) -> Iterator[None]:
    """While it lasts, rows of ``numbers`` numbers go to Python a few million numbers at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    most = max(1, (1 << 22) // max(numbers, 1))
    spark.conf.set(name, min(int(before), most) if int(before) > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def wide_rows(z: DataFrame, targets: DataFrame) -> DataFrame:
    """(cell_id, v, and the targets' columns): all blocks of a training cell in group order."""
    rows = z.where("split = 'train'").groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("group_ord", "z"))).alias("b"))
    rest = [c for c in targets.columns if c != "cell_id"]
    return rows.join(targets, "cell_id").select("cell_id", F.flatten(F.transform("b", lambda x: x["z"])).alias("v"), *rest)


def layout(z: DataFrame) -> tuple[list[str], int]:
    """(groups in order, columns of each). ValueError if Z is empty."""
    groups = [r["group"] for r in z.select("group", "group_ord").distinct().orderBy("group_ord").collect()]
    first = z.select(F.size("z").alias("n")).first()
    if first is None:
        raise ValueError("Z is empty")
    return groups, first["n"]


def gather_sums(z: DataFrame, targets: DataFrame) -> Sums:
    """``targets``: cell_id, y array<double> (one entry per target). ValueError without any
    training row."""
    return gather_each(z, targets.select("cell_id", "y"), *layout(z))[0]


def gather_each(z: DataFrame, targets: DataFrame, groups: list[str], width: int) -> list[Sums]:
    """Sums from one pass: with a column ``s`` (array of 0 or 1, one per target) each target's over
    the rows where its entry is 1, else all targets' together."""
    p = len(groups) * width
    masked = "s" in targets.columns

    def products(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        full = np.hstack([np.ones((len(pdf), 1)), np.stack(pdf["v"].to_numpy()), np.stack(pdf["y"].to_numpy())])
        if not masked:
            return {"0": full.T @ full}
        out = {}
        for k, own in enumerate(np.stack(pdf["s"].to_numpy()).T > 0):
            mine = full[own][:, [*range(p + 1), p + 1 + k]]
            out[str(k)] = mine.T @ mine
        return out

    with small_batches(z.sparkSession, p):
        found = summed(wide_rows(z, targets).select("v", "y", *(["s"] if masked else [])), products)
    if not found:
        raise ValueError("no training rows")
    out = []
    for k in sorted(found, key=int):
        size = int(round(len(found[k]) ** 0.5))
        m = found[k].reshape(size, size)
        n = int(round(m[0, 0]))
        if not n:
            raise ValueError("no training rows")
        out.append(Sums(n, m[0, 1 : p + 1], m[0, p + 1 :], m[1 : p + 1, 1 : p + 1], m[1 : p + 1, p + 1 :], groups, width, np.diag(m)[p + 1 :].copy()))
    return out


def gap_of(w: np.ndarray, q: np.ndarray, c: np.ndarray, yy: float, lam: float, k: int) -> tuple[float, np.ndarray]:
    """(duality gap, the dual point's product with each group) of centred quantities a row:
    ``c`` = Zty, ``q`` = Zt(y - Zw), ``yy`` = |y|^2."""
    norms = np.linalg.norm(q.reshape(-1, k), axis=1)
    yr = yy - float(c @ w)  # y times the residual
    rr = max(yr - float(w @ q), 0.0)
    top = float(norms.max())
    scale = float(np.clip(yr / rr, -lam / top, lam / top)) if rr > 0 and top > 0 else 0.0
    primal = rr / 2 + lam * float(np.linalg.norm(w.reshape(-1, k), axis=1).sum())
    return primal - (scale * yr - scale * scale * rr / 2), abs(scale) * norms


def violations(w: np.ndarray, q: np.ndarray, lam: float, k: int) -> np.ndarray:
    """By group, how far the optimality conditions are off, as a share of lambda."""
    g, v = q.reshape(-1, k), w.reshape(-1, k)
    norms = np.linalg.norm(v, axis=1, keepdims=True)
    inside = np.abs(g - lam * v / np.maximum(norms, 1e-300)).max(axis=1)
    return np.where(norms[:, 0] > 0, inside, np.maximum(np.linalg.norm(g, axis=1) - lam, 0)) / lam


def _upper(gram: np.ndarray) -> np.ndarray:
    """The upper half of a symmetric matrix, by rows: what travels of it."""
    return gram[~np.tri(len(gram), k=-1, dtype=bool)]


def _whole(flat: np.ndarray, size: int) -> np.ndarray:
    out, mask = np.empty((size, size)), ~np.tri(size, k=-1, dtype=bool)
    out[mask] = flat
    out.T[mask] = flat
    return out


def _largest(gram: np.ndarray, k: int) -> list[float]:
    return [max(float(np.linalg.eigvalsh(gram[a : a + k, a : a + k])[-1]), 1e-12) for a in range(0, len(gram), k)]


def _descend(gram: np.ndarray, c: np.ndarray, w: np.ndarray, lam: float, yy: float, k: int, gap_tol: float, kkt_tol: float, rounds: int) -> None:
    """Block coordinate descent on a centred Gram matrix, in place, with passes over the groups with
    weight between those over all that the gap hasn't ruled out."""
    gw = gram @ w
    steps = _largest(gram, k)
    alive = list(range(len(c) // k))

    def sweep(todo: list[int]) -> float:
        moved = 0.0
        for g in todo:
            b = slice(g * k, g * k + k)
            old = w[b]
            u = old - (gw[b] - c[b]) / steps[g]
            norm = float(np.linalg.norm(u))
            diff = (u * max(0.0, 1 - lam / steps[g] / norm) if norm else u) - old
            if diff.any():
                gw[:] += gram[:, b] @ diff
                w[b] += diff
                moved = max(moved, steps[g] * float(np.linalg.norm(diff)))
        return moved

    while rounds > 0:
        moved = sweep(alive)
        rounds -= 1
        q = c - gw
        gap, scaled = gap_of(w, q, c, yy, lam, k)
        if gap <= gap_tol * yy / 2 and violations(w, q, lam, k).max() <= kkt_tol:
            return
        for g in [g for g in alive if scaled[g] + (2 * steps[g] * max(gap, 0.0)) ** 0.5 < lam]:
            b = slice(g * k, g * k + k)
            gw -= gram[:, b] @ w[b]
            w[b] = 0.0
            alive.remove(g)
        active = [g for g in alive if w[g * k : g * k + k].any()]
        while active and rounds > 0 and sweep(active) > 0.1 * moved:
            rounds -= 1


def solve(s: Sums, alpha: float, target: int = 0, start: np.ndarray | None = None, rounds: int = 5000) -> tuple[np.ndarray, float]:
    """(coefficients, intercept)."""
    return solve_certified(s, alpha, target, start, rounds)[:2]


def solve_certified(s: Sums, alpha: float, target: int = 0, start: np.ndarray | None = None, rounds: int = 5000) -> tuple[np.ndarray, float, float]:
    """(coefficients, intercept, gap as a share of the null model's loss)."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    lam = s.lambda_of(alpha, target)
    mean_z, mean_y = s.z / s.n, s.y[target] / s.n
    gram = s.zz / s.n - np.outer(mean_z, mean_z)
    c = s.zy[:, target] / s.n - mean_z * mean_y
    yy = float(s.yy[target] / s.n - mean_y**2)
    w = np.zeros(len(c)) if start is None else start.copy()
    if lam > 0 and yy > 0:
        _descend(gram, c, w, lam, yy, s.width, GAP, KKT, rounds)
        gap = max(gap_of(w, c - gram @ w, c, yy, lam, s.width)[0], 0.0) / (yy / 2)
    else:
        w[:], gap = 0.0, 0.0
    return w, float(mean_y - mean_z @ w), gap


def kkt_residual(s: Sums, w: np.ndarray, alpha: float, target: int = 0) -> float:
    """Largest violation of the optimality conditions, as a share of lambda."""
    mean_z, mean_y = s.z / s.n, s.y[target] / s.n
    q = s.zy[:, target] / s.n - mean_z * mean_y - (s.zz / s.n - np.outer(mean_z, mean_z)) @ w
    return float(violations(w, q, s.lambda_of(alpha, target), s.width).max())


def row_blocks(z: DataFrame | Unmade, targets: DataFrame, p: int) -> DataFrame:
    """(m, y, s): doubles of some training rows (of their vectors, where Z is unmade), their targets, and for
    each target whether a row counts. Cached, since every pass reads them."""
    if "s" not in targets.columns:
        targets = targets.withColumn("s", F.transform("y", lambda _: F.lit(1.0)))
    if isinstance(z, Unmade):
        rows = z.rows.where("split = 'train'").select("cell_id", F.col("x").alias("v")).join(targets, "cell_id")
    else:
        rows = wide_rows(z, targets)
    many = max(1, BLOCK // p)

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), many):
                some = pdf.iloc[at : at + many]
                yield pd.DataFrame({c: [np.stack(some[n].to_numpy()).astype(float).tobytes()] for c, n in (("m", "v"), ("y", "y"), ("s", "s"))})

    blocks = rows.select("v", "y", "s").mapInPandas(pack, "m binary, y binary, s binary").persist()
    with small_batches(targets.sparkSession, p):
        blocks.count()
    return blocks


@dataclass
class Problem:
    """Z with its targets, to be solved at any alpha: ``sums`` where it is narrow, else ``blocks``."""

    groups: list[str]
    width: int
    targets: int
    sums: list[Sums] | None = None
    blocks: DataFrame | None = None
    #: Makes rows of Z in a task from the vectors that blocks hold; None where they hold Z.
    make: Callable[[np.ndarray], np.ndarray] | None = None
    passes: int = 0
    solves: int = 0
    kept: dict = field(default_factory=dict)
    #: Of each target: rows, sums of columns, targets, their squares and products, from the first pass over blocks.
    n: np.ndarray | None = None
    z: np.ndarray | None = None
    y: np.ndarray | None = None
    yy: np.ndarray | None = None
    zy: np.ndarray | None = None

    def release(self) -> None:
        if self.blocks is not None:
            self.blocks.unpersist()

    def fit(self, alpha: float, which: list[int] | None = None, starts: dict[int, np.ndarray] | None = None) -> dict[int, tuple[np.ndarray, float, float]]:
        """By target: (coefficients, intercept, gap), of the targets ``which`` or all."""
        if alpha <= 0:
            raise ValueError("alpha must be positive")
        which, starts = list(range(self.targets)) if which is None else which, starts or {}
        self.solves += len(which)
        if self.sums is None:
            return self._by_passes(alpha, which, starts)
        at = lambda t: (self.sums[t], 0) if len(self.sums) > 1 else (self.sums[0], t)
        return {t: solve_certified(at(t)[0], alpha, at(t)[1], starts.get(t)) for t in which}

    def _sum(self, of, most_tasks: int | None = None) -> dict[str, np.ndarray]:
        """One pass: sums of what ``of`` (Z, targets, masks of a batch of blocks) gives. Each task's sums travel, so
        where they are larger than its rows ``most_tasks`` takes several tasks together."""
        targets, make = self.targets, self.make

        def each(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
            # a batch's blocks together: products are large, and few are added up
            rows = lambda c: np.concatenate([np.frombuffer(x) for x in pdf[c]])
            y, s = rows("y").reshape(-1, targets), rows("s").reshape(-1, targets)
            m = rows("m").reshape(len(y), -1)
            return of(m if make is None else make(m), y, s)

        self.passes += 1
        with small_batches(self.blocks.sparkSession, BLOCK):
            return summed(self.blocks if most_tasks is None else self.blocks.coalesce(most_tasks), each)

    def _first_sums(self) -> None:
        """Sums that no model changes: rows, columns, targets, their products."""

        def of(m: np.ndarray, y: np.ndarray, s: np.ndarray) -> dict[str, np.ndarray]:
            return {"n": s.sum(axis=0), "z": m.T @ s, "y": (s * y).sum(axis=0), "yy": (s * y * y).sum(axis=0), "zy": m.T @ (s * y)}

        found = self._sum(of)
        if not found or not found["n"].all():
            raise ValueError("no training rows")
        self.n, self.y, self.yy = found["n"], found["y"], found["yy"]
        self.z, self.zy = (found[k].reshape(-1, self.targets) for k in ("z", "zy"))

    def _by_passes(self, alpha: float, which: list[int], starts: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, float, float]]:
        if self.n is None:
            self._first_sums()
        k, p = self.width, len(self.groups) * self.width
        mean_z = {t: self.z[:, t] / self.n[t] for t in which}
        mean_y = {t: self.y[t] / self.n[t] for t in which}
        c = {t: self.zy[:, t] / self.n[t] - mean_z[t] * mean_y[t] for t in which}
        yy = {t: float(self.yy[t] / self.n[t] - mean_y[t] ** 2) for t in which}
        lam = {t: alpha * float(np.abs(self.zy[:, t]).max()) / self.n[t] for t in which}
        w = {t: starts[t].copy() if t in starts else np.zeros(p) for t in which}
        out = {}
        todo = [t for t in which if lam[t] > 0 and yy[t] > 0]
        for t in set(which) - set(todo):
            out[t] = np.zeros(p), float(mean_y[t]), 0.0
        while todo:
            q = self._residual_products(w, todo, mean_z, c)
            chosen = {}
            for t in list(todo):
                gap, _ = gap_of(w[t], q[t], c[t], yy[t], lam[t], k)
                off = violations(w[t], q[t], lam[t], k)
                if gap <= WIDE_GAP * yy[t] / 2 and off.max() <= WIDE_KKT:
                    out[t] = w[t], float(mean_y[t] - mean_z[t] @ w[t]), max(gap, 0.0) / (yy[t] / 2)
                    todo.remove(t)
                    continue
                # those that a step would move most; twice as many as have weight, as the matrix may hold
                u = w[t].reshape(-1, k) + q[t].reshape(-1, k)
                norms = np.linalg.norm(u, axis=1, keepdims=True)
                step = np.linalg.norm(w[t].reshape(-1, k) - u * np.maximum(0, 1 - lam[t] / np.maximum(norms, 1e-300)), axis=1)
                active = int(w[t].reshape(-1, k).any(axis=1).sum())
                many = max(1, min(MOST_COLUMNS // k, max(10, 2 * active)))
                chosen[t] = sorted(np.argsort(-step, kind="stable")[:many].tolist())
            for t, groups, gram in self._grams(chosen, mean_z):
                cols = np.concatenate([np.arange(g * k, g * k + k) for g in groups])
                own = w[t][cols]
                # the others are fixed: their part is in the residual
                target = q[t][cols] + gram @ own
                rest = max(yy[t] - float(c[t] @ w[t]) - float(w[t] @ q[t]), 0.0) + 2 * float(q[t][cols] @ own) + float(own @ gram @ own)
                _descend(gram, target, own, lam[t], max(rest, 1e-300), k, WIDE_GAP / 10, WIDE_KKT / 10, 2000)
                w[t][cols] = own
        return out

    def _residual_products(self, w: dict[int, np.ndarray], todo: list[int], mean_z: dict, c: dict) -> dict[int, np.ndarray]:
        """By target, Zt(y - Zw) a row, centred: one pass for all; none for models without weight."""
        live = [t for t in todo if w[t].any()]
        q = {t: c[t].copy() for t in todo if t not in live}
        if live:
            cols = np.flatnonzero(np.any([w[t] for t in live], axis=0))
            coef = np.stack([w[t][cols] for t in live], axis=1)
            sent = self.blocks.sparkSession.sparkContext.broadcast((cols, coef))  # the size of the models

            def of(m: np.ndarray, y: np.ndarray, s: np.ndarray) -> dict[str, np.ndarray]:
                at, values = sent.value
                r = s[:, live] * (y[:, live] - m[:, at] @ values)
                return {"q": m.T @ r, "r": r.sum(axis=0)}

            found = self._sum(of)
            sent.unpersist()
            for j, t in enumerate(live):
                q[t] = found["q"].reshape(-1, len(live))[:, j] / self.n[t] - mean_z[t] * found["r"][j] / self.n[t]
        return q

    def _grams(self, chosen: dict[int, list[int]], mean_z: dict) -> Iterator[tuple[int, list[int], np.ndarray]]:
        """(target, groups, centred Gram matrix) of each, from a kept matrix or by passes that sum as many
        as ``KEPT`` numbers together."""
        k, waiting = self.width, dict(chosen)
        columns = lambda groups: np.concatenate([np.arange(g * k, g * k + k) for g in groups])
        while waiting:
            share, room = {}, KEPT
            for t, groups in list(waiting.items()):
                held = next((h for (of, h) in self.kept if of == t and set(groups) <= set(h)), None)
                if held is not None:
                    at = columns([held.index(g) for g in groups])
                    yield t, groups, self.kept[t, held][np.ix_(at, at)]
                    del waiting[t]
                elif not share or (len(groups) * k) ** 2 <= room:
                    share[t] = columns(groups)
                    room -= (len(groups) * k) ** 2
            if not share:
                continue

            def of(m: np.ndarray, y: np.ndarray, s: np.ndarray, share=share) -> dict[str, np.ndarray]:
                return {str(t): _upper((m[:, at] * s[:, [t]]).T @ m[:, at]) for t, at in share.items()}

            wide = max(len(at) for at in share.values())
            # a matrix a task: no more tasks than run at once, so what travels doesn't grow with the rows
            cores = self.blocks.sparkSession.sparkContext.defaultParallelism
            for t, flat in self._sum(of, max(1, min(cores, int(self.n.max()) // wide))).items():
                at = share[int(t)]
                gram = _whole(flat, len(at)) / self.n[int(t)] - np.outer(mean_z[int(t)][at], mean_z[int(t)][at])
                self.kept[int(t), tuple(waiting[int(t)])] = gram
                while sum(x.size for x in self.kept.values()) > KEPT and len(self.kept) > len(share):
                    del self.kept[next(iter(self.kept))]


def problem(z: DataFrame | Unmade, targets: DataFrame) -> Problem:
    """``targets``: cell_id, y array<double>, and maybe s array<double> (0 or 1: whether the row counts
    for the target). ValueError without any training row. Unmade Z is solved by passes at any width."""
    groups, width = (z.groups, z.width) if isinstance(z, Unmade) else layout(z)
    first = targets.select(F.size("y").alias("n")).first()
    if first is None:
        raise ValueError("no training rows")
    p = len(groups) * width
    if isinstance(z, Unmade):
        return Problem(groups, width, first["n"], blocks=row_blocks(z, targets, p), make=z.maker())
    if p <= MOST_COLUMNS:
        return Problem(groups, width, first["n"], sums=gather_each(z, targets, groups, width), passes=1)
    return Problem(groups, width, first["n"], blocks=row_blocks(z, targets, p))


def group_norms(w: np.ndarray, width: int, norm_mode: str = "reference") -> np.ndarray:
    """Norm of each block; the ``reference`` mode leaves out a block's last coefficient."""
    blocks = w.reshape(-1, width)
    return np.linalg.norm(blocks if norm_mode == "full" else blocks[:, :-1], axis=1)
