"""Reproducible draws: pure functions of (seed, key), the same in Spark and in plain SQL."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: str, key: Column) -> Column:
    """Hex text that orders keys at random."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def uniform(seed: str, key: Column) -> Column:
    """A double in (0, 1)."""
    head = F.conv(F.substring(draw(seed, key), 1, 8), 16, 10).cast("double")
    return (head + 0.5) / F.lit(4294967296.0)


def normal(seed: str, key: Column) -> Column:
    """Standard normal (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(seed + "a", key)))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(seed + "b", key))


def cauchy(seed: str, key: Column) -> Column:
    return F.tan(F.lit(math.pi) * (uniform(seed, key) - 0.5))


def laplace(seed: str, key: Column) -> Column:
    u = uniform(seed, key) - 0.5
    return -F.signum(u) * F.log(F.lit(1.0) - 2 * F.abs(u))


def hash_rank(df: DataFrame, seed: str, key: str, by: list[str] = (), out: str = "rn") -> DataFrame:
    """``df`` with the rank (from 1) of each row in random order within ``by``.

    A plain row_number would sort a whole group in one task. Here the draws' first digits
    make 4096 buckets per group; bucket counts give offsets, and only buckets are sorted.
    """
    by = list(by)
    rows = df.withColumn("_d", draw(seed, F.col(key))).withColumn("_b", F.substring("_d", 1, 3))
    counts = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inner = Window.partitionBy(*by, "_b").orderBy("_d", key)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*by, "_b"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    ranked = rows.withColumn("_r", F.row_number().over(inner)).alias("r").join(offsets.alias("o"), on)
    return ranked.select("r.*", F.col("o._o").alias("_o")).withColumn(out, (F.col("_o") + F.col("_r")).cast("bigint")).drop("_d", "_b", "_r", "_o")


# --- the same draws in numpy, for tasks that need many of them ---------------------------------

# MD5 (RFC 1321), fixed values: turns of each round, the first state; the sines follow their rule
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def _heads(text: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of each padded message (uint8[n, 64 blocks])."""
    state = [np.full(len(text), x, np.uint32) for x in _STATE]
    for start in range(0, text.shape[1], 64):
        words = np.ascontiguousarray(text[:, start : start + 64]).view("<u4").T.copy()
        a, b, c, d = state
        for i in range(64):
            kind = i // 16
            if kind == 0:
                f, at = d ^ (b & (c ^ d)), i
            elif kind == 1:
                f, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif kind == 2:
                f, at = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, at = c ^ (b | ~d), 7 * i % 16
            f += a
            f += words[at]
            f += np.uint32(_SINES[i])
            turn = _TURNS[kind][i % 4]
            a, d, c, b = d, c, b, b + (f << np.uint32(turn) | f >> np.uint32(32 - turn))
        state = [x + y for x, y in zip(state, (a, b, c, d))]
    return state[0].byteswap()


def _numbers(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Decimal digits of whole numbers from 0, by their count: (places in ``values``, uint8[n, digits])."""
    out = []
    width = np.ones(len(values), np.int64)
    for k in range(1, 19):
        width += values >= 10**k
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        powers = 10 ** np.arange(w - 1, -1, -1)
        out.append((at, (values[at, None] // powers % 10 + 48).astype(np.uint8)))
    return out


def grid_uniform(seed: str, name: str, rows: Sequence[int] | np.ndarray, columns: int) -> np.ndarray:
    """``uniform(seed, "name:i:j")`` of each i of ``rows`` and j < ``columns``: uint32 arithmetic over
    all keys at once, the same values as the column expression's."""
    rows = np.asarray(rows, np.int64)
    head = f"{seed}:{name}:".encode("utf-8", "surrogatepass")
    out = np.empty((len(rows), columns))
    for at_i, digits_i in _numbers(rows):
        for at_j, digits_j in _numbers(np.arange(columns, dtype=np.int64)):
            size = len(head) + digits_i.shape[1] + 1 + digits_j.shape[1]
            n = len(at_i) * len(at_j)
            length = -(-(size + 9) // 64) * 64
            text = np.zeros((len(at_i), len(at_j), length), np.uint8)
            at = len(head)
            text[:, :, :at] = np.frombuffer(head, np.uint8)
            text[:, :, at : at + digits_i.shape[1]] = digits_i[:, None]
            at += digits_i.shape[1]
            text[:, :, at] = 58
            text[:, :, at + 1 : size] = digits_j[None]
            text[:, :, size] = 0x80
            text = text.reshape(n, length)
            text[:, -8:] = np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
            found = _heads(text)
            out[np.ix_(at_i, at_j)] = ((found + 0.5) / 4294967296.0).reshape(len(at_i), len(at_j))
    return out


def grid_normal(seed: str, name: str, rows: Sequence[int] | np.ndarray, columns: int) -> np.ndarray:
    radius = np.sqrt(-2.0 * np.log(grid_uniform(seed + "a", name, rows, columns)))
    return radius * np.cos(2 * math.pi * grid_uniform(seed + "b", name, rows, columns))


def grid_cauchy(seed: str, name: str, rows: Sequence[int] | np.ndarray, columns: int) -> np.ndarray:
    return np.tan(math.pi * (grid_uniform(seed, name, rows, columns) - 0.5))


def grid_laplace(seed: str, name: str, rows: Sequence[int] | np.ndarray, columns: int) -> np.ndarray:
    u = grid_uniform(seed, name, rows, columns) - 0.5
    return -np.sign(u) * np.log(1.0 - 2 * np.abs(u))
