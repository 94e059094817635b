"""Sums of numpy arrays over all rows, added up in Spark a block at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from kernloom.functions.lineage import shuffles_removed

BLOCK = 1 << 17


def summed(rows: DataFrame, of: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """By key, the sum of the arrays that ``of`` gives for each batch, flattened.

    A task holds one array per key. Tasks' arrays meet in blocks of 131,072 numbers, so only the
    final sums come to the driver. No rows give an empty dict.
    """

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in parts:
            if len(pdf):
                for key, x in of(pdf).items():
                    if key in total:
                        total[key] += x
                    else:
                        total[key] = np.array(x, dtype=float)
        for key, x in total.items():
            flat = np.ascontiguousarray(x, dtype=float).ravel()
            for at in range(0, len(flat), BLOCK):
                yield pd.DataFrame({"key": [key], "at": [at], "x": [flat[at : at + BLOCK].tobytes()]})

    def combine(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for pdf in parts:
            for key, at, x in zip(pdf["key"], pdf["at"], pdf["x"]):
                sums[key, at] = sums.get((key, at), 0) + np.frombuffer(x)
        if sums:
            yield pd.DataFrame({"key": [k for k, _ in sums], "at": [a for _, a in sums], "x": [v.tobytes() for v in sums.values()]})

    schema = "key string, at long, x binary"
    found: dict[str, list[tuple[int, bytes]]] = {}
    with shuffles_removed(rows.sparkSession):
        sums = rows.mapInPandas(partial, schema).repartition("key", "at").mapInPandas(combine, schema).collect()
    for r in sums:
        found.setdefault(r["key"], []).append((r["at"], r["x"]))
    return {key: np.concatenate([np.frombuffer(x) for _, x in sorted(blocks)]) for key, blocks in found.items()}
