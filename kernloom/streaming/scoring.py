"""Scoring a stream of vectors with a fitted model: projection and product are row-wise, so the
batch operators apply to a stream as they are."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def score_stream(vectors: DataFrame, weights: dict[str, np.ndarray], coef: dict[str, np.ndarray], intercept: float) -> DataFrame:
    """(cell_id, prob) of rows with cell_id and ``x`` map<string, array<double>> by group. Works on
    batch and streaming frames alike; there is no state."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            s = np.full(len(pdf), float(intercept))
            for g, w in weights.items():
                if g in coef:
                    a = np.stack([np.asarray(dict(x)[g], float) for x in pdf["x"]]) @ w if len(pdf) else np.zeros((0, w.shape[1]))
                    s += np.hstack([np.cos(a), np.sin(a)]) @ coef[g] * math.sqrt(1.0 / w.shape[1])
            yield pd.DataFrame({"cell_id": pdf["cell_id"], "prob": 1 / (1 + np.exp(-s))})

    return vectors.select("cell_id", "x").mapInPandas(run, f"cell_id {vectors.schema['cell_id'].dataType.simpleString()}, prob double")
