"""Kernel features against a bounded set of landmark studies (the Nystroem method of Williams and Seeger, 2001).

A kernel machine over all pairs of studies cannot be spread out. Here every study is described by its kernel values
with m landmarks, whitened by the landmarks' own kernel matrix, and a linear machine is trained on that: an
approximation by design, exact in the limit where every study is a landmark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANDMARKS = 128
KERNELS = ("rbf", "sigmoid")


def kernel_values(x: np.ndarray, marks: np.ndarray, kernel: str, gamma: float) -> np.ndarray:
    dots = x @ marks.T
    if kernel == "sigmoid":
        return np.tanh(gamma * dots)
    gaps = (x * x).sum(axis=1)[:, None] + (marks * marks).sum(axis=1)[None, :] - 2.0 * dots
    return np.exp(-gamma * np.maximum(gaps, 0.0))


def landmark_matrix(train: DataFrame, m: int = LANDMARKS, key: str = "doc_id") -> np.ndarray:
    """Vectors of m training studies in digest order: m rows of bounded width, whatever the table's size."""
    picked = (
        train.select(key, "features").orderBy(F.md5(F.col(key).cast("string")), key).limit(m).collect()
    )
    return np.array([row["features"].toArray() for row in picked])


def scaled_gamma(train: DataFrame) -> float:
    """One over the width times the variance of all feature values."""
    values = vector_to_array("features")
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    squares = F.aggregate(values, F.lit(0.0), lambda s, v: s + v * v)
    sums = train.agg(F.sum(total).alias("s"), F.sum(squares).alias("q"), F.sum(F.size(values)).alias("n")).first()
    n, width = sums["n"] or 1, len((train.select("features").first() or [[0]])[0])
    variance = (sums["q"] or 0.0) / n - ((sums["s"] or 0.0) / n) ** 2
    return 1.0 / (width * variance) if variance > 0 else 1.0


def whitening(marks: np.ndarray, kernel: str, gamma: float) -> np.ndarray:
    """Inverse square root of the landmarks' kernel matrix; directions without positive weight are dropped."""
    own = kernel_values(marks, marks, kernel, gamma)
    weights, directions = np.linalg.eigh((own + own.T) / 2.0)
    keep = weights > 1e-9 * max(weights.max(), 1e-300)
    return directions[:, keep] / np.sqrt(weights[keep])


def kernel_features(
    df: DataFrame, marks: np.ndarray, white: np.ndarray, kernel: str, gamma: float, out: str = "kernel_features"
) -> DataFrame:
    """Add the whitened kernel values of each row as a vector, computed in Arrow batches."""
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}")
    shared = df.sparkSession.sparkContext.broadcast((marks, white))

    @F.pandas_udf("array<double>")
    def mapped(vectors: pd.Series) -> pd.Series:
        landmarks, whitener = shared.value
        if not len(vectors):
            return pd.Series([], dtype=object)
        parts = []
        for at in range(0, len(vectors), 1000):
            x = np.array(vectors.iloc[at : at + 1000].tolist(), dtype=float)
            parts.append(kernel_values(x, landmarks, kernel, gamma) @ whitener)
        return pd.Series(list(np.concatenate(parts)))

    return df.withColumn(out, array_to_vector(mapped(vector_to_array("features"))))
