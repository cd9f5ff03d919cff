"""A fitted decision tree as a node table, which can be read to any smaller depth.

A greedy tree grown to a depth is the deeper tree cut off there: a node takes the same split whatever the limit below
it is. So candidates of a search that differ in depth only need one fit. As in the library two leaves that come to the
same class are one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studysift.operators.storage import shared_folder


@dataclass(frozen=True)
class Nodes:
    """Children (-1 for none), split and class weights of each node; node 0 is the root."""

    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    weights: np.ndarray


def node_table(model: Any) -> Nodes:
    """The nodes of a fitted tree, read from the model's own saved form."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = f"{shared_folder(spark).rstrip('/')}/studysift/tree-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").orderBy("id").collect()
    cuts = [r["split"]["leftCategoriesOrThreshold"] for r in rows]
    return Nodes(
        np.array([r["leftChild"] for r in rows]),
        np.array([r["rightChild"] for r in rows]),
        np.array([r["split"]["featureIndex"] for r in rows]),
        np.array([c[0] if c else 0.0 for c in cuts]),
        np.array([r["impurityStats"] for r in rows], dtype=float),
    )


def to_depth(nodes: Nodes, depth: int) -> Nodes:
    """The tree cut off below ``depth``."""
    left, right = nodes.left.copy(), nodes.right.copy()
    level = np.zeros(len(left), np.int64)
    best = nodes.weights.argmax(axis=1)
    for i in range(len(left)):  # children have larger numbers than their parent
        if left[i] >= 0:
            level[[left[i], right[i]]] = level[i] + 1
    cut = level >= depth
    left[cut] = right[cut] = -1
    for i in range(len(left) - 1, -1, -1):
        a, b = left[i], right[i]
        if a >= 0 and left[a] < 0 and left[b] < 0 and best[a] == best[b]:
            left[i] = right[i] = -1
    return Nodes(left, right, nodes.feature, nodes.threshold, nodes.weights)


def with_probability(df: DataFrame, nodes: Nodes) -> DataFrame:
    """Add ``pred`` and ``proba`` of class 1, walking all rows of a batch down together."""

    @F.pandas_udf("pred int, proba double")
    def walked(values: pd.Series) -> pd.DataFrame:
        if not len(values):
            return pd.DataFrame({"pred": pd.Series([], dtype="int32"), "proba": pd.Series([], dtype=float)})
        x = np.array(values.tolist(), dtype=float)
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (nodes.left[at] >= 0).any():
            inner = nodes.left[at] >= 0
            goes_left = x[rows, np.maximum(nodes.feature[at], 0)] <= nodes.threshold[at]
            at = np.where(inner, np.where(goes_left, nodes.left[at], nodes.right[at]), at)
        weights = nodes.weights[at]
        share = weights[:, 1] / weights.sum(axis=1)
        return pd.DataFrame({"pred": weights.argmax(axis=1).astype("int32"), "proba": share})

    kept = df.columns
    return df.withColumn("_w", walked(vector_to_array("features"))).select(*kept, "_w.pred", "_w.proba")
