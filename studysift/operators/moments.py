"""Gaussian naive Bayes from class sums that are formed once for all folds.

Counts, sums and sums of squares per fold mark, class and feature are mergeable, so every training set that a
validation needs, all folds but one or all earlier ones, is a sum over marks: one pass over the rows serves all folds
and all smoothing values. The sums are as wide as the feature vectors and no longer than the number of marks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMOOTHING = 1e-9  # of the largest variance, added to each variance
LARGEST_MARGIN = 700.0
NO_MARK = 2**31 - 1


@dataclass(frozen=True)
class ClassSums:
    """Rows ``n[c]``, sums ``s[c, j]`` and sums of squares ``q[c, j]`` of two classes."""

    n: np.ndarray
    s: np.ndarray
    q: np.ndarray

    def coefficients(self, smoothing: float = SMOOTHING) -> tuple[float, list[float], list[float]]:
        """``(base, a, b)``: log odds of class 1 are base + sum(a x + b x x)."""
        if not self.n.all():
            return float(np.copysign(np.inf, self.n[1] - self.n[0])), [0.0] * self.s.shape[1], [0.0] * self.s.shape[1]
        rows = self.n.sum()
        overall = self.q.sum(axis=0) / rows - (self.s.sum(axis=0) / rows) ** 2
        n = self.n[:, None]
        mean = self.s / n
        spread = self.q / n - mean * mean + max(smoothing * overall.max(initial=0.0), 1e-30)
        base = np.log(self.n) - 0.5 * (np.log(2 * np.pi * spread) + mean * mean / spread).sum(axis=1)
        a, b = mean / spread, -0.5 / spread
        return float(base[1] - base[0]), (a[1] - a[0]).tolist(), (b[1] - b[0]).tolist()


@dataclass(frozen=True)
class FoldSums:
    """Class sums of each fold mark."""

    parts: dict[int, ClassSums]
    width: int

    def of(self, chosen: Callable[[int], bool]) -> ClassSums:
        """Sums over the marks that are chosen."""
        got = [p for mark, p in self.parts.items() if chosen(mark)]
        zero = ClassSums(np.zeros(2), np.zeros((2, self.width)), np.zeros((2, self.width)))
        return ClassSums(*(sum((getattr(p, name) for p in got), getattr(zero, name)) for name in ("n", "s", "q")))


def fold_sums(rows: DataFrame, fold: str | None = "fold") -> FoldSums:
    """One pass over ``features``, ``label`` and the fold mark; a row without a mark has ``NO_MARK``."""
    mark = F.lit(0) if fold is None else F.coalesce(fold, F.lit(NO_MARK))
    values = vector_to_array("features")
    marked = rows.select(mark.alias("mark"), "label", values.alias("x"))
    first = rows.select("features").first()
    width = len(first[0]) if first else 0
    # the count of rows rides along as one more position
    cells = F.transform(F.concat(F.col("x"), F.array(F.lit(1.0))), lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    rows = marked.select("mark", "label", F.inline(F.filter(cells, lambda c: c["v"] != 0)))
    v = F.col("v")
    sums = rows.groupBy("mark", "label", "i").agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    parts: dict[int, ClassSums] = {}
    for r in sums.collect():  # marks x 2 x width rows at most
        zero = ClassSums(np.zeros(2), np.zeros((2, width)), np.zeros((2, width)))
        own, c = parts.setdefault(r["mark"], zero), int(r["label"])
        if r["i"] == width:
            own.n[c] = r["s"]
        else:
            own.s[c, r["i"]], own.q[c, r["i"]] = r["s"], r["q"]
    return FoldSums(parts, width)


def coefficient_table(df: DataFrame, models: Iterable[tuple[int, ClassSums, float]]) -> DataFrame:
    """``(model, m)`` with ``m`` the coefficients of models ``(number, sums, smoothing)``: one row per model."""
    rows = [(number, sums.coefficients(smoothing)) for number, sums, smoothing in models]
    return df.sparkSession.createDataFrame(
        rows, "model int, m struct<base:double,a:array<double>,b:array<double>>"
    )


def with_probability(df: DataFrame, model: Column) -> DataFrame:
    """Add ``pred`` and ``proba`` by the coefficients in the struct ``model``."""
    x = vector_to_array("features")
    linear = F.zip_with(x, model["a"], lambda v, a: v * a)
    square = F.zip_with(x, model["b"], lambda v, b: v * v * b)
    margin = model["base"] + F.aggregate(F.zip_with(linear, square, lambda v, w: v + w), F.lit(0.0), lambda s, v: s + v)
    margin = F.greatest(F.least(margin, F.lit(LARGEST_MARGIN)), F.lit(-LARGEST_MARGIN))
    kept = df.columns
    scored = df.withColumn("_margin", margin)
    proba = 1.0 / (1.0 + F.exp(-F.col("_margin")))
    return scored.select(*kept, (F.col("_margin") > 0).cast("int").alias("pred"), proba.alias("proba"))
