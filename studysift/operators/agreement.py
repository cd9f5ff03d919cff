"""Agreement between human reviewers and models: outer join, binning, Euclidean distances."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studysift.functions import measures as ms

KEYS = ("uuid", "was_selected")
REVIEWERS = ("R1", "R2", "R3")


def reviewer_join(model: DataFrame, reviewers: DataFrame) -> DataFrame:
    """Full outer join on study and verdict; the model's title is kept, the reviewers' fills gaps.

    A null uuid names no study, so such rows pass through unmatched instead of meeting in one task.
    """
    left = model.withColumnRenamed("title", "_tl")
    right = reviewers.withColumnRenamed("title", "_tr")
    known = F.col("uuid").isNotNull()
    joined = left.where(known).join(right.where(known), list(KEYS), "full_outer")
    loose = left.where(~known).unionByName(right.where(~known), allowMissingColumns=True)
    both = joined.unionByName(loose, allowMissingColumns=True)
    return both.withColumn("title", F.coalesce("_tl", "_tr")).drop("_tl", "_tr")


def binned(joined: DataFrame, models: dict[str, str]) -> DataFrame:
    """Model probabilities as 0, 1, 2 under their short names, and the verdict FR as 0 or 2."""
    bins = {short: ms.proba_bin(F.col(column)) for short, column in models.items()}
    return joined.withColumns(bins).withColumn("FR", F.col("was_selected") * 2).drop(*models.values())


def _opinions(model: str) -> list[tuple[str, ...]]:
    """Four single opinions, six pairs and four groups of three, the model standing in for one reviewer in turn."""
    singles = [(name,) for name in (*REVIEWERS, model)]
    pairs = list(combinations((*REVIEWERS, model), 2))
    groups = [REVIEWERS, *[tuple(model if r == out else r for r in REVIEWERS) for out in REVIEWERS]]
    return singles + pairs + groups


def _measure(names: tuple[str, ...]) -> str:
    if len(names) == 1:
        return f"distance_{names[0]}_FR"
    return "_".join(("distance", "pair" if len(names) == 2 else "group", *names))


def distances(df: DataFrame, models: tuple[str, ...], verdict: str = "FR") -> DataFrame:
    """``(model, measure, distance)``: sqrt of the summed squared gap between a mean opinion and the verdict.

    For each model: every single opinion, the mean of every pair and of every three, over the reviewers and the
    model. All of them come from one pass; a row in which an opinion is missing drops out of that sum.
    """

    def gap(names: tuple[str, ...]) -> Column:
        mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / float(len(names))
        return F.sqrt(F.coalesce(F.sum(F.pow(mean - F.col(verdict), F.lit(2.0))), F.lit(0.0)))

    labels = [(model, names) for model in models for names in _opinions(model)]
    sums = {names: f"_{i}" for i, names in enumerate(dict.fromkeys(names for _, names in labels))}
    rows = [
        F.struct(
            F.lit(model).alias("model"), F.lit(_measure(names)).alias("measure"), F.col(sums[names]).alias("distance")
        )
        for model, names in labels
    ]
    totals = df.agg(*[gap(names).alias(alias) for names, alias in sums.items()])
    return totals.select(F.inline(F.array(*rows)))
