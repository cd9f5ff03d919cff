"""Metrics of predictions and probabilities. Counts come from one aggregate; rows are never multiplied."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studysift.functions import measures as ms
from studysift.operators.ranking import running_sums


def confusion_counts(truth: str, predicted: Column) -> list[Column]:
    """Aggregates TN, TP, FN, FP."""
    y = F.col(truth)
    return [
        F.count_if((y == 0) & (predicted == 0)).alias("true_negatives"),
        F.count_if((y == 1) & (predicted == 1)).alias("true_positives"),
        F.count_if((y == 1) & (predicted == 0)).alias("false_negatives"),
        F.count_if((y == 0) & (predicted == 1)).alias("false_positives"),
    ]


def confusion(df: DataFrame, predictions: dict[str, str], truth: str = "label") -> DataFrame:
    """``(classifier, TN, TP, FN, FP)`` for several prediction columns of one table, in a single pass."""
    counts = [F.struct(*confusion_counts(truth, F.col(c))).alias(f"_{i}") for i, c in enumerate(predictions.values())]
    rows = [F.struct(F.lit(name).alias("classifier"), f"_{i}.*") for i, name in enumerate(predictions)]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def add_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 next to confusion counts; 0 where a denominator is 0."""
    tn, tp, fn, fp = (
        F.col(c) for c in ("true_negatives", "true_positives", "false_negatives", "false_positives")
    )
    return counts.withColumns(
        {"accuracy": ms.accuracy(tn, tp, fn, fp), "precision": ms.precision(tp, fp), "recall": ms.recall(tp, fn)}
    ).withColumn("f1", ms.f1(F.col("precision"), F.col("recall")))


def binary_metrics(df: DataFrame, predictions: dict[str, str], truth: str = "label") -> DataFrame:
    """``(classifier, accuracy, precision, recall, f1)``."""
    return add_metrics(confusion(df, predictions, truth)).select(
        "classifier", "accuracy", "precision", "recall", "f1"
    )


def macro_metrics(df: DataFrame, by: Sequence[str] = (), truth: str = "label", predicted: str = "pred") -> DataFrame:
    """Precision, recall and F1 averaged over both classes, for each value of ``by``.

    A class that neither occurs nor is predicted is left out of the average, as a label set taken from the data does.
    """
    counted = df.groupBy(*by).agg(*confusion_counts(truth, F.col(predicted)))
    tn, tp, fn, fp = (
        F.col(c) for c in ("true_negatives", "true_positives", "false_negatives", "false_positives")
    )
    per_class = [
        (ms.precision(tp, fp), ms.recall(tp, fn), tp + fp + fn > 0),
        (ms.precision(tn, fn), ms.recall(tn, fp), tn + fn + fp > 0),
    ]
    classes = F.filter(
        F.array(*[F.when(ok, F.struct(p.alias("p"), r.alias("r"), ms.f1(p, r).alias("f"))) for p, r, ok in per_class]),
        lambda c: c.isNotNull(),
    )

    def mean(part: str) -> Column:
        total = F.aggregate(F.col("_c"), F.lit(0.0), lambda acc, c: acc + c[part])
        return ms.safe_ratio(total, F.size("_c"))

    return counted.withColumn("_c", classes).select(
        *by, mean("p").alias("precision_macro"), mean("r").alias("recall_macro"), mean("f").alias("f1_macro")
    )


def outcome_rows(df: DataFrame, predicted: str, truth: str = "label", keep: Sequence[str] = ("title",)) -> DataFrame:
    """Rows with the outcome (TN, TP, FN, FP) of one classifier."""
    return df.select(
        *keep, truth, predicted, ms.outcome(F.col(truth), F.col(predicted)).alias("outcome")
    ).where(F.col("outcome").isNotNull())


def shared_outcomes(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Studies to which two classifiers give the same outcome; joined on the study's key."""
    return a.join(b.select(key, "outcome"), [key, "outcome"])


def threshold_sweep(
    df: DataFrame, thresholds: dict[str, Sequence[float]], columns: dict[str, str], truth: str = "label"
) -> DataFrame:
    """Confusion counts and metrics of each classifier at several thresholds, all from one pass over the rows."""
    cuts = [(name, float(t)) for name, ts in thresholds.items() for t in ts]
    counts = [
        F.struct(*confusion_counts(truth, ms.at_least(F.col(columns[name]), t))).alias(f"_{i}")
        for i, (name, t) in enumerate(cuts)
    ]
    rows = [
        F.struct(F.lit(name).alias("classifier"), F.lit(t).alias("threshold"), f"_{i}.*")
        for i, (name, t) in enumerate(cuts)
    ]
    return add_metrics(df.agg(*counts).select(F.inline(F.array(*rows))))


def full_recall_threshold(df: DataFrame, by: Sequence[str], proba: str = "proba", truth: str = "label") -> DataFrame:
    """Lowest probability of any selected study, at most 0.5."""
    lowest = F.min(F.when(F.col(truth) == 1, F.col(proba)))
    return df.groupBy(*by).agg(F.least(F.lit(0.5), lowest).alias("threshold"))


def pr_curve(df: DataFrame, by: Sequence[str], proba: str = "proba", truth: str = "label") -> DataFrame:
    """Precision and recall at each distinct score down to the first with full recall, plus the end point (1, 0).

    Rows are first combined by score, then summed from the highest score down in range buckets.
    """
    points = df.groupBy(*by, F.col(proba).alias("threshold")).agg(
        F.count_if(F.col(truth) == 1).alias("_p"), F.count(F.lit(1)).alias("_n")
    )
    summed = running_sums(
        points, "threshold", {"_tp": F.col("_p"), "_all": F.col("_n")}, per=by, descending=True
    )
    totals = df.groupBy(*by).agg(F.count_if(F.col(truth) == 1).alias("_t"))
    curve = (
        summed.join(totals, list(by))
        .where(F.col("_tp") - F.col("_p") < F.col("_t"))
        .select(
            *by,
            "threshold",
            ms.safe_ratio(F.col("_tp"), F.col("_all")).alias("precision"),
            ms.safe_ratio(F.col("_tp"), F.col("_t")).alias("recall"),
        )
    )
    ends = totals.select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return curve.unionByName(ends)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight ``n / (2 n_c)`` of each class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumn("_n", total).select(
        label, "n_class", ms.balanced_weight(F.col("_n"), F.col("n_class")).alias("weight")
    )


def with_class_weight(df: DataFrame, balanced: bool, label: str = "label") -> DataFrame:
    """Add a ``weight`` column: balanced class weights, or 1."""
    if not balanced:
        return df.withColumn("weight", F.lit(1.0))
    sizes = df.agg(
        F.struct(F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0")).alias("s")
    ).scalar()
    own = F.when(F.col(label) == 1, F.col("_s.n1")).otherwise(F.col("_s.n0"))
    return (
        df.withColumn("_s", sizes)
        .withColumn("weight", ms.balanced_weight(F.col("_s.n1") + F.col("_s.n0"), own))
        .drop("_s")
    )


def best_candidate(results: DataFrame, by: Sequence[str] = ("classifier",)) -> DataFrame:
    """The candidate with the highest mean score, the first one on ties."""
    best = F.max_by(F.struct("candidate", "mean_score"), F.struct(F.col("mean_score"), -F.col("candidate")))
    return results.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")
