"""Arithmetic of weights, metrics and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def significant(value: Column, digits: int = 9) -> Column:
    """A double cut to so many significant digits, so that ties do not hang on the order of a sum."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))))
    plain = (value == 0) | (F.abs(value) == float("inf"))
    return F.when(plain, value).when(~F.isnan(value), F.round(value / power, digits - 1) * power)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return safe_ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return safe_ratio(tp, tp + fn)


def f1(p: Column, r: Column) -> Column:
    return safe_ratio(2.0 * p * r, p + r)


def accuracy(tn: Column, tp: Column, fn: Column, fp: Column) -> Column:
    return safe_ratio(tn + tp, tn + tp + fn + fp)


def at_least(proba: Column, threshold: float | Column) -> Column:
    """1 where the probability reaches the threshold."""
    return (proba >= threshold).cast("int")


def unless_below(proba: Column, threshold: float | Column) -> Column:
    """0 where the probability lies strictly below the threshold, else 1."""
    return F.when(proba < threshold, 0).otherwise(1)


def outcome(truth: Column, predicted: Column) -> Column:
    """Which of TN, TP, FN, FP a row is; null for anything else."""
    return (
        F.when((truth == 0) & (predicted == 0), "TN")
        .when((truth == 1) & (predicted == 1), "TP")
        .when((truth == 1) & (predicted == 0), "FN")
        .when((truth == 0) & (predicted == 1), "FP")
    )


def proba_bin(proba: Column) -> Column:
    """0 up to 0.5, 1 up to 0.6, else 2; a missing probability compares false and so gives 2."""
    missing = proba.isNull() | F.isnan(proba)
    return F.when(missing, 2).when(proba <= 0.5, 0).when(proba <= 0.6, 1).otherwise(2)


def smooth_idf(n_docs: Column, df: Column) -> Column:
    return F.log((1.0 + n_docs) / (1.0 + df)) + 1.0


def balanced_weight(n: Column, n_class: Column, classes: int = 2) -> Column:
    return n / (float(classes) * n_class)


def duration_label(start: Column, end: Column) -> Column:
    """``HHh:MMm:SSs`` between two timestamps; whole days are dropped, also for a negative interval.

    Works on the interval itself, so timestamps without a time zone are not shifted by the session's zone.
    """
    gap = end - start
    hour, minute, second = (F.extract(F.lit(part), gap) for part in ("HOUR", "MINUTE", "SECOND"))
    seconds = F.pmod(F.floor((hour * 60 + minute) * 60 + second).cast("long"), F.lit(86400).cast("long"))
    return F.format_string(
        "%02dh:%02dm:%02ds",
        F.floor(seconds / 3600).cast("long"),
        F.floor(seconds % 3600 / 60).cast("long"),
        seconds % 60,
    )
