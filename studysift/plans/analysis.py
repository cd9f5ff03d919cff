"""Analysis of an earlier run: threshold sweeps and agreement with human reviewers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from studysift.config import ScreeningConfig
from studysift.operators import agreement as ag
from studysift.operators import metrics as mt

# Fixed short names under which the models appear in the agreement tables.
SHORT_NAMES = {"RF": "RFOREST_proba", "SVM": "SVM_proba"}


def sweep(probabilities: DataFrame, config: ScreeningConfig | None = None) -> DataFrame:
    """Confusion counts and metrics of each model of a run at its studied thresholds."""
    thresholds = (config or ScreeningConfig()).thresholds
    present = {name: ts for name, ts in thresholds.items() if f"{name}_proba" in probabilities.columns}
    return mt.threshold_sweep(probabilities, present, {n: f"{n}_proba" for n in present}, "was_selected")


def reviewer_agreement(probabilities: DataFrame, reviewers: DataFrame) -> DataFrame:
    """Distances of reviewers, models and their mixtures from the final verdict."""
    models = {short: column for short, column in SHORT_NAMES.items() if column in probabilities.columns}
    joined = ag.reviewer_join(probabilities, reviewers)
    return ag.distances(ag.binned(joined, models), tuple(models))
