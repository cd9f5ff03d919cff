"""Run settings of a screening job, as one plain value."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

MAX_FEATURES = 5000
SCORINGS = (
    "f1", "accuracy", "precision", "recall", "f1_macro", "precision_macro", "recall_macro", "roc_auc", "average_precision",
)


@dataclass(frozen=True)
class ScreeningConfig:
    """Settings of :func:`studysift.plans.screening.run_screening`.

    ``validation`` is one of ``years``, ``series``, ``grid`` and ``none``; ``score`` names a scorer of
    :data:`studysift.operators.selection.SCORERS`; ``cv`` is the number of folds of a grid search, ``n_splits`` that of
    the other validations; ``fit_partitions`` is the layout of every fit; ``classifiers`` names entries of the classifier registry.
    """

    k: int = 1200
    score: str = "anova"
    select_features: bool = True
    ngram_range: tuple[int, int] = (1, 3)
    min_df: int = 1
    validation: str = "grid"
    scoring: str = "f1"
    n_splits: int = 5
    cv: int = 5
    fit_partitions: int = 8
    seed: int = 42
    year_to_split: int = 2013
    classifiers: tuple[str, ...] = ("svm", "rforest")
    thresholds: dict[str, tuple[float, ...]] = field(
        default_factory=lambda: {"RFOREST": (0.5, 0.6, 0.65, 0.7), "SVM": (0.5, 0.75, 0.8, 0.85)}
    )

    def __post_init__(self) -> None:
        if not 0 < self.k <= MAX_FEATURES:
            raise ValueError(f"k must lie in 1..{MAX_FEATURES}, got {self.k}")
        if self.validation not in ("years", "series", "grid", "none"):
            raise ValueError(f"unknown validation mode {self.validation!r}")
        if self.scoring not in SCORINGS:
            raise ValueError(f"unknown scoring {self.scoring!r}")

    def as_rows(self) -> list[tuple[str, str]]:
        """The settings as (information, value) rows for the run report."""
        return [(name, str(value)) for name, value in asdict(self).items()]
