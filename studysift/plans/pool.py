"""Re-split of one labelled pool: seeded shuffle, quotas per class, year order and year profile."""

from __future__ import annotations

from pyspark.sql import DataFrame

from studysift.operators import folds as fd
from studysift.operators import validate as vd


def resplit(
    pool: DataFrame, seed: int, selected_to_test: int = 21, removed_to_train: int = 104, key: str = "doc_id"
) -> dict[str, DataFrame]:
    """The re-split studies in year order, their set sizes and year profiles."""
    split = fd.quota_split(pool, seed, selected_to_test, removed_to_train, key)
    return {
        "studies": fd.year_order(split, key),
        "sizes": vd.set_sizes(split, ("split",)),
        "years": vd.year_profile_side_by_side(split),
        "year_counts": vd.year_counts(split),
    }
