"""Positions and running sums over a global order, without pulling that order into one task.

A window with no partition key sorts everything in one task. Here the order is cut into range buckets first
(quantiles of the key, as many as there are shuffle partitions), the buckets are summed into a small table, and each
bucket is then numbered on its own with the total of the buckets before it added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"
PART = "_part"


def with_range_bucket(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """Add a range bucket of a numeric key; the bounds are fitted in one pass over that column alone."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fitted = QuantileDiscretizer(
        numBuckets=max(2, n), inputCol=key, outputCol=BUCKET, relativeError=1.0 / (4 * max(2, n)), handleInvalid="keep"
    ).fit(df.select(key))
    return fitted.transform(df)


def running_sums(
    df: DataFrame,
    key: str | Sequence[str],
    sums: dict[str, Column],
    per: Sequence[str] = (),
    groups: Sequence[str] = (),
    bucket: Column | None = None,
    descending: bool = False,
) -> DataFrame:
    """Inclusive running sums in the order ``groups, key``, restarted for each value of ``per``.

    ``key`` must be unique within ``per`` and ``groups``. It is numeric unless ``bucket`` gives a coarser column that
    sorts the same way. ``descending`` reverses the key, not the groups.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cut = with_range_bucket(df, keys[0]) if bucket is None else df.withColumn(BUCKET, bucket)
    way = (lambda c: F.col(c).desc()) if descending else F.col
    parts = [*per, *groups, BUCKET]
    # one key that is never null names the part, so rows with a null year or group are kept by the join
    name = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in parts])
    measured = cut.select("*", name.alias(PART), *[v.alias(f"_v_{n}") for n, v in sums.items()])

    before = Window.partitionBy(*per).orderBy(*groups, way(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        measured.groupBy(PART, *parts)
        .agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
        .select(PART, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    )
    inside = Window.partitionBy(PART).orderBy(*[way(k) for k in keys]).rowsBetween(Window.unboundedPreceding, 0)
    return (
        measured.select(*df.columns, PART, *[F.sum(f"_v_{n}").over(inside).alias(f"_r_{n}") for n in sums])
        .join(offsets, PART)
        .select(*df.columns, *[(F.col(f"_r_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])
    )


def number_rows(
    df: DataFrame,
    key: str | Sequence[str],
    per: Sequence[str] = (),
    groups: Sequence[str] = (),
    bucket: Column | None = None,
    out: str = "position",
) -> DataFrame:
    """1-based position of each row in the order ``groups, key``, restarted for each value of ``per``."""
    return running_sums(df, key, {out: F.lit(1).cast("long")}, per=per, groups=groups, bucket=bucket)
