"""A join by key that a frequent key cannot crowd into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studysift.operators.storage import stored

ROWS_PER_KEY = 1_000_000
MOST_SPLIT = 200_000
TRACKED = 32_768  # keys that the frequency sketch tells apart in one task, and after merging
SKETCH_ERROR = 3.5 / TRACKED  # share of all rows by which a sketched count may be off


def rows_per_key_limit(total: int, rows_per_key: int = ROWS_PER_KEY) -> int:
    """Rows that one key may bring to a task. At most ``MOST_SPLIT`` keys can have more, whatever the size."""
    return max(rows_per_key, -(-total // MOST_SPLIT))


def join_split(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    sizes: DataFrame,
    spread: str = "doc_id",
    rows_per_key: int | None = None,
    how: str = "inner",
) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key; frequent keys are dealt over several sub-keys.

    ``sizes`` is ``(keys..., n)``, the rows of each key, as a stored table. A key with more rows than the limit is
    split by a hash of ``spread`` into as many parts as it needs, and its table row is copied as often. The split
    factors are broadcast: there are ``MOST_SPLIT`` of them at most. Without any such key this is a plain join. Sizes may
    leave out keys below the limit, as those of :func:`frequent_keys` do.
    """
    keys = list(keys)
    limit = rows_per_key_limit(sizes.agg(F.sum("n")).first()[0] or 0, ROWS_PER_KEY if rows_per_key is None else rows_per_key)
    frequent = sizes.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("_copies"))
    if frequent.isEmpty():
        return rows.join(table, keys, how)
    frequent = F.broadcast(frequent)
    copies = F.coalesce("_copies", F.lit(1))
    left = rows.join(frequent, keys, "left").withColumn("_part", F.pmod(F.xxhash64(spread), copies).cast("int"))
    right = table.join(frequent, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), copies - 1)))
    return left.drop("_copies").join(right.drop("_copies"), [*keys, "_part"], how).drop("_part")


def frequent_keys(rows: DataFrame, key: str, rows_per_key: int | None = None) -> DataFrame:
    """``(key, n)`` of the keys that have more rows than one task should take, by a mergeable frequency sketch.

    Every task sketches its rows and only sketches of fixed size meet, so frequent keys are known before any row is
    shuffled by key. No key above the limit is missed: the limit is never below the sketch's error, and a count that
    may be too low by that much is rounded up by it.
    """
    most = int(1 / SKETCH_ERROR)
    sketch = rows.agg(F.count(key).alias("rows"), F.expr(f"approx_top_k({key}, {most}, {TRACKED})").alias("top"))
    sketch = stored(sketch, "frequent-keys")
    total = sketch.first()["rows"]
    error = int(total * SKETCH_ERROR)
    limit = max(rows_per_key_limit(total, ROWS_PER_KEY if rows_per_key is None else rows_per_key), error)
    found = sketch.select(F.inline("top")).toDF(key, "n").where(F.col(key).isNotNull())
    return stored(found.select(key, (F.col("n") + error).alias("n")).where(F.col("n") > limit), "frequent-keys")
