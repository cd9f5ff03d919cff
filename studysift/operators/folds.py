"""Orders, splits and folds. A fold is a column, so an expanding window costs no extra rows:
fold i tests the rows marked i and trains on those whose mark is smaller (0 is never tested)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studysift.operators.ranking import number_rows

YEAR_ORDER = ("year", "label")


def split_of(year: Column, last_train_year: int) -> Column:
    """``train``, ``test``, or null for a study without a year."""
    return F.when(year <= last_train_year, "train").when(year > last_train_year, "test")


def temporal_split(studies: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """(train, test): studies up to and after a year; those without a year are in neither."""
    return studies.where(F.col("year") <= year), studies.where(F.col("year") > year)


def with_temporal_split(studies: DataFrame, year: int, out: str = "part") -> DataFrame:
    """The same as a column, in one pass; null without a year."""
    return studies.withColumn(out, split_of(F.col("year"), year))


def year_order(studies: DataFrame, key: str = "entry_index", per: Sequence[str] = ("split",)) -> DataFrame:
    """Position by year; inside a year removed studies precede selected ones, then file order."""
    return number_rows(studies, key, per=per, groups=("year", "category"))


def shuffle_key(seed: int, key: str = "doc_id") -> Column:
    """A digest that orders rows at random for a seed, the same on every partitioning."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def seeded_shuffle(df: DataFrame, seed: int, key: str = "doc_id") -> DataFrame:
    """Number rows in a seeded random order; digests are even, so their prefix makes the range buckets."""
    keyed = df.withColumn("_k", shuffle_key(seed, key))
    return number_rows(keyed, ("_k", key), bucket=F.substring("_k", 1, 3)).drop("_k")


def head_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def quota_split(
    studies: DataFrame, seed: int, selected_to_test: int = 21, removed_to_train: int = 104, key: str = "doc_id"
) -> DataFrame:
    """Split per class after a seeded shuffle: the first selected go to test, the first removed to train.

    Only the rows within the quotas are ranked and broadcast, and the quotas are constants.
    """
    top = Window.partitionBy("category").orderBy("_k", key)
    picked = (
        studies.select(key, "category", shuffle_key(seed, key).alias("_k"))
        .withColumn("_r", F.row_number().over(top))
        .where(F.col("_r") <= max(selected_to_test, removed_to_train))
        .where(F.col("_r") <= F.when(F.col("category") == "selected", selected_to_test).otherwise(removed_to_train))
        .select(key, F.lit(True).alias("_picked"))
    )
    in_test = (F.col("category") == "selected") == F.coalesce("_picked", F.lit(False))
    return (
        studies.drop("split")
        .join(F.broadcast(picked), key, "left")
        .withColumn("split", F.when(in_test, "test").otherwise("train"))
        .drop("_picked")
    )


def year_cuts(train: DataFrame, n_splits: int, min_tail: int = 5) -> DataFrame:
    """``(year, fold)``, one row per year; fold 1 tests the newest block and null marks years never tested.

    Walking back from the newest year each fold takes one year. While the rows from that year to the newest one are
    fewer than ``min_tail`` it takes the year before as well; that holds for the newest m years, so the first
    ``ceil(m / 2)`` folds span two years each. Too few years raise an error when the plan runs.
    """
    newest_first = Window.orderBy(F.col("year").desc())
    all_years = Window.partitionBy()
    ranked = (
        train.groupBy("year")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("year", F.sum("_n").over(newest_first).alias("_tail"), F.row_number().over(newest_first).alias("_r"))
        .withColumns(
            {
                "_doubled": F.ceil(F.sum((F.col("_tail") < min_tail).cast("int")).over(all_years) / 2),
                "_years": F.count(F.lit(1)).over(all_years),
            }
        )
    )
    doubled = F.col("_doubled")
    fold = F.when(F.col("_r") <= 2 * doubled, F.ceil(F.col("_r") / 2)).otherwise(F.col("_r") - doubled)
    enough = F.when(
        F.col("_years") < n_splits + F.least(doubled, F.lit(n_splits)) + 1,
        F.raise_error(F.lit("year folds need more distinct years")),
    ).otherwise(fold)
    return ranked.select("year", F.when(enough <= n_splits, enough).cast("int").alias("fold"))


def year_folds(train: DataFrame, n_splits: int, min_tail: int = 5) -> DataFrame:
    """Add ``fold`` by year block; fold i trains on every year before its block.

    The cuts reach the rows as one small array in a scalar subquery, so a crowded year never meets in one task.
    """
    cuts = year_cuts(train, n_splits, min_tail).where(F.col("fold").isNotNull())
    entries = F.collect_list(F.struct("fold", "year"))
    cut_years = cuts.groupBy("fold").agg(F.min("year").alias("year")).agg(F.array_sort(entries).alias("c")).scalar()
    marked = train.withColumn("_c", cut_years)
    # cut years fall from fold to fold: the first one not after the row's year is its fold
    hit = F.filter(F.col("_c"), lambda c: c["year"] <= F.col("year"))
    return marked.withColumn("fold", F.get(hit, 0)["fold"]).drop("_c")


def time_series_folds(train: DataFrame, n_splits: int, key: str = "entry_index") -> DataFrame:
    """Add ``fold``: 0 for the leading rows, then ``n_splits`` equal blocks of ``n // (n_splits + 1)`` rows."""
    size = train.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = number_rows(train, key, groups=YEAR_ORDER).withColumn("_n", size)
    block = F.floor(F.col("_n") / (n_splits + 1))
    lead = F.col("_n") - n_splits * block
    fold = F.when(F.col("position") <= lead, 0).otherwise(F.ceil((F.col("position") - lead) / block))
    return placed.withColumn("fold", fold.cast("int")).drop("_n", "position")


def stratified_folds(train: DataFrame, n_splits: int, key: str = "entry_index") -> DataFrame:
    """Add ``fold`` 1..n_splits with even class shares, without shuffling.

    Sizes follow the usual allocation: line all rows up by class, the class met first leading, and deal the line out
    to the folds in turn; each class then fills its folds in row order.
    """
    is1, is0 = F.col("label") == 1, F.col("label") == 0
    sizes = train.agg(
        F.struct(
            F.count_if(is1).alias("n1"),
            F.count_if(is0).alias("n0"),
            F.min(F.when(is1, F.col("year"))).alias("y1"),
            F.min(F.when(is0, F.col("year"))).alias("y0"),
        ).alias("s")
    ).scalar()
    placed = number_rows(train, key, per=("label",), groups=("year",)).withColumn("_s", sizes)
    # within a year removed rows come first, so class 1 leads only with an earlier first year
    lead1 = F.coalesce(F.col("_s.y1") < F.col("_s.y0"), F.col("_s.y0").isNull())
    start = (
        F.when((F.col("label") == 1) & ~lead1, F.col("_s.n0"))
        .when((F.col("label") == 0) & lead1, F.col("_s.n1"))
        .otherwise(0)
    )
    count = F.when(F.col("label") == 1, F.col("_s.n1")).otherwise(F.col("_s.n0"))
    ends = placed.withColumns({"_a": start, "_z": start + count})

    def dealt(m: Column, i: int) -> Column:
        return F.floor(m / n_splits) * (i + 1) + F.least(m % n_splits, F.lit(i + 1))

    passed = [
        F.when(F.col("position") > dealt(F.col("_z"), i) - dealt(F.col("_a"), i), 1).otherwise(0)
        for i in range(n_splits - 1)
    ]
    fold = sum(passed, F.lit(1))
    return ends.withColumn("fold", fold.cast("int")).drop("_s", "_a", "_z", "position")


def fold_parts(df: DataFrame, fold: int, expanding: bool) -> tuple[DataFrame, DataFrame]:
    """(train, test) rows of one fold: all other rows, or only the earlier blocks of a forward-numbered fold."""
    train = F.col("fold") < fold if expanding else F.col("fold") != fold
    return df.where(train), df.where(F.col("fold") == fold)


def year_fold_parts(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) of one year fold: these count backwards, so older rows carry a larger mark or none."""
    return df.where(F.coalesce("fold", F.lit(2**31 - 1)) > fold), df.where(F.col("fold") == fold)
