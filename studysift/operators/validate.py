"""Checks on a labelled set: required fields, repeated titles, titles shared between sets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studysift.functions import text as tx

SET = ("split", "category")


def missing_fields(names: Sequence[str] = ("abstract", "year", "title")) -> Column:
    """Array of required fields that are absent or empty; a year that is no whole number counts as missing."""

    def missing(name: str) -> Column:
        absent = F.col(name).isNull() | (F.length(F.col(name).cast("string")) == 0)
        if name == "year":
            absent = absent | F.col(name).cast("string").try_cast("int").isNull()
        return F.when(absent, name)

    return F.filter(F.array(*[missing(n) for n in names]), lambda r: r.isNotNull())


def check_required(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) of entries with title, abstract and year; rejects carry a ``reasons`` array."""
    reasons = missing_fields()
    if "unread" in entries.columns:  # a field that does not close may be one of those, or swallow them
        reasons = F.concat(reasons, F.when(F.col("unread").isNotNull(), F.array(F.lit("unread"))).otherwise(F.array().cast("array<string>")))
    checked = entries.withColumn("reasons", reasons)
    ok = F.size("reasons") == 0
    return checked.where(ok).drop("reasons"), checked.where(~ok)


def to_studies(valid: DataFrame) -> DataFrame:
    """Valid entries as studies: content, integer year and label."""
    return valid.withColumns(
        {
            "content": tx.content(F.col("title"), F.col("abstract")),
            "year": F.col("year").cast("string").try_cast("int"),
            "label": F.when(F.col("category") == "selected", 1).otherwise(0),
        }
    ).drop("abstract")


def dataset(studies: DataFrame, ids: str = "uuid") -> DataFrame:
    """The dataset projection ``uuid, titles, texts, categories, years``."""
    return studies.select(
        F.col(ids).alias("uuid"),
        F.col("title").alias("titles"),
        F.col("content").alias("texts"),
        F.col("label").alias("categories"),
        F.col("year").alias("years"),
    )


def _firsts(studies: DataFrame, within: Sequence[str]) -> DataFrame:
    # a hash aggregate combines a frequent title on the map side; a window would bring all its copies to one task
    return (
        studies.groupBy(*within, "title")
        .agg(F.min("entry_index").alias("entry_index"))
        .select(*within, "entry_index")
    )


def keep_first(studies: DataFrame, within: Sequence[str] = SET) -> DataFrame:
    """The first study of each title inside a set; ``entry_index`` is unique there and gives the order."""
    return studies.join(_firsts(studies, within), [*within, "entry_index"], "left_semi")


def surplus_titles(studies: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Bag difference: every copy of a title beyond the first."""
    return studies.join(_firsts(studies, within), [*within, "entry_index"], "left_anti").select(*within, "title")


def duplicate_titles(studies: DataFrame, within: Sequence[str] = SET) -> DataFrame:
    """Titles seen more than once in a set, with the number of times."""
    return (
        studies.groupBy(*within, "title").agg(F.count(F.lit(1)).alias("times_seen")).where(F.col("times_seen") > 1)
    )


def set_sizes(studies: DataFrame, within: Sequence[str] = SET) -> DataFrame:
    return studies.groupBy(*within).agg(F.count(F.lit(1)).alias("entries"))


def title_membership(studies: DataFrame) -> DataFrame:
    """One row per title with a 0/1 flag for each of the four sets it occurs in."""

    def seen(split: str, category: str) -> Column:
        hit = (F.col("split") == split) & (F.col("category") == category)
        return F.max(F.when(hit, 1).otherwise(0)).alias(f"{split}_{category}")

    pairs = [(s, c) for s in ("test", "train") for c in ("removed", "selected")]
    return studies.groupBy("title").agg(*[seen(s, c) for s, c in pairs])


# Fixed names of the three comparisons and the sets each of them merges.
COMPARISONS = {
    "Testing Set": ("test_removed", "test_selected"),
    "Training Set": ("train_removed", "train_selected"),
    "Training and Testing Sets": ("test_removed", "test_selected", "train_removed", "train_selected"),
}


def set_overlap(studies: DataFrame) -> DataFrame:
    """Per comparison: titles, distinct titles and their difference (titles are unique inside a set)."""
    flags = title_membership(studies)
    sums = []
    for i, sets in enumerate(COMPARISONS.values()):
        total = sum((F.col(s) for s in sets[1:]), F.col(sets[0]))
        sums += [F.sum(total).alias(f"n{i}"), F.count_if(total > 0).alias(f"d{i}")]
    stacked = ", ".join(f"'{name}', n{i}, d{i}" for i, name in enumerate(COMPARISONS))
    return (
        flags.agg(*sums)
        .selectExpr(f"stack({len(COMPARISONS)}, {stacked}) AS (comparison, titles, distinct_titles)")
        .withColumn("overlap", F.col("titles") - F.col("distinct_titles"))
    )


def shared_titles(studies: DataFrame) -> DataFrame:
    """Titles found both as selected and removed in a split, or in both splits."""
    te = (F.col("test_removed") + F.col("test_selected")) > 0
    tr = (F.col("train_removed") + F.col("train_selected")) > 0
    hits = F.array(
        F.when((F.col("test_removed") == 1) & (F.col("test_selected") == 1), "Testing Set"),
        F.when((F.col("train_removed") == 1) & (F.col("train_selected") == 1), "Training Set"),
        F.when(te & tr, "Training and Testing Sets"),
    )
    return (
        title_membership(studies)
        .select("title", F.explode(hits).alias("comparison"))
        .where(F.col("comparison").isNotNull())
    )


def year_profile(studies: DataFrame) -> DataFrame:
    """Studies per split and year, with totals per split and over all (null means all)."""
    return studies.rollup("split", "year").agg(F.count(F.lit(1)).alias("studies"))


def year_counts(studies: DataFrame) -> DataFrame:
    """Number of distinct years in each split."""
    return studies.groupBy("split").agg(F.countDistinct("year").alias("years"))


def year_profile_pivot(studies: DataFrame) -> DataFrame:
    """Studies per year with one column per split."""
    return studies.groupBy("year").pivot("split", ["train", "test"]).agg(F.count(F.lit(1))).fillna(0)


def year_profile_side_by_side(studies: DataFrame) -> DataFrame:
    """The i-th year of the training set next to the i-th year of the testing set."""
    ranked = (
        studies.groupBy("split", "year")
        .agg(F.count(F.lit(1)).alias("studies"))
        .withColumn("line", F.row_number().over(Window.partitionBy("split").orderBy("year")))
    )

    def side(split: str, column: str) -> Column:
        return F.max(F.when(F.col("split") == split, F.col(column)))

    return ranked.groupBy("line").agg(
        side("train", "year").alias("train_year"),
        side("train", "studies").alias("train_studies"),
        side("test", "year").alias("test_year"),
        side("test", "studies").alias("test_studies"),
    )


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Drop index columns that a spreadsheet export left behind."""
    return df.drop(*[c for c in df.columns if c.startswith("Unnamed")])


@dataclass(frozen=True)
class Validation:
    """What a validation run found. ``studies`` keeps every valid first entry, overlap or not."""

    studies: DataFrame
    rejects: DataFrame
    duplicates: DataFrame
    overlap: DataFrame

    def is_valid(self) -> bool:
        return self.rejects.isEmpty() and self.overlap.where("overlap > 0").isEmpty()

    def require_valid(self) -> Validation:
        if not self.is_valid():
            raise ValueError("entries with missing fields or titles shared between sets; see rejects and overlap")
        return self


def validate(entries: DataFrame, strict: bool = False) -> Validation:
    """Validate tagged entries (``split``, ``category``, ``entry_index``, ``title``, ``abstract``, ``year``)."""
    valid, rejects = check_required(entries)
    tagged = to_studies(valid)
    unique = keep_first(tagged)
    result = Validation(unique, rejects, duplicate_titles(tagged), set_overlap(tagged))
    return result.require_valid() if strict else result
