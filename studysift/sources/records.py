"""The ``studies`` table built from a ``documents`` and a ``labels`` parquet table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studysift.functions import text as tx
from studysift.operators.folds import split_of

YEAR_TO_SPLIT = 2013


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Give every core work when a table comes in fewer splits than there are cores.

    Only then, that is on small inputs, is the table shuffled; many splits are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.select(key).rdd.getNumPartitions() >= cores else df.repartition(2 * cores, key)


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Document texts for work that costs more than reading them."""
    return spread(read_table(spark, folder, "documents").select("doc_id", "text", "source"))


def source_year() -> Column:
    """The year a source name stands for: src0 is 2000, src19 is 2019."""
    return (2000 + F.substr("source", F.lit(4)).try_cast("int")).cast("int")


def documents(spark: SparkSession, folder: str, text_work: bool = False) -> DataFrame:
    """Every document as a title, its abstract and a year, labelled or not."""
    table = texts(spark, folder) if text_work else read_table(spark, folder, "documents")
    return table.select(
        "doc_id",
        tx.first_line(F.col("text")).alias("title"),
        tx.after_first_line(F.col("text")).alias("abstract"),
        F.col("text").alias("content"),
        source_year().alias("year"),
    )


def studies(
    spark: SparkSession, folder: str, text_work: bool = False, year_to_split: int = YEAR_TO_SPLIT
) -> DataFrame:
    """Labelled documents as studies with category, label and the temporal split."""
    labels = read_table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return (
        documents(spark, folder, text_work)
        .drop("abstract")
        .join(labels, "doc_id")
        .select(
            "doc_id",
            F.col("doc_id").alias("entry_index"),
            "title",
            "content",
            "year",
            F.when(F.col("label") == 1, "selected").otherwise("removed").alias("category"),
            "label",
            split_of(F.col("year"), year_to_split).alias("split"),
        )
    )
