"""Shared by the operators of this package: empty-for-null text, and rows kept by key.

Every operator reads only the columns it names, so further columns of its input, whatever they are called, do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studysift.operators.storage import stored

BROADCAST_BYTES = 64 << 20

__all__ = ["keep_rows", "read", "same", "small", "stored", "text_of"]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Join condition: all named columns equal, null equal to null."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition




def small(side: DataFrame, width: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """A stored side of a join, marked for broadcast if its rows of ``width`` bytes come to no more than ``most``.

    Beyond that Spark shuffles both sides.
    """
    return F.broadcast(side) if side.count() * width <= most else side


def keep_rows(docs: DataFrame, found: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows of ``docs`` by the verdicts ``(doc_id, name, kept)``, one for each row; ``key`` computes the name.

    Rows that share id and name share a text: one of them stays if any does. Only such rows are compared again; all
    others are told apart by a join with what goes.
    """
    own = "key"
    while own.lower() in {c.lower() for c in docs.columns}:
        own += "_"
    found = found.groupBy("doc_id", F.col(name).alias("name")).agg(
        F.max("kept").alias("stays"), F.count("*").alias("n")
    )
    found = stored(found.filter("NOT stays OR n > 1"), "verdicts")
    keyed = docs.select(*[docs[c] for c in docs.columns], key.alias(own))

    def matches(left: DataFrame, right: DataFrame) -> Column:
        return left["doc_id"].eqNullSafe(right["doc_id"]) & left[own].eqNullSafe(right["name"])

    going = stored(found.filter("NOT stays").select("doc_id", "name"), "going")
    staying = keyed.join(small(going, 100), matches(keyed, going), "left_anti")
    repeated = stored(found.filter("stays").select("doc_id", "name"), "repeated_rows")
    if repeated.isEmpty():
        return staying.drop(own)
    repeated = small(repeated, 100)
    once = staying.join(repeated, matches(staying, repeated), "left_anti")
    several = staying.join(repeated, matches(staying, repeated), "left_semi").dropDuplicates(["doc_id", own])
    return once.unionByName(several).drop(own)
