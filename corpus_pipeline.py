"""Training-data pipeline over ``documents``: filters, both de-duplications, decontamination, packing.

Each stage works on all that the one before it kept and returns the columns of ``documents``; the last returns the
packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from studysift.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from studysift.llm.common import read, stored

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model fitted on their labelled rows does not call toxic."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space the one with the smallest id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose SimHash fingerprints are linked, as in ``op2_simhash``, the one with the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands stay."""
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as token sequences."""
    return packing.pack_documents(docs, packing.vocabulary(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

ORACLE_SQL = None  # no stage but exact de-duplication can be stated in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each over what the one before it kept, written and read again in between."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
