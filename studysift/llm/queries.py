"""One query per operator, over the whole table the operator is meant for, and SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studysift.llm import decontaminate, exact_dedup, language_model, minhash, packing, sanitise, sharding, simhash
from studysift.llm import spelling, suffix_dedup, toxicity, trie, warc
from studysift.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read(spark, folder, "documents"), packing.vocabulary("word_bpe_49k.json"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents")).drop("text_key", "root")


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, folder, "documents"))


def op4_sanitise(spark: SparkSession, folder: str) -> DataFrame:
    return sanitise.digest(sanitise.personal_data(read(spark, folder, "documents")))


def op5_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.scores(read(spark, folder, "documents"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, folder, "documents"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    back = warc.archive_pages(read(spark, folder, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    shards = sharding.shard_documents(read(spark, folder, "documents"))
    return shards.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, folder, "documents"))


def op12_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(read(spark, folder, "documents")).drop("text_key", "root")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(read(spark, folder, "conversations"))


def all_queries() -> dict[str, Query]:
    return {
        "op1_packing": op1_packing,
        "op2_simhash": op2_simhash,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_sanitise": op4_sanitise,
        "op5_context_tree": op5_context_tree,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_toxicity": op7_toxicity,
        "op8_warc": op8_warc,
        "op9_sharding": op9_sharding,
        "op10_decontaminate": op10_decontaminate,
        "op11_spelling": op11_spelling,
        "op12_minhash": op12_minhash,
        "op13_prefix_trie": op13_prefix_trie,
    }


def all_oracles() -> dict[str, str]:
    return {"op3_exact_dedup": OP3, "op8_warc": OP8}


OP3 = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""

OP8 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), g AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM p JOIN g USING (payload_digest)
"""
