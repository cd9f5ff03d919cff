"""Exact de-duplication by content-defined chunk recipes.

Text, with each run of white space as one space, is cut where its content says so: after a word end that meets a
pattern, at least ``SHORTEST`` and at most ``LONGEST`` characters from the last cut. Equal chunks get one identifier, a
64-bit hash that is verified on the chunks' full text: where one hash stands for two texts, the further texts get
ordinals of their own. A document becomes the ordered list of its identifiers, and equal lists are equal documents.
Chunks travel once, after equal ones have been merged in each task; whole documents never do.

Only DataFrame functions are used. Defined results: a null text counts as empty, and all empty texts are equal; a null
``doc_id`` ranks after all others, and a group of null ids only has a null ``keep_id``; of repeated rows with the
smallest id one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studysift.llm.common import keep_rows, same, stored, text_of

SHORTEST, LONGEST = 256, 4096
SPACE = r"[\x20\x09-\x0D]+"
ODD, EVEN = "acegikmoqsuwy", "bdfhjlnprtvxz"  # letters by their place in the alphabet
CUT = rf"(?<=[{EVEN}][{ODD}] )(?=[{ODD}][{EVEN}][{ODD}])"  # one word end in twenty or thirty


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), SPACE, " ")


def chunks_of(text: Column) -> Column:
    """Content-defined chunks whose concatenation is the text; an empty text has none."""
    pattern = rf"(?s).{{{SHORTEST},{LONGEST}}}?{CUT}|.{{1,{LONGEST}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _hash(chunk: Column, bits: int) -> Column:
    return F.xxhash64(chunk) if bits == 64 else F.pmod(F.xxhash64(chunk), F.lit(1 << bits))


def _clashes(chunked: DataFrame) -> DataFrame:
    """``(hash, chunk, ordinal)`` of the texts beyond the first that share a hash; verified on the whole text."""
    texts = chunked.select(F.explode("pairs").alias("p")).select("p.hash", "p.chunk").distinct()
    shared = stored(texts.groupBy("hash").count().filter("count > 1").select("hash"), "shared_hashes")
    order = Window.partitionBy("hash").orderBy("chunk")
    if shared.isEmpty():
        return shared.select("hash", F.lit("").alias("chunk"), F.lit(0).alias("ordinal"))
    ranked = texts.join(shared, "hash").withColumn("ordinal", F.row_number().over(order) - 1)
    return ranked.filter("ordinal > 0")


def recipes(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """``(doc_id, text_sha256, recipe)`` per row; the recipe is the ordered list of verified chunk identifiers."""
    text = docs.select("doc_id", normalised().alias("norm"))
    named = text.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), chunks_of(F.col("norm")).alias("chunks"))
    plain = named.select(
        "doc_id", "text_sha256", F.transform("chunks", lambda c: _hash(c, hash_bits)).alias("hashes")
    )
    pairs = F.transform("chunks", lambda c: F.struct(_hash(c, hash_bits).alias("hash"), c.alias("chunk")))
    clashes = stored(_clashes(named.select(pairs.alias("pairs"))), "chunk_clashes")
    if clashes.isEmpty():
        return plain.withColumnRenamed("hashes", "recipe")
    # One hash stands for several texts somewhere: give each occurrence its ordinal, then rebuild the lists.
    spots = named.select("doc_id", "text_sha256", F.posexplode(pairs).alias("pos", "p")).distinct()
    spots = spots.select("doc_id", "text_sha256", "pos", "p.hash", "p.chunk").join(clashes, ["hash", "chunk"], "left")
    lists = spots.groupBy("doc_id", "text_sha256").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("ordinal", F.lit(0)).alias("ordinal")))).alias("o")
    )
    ordinals = lists.select("doc_id", "text_sha256", F.transform("o", lambda s: s["ordinal"].cast("long")).alias("o"))
    joined = plain.join(ordinals, same(plain, ordinals, "doc_id", "text_sha256"), "left")
    return joined.select(
        plain["doc_id"],
        plain["text_sha256"],
        F.concat("hashes", F.coalesce("o", F.array().cast("array<bigint>"))).alias("recipe"),
    )


def exact_duplicates(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """One row per document, dropped ones too: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The recipe alone decides; the digest is each row's own. Groups are counted with a combine before the shuffle,
    repeated rows travel as one row with a count, and a group that holds a large part of all rows is split by adaptive
    execution in the join.
    """
    listed = stored(recipes(docs, hash_bits), "recipes")
    groups = listed.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    rows = listed.groupBy("recipe", "text_sha256", "doc_id").agg(F.count("*").alias("times"))
    return (
        rows.join(groups, "recipe")
        .select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("turn"))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"),
            "text_sha256",
        )
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    found = exact_duplicates(docs)
    return keep_rows(docs, found, F.sha2(normalised(), 256), "text_sha256")
