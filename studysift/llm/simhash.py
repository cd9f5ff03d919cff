"""SimHash near-duplicates by one-wildcard segment variants.

Two fingerprints that differ in at most two of 64 bits differ in at most one bit of the lower or of the upper half.
So every distinct fingerprint is indexed under 64 variants, each half with one bit left open, and an equality join on
the variant finds all candidates, which are verified on the whole fingerprint. Buckets of two or three fingerprints are
told apart by their minimum, maximum and exclusive or, in one aggregate with a combine before the shuffle.

A bucket of more, as a large group of near copies makes, would give all pairs of its members. Its fingerprints are
linked otherwise: two differ in at most two bits just when some value is at most one bit from either, so each is
entered under itself and its 64 one-bit neighbours, and under each such value, which can have 65 members at most, all
are tied to the smallest. Links are then the same as those of all pairs, and their number stays linear.

Components come from large-star and small-star rounds over the links of distinct fingerprints, each round written to
the shared folder. Defined results: a null text is empty; texts without words share fingerprint zero; null ids are
carried, and a component of null ids only has a null id; repeated rows are returned each; an empty table gives an
empty result. Texts of any length are read whole, their shingles in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studysift.llm.common import keep_rows, stored

SEED = 42
WORDS = 3
BITS_APART = 2
BLOCK = 1 << 16


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64 bits, each set if over half the shingle hashes have it, as a signed number."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    n = max(1, len(tokens) - words + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : at + BLOCK], stops[at : at + BLOCK])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, fp)`` of every row; the key is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py() or b"") for t in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "fp"])

    text = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("k"), F.col("text").cast("binary"))
    return text.mapInArrow(run, "doc_id long, text_key long, fp long")


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= BITS_APART


def variants(prints: DataFrame) -> DataFrame:
    """``(key, fp)``: each half of the fingerprint with one bit left open, numbered by half and bit."""
    half = "shiftrightunsigned(fp, n & 32) & 4294967295L"
    key = f"shiftleft(CAST(n AS BIGINT), 32) | (({half}) & ~shiftleft(1L, n & 31))"
    return prints.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(63)))).select(F.expr(key).alias("key"), "fp")


def links(prints: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: links of distinct fingerprints, enough to connect all that differ in two bits or fewer."""
    index = variants(prints)
    buckets = index.groupBy("key").agg(
        F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"), F.bit_xor("fp").alias("x")
    )
    buckets = stored(buckets.filter("n > 1"), "simhash_buckets")
    low, high = F.col("low"), F.col("high")
    third = F.when(F.col("n") == 3, F.col("x").bitwiseXOR(low).bitwiseXOR(high)).otherwise(low)
    pairs = F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in ((low, high), (low, third), (third, high))])
    small = buckets.filter("n <= 3").select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    small = small.filter((F.col("a") < F.col("b")) & _near(F.col("a"), F.col("b")))

    # Members of a bucket have one of two values of its half, so they are found by a join on whole halves.
    value, bit = "(key & 4294967295L)", "(shiftright(key, 32) & 31)"
    either = F.expr(f"array({value}, {value} | shiftleft(1L, CAST({bit} AS INT)))")
    upper = F.expr("shiftright(key, 37) = 1")
    wanted = buckets.filter("n > 3").select(upper.alias("upper"), F.explode(either).alias("half")).distinct()
    sides = F.array(
        F.struct(F.lit(False).alias("upper"), F.expr("fp & 4294967295L").alias("half")),
        F.struct(F.lit(True).alias("upper"), F.expr("shiftrightunsigned(fp, 32)").alias("half")),
    )
    halves = prints.select("fp", F.explode(sides).alias("s")).select("fp", "s.*")
    crowded = halves.join(wanted, ["upper", "half"], "left_semi").select("fp").distinct()
    flips = F.sequence(F.lit(-1), F.lit(63))
    middle = F.expr("CASE WHEN n < 0 THEN fp ELSE fp ^ shiftleft(1L, n) END")
    around = crowded.withColumn("n", F.explode(flips)).select(middle.alias("middle"), "fp")
    stars = around.groupBy("middle").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1)
    stars = stars.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).filter("a < b")
    return small.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links; the root is the smallest node of its component."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        seen = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if seen == state:
            break
        state = seen
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def distinct_prints(marked: DataFrame) -> DataFrame:
    return stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")


def named(marked: DataFrame, prints: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_id, text_key, fp, component_id, root`` of rows ``(doc_id, text_key, fp)`` by links between their ``fp``."""
    roots = stored(components(edges), "components")
    linked = prints.join(roots, prints["fp"] == roots["node"]).select("fp", "root", "least")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    known = prints.join(linked.join(smallest, "root").select("fp", "root", "component_id"), "fp", "left")
    known = known.select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id")
    )
    return marked.join(known, "fp").select("doc_id", "text_key", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, text_key, fingerprint, component_id, root``, the last a fingerprint."""
    marked = stored(fingerprints(docs), "fingerprints")
    prints = distinct_prints(marked)
    found = named(marked, prints, links(prints.select("fp")))
    fingerprint_text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", "text_key", fingerprint_text, "component_id", "root")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Of each component the document with the smallest id, with all its columns."""
    return first_of_each(docs, near_duplicates(docs))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each component of ``(doc_id, text_key, component_id, root)`` the document with the smallest id."""
    found = stored(found, "near_duplicates")
    least = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Rows that share an id may stand in for one component more than once: the smallest text key decides.
    first = least.groupBy("root").agg(F.min("text_key").alias("first_key"))
    joined = found.join(first, "root")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("text_key").eqNullSafe(F.col("first_key"))
    return keep_rows(docs, joined.withColumn("kept", kept), F.xxhash64("text"), "text_key")
