"""MinHash near-duplicates by fast similarity sketches, banding and exact verification.

A text's set are its distinct word shingles. Its sketch has ``BANDS * ROWS`` coordinates that are filled in rounds: in
each of the first rounds every shingle is placed in one random coordinate, which keeps the smallest value of the first
round that met it; in as many further rounds all shingles go to one coordinate each, so that every coordinate is
filled whatever the size of the set. Rounds stop when none is left empty: large sets need one or two, and their
coordinates are drawn almost without replacement, which is what concentrates the estimate. Two sets agree in a
coordinate with a probability of their Jaccard similarity; with 32 bands of 5 coordinates a pair at 0.85 shares no
band with a probability below 1e-8.

Equal sets are one class from the start. Distinct sets that share a band are verified on their whole sets. A bucket of
many is not turned into all its pairs: in rounds its members meet one of them, first the smallest, then the one with
most links so far, and members that are connected already need not meet again. What is left after the rounds, members
of crowded buckets in different components, meets by its rarest shingles: similar sets share one of a short prefix in
the order of rarity, at places that leave room for the overlap they need. Copies with many changes of their own have
nothing but those in their prefixes, so a group of copies that are not similar makes no pairs.

Sets travel as 64-bit hashes of their shingles, the middle of a star copied once per block of pairs. Defined results: a
null text is empty; texts without words have an empty set and are linked with nothing, equal ones neither; null ids are
carried, and a component of null ids only has a null id; repeated rows are returned each; an empty table gives an empty
result. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studysift.llm.common import keep_rows, small, stored
from studysift.llm.simhash import components

WORDS = 3
SIMILAR = 85  # hundredths
BANDS = 32
ROWS = 5
WIDTH = BANDS * ROWS
STAR_ROUNDS = 3
BLOCK = 256  # pairs that share one copy of a set
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
CELLS = 1 << 20


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; of the whole sequence where there are fewer words."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) < words:
        shingles = {b" ".join(tokens)}
    else:
        shingles = set(map(b" ".join, zip(*(islice(tokens, i, None) for i in range(words)))))
    out = np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(shingles))
    return np.unique(out)


def _mixed(values: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash of 64-bit hashes for each salt."""
    x = values ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sketches(values: np.ndarray, sizes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """One row of ``width`` coordinates per set; ``values`` are the sets one after another, none of them empty.

    A coordinate holds round and value in one number, so the smallest of all rounds is that of its first round.
    """
    sets = held = len(sizes)
    out = np.full((sets, width), EMPTY, np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(sets), sizes)
    left = np.arange(sets)
    for turn in range(2 * width):
        if len(left) < 0.7 * held:  # filled sets would change nothing more
            alive = np.zeros(sets, bool)
            alive[left] = True
            values, owner, held = values[alive[owner]], owner[alive[owner]], len(left)
        if not held:
            break
        hashed = _mixed(values, turn)
        value = (hashed >> np.uint64(10)) | np.uint64(turn << 54)
        place = (hashed % np.uint64(width)).astype(np.int64) if turn < width else turn - width
        np.minimum.at(flat, owner * width + place, value)
        left = left[(out[left] == EMPTY).any(axis=1)]
    return out


def _sketch_batch(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, 128-bit names of the sets and band keys."""
    import xxhash

    sets = [shingle_hashes(t, words) for t in texts]
    sizes = np.array([len(s) for s in sets])
    names = np.array(
        [[xxhash.xxh64_intdigest(s.tobytes(), seed) for seed in (1, 2)] for s in sets], np.uint64
    ).reshape(-1, 2)
    sketch = np.zeros((len(sets), WIDTH), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        sketch[full] = sketches(np.concatenate([sets[i] for i in full]), sizes[full])
    bands = sketch.reshape(-1, BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sets), BANDS)).copy()
    for row in range(ROWS):
        keys = _mixed(keys + bands[:, :, row], row)
    return sizes, names, keys


def sketched(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(doc_id, text_key, n, name1, name2, bands)`` of every row."""
    names = ["doc_id", "text_key", "n", "name1", "name2", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # few enough texts for their shingles to stay within bounds
                texts, held = [], 0
                while at < batch.num_rows and held < CELLS:
                    texts.append(batch.column(2)[at].as_py() or b"")
                    held += len(texts[-1])
                    at += 1
                sizes, name, keys = _sketch_batch(texts, words)
                own = batch.slice(at - len(texts), len(texts))
                columns = [own.column(0), own.column(1), pa.array(sizes, pa.int64())]
                columns += [pa.array(name[:, i].astype(np.uint64).view(np.int64)) for i in (0, 1)]
                offsets = np.arange(len(texts) + 1, dtype=np.int32) * BANDS
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).reshape(-1))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, text_key long, n long, name1 long, name2 long, bands array<long>"
    asked = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("k"), F.col("text").cast("binary"))
    return asked.mapInArrow(run, schema)


def shingle_sets(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``(row, hashes)`` of rows ``(row, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.slice(at, 256)
                sets = [shingle_hashes(t.as_py() or b"", words).view(np.int64) for t in own.column(1)]
                offsets = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                column = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([own.column(0), column], names=["row", "hashes"])

    return texts.select("row", F.col("text").cast("binary")).mapInArrow(run, "row long, hashes array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Of distinct pairs ``(a, b)`` of rows those whose sets are similar.

    A set that is in many pairs as ``a`` is copied once per ``BLOCK`` of them, so no task gathers all its pairs.
    """
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("b"), F.col("blocks"))
    numbered = pairs.join(blocks, "a").select("a", "b", block.alias("block"))
    first = sets.select(F.col("row").alias("a"), F.col("hashes").alias("one")).join(blocks, "a")
    first = first.select("a", "one", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    second = sets.select(F.col("row").alias("b"), F.col("hashes").alias("two"))
    met = numbered.join(second, "b").join(first, ["a", "block"])
    common = F.size(F.array_intersect("one", "two"))
    union = F.size("one") + F.size("two") - common
    return met.filter(100 * common.cast("long") >= similar * union).select("a", "b")


def _close(n: str, m: str, similar: int) -> str:
    """Sizes that do not rule the similarity out."""
    return f"100 * least({n}, {m}) >= {similar} * greatest({n}, {m})"


def _components(links: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` with ``root``, the row itself where it is not linked."""
    roots = small(stored(components(links), "minhash_components"), 40)
    return members.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn(
        "root", F.coalesce("root", "row")
    )


def links(sets: DataFrame, hashes_of: Callable[[DataFrame], DataFrame], similar: int = SIMILAR) -> DataFrame:
    """``(a, b)``: links of distinct sets ``(row, n, bands)``, enough to connect all that are similar.

    ``hashes_of`` gives ``(row, hashes)`` for distinct rows.
    """
    keyed = sets.select(F.explode("bands").alias("key"), "row", "n")
    buckets = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("row", "n")).alias("first"))
    buckets = stored(buckets.filter("members > 1"), "minhash_buckets")
    members = stored(keyed.join(buckets, "key"), "minhash_members")
    star = members.filter(f"row != first.row AND {_close('n', 'first.n', similar)}")
    met = stored(star.select(F.col("first.row").alias("a"), F.col("row").alias("b")).distinct(), "minhash_pairs")
    rows = met.select(F.col("a").alias("row")).unionByName(met.select(F.col("b").alias("row")))
    rows = rows.unionByName(members.filter("members > 2").select("row")).distinct()
    hashes = stored(hashes_of(rows), "minhash_sets")
    found = stored(verified(met, hashes, similar), "minhash_links")
    crowded = members.filter("members > 2").select("key", "row", "n", F.col("first.row").alias("pivot"))
    used = crowded.select("key", "pivot").distinct()
    for _ in range(STAR_ROUNDS - 1):
        left = _apart(crowded, found)
        if left.isEmpty():
            return found
        degree = found.unionByName(found.selectExpr("b AS a", "a AS b")).groupBy(F.col("a").alias("row")).count()
        fresh = left.join(used.withColumnRenamed("pivot", "row"), ["key", "row"], "left_anti").join(degree, "row", "left")
        order = F.struct(F.coalesce("count", F.lit(0)), -F.col("row"))
        best = fresh.groupBy("key").agg(F.max_by(F.struct("row", "n", "root"), order).alias("best"))
        star = left.join(best, "key").filter(f"root != best.root AND {_close('n', 'best.n', similar)}")
        pairs = star.select(F.least("row", "best.row").alias("x"), F.greatest("row", "best.row").alias("y"), F.col("best.row").alias("a"))
        pairs = pairs.groupBy("x", "y").agg(F.min("a").alias("a"))
        pairs = pairs.select("a", F.expr("IF(a = x, y, x)").alias("b"))
        pairs = stored(_fresh(pairs, met), "minhash_pairs")
        used = stored(used.unionByName(best.select("key", F.col("best.row").alias("pivot"))), "minhash_pivots")
        met = met.unionByName(pairs)
        found = stored(found.unionByName(verified(pairs, hashes, similar)), "minhash_links")
    left = _apart(crowded, found)
    if left.isEmpty():
        return found
    pairs = stored(_fresh(_by_rare_shingles(left, hashes, similar), met), "minhash_pairs")
    return found.unionByName(verified(pairs, hashes, similar))


def _fresh(pairs: DataFrame, met: DataFrame) -> DataFrame:
    """Pairs that have not met, in either order."""
    name = [F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")]
    return pairs.select("a", "b", *name).join(met.select(*name), ["x", "y"], "left_anti").select("a", "b")


def _apart(crowded: DataFrame, found: DataFrame) -> DataFrame:
    """Members ``(key, row, n, root)`` of crowded buckets that hold more than one component."""
    rooted = stored(_components(found, crowded.select("key", "row", "n")), "minhash_rooted")
    split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    return stored(rooted.join(split.select("key"), "key"), "minhash_apart")


def _by_rare_shingles(left: DataFrame, hashes: DataFrame, similar: int) -> DataFrame:
    """Distinct pairs ``(a, b)`` of rows in different components that may be similar, none that is left out.

    Of two similar sets the larger one has a shingle in its first ``n - similar n + 1`` rarest, the smaller one the same
    in its first ``n - 2 similar n / (1 + similar) + 1``; a shingle of one row only is placed first and never joined.
    """
    rows = left.groupBy("row").agg(F.min("root").alias("root"), F.min("n").alias("n"))
    items = stored(rows.join(hashes, "row").select("row", "root", "n", F.explode("hashes").alias("h")), "minhash_items")
    shared = items.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1")
    ordered = F.array_sort(F.collect_list(F.struct("c", "h")))
    placed = items.join(shared, "h").groupBy("row", "root", "n").agg(ordered.alias("o"))
    placed = placed.select("row", "root", "n", F.size("o").alias("size"), F.posexplode("o").alias("p", "s"))
    placed = placed.select("row", "root", "n", (F.col("n") - F.col("size") + F.col("p") + 1).alias("at"), F.col("s.h").alias("h"))
    placed = stored(placed.filter(f"at <= n - ({similar} * n + 99) div 100 + 1"), "minhash_prefixes")
    whole = 100 + similar
    short = placed.filter(f"at <= n - ({2 * similar} * n + {whole - 1}) div {whole} + 1")
    short = short.select("h", *[F.col(c).alias(f"{c}2") for c in ("row", "root", "n", "at")])
    met = placed.join(short, "h").filter(
        f"root != root2 AND struct(n2, row2) < struct(n, row) AND {_close('n', 'n2', similar)} "
        f"AND 1 + least(n - at, n2 - at2) >= ({similar} * (n + n2) + {whole - 1}) div {whole}"
    )
    return met.select(F.col("row").alias("a"), F.col("row2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """One row per document: ``doc_id, text_key, n_shingles, component_id, root``; rows of an empty set have no root."""
    marked = sketched(docs, words).withColumn("row", F.monotonically_increasing_id())
    marked = stored(marked, "sketches")
    classes = marked.filter("n > 0").groupBy("name1", "name2").agg(
        F.min("row").alias("row"), F.min("doc_id").alias("least")
    )
    classes = stored(classes, "minhash_classes")
    distinct = stored(marked.join(classes.select("row"), "row", "left_semi").drop("name1", "name2"), "minhash_distinct")
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")

    def hashes_of(rows: DataFrame) -> DataFrame:
        asked = small(stored(distinct.select("row", "doc_id", "text_key").join(rows, "row"), "minhash_rows"), 40)
        same = asked["doc_id"].eqNullSafe(texts["doc_id"]) & (asked["text_key"] == texts["text_key"])
        # rows that share id and text come more than once
        return shingle_sets(texts.join(asked, same).select("row", "text"), words).dropDuplicates(["row"])

    edges = links(distinct.select("row", "n", "bands"), hashes_of, similar)
    roots = stored(components(edges), "minhash_components")
    known = classes.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "root").select("name1", "name2", "root", "component_id")
    out = marked.join(known, ["name1", "name2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), own.alias("component_id"),
        F.when(F.col("n") > 0, F.col("root")).alias("root"),
    )


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """Of each component the document with the smallest id, with all its columns; texts without words all stay."""
    found = stored(near_duplicates(docs, words, similar), "near_duplicates")
    kept = F.col("root").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))
    least = found.filter(kept).groupBy("root").agg(F.min("text_key").alias("first_key"))
    joined = found.join(least.filter("root IS NOT NULL"), "root", "left")
    first = F.col("root").isNull() | F.col("text_key").eqNullSafe(F.col("first_key"))
    return keep_rows(docs, joined.withColumn("kept", kept & first), F.xxhash64("text"), "text_key")
