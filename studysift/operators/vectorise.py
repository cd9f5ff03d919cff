"""Term counts, document frequency and TF-IDF.

Whole runs read the text once: the term store has one row per document and term, dealt and sorted by term, with the
term's frequencies beside it. It is the only table of that length that is shuffled; weights, norms and class sums are
passes over it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studysift.functions import measures as ms
from studysift.functions import text as tx
from studysift.operators.joins import frequent_keys, join_split
from studysift.operators.storage import stored

DOCUMENTS_PER_TERM = 5_000_000  # rows of one term that a task takes when a term store is written
MAX_BROADCAST_NORMS = 4_000_000  # 16 bytes each
TERMS_PER_BATCH = 100_000
TERMS_PER_DEAL = 1_000_000
ROWS_PER_TASK = 1_000_000  # term rows that meet in one task of a term store, by the length of the text
CHARACTERS_PER_ROW = 2.5
PACKS_PER_TASK = 8

Batches = Iterator[pa.RecordBatch]


def _grams(df: DataFrame, text: str, keep: Sequence[str], ngram_range: tuple[int, int]) -> DataFrame:
    words = df.select(*keep, tx.vector_words(F.col(text)).alias("_w"))
    return words.select(*keep, tx.ngrams(F.col("_w"), *ngram_range).alias("_g"))


def term_counts(
    df: DataFrame, text: str = "content", keep: Sequence[str] = ("doc_id",), ngram_range: tuple[int, int] = (1, 3)
) -> DataFrame:
    """``(keep..., term, tf)``: how often each n-gram occurs in each document.

    A document is one row and counted by itself, so no shuffle is needed. Rows leave a task in batches.
    """
    spaced = df.select(*keep, tx.spaced_words(F.col(text)).alias("_w"))
    counted = _counter(list(keep), ngram_range, TERMS_PER_BATCH)
    schema = T.StructType([spaced.schema[name] for name in keep]).add("term", T.StringType()).add("tf", T.IntegerType())
    return spaced.mapInArrow(counted, schema)


def _counter(names: list[str], ngram_range: tuple[int, int], size: int) -> Callable[[Batches], Batches]:
    """What makes term counts of batches ``(names..., _w)``, about ``size`` rows at a time."""
    low, high = ngram_range
    if not 1 <= low <= high:
        raise ValueError("need 1 <= low <= high")

    def counted(batches: Batches) -> Batches:
        for batch in batches:
            texts, at, sizes, terms, tfs = batch.column("_w"), 0, [], [], []
            for i in range(len(batch)):
                words = [w for w in (texts[i].as_py() or "").split(" ") if len(w) > 1]
                counts: Counter[str] = Counter()
                for n in range(low, high + 1):
                    counts.update(words if n == 1 else map(" ".join, zip(*[words[j:] for j in range(n)])))
                sizes.append(len(counts))
                terms.extend(counts)
                tfs.extend(counts.values())
                if len(terms) >= size or i + 1 == len(batch):
                    rows = pa.array(np.repeat(np.arange(at, i + 1), sizes))
                    columns = [batch.column(name).take(rows) for name in names]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(terms, pa.string()), pa.array(tfs, pa.int32())], names=[*names, "term", "tf"]
                    )
                    at, sizes, terms, tfs = i + 1, [], [], []

    return counted


def _met_by_term(
    df: DataFrame, text: str, keep: Sequence[str], ngram_range: tuple[int, int], known: Column, tasks: int
) -> DataFrame:
    """``(keep..., term, tf, df, n)``, all rows of a term in one of so many tasks and sorted by term.

    Rows travel in packs, one array a column, since a task has too many of them to hand each over by itself. Only the
    distinct terms of a task are sorted, the rows follow by their numbers.
    """
    spaced = df.select(*keep, known.alias("_in"), tx.spaced_words(F.col(text)).alias("_w"))
    names, packs = [*keep, "_in"], tasks * PACKS_PER_TASK
    counted = _counter(names, ngram_range, TERMS_PER_DEAL)
    fields = T.StructType([spaced.schema[name] for name in names]).add("term", T.StringType()).add("tf", T.IntegerType())
    packed = T.StructType([T.StructField("_pack", T.IntegerType())])
    for field in fields:
        packed = packed.add(field.name, T.ArrayType(field.dataType))
    out = T.StructType([f for f in fields if f.name != "_in"]).add("df", T.LongType()).add("n", T.LongType())

    def dealt(batches: Batches) -> Batches:
        for batch in counted(batches):
            terms = batch.column("term").to_numpy(zero_copy_only=False)
            pack = (pd.util.hash_array(terms, categorize=False) % packs).astype(np.int32)
            sizes = np.bincount(pack, minlength=packs)
            filled = np.flatnonzero(sizes)
            offsets = pa.array(np.append(0, np.cumsum(sizes[filled])).astype(np.int32))
            rows = batch.take(pa.array(np.argsort(pack, kind="stable")))
            arrays = [pa.ListArray.from_arrays(offsets, rows.column(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), *arrays], names=packed.names)

    def met(batches: Batches) -> Batches:
        held = [b for b in batches if len(b)]
        if not held:
            return
        columns = {f.name: pa.concat_arrays([b.column(f.name).flatten() for b in held]) for f in fields}
        del held
        encoded, inside = columns.pop("term").dictionary_encode(), columns.pop("_in").to_numpy(zero_copy_only=False)
        order = pc.sort_indices(encoded.dictionary)
        place = np.empty(len(order), np.int32)
        place[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
        terms, codes = encoded.dictionary.take(order), place[encoded.indices.to_numpy()]
        n = np.bincount(codes, minlength=len(terms))
        inner = np.bincount(codes[inside.astype(bool)], minlength=len(terms))
        rows = np.argsort(codes, kind="stable")
        for at in range(0, len(rows), TERMS_PER_BATCH):
            some = rows[at : at + TERMS_PER_BATCH]
            code = codes[some]
            made = {c: x.take(pa.array(some)) for c, x in columns.items()}
            made |= {"term": terms.take(pa.array(code)), "df": pa.array(inner[code]), "n": pa.array(n[code])}
            yield pa.RecordBatch.from_arrays([made[c] for c in out.names], names=out.names)

    return spaced.mapInArrow(dealt, packed).repartition(tasks, "_pack").mapInArrow(met, out)


def term_store(
    df: DataFrame,
    text: str = "content",
    keep: Sequence[str] = ("doc_id",),
    ngram_range: tuple[int, int] = (1, 3),
    in_train: Column | None = None,
    documents_per_term: int = DOCUMENTS_PER_TERM,
) -> DataFrame:
    """``(keep..., term, tf, df, n)``, written once: term counts with the term's rows in training (``df``) and in all.

    ``in_train`` is over ``keep``; without it every row counts. A term has one row a document at most, so while there
    are few enough documents rows are shuffled by term once and counted where they meet, in as many tasks as the length
    of the text asks for. Beyond that the frequencies are aggregated first and frequent terms split by document.
    """
    known = F.lit(True) if in_train is None else F.coalesce(in_train, F.lit(False))
    documents, characters = df.agg(F.count(F.lit(1)), F.sum(F.length(text).cast("long"))).first()
    if documents <= documents_per_term:
        grams = (characters or 0) * (ngram_range[1] - ngram_range[0] + 1) / 3 / CHARACTERS_PER_ROW
        tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(grams / ROWS_PER_TASK))
        return stored(_met_by_term(df, text, keep, ngram_range, known, tasks), "term-store", "zstd")
    rows = term_counts(df, text, keep, ngram_range)
    frequencies = {"df": F.count_if(known), "n": F.count(F.lit(1))}
    rows = stored(rows, "term-counts", "zstd")
    sizes = stored(rows.groupBy("term").agg(*[x.alias(c) for c, x in frequencies.items()]), "term-sizes")
    joined = join_split(rows, sizes, ["term"], sizes.select("term", "n"))
    return stored(joined.select(*rows.columns, "df", "n"), "term-store", "zstd")


def exploded(store: DataFrame) -> DataFrame:
    """``(keep..., term, tf)`` of a term store."""
    return store.select(*[c for c in store.columns if c not in ("df", "n")])


def document_terms(
    df: DataFrame, text: str = "content", keep: Sequence[str] = ("doc_id",), ngram_range: tuple[int, int] = (1, 3)
) -> DataFrame:
    """``(keep..., term)``, each term once per document; cheaper than :func:`term_counts`."""
    grams = _grams(df, text, keep, ngram_range)
    return grams.select(*keep, F.explode_outer(F.array_distinct("_g")).alias("term")).where(F.col("term").isNotNull())


def document_frequency(terms: DataFrame, min_df: int = 1) -> DataFrame:
    """``(term, df)`` over rows that hold a term once per document."""
    counted = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counted if min_df <= 1 else counted.where(F.col("df") >= min_df)


def vocabulary_size(terms: DataFrame, exact: bool = True, rsd: float = 0.02) -> DataFrame:
    """Number of distinct terms; the approximate form needs no shuffle of the terms."""
    counted = F.countDistinct("term") if exact else F.approx_count_distinct("term", rsd)
    return terms.agg(counted.alias("vocabulary_size"))


def with_idf(df_table: DataFrame, n_docs: Column) -> DataFrame:
    """Add the smooth inverse document frequency to a ``(term, df)`` table."""
    return df_table.withColumn("idf", ms.smooth_idf(n_docs, F.col("df")))


def fit_idf(
    train: DataFrame, text: str = "content", ngram_range: tuple[int, int] = (1, 3), min_df: int = 1
) -> DataFrame:
    """``(term, df, idf)`` of the training documents, the vocabulary of a model."""
    n_docs = train.agg(F.count(F.lit(1)).alias("n")).scalar()
    terms = document_terms(train.select("doc_id", text), text, ngram_range=ngram_range)
    return with_idf(document_frequency(terms, min_df), n_docs)


def vocabulary_of(store: DataFrame, in_train: Column, min_df: int = 1, n_docs: int | None = None) -> DataFrame:
    """``(term, df, idf, n)`` of a term store, written once: document frequency in training, and rows in all.

    ``n_docs`` is the number of training documents; without it those that have a term are counted.
    """
    if n_docs is None:
        n_docs = store.where(in_train).select("doc_id").distinct().count()
    counted = store.groupBy("term").agg(F.count_if(in_train).alias("df"), F.count(F.lit(1)).alias("n"))
    kept = counted.where(F.col("df") >= max(1, min_df))
    return stored(with_idf(kept, F.lit(n_docs)).select("term", "df", "idf", "n"), "vocabulary")


def store_vocabulary(store: DataFrame, min_df: int = 1) -> DataFrame:
    """``(term, df, n)`` of the terms that the store's own training rows know."""
    counted = store.where(F.col("df") >= max(1, min_df)).groupBy("term")
    return counted.agg(F.max("df").alias("df"), F.max("n").alias("n"))


def weighed(counts: DataFrame, vocabulary: DataFrame, rows_per_key: int | None = None) -> DataFrame:
    """Term counts with ``w``, the count times the term's weight; terms outside the vocabulary drop out.

    Frequent terms are split by document. Where the vocabulary does not carry ``n``, the rows of each term, a sketch
    tells which terms are frequent.
    """
    sizes = vocabulary.select("term", "n") if "n" in vocabulary.columns else frequent_keys(counts, "term", rows_per_key)
    joined = join_split(counts, vocabulary.select("term", "idf"), ["term"], sizes, rows_per_key=rows_per_key)
    return joined.select(*counts.columns, (F.col("tf") * F.col("idf")).alias("w"))


def store_weights(store: DataFrame, n_docs: int, min_df: int = 1) -> DataFrame:
    """Rows of a term store with ``w``, by the frequencies it carries; nothing is joined or shuffled."""
    kept = store.where(F.col("df") >= max(1, min_df))
    return kept.withColumn("w", F.col("tf") * ms.smooth_idf(F.lit(n_docs), F.col("df")))


def _norms(rows: DataFrame) -> DataFrame:
    return stored(rows.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "norms")


def norms(store: DataFrame, vocabulary: DataFrame, rows_per_key: int | None = None) -> DataFrame:
    """``(doc_id, norm)`` of a term store, written once; only sums per document are kept of the weights."""
    return _norms(weighed(exploded(store).select("doc_id", "term", "tf"), vocabulary, rows_per_key))


def store_norms(store: DataFrame, n_docs: int, min_df: int = 1) -> DataFrame:
    """The same by the frequencies that the store carries."""
    return _norms(store_weights(store, n_docs, min_df))


def with_norm(rows: DataFrame, norms: DataFrame) -> DataFrame:
    """Rows with the ``norm`` of their document. Norms are sent to the tasks up to 64 MB, so long rows stay in place."""
    small = norms.limit(MAX_BROADCAST_NORMS + 1).count() <= MAX_BROADCAST_NORMS
    of = F.broadcast(norms) if small else norms
    of = of.withColumnRenamed("doc_id", "_of")
    return rows.join(of, F.col("doc_id").eqNullSafe(F.col("_of"))).drop("_of")


def store_tfidf(store: DataFrame, n_docs: int, min_df: int = 1) -> DataFrame:
    """Term counts of a store with ``v``, the L2-normalised weight, for the terms of the vocabulary."""
    rows = with_norm(store_weights(store, n_docs, min_df), store_norms(store, n_docs, min_df))
    return rows.withColumn("v", F.col("w") / F.col("norm")).drop("w", "norm", "df", "n")


def tfidf(counts: DataFrame, vocabulary: DataFrame, rows_per_key: int | None = None) -> DataFrame:
    """Add ``v``, the L2-normalised TF-IDF weight, to term counts; terms outside the vocabulary drop out.

    The norm is a window over a document, so the long table is shuffled once by term and once by document.
    """
    rows = weighed(counts, vocabulary, rows_per_key)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return rows.select(*counts.columns, (F.col("w") / norm).alias("v"))
