"""Scores of terms against the class label, the best k of them, and feature vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studysift.functions.measures import significant, smooth_idf
from studysift.operators.joins import join_split
from studysift.operators.ranking import number_rows
from studysift.operators.storage import stored
from studysift.operators.vectorise import exploded, store_weights, with_norm

# A scorer maps the per-term sums (columns d1 d0 s1 s0 q1 q0) and the class sizes (n1, n0) to a score.
Scorer = Callable[[Column, Column], Column]


def class_sizes(train: DataFrame, label: str = "label") -> Column:
    """Struct ``(n1, n0)`` of class sizes as a scalar subquery: one row by construction."""
    one = F.count_if(F.col(label) == 1)
    return train.agg(F.struct(one.alias("n1"), F.count_if(F.col(label) == 0).alias("n0")).alias("n")).scalar()


def term_statistics(features: DataFrame, label: str = "label", value: str | None = "v") -> DataFrame:
    """Per term and class: documents holding it (d), sum of its weights (s), sum of squares (q). One hash aggregate.

    Without ``value`` only the document counts are formed, which is all that affinity needs.
    """
    is1, is0 = F.col(label) == 1, F.col(label) == 0
    if value is None:
        return features.groupBy("term").agg(F.count_if(is1).alias("d1"), F.count_if(is0).alias("d0"))
    parts = _class_parts(label, value)
    return features.groupBy("term").agg(
        *[F.count_if(x).alias(c) if c[0] == "d" else F.coalesce(F.sum(x), F.lit(0.0)).alias(c) for c, x in parts.items()]
    )


def _class_parts(label: str, value: str) -> dict[str, Column]:
    """What a row adds to each of the six sums: a condition that is counted, or a value that is summed."""
    is1, is0, v = F.col(label) == 1, F.col(label) == 0, F.col(value)
    return {
        "d1": is1 & (v > 0),
        "d0": is0 & (v > 0),
        "s1": F.when(is1, v),
        "s0": F.when(is0, v),
        "q1": F.when(is1, v * v),
        "q0": F.when(is0, v * v),
    }


def class_sums(
    store: DataFrame, norms: DataFrame, n_docs: int, in_train: Column, min_df: int = 1, label: str = "label"
) -> DataFrame:
    """The same statistics from a term store and its norms, over the training documents.

    A weight is count times idf over norm and the idf belongs to the term, so it is put in after the sums; the term's
    document frequency is one of them. Most terms have one row (``n``) and are their own sums; only the others are
    aggregated.
    """
    rows = with_norm(store.where(in_train).select("doc_id", label, "term", "tf", "n"), norms)
    rows = rows.select(label, "term", "n", (F.col("tf") / F.col("norm")).alias("u"))
    own = {
        c: F.coalesce(x, F.lit(False)).cast("int").cast("long") if c[0] == "d" else F.coalesce(x, F.lit(0.0))
        for c, x in _class_parts(label, "u").items()
    }
    single = rows.where("n = 1").select("term", *[x.alias(c) for c, x in own.items()])
    sums = term_statistics(rows.where("n > 1"), label, "u").unionByName(single)
    sums = sums.withColumn("df", F.col("d1") + F.col("d0"))
    idf = smooth_idf(F.lit(n_docs), F.col("df"))
    scaled = {"idf": idf, **{c: F.col(c) * idf for c in ("s1", "s0")}, **{c: F.col(c) * idf * idf for c in ("q1", "q0")}}
    return sums.where(F.col("df") >= max(1, min_df)).withColumns(scaled)


def affinity(n1: Column, n0: Column) -> Column:
    """Difference of the Jaccard overlaps of a term's documents with the two classes."""
    d1, d0 = F.col("d1"), F.col("d0")
    return d1 / (n1 + d0) - d0 / (n0 + d1)


def chi2(n1: Column, n0: Column) -> Column:
    """Chi-square of summed weights per class against the class priors."""
    s1, s0 = F.col("s1"), F.col("s0")
    total, n = s1 + s0, n1 + n0
    parts = [F.try_divide((s - total * m / n) * (s - total * m / n), total * m / n) for s, m in ((s1, n1), (s0, n0))]
    return parts[0] + parts[1]


def anova(n1: Column, n0: Column) -> Column:
    """F ratio of the variance between and within the classes; infinite when only the latter is zero."""
    s1, s0 = F.col("s1"), F.col("s0")
    n = n1 + n0
    mean_part = (s1 + s0) * (s1 + s0) / n
    between = F.try_divide(s1 * s1, n1) + F.try_divide(s0 * s0, n0) - mean_part
    within = F.col("q1") + F.col("q0") - mean_part - between
    ratio = F.try_divide(between, F.try_divide(within, n - 2))
    return F.when(within > 0, ratio).when(between > 0, F.lit(float("inf")))


def pearson(n1: Column, n0: Column) -> Column:
    """Signed correlation of a term's weight with the label, absent terms counting as zero."""
    s1, s = F.col("s1"), F.col("s1") + F.col("s0")
    n = n1 + n0
    spread = F.sqrt(F.greatest(n * (F.col("q1") + F.col("q0")) - s * s, F.lit(0.0))) * F.sqrt(
        (n * n1 - n1 * n1).cast("double")
    )
    return F.try_divide(n * s1 - s * n1, spread)


SCORERS: dict[str, Scorer] = {"affinity": affinity, "chi2": chi2, "anova": anova, "pearson": pearson}


def score_terms(stats: DataFrame, sizes: Column, score: str | Scorer) -> DataFrame:
    """``(term, score)`` at full precision; a score that is not a number becomes null, which ranks lowest."""
    scorer = SCORERS[score] if isinstance(score, str) else score
    with_sizes = stats.withColumn("_n", sizes)
    raw = scorer(F.col("_n.n1").cast("double"), F.col("_n.n0").cast("double"))
    scored = with_sizes.select("term", raw.alias("score"))
    return scored.select("term", F.when(~F.isnan("score"), F.col("score")).alias("score"))


def select_k_best(scores: DataFrame, k: int) -> DataFrame:
    """``(rank, term, score)`` of the k best terms; among ties the last term in code-point order comes first.

    Scores are compared at nine significant digits, so small ones are told apart as well as large ones.

    The limit keeps k rows per task before anything meets, so the numbering sees k rows at most.
    """
    order = [significant(F.col("score")).desc_nulls_last(), F.col("term").desc()]
    best = scores.orderBy(*order).limit(k)
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "term", "score")


def sparse_vector(indices: Column, values: Column, size: int) -> Column:
    """Sparse ML vector from index and value arrays, made in the JVM (there is no built-in for the sparse form)."""
    parts = F.struct(
        F.lit(0).alias("type"), F.lit(size).alias("size"), indices.alias("indices"), values.alias("values")
    )
    holder = T.StructType([T.StructField("vector", VectorUDT())])
    return F.from_json(F.to_json(F.struct(parts.alias("vector"))), holder)["vector"]


def all_terms(frequencies: DataFrame) -> DataFrame:
    """``(rank, term, score)`` of every term of ``(term, df)``, numbered in digest order; the score is its frequency."""
    keyed = frequencies.select("term", F.col("df").cast("double").alias("score"), F.md5("term").alias("_k"))
    numbered = number_rows(keyed, ("_k", "term"), bucket=F.substring("_k", 1, 3), out="rank")
    return numbered.select(F.col("rank").cast("int").alias("rank"), "term", "score")


def feature_vectors(
    studies: DataFrame, features: DataFrame, best: DataFrame, k: int, bounded: bool = True
) -> DataFrame:
    """Studies with ``entries`` and their ``features`` vector over k terms; a study with none of them has empty ones.

    The best terms are k at most and k is bounded, so they are broadcast; a whole vocabulary is joined by term
    instead (``bounded=False``). Weights are not normalised again.
    """
    index = best.select("term", (F.col("rank") - 1).alias("_i"))
    index = F.broadcast(index) if bounded else index
    return _packed(studies, features.select("doc_id", "term", "v").join(index, "term"), k)


def chosen_vectors(
    studies: DataFrame, store: DataFrame, norms: DataFrame, vocabulary: DataFrame, best: DataFrame, k: int, bounded: bool = True
) -> DataFrame:
    """The same from a term store: only counts of the chosen terms are weighed, no weight of another term is formed."""
    chosen = best.select("term", (F.col("rank") - 1).alias("_i"))
    rows = exploded(store).select("doc_id", "term", "tf")
    if bounded:
        index = F.broadcast(vocabulary.select("term", "idf").join(F.broadcast(chosen), "term"))
        rows = rows.join(index, "term").withColumn("w", F.col("tf") * F.col("idf"))
    else:
        known = vocabulary.join(chosen, "term").select("term", "idf", "_i", "n")
        rows = join_split(rows, known.drop("n"), ["term"], stored(known.select("term", "n"), "term-sizes"))
        rows = rows.withColumn("w", F.col("tf") * F.col("idf"))
    return _from_weights(studies, rows, norms, k)


def store_vectors(
    studies: DataFrame, store: DataFrame, norms: DataFrame, n_docs: int, best: DataFrame, k: int, bounded: bool = True, min_df: int = 1
) -> DataFrame:
    """The same by the frequencies that the store carries."""
    chosen = best.select("term", (F.col("rank") - 1).alias("_i"))
    rows = store_weights(store, n_docs, min_df).select("doc_id", "term", "w", "n")
    if bounded:
        rows = rows.join(F.broadcast(chosen), "term")
    else:
        sizes = stored(rows.where("n > 1").groupBy("term").agg(F.max("n").alias("n")), "term-sizes")
        rows = join_split(rows.drop("n"), chosen, ["term"], sizes)
    return _from_weights(studies, rows, norms, k)


def _from_weights(studies: DataFrame, rows: DataFrame, norms: DataFrame, k: int) -> DataFrame:
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_i", F.col("w").alias("v")))).alias("_p"))
    parts = parts.join(norms, "doc_id")
    scaled = F.transform("_p", lambda p: F.struct(p["_i"].alias("_i"), (p["v"] / F.col("norm")).alias("v")))
    return _with_vector(studies, parts.select("doc_id", scaled.alias("_p")), k)


def _packed(studies: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    return _with_vector(
        studies, entries.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_i", "v"))).alias("_p")), k
    )


def _with_vector(studies: DataFrame, packed: DataFrame, k: int) -> DataFrame:
    empty = F.array().cast("array<struct<_i:int,v:double>>")
    joined = studies.join(packed, "doc_id", "left").withColumn("entries", F.coalesce("_p", empty)).drop("_p")
    return joined.withColumn("features", sparse_vector(F.col("entries._i"), F.col("entries.v"), k))
