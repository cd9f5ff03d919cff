"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip-pairs.

Every coordinate has a learning rate of its own, and the L1 term leaves most weights at zero, so the model is a short
list of coordinates and weights, at most ``WIDTH`` of them, that is sent to the tasks. It is fitted on labelled rows
outside the held-out fold, a hash sample of them of about ``TRAIN_ROWS`` at most: parts of about
``SHARD_ROWS`` are fitted by a task each, in several passes, and the weights are averaged. Scoring is a column function: no shuffle of texts.

Defined results: a null text is empty, and an empty one has the score of the bias alone; null labels are no labels; of
contradicting labels of one document the toxic one counts; without any labelled row all scores are 0.5; repeated rows
are scored each; an empty table gives an empty result. Texts of any length are scored whole; a feature counts once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 1 << 20
TRAIN_ROWS = 20_000
SHARD_ROWS = 5_000
PASSES = 6
ALPHA, BETA, L1, L2 = 3.0, 1.0, 4.0, 0.1
FOLD = 5
PUNCTUATION = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(64 - 20)


def features(text: str) -> np.ndarray:
    """Coordinates of the words, pairs of neighbours and pairs with one word between, in [1, WIDTH)."""
    tokens = text.lower().encode("utf-8", "replace").translate(PUNCTUATION).split()
    word = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))
    pair = word[:-1] * np.uint64(1_000_003) + word[1:] + np.uint64(1 << 33)
    skip = word[:-2] * np.uint64(998_244_353) + word[2:] + np.uint64(1 << 34)
    return np.maximum((np.concatenate([word, pair, skip]) * MIX) >> SHIFT, np.uint64(1)).astype(np.int64)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Weights by coordinate; coordinate 0 is the bias, which has no L1 term."""
    z, n = np.zeros(WIDTH), np.zeros(WIDTH)
    l1 = np.full(WIDTH, L1)
    l1[0] = 0.0
    order = np.random.default_rng(7)

    def weights(at) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) <= l1[at], 0.0, w)

    for _ in range(passes):
        for i in order.permutation(len(rows)):
            at = rows[i]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(slice(None))


def bucket(key: str, modulus: int) -> Column:
    """crc32 of the id as text, by remainder; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


@dataclass
class Model:
    """Non-zero weights and their coordinates."""

    at: list[int]
    weight: list[float]

    def scorer(self) -> Callable[[Column | str], Column]:
        """A column function from text to score."""
        at, weight = self.at, self.weight
        dense: list[np.ndarray] = []

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            if not dense:
                w = np.zeros(WIDTH)
                w[at] = weight
                dense.append(w)
            w = dense[0]
            sums = []
            for text in texts:
                got = features(text.as_py() or "")
                got = np.unique(got[w[got] != 0.0])
                sums.append(w[0] + w[got].sum())
            return pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))), pa.float64())

        return score


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on labelled documents outside the held-out fold.

    The sampled ids, ``rows`` of them on average, are broadcast, so texts are read in place and only those of the
    sample are shuffled.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (bucket("doc_id", FOLD) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    there = max(1, known.count())
    share, shards = min(1.0, rows / there), max(1, round(min(rows, there) / SHARD_ROWS))
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "text"])
        bias = np.zeros(1, np.int64)
        found = [np.concatenate([bias, np.unique(features(t))]) for t in part["text"].fillna("")]
        w = ftrl(found, part["toxic"].to_numpy(float)) / shards
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": at, "weight": w[at]})

    shard = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards))
    parts = texts.groupBy(shard.alias("shard")).applyInPandas(train, "at long, weight double")
    # At most WIDTH rows, whatever the corpus.
    model = parts.groupBy("at").agg(F.sum("weight").alias("weight")).orderBy("at").collect()
    return Model([r["at"] for r in model], [r["weight"] for r in model])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    score = fit(docs, labels).scorer()
    scored = docs.select("doc_id", (bucket("doc_id", FOLD) == 0).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the model does not reject, with all their columns."""
    return docs.filter(fit(docs, labels).scorer()("text") < 0.5)
