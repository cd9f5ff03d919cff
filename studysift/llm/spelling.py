"""Spelling variants: words that differ by one letter, grouped under the form that is met most.

Letters are hashed to a few symbols, so the full one-edit neighbourhood of a reduced word has a few dozen to a few
hundred members whatever the real alphabet. Each distinct reduced word makes its neighbourhood once; an equality join
with the reduced vocabulary finds which neighbours exist, and only then do the original words meet and are verified by
their edit distance. Two words one edit apart have reduced words at most one edit apart, so no pair is lost; what the
reduced alphabet brings together beyond that the verification rejects. The number of symbols follows from the size of
the vocabulary: the smallest power of two that tells that many words of ``TYPICAL`` letters apart. It changes how many
candidates are looked at and never the result.

Neighbours travel as 64-bit polynomial keys, which are all that a shuffle carries until candidates are known. A key two
reduced words share by chance only adds candidates.

Defined results: a null text has no words; a null ``doc_id`` counts as empty text where the run is garbled; repeated
rows and texts count each; an empty table, or one without frequent words, gives an empty result. Runs of any length are
read whole, and their neighbourhoods are made in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studysift.llm.common import stored

RUN = "[A-Za-zÀ-ÿ]+"
LETTERS = 6
OCCURRENCES = 5
GARBLED = 199
TIMES = 5
TYPICAL = 8
SYMBOLS = (4, 8, 16, 32)
CELLS = 1 << 20  # neighbours made at once in a task
BASE = 0x9E3779B97F4A7C15  # any odd number does


def lowered(run: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` is the same for plain ASCII and quicker."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(run) == F.octet_length(run), F.lower(run)).otherwise(F.translate(run, upper, upper.lower()))


def garbled(doc_id: Column, run: Column) -> Column:
    """The run, without one code point where ``GARBLED`` divides the checksum of id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    without = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % GARBLED == 0, without).otherwise(run)


def vocabulary(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """``(word, n)`` of words long and frequent enough; counted with a combine before the shuffle."""
    runs = docs.select(F.col("doc_id").alias("d"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= letters).select("d", lowered(F.col("run")).alias("run"))
    words = runs.select(garbled(F.col("d"), F.col("run")).alias("word")).filter(F.length("word") >= letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= occurrences)


def symbols_for(words: int) -> int:
    return next((s for s in SYMBOLS if s**TYPICAL >= words), SYMBOLS[-1])


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _keys(codes: np.ndarray) -> np.ndarray:
    return (codes * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def _reduced(word: str, symbols: int) -> str:
    return "".join(chr(97 + ord(c) % symbols) for c in word)


def _codes(words: list[str]) -> np.ndarray:
    """Symbols of words of one length as numbers from 1."""
    flat = np.frombuffer("".join(words).encode("ascii"), np.uint8).reshape(len(words), -1)
    return flat.astype(np.uint64) - np.uint64(96)


def neighbourhood(codes: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, key)`` of every string at most one edit from the rows, which share a length, in blocks."""
    n, length = codes.shape
    power = _powers(length + 2)
    back = np.uint64(pow(BASE, -1, 1 << 64))
    weighed = codes * power[:length]
    key = weighed.sum(axis=1, dtype=np.uint64)
    before = np.cumsum(weighed, axis=1, dtype=np.uint64) - weighed
    after = key[:, None] - before - weighed
    rows = np.arange(n)
    yield rows, key
    letters = np.arange(1, symbols + 1, dtype=np.uint64)
    wide = max(1, CELLS // (n * symbols))
    for at in range(0, length, wide):
        part = slice(at, at + wide)
        own, here = codes[:, part, None], power[:length][part][:, None]
        other = own != letters  # the same letter put before itself or in its own place makes nothing new
        row, _, _ = np.nonzero(other)
        yield row, (key[:, None, None] + (letters - own) * here)[other]
        put = (before + (after + weighed) * np.uint64(BASE))[:, part, None]
        yield row, (put + letters * here)[other]
        last = codes[:, at + 1 : at + wide + 1]
        differs = np.ones(codes[:, part].shape, bool)  # of equal letters in a row one is left out
        differs[:, : last.shape[1]] = codes[:, part][:, : last.shape[1]] != last
        row, _ = np.nonzero(differs)
        yield row, (before[:, part] + after[:, part] * back)[differs]
    for more in letters * power[length]:
        yield rows, key + more


def _by_length(words: list[str], symbols: int) -> Iterator[list[int]]:
    """Places of words of one length, few enough for their neighbourhoods to fit."""
    groups: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        groups.setdefault(len(word), []).append(i)
    for length, places in groups.items():
        step = max(1, CELLS // (length * symbols))
        for at in range(0, len(places), step):
            yield places[at : at + step]


def coded(words: DataFrame, symbols: int) -> DataFrame:
    """``(word, n, reduced, key)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reduced = [_reduced(w, symbols) for w in batch.column(0).to_pylist()]
            keys = np.zeros(len(reduced), np.uint64)
            for places in _by_length(reduced, symbols):
                keys[places] = _keys(_codes([reduced[i] for i in places]))
            columns = [batch.column(0), batch.column(1), pa.array(reduced), pa.array(keys.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "reduced", "key"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, reduced string, key long")


def neighbours(reduced: DataFrame, symbols: int) -> DataFrame:
    """``(key, near)`` of the one-edit neighbourhood of every reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for places in _by_length(words, symbols):
                codes = _codes([words[i] for i in places])
                own = _keys(codes)
                for row, near in neighbourhood(codes, symbols):
                    columns = [pa.array(own[row].view(np.int64)), pa.array(near.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "near"])

    return reduced.select("reduced").mapInArrow(run, "key long, near long")


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, near, near_n)``: every ordered pair of the words that are exactly one edit apart."""
    symbols = symbols_for(words.count())
    known = stored(coded(words, symbols), "reduced_words")
    keys = known.select(F.col("key").alias("near")).distinct()
    around = neighbours(known.select("reduced").distinct(), symbols)
    pairs = stored(around.join(keys, "near", "left_semi").distinct(), "reduced_pairs")
    left = known.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = known.select(F.col("key").alias("near"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = pairs.join(left, "key").join(right, "near").filter("a < b")
    found = stored(met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct(), "near_words")
    both = found.unionByName(found.selectExpr("b AS a", "b_n AS a_n", "a AS b", "a_n AS b_n"))
    return both.toDF("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` by following ``(word, form)`` to the end, each round twice as far as the one before.

    A form is met at least ``TIMES`` as often as its word, so there are no circles and few rounds.
    """
    state = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = state.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        step = stored(step, "roots")
        state = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return state


def spelling_variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every frequent word of ``(doc_id, text)``."""
    words = stored(vocabulary(docs), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    around = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    takes = -F.col("best.m") >= times * F.col("n")
    around = around.select(
        "word", "n_near", F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.m")).alias("form_n")
    )
    around = stored(around, "spelling_forms")
    ends = roots(around.filter("form IS NOT NULL"))
    named = words.join(around, "word", "left").join(ends, "word", "left")
    return named.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n",
    )
