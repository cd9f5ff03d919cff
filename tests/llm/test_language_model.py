import math
import tracemalloc
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from studysift.llm import language_model as lm
from tests.llm.cases import ODD, empty, odd, remainder, words

DEPTH = 3


def model(rows):
    """Context-tree weighting by its definition."""
    counts = {}

    def steps(text):
        data = b"\xff" * DEPTH + " ".join(words(text)).encode() + b"\xff"
        for j in range(DEPTH, len(data)):
            decided = 1
            for k in range(8):
                bit = data[j] >> 7 - k & 1
                yield data[j - DEPTH : j], decided, bit
                decided = 2 * decided + bit

    for doc_id, text in rows:
        if remainder(doc_id, 7) != 2:
            for context, decided, bit in steps(text):
                for d in range(DEPTH + 1):
                    counts.setdefault((context[DEPTH - d :], decided), [0, 0])[bit] += 1
    longer = {}
    for context, decided in counts:
        if context:
            longer.setdefault((context[1:], decided), []).append((context, decided))

    def kt(node):
        a, b = counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @lru_cache(None)
    def weighted(node):
        if len(node[0]) == DEPTH:
            return kt(node)
        return float(np.logaddexp(kt(node), sum(map(weighted, longer[node])))) - math.log(2)

    def predict(context, decided, bit):
        p = None
        for d in range(DEPTH, -1, -1):
            node = context[DEPTH - d :], decided
            if node in counts:
                own = (counts[node][bit] + 0.5) / (sum(counts[node]) + 1)
                if p is None:
                    p = own
                else:
                    share = 1 / (1 + math.exp(min(700, sum(map(weighted, longer[node])) - kt(node))))
                    p = share * own + (1 - share) * p
        return 0.5 if p is None else p

    return lambda text: sum(math.log10(predict(*s)) for s in steps(text))


@pytest.mark.parametrize("strings, most_words", [(1 << 20, 300_000), (40, 3)])
def test_against_definition(spark, small, strings, most_words):
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id", "left(text, 400) AS text").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r for r in lm.scores(docs, DEPTH, strings, most_words).collect()}
    score = model(rows)
    count, trained = Counter(), 0
    for doc_id, text in rows:
        if remainder(doc_id, 7) != 2:
            count.update([*words(text), None])
    total = sum(count.values())
    for doc_id, text in rows:
        tokens, r = [*words(text), None], got[doc_id]
        assert r["score"] == pytest.approx(score(text), abs=1e-6)
        base = sum(math.log10((count[t] + 1) / (total + len(count) + 1)) for t in tokens)
        assert r["base_score"] == pytest.approx(base, abs=1e-7)
        assert (r["n_tokens"], r["n_known"]) == (len(tokens), sum(count[t] > 0 for t in tokens))
        assert r["train_tokens"] == total and r["held_out"] == (remainder(doc_id, 7) == 2)


def test_odd_documents(spark):
    rows = lm.scores(odd(spark)).collect()
    assert len(rows) == len(ODD)
    by_id = {r["doc_id"]: r for r in rows}
    for doc_id, text, _ in ODD:
        assert by_id[doc_id]["n_tokens"] == len(words(text)) + 1
        assert math.isfinite(by_id[doc_id]["score"]) and by_id[doc_id]["score"] < 0
    assert lm.scores(empty(spark)).count() == 0


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if remainder(i, 7) == 2)
    (row,) = lm.scores(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).collect()
    assert row["score"] == pytest.approx(3 * 8 * math.log10(0.5)) and row["train_tokens"] == 0


def test_probabilities_of_next_byte_sum_to_one():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 100, 400).astype(np.uint64)
    strings = text[:-2] << np.uint64(16) | text[1:-1] << np.uint64(8) | text[2:]
    context = strings[10] & ~np.uint64(255)
    every = context | np.arange(256, dtype=np.uint64)
    string = np.concatenate([strings, every])
    learnt = np.concatenate([np.ones(len(strings), np.int64), np.zeros(256, np.int64)])
    layers = lm.deep_layers(string, learnt, 2)
    none = {d: lm.Nodes(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for d in (0, 1)}
    logs = lm.code_lengths(string, layers, none)[-256:]
    assert np.exp(logs).sum() == pytest.approx(1)


def test_lookup():
    key = np.random.default_rng(0).integers(0, 1 << 60, 5000).astype(np.uint64)
    table = lm.Lookup(key, np.arange(5000.0))
    assert (table.get(key) == np.arange(5000.0)).all()
    assert np.isnan(table.get(key + np.uint64(1 << 61))).all()


def test_better_than_chance_on_held_out_text(spark, small):
    rows = [r for r in lm.scores(spark.read.parquet(f"{small}/documents.parquet")).collect() if r["held_out"]]
    assert sum(r["bits_per_byte"] for r in rows) / len(rows) < 3.5


def peak_bytes(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_a_block():
    key = np.random.default_rng(0).integers(0, 1 << 48, 1 << 17).astype(np.uint64)
    key = np.unique(key)
    assert peak_bytes(lambda: lm.Lookup(key, np.ones(len(key)))) < 64 * len(key)
    block = lm.words_of(pa.array(["some words of one text " * 40] * 1000))
    strings = lm.strings_of(block, 5)[0]
    assert peak_bytes(lambda: lm.strings_of(block, 5)) < 24 * len(strings)
    key = np.unique(strings)
    table = lm.Lookup(key, np.ones(len(key)))
    assert peak_bytes(lambda: lm.values_of(block, 5, table)) < 24 * len(strings)


def test_pieces_of_a_block_equal_the_whole(monkeypatch):
    block = lm.words_of(pa.array(["One text", "", None, "a", "äö one text one", "one text"]))
    strings, ends = lm.strings_of(block, 3)
    key = np.unique(strings)
    table = lm.Lookup(key[::2], np.arange(1.0, 1 + len(key[::2])))
    for piece in (1, 3, 1000):
        monkeypatch.setattr(lm, "PIECE", piece)
        value, rare, rare_strings, stops = lm.values_of(block, 3, table)
        whole = table.get(strings)
        assert (value == np.nan_to_num(whole)).all() and (stops == ends).all()
        assert (rare == np.flatnonzero(np.isnan(whole))).all() and (rare_strings == strings[rare]).all()


def test_workers_get_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    long_texts = spark.range(0, 4000, 1, 1).selectExpr("repeat('word ', 2000) AS text")
    before = spark.conf.get(name, None)
    with lm.small_batches(spark):
        rows = long_texts.mapInArrow(sizes, "n long").collect()
    assert max(r["n"] for r in rows) < 2 * lm.BATCH_BYTES
    assert spark.conf.get(name, None) == before
