import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from studysift.llm import packing
from tests.llm.cases import ODD, empty, odd

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def check_layout(rows, limit=4096):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= limit
    return len(by_sequence)


def test_odd_documents(spark):
    rows = packing.pack_documents(odd(spark), PATH).collect()
    want = []
    for doc_id, text, _ in ODD:
        ids = expected(text)
        for i, start in enumerate(range(0, len(ids), 4096)):
            own = np.array(ids[start : start + 4096], "<u4")
            want.append((doc_id, i, start, len(own), zlib.crc32(own.tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    total = sum(w[3] for w in want)
    assert check_layout(rows) <= -(-total // 4096) + 1


def test_empty(spark):
    assert packing.pack_documents(empty(spark), PATH).count() == 0


def test_small_groups_and_ids(spark):
    docs = spark.createDataFrame([(i, "some words " * (i % 400)) for i in range(600)], "doc_id long, text string")
    packed = packing.pack(packing.stored(packing.tokenised(docs, PATH, with_ids=True), "t"), group=100)
    rows = packed.collect()
    assert len(rows) == 600
    check_layout(rows)
    by_sequence = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in rows:
        assert by_sequence[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]


@pytest.mark.parametrize("seed", range(3))
def test_rule_is_the_sum_of_squares(seed):
    """Each placement leaves the least sum of squared counts of open bins per gap."""
    rng = np.random.default_rng(seed)
    limit, lengths = 40, rng.integers(1, 41, 300)
    where, offset, left = packing.sum_of_squares(lengths, limit)
    counts, room = np.zeros(limit + 1, int), []
    for i in np.argsort(-lengths, kind="stable"):
        size = lengths[i]

        def after(gap):
            c = counts.copy()
            if gap < limit:
                c[gap] -= 1
            if gap - size:
                c[gap - size] += 1
            return (c[1:limit] ** 2).sum()

        options = [g for g in range(size, limit) if counts[g]] + [limit]
        got = limit - offset[i]
        assert got in options and after(got) == min(map(after, options))
        if got < limit:
            counts[got] -= 1
        if got - size:
            counts[got - size] += 1
    assert left.sum() == (left.max(initial=0) >= 0) * (len(left) * limit - lengths.sum())


def test_few_sequences():
    lengths = np.random.default_rng(1).geometric(1 / 900, 8000).clip(1, 4096)
    _, _, left = packing.sum_of_squares(lengths, 4096)
    assert len(left) <= 1.003 * lengths.sum() / 4096 + 1
