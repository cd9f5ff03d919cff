from collections import Counter

import pytest

from studysift.llm import suffix_dedup as sd
from tests.llm.cases import ODD, empty, odd, sha


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), (b"\0" + gone).count(b"\0\1"), sha(kept)))
    return out


def compare(docs, rows, group=1000):
    found = sd.remove_repeats(docs, group).collect()
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found]
    want = [(i, *w) for i, w in zip([r[0] for r in rows], brute([r[1] for r in rows]))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_odd_documents(spark):
    short = [(i, t if t is None or len(t) < 5000 else t[:5000], lang) for i, t, lang in ODD]
    compare(spark.createDataFrame(short, "doc_id long, text string, lang string"), short)
    assert sd.remove_repeats(odd(spark)).count() == len(ODD)
    assert sd.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("group", [1000, 1])
def test_given_documents(spark, small, group):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    compare(docs, [(r["doc_id"], r["text"]) for r in docs.collect()], group)


def test_edges_of_passages(spark):
    """Passages of just under and over the length, in places of every kind, with surroundings that share a part."""
    import random

    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = noise(260)
    rows = []
    for i, (a, b) in enumerate([(0, 199), (0, 200), (3, 203), (60, 260), (0, 260), (10, 215), (59, 258)]):
        rows.append((i, noise(rng.randint(0, 90)) + shared[a:b] + noise(rng.randint(0, 90))))
    rows += [(20, shared[:120] + noise(30) + shared[120:]), (21, "ab" * 400), (22, "ab" * 101), (23, noise(50) + "xyz" * 90)]
    rows += [(24, noise(40) + "xyz" * 70 + noise(40)), (25, shared), (26, shared[:230] + shared[:230])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compare(docs, rows)
    compare(docs, rows, 1)


def test_kept_text(spark):
    rows = [(1, "a" * 300), (2, "unlike anything else")]
    found = {r["doc_id"]: r["kept"] for r in sd.remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert found == {1: b"", 2: b"unlike anything else"}


def test_intervals_of_a_known_tree():
    # banana: suffixes a, ana, anana, banana, na, nana
    assert sorted(sd.intervals([0, 1, 3, 0, 0, 2])) == [(0, 0, 5), (1, 0, 2), (2, 4, 5), (3, 1, 2)]


def test_left_extensions_tell_repeats_apart():
    members = [(b"ba", b"xyz"), (b"bc", b"xyz"), (b"bc", b"xyw")]
    found = {(left, right, tuple(sorted(m))) for left, right, m in sd.maximal_repeats(members, 4)}
    assert found == {(1, 3, (0, 1)), (2, 2, (1, 2))}
