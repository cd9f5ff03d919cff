import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from studysift.llm import minhash
from tests.llm.cases import ODD, empty, odd
from tests.llm.cases import words as split_words


def shingles(text):
    w = split_words(text)
    if not w:
        return set()
    return {" ".join(w)} if len(w) < 3 else set(zip(w, w[1:], w[2:]))


def expected(docs):
    """``(doc_id, set size, component)`` by all pairs."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)), key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < share / 3 else [f"new{rng.randrange(10**6)}"] if x < 2 * share / 3 else [w]
        if x > 1 - share / 3:
            out.append(f"more{rng.randrange(10**6)}")
    return out


def families(seed):
    """Originals with copies of many degrees, and texts that share a long part but are not similar."""
    rng = random.Random(seed)
    docs = []
    for _ in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 2, 3, 8, 60, 400]))]
        docs.append(words)
        docs += [edited(rng, words, rng.choice([0, 0.005, 0.02, 0.04, 0.08])) for _ in range(12)]
    frame = [f"f{i}" for i in range(150)]
    docs += [frame + [f"p{rng.randrange(10**6)}" for _ in range(rng.choice([15, 25, 60]))] for _ in range(60)]
    rows = [(i, rng.choice([" ", "\t", "  \n"]).join(w).upper()) for i, w in enumerate(docs)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,rounds", [(1, 3), (2, 1)])
def test_against_all_pairs(spark, monkeypatch, seed, rounds):
    monkeypatch.setattr(minhash, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    docs = families(seed)
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, row long, n int")
    want = expected(docs)
    assert result(minhash.near_duplicates(df)) == want
    assert len({c for _, _, c in want}) < 0.8 * len(docs)


def test_given_documents(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert result(minhash.near_duplicates(df)) == expected(docs)


def test_odd_and_empty(spark):
    got = result(minhash.near_duplicates(odd(spark)))
    docs = [(i, t) for i, t, _ in ODD]
    want = [(d, n, d if not n else c) for d, n, c in expected(docs)]
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(empty(spark)).count() == 0
    kept = [r["doc_id"] for r in minhash.drop_near_duplicates(odd(spark)).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 3, 4, 6, 7, 9, 10, None, 11, 12, 13], key=str)


def test_sketch_fills_every_coordinate_and_estimates():
    """No coordinate stays empty, the sketch of a union is the smaller one everywhere, and agreement is the similarity."""
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    sizes = np.array([1, 2, 7, 100, 160, 5000, 20_000])
    out = minhash.sketches(np.concatenate([pool[:n] for n in sizes]), sizes)
    assert (out != minhash.EMPTY).all()
    one = minhash.sketches(pool[:300], np.array([300]))
    two = minhash.sketches(pool[100:400], np.array([300]))
    both = minhash.sketches(pool[:400], np.array([400]))
    assert (np.minimum(one, two) == both).all()
    gaps = []
    for at in range(0, 16_000, 400):
        a, b = pool[at : at + 360], pool[at + 40 : at + 400]
        pair = minhash.sketches(np.concatenate([a, b]), np.array([360, 360]))
        gaps.append((pair[0] == pair[1]).mean() - 320 / 400)
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.04


def test_large_group_of_near_copies(spark):
    """Copies that are similar to their original and not to each other are one component, whatever their number."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    docs = [(500, " ".join(words))]
    for i in range(400):
        own = list(words)
        for at in rng.sample(range(300), 5):
            own[at] = f"x{i}-{at}"
        docs.append((i, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["component_id"] for r in minhash.near_duplicates(df).collect()} == {0}


def test_rare_shingles_miss_no_similar_pair(spark):
    """Every similar pair of rows in different components is among the pairs, and copies with many own changes make none."""
    docs = [(i, shingles(t)) for i, t in families(4) if t.strip()]
    ids = {s: n for n, s in enumerate(sorted({x for _, ss in docs for x in ss}, key=str))}
    hashes = spark.createDataFrame([(i, [ids[x] for x in ss]) for i, ss in docs], "row long, hashes array<long>")
    left = hashes.select(F.lit(1).alias("key"), "row", F.size("hashes").cast("long").alias("n"), F.col("row").alias("root"))
    got = {tuple(sorted(r)) for r in minhash._by_rare_shingles(left, hashes, 85).collect()}
    sets = dict(docs)
    near = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert near <= got and len(near) > 100
    base = list(range(1000))
    rows = [(i, base[: 900 - i % 3] + [10_000 + 200 * i + j for j in range(110)]) for i in range(60)]
    hashes = spark.createDataFrame(rows, "row long, hashes array<long>")
    left = hashes.select(F.lit(1).alias("key"), "row", F.size("hashes").cast("long").alias("n"), F.col("row").alias("root"))
    assert minhash._by_rare_shingles(left, hashes, 85).count() == 0
