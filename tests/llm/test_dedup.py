import re
from itertools import combinations

import pytest
import xxhash

from studysift.llm import exact_dedup, simhash
from tests.llm.cases import ODD, empty, odd, sha, words


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("bits", [64, 1])
def test_exact_odd_documents(spark, bits):
    """With hashes of one bit almost all chunks clash, and identifiers need their ordinals."""
    rows = exact_dedup.exact_duplicates(odd(spark), bits).collect()
    groups = {}
    for doc_id, text, _ in ODD:
        groups.setdefault(norm(text), []).append(doc_id)
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            want.append((i, keep, len(ids), first, sha(text)))
            first = False
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(g[3] for g in got) == len(groups)


def test_chunks_make_up_the_text(spark):
    texts = ["", "short", "no blank " * 3, "x" * 10_000, "the den was near a cave and " * 800, "a b c\n" * 2000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", exact_dedup.chunks_of(df["t"]).alias("c")).collect():
        assert "".join(r["c"]) == r["t"]
        assert all(len(c) <= exact_dedup.LONGEST for c in r["c"])


def test_chunks_meet_again_after_an_edit(spark):
    import random

    rng = random.Random(3)
    text = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 8))) for _ in range(9000))
    df = spark.createDataFrame([(text,), ("inserted words " + text,)], "t string")
    one, two = [set(r["c"]) for r in df.select(exact_dedup.chunks_of(df["t"]).alias("c")).collect()]
    assert len(one & two) >= 0.8 * len(one)


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates])
def test_filters_keep_columns_and_one_row_of_each(spark, drop):
    docs = odd(spark)
    kept = drop(docs)
    assert kept.schema == docs.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(8) == 0 and ids.count(1) == 1 and ids.count(None) == 1 and 9 in ids and 10 in ids
    repeated = docs.filter("doc_id = 8")
    assert drop(repeated).count() == 1
    assert drop(empty(spark)).count() == 0


def test_exact_empty(spark):
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


# Near-duplicates


def fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_odd_documents(spark):
    rows = simhash.near_duplicates(odd(spark)).collect()
    prints = [(i, fingerprint(t)) for i, t, _ in ODD]
    assert sorted(((r["doc_id"], r["fingerprint"]) for r in rows), key=str) == sorted(
        ((i, format(f, "016x")) for i, f in prints), key=str
    )
    distinct = {f for _, f in prints}
    near = [(a, b) for a, b in combinations(distinct, 2) if (a ^ b).bit_count() <= 2]
    root = roots(near, distinct)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = [(i, least.get(root[f])) for i, f in prints]
    assert sorted(((r["doc_id"], r["component_id"]) for r in rows), key=str) == sorted(want, key=str)


def test_links_of_a_crowded_ball(spark):
    """Fingerprints so close that buckets hold many: all linked ones end in one component, and no others."""
    import random

    rng = random.Random(5)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = set()
    for centre in (rng.getrandbits(64) for _ in range(6)):
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            found.add(x)
    found |= {rng.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(signed(x),) for x in found], "fp long")
    edges = simhash.links(df)
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    near = [(signed(a), signed(b)) for a, b in combinations(found, 2) if (a ^ b).bit_count() <= 2]
    want = roots(near, {signed(x) for x in found})
    assert all(got.get(x, x) == want[x] for x in want)
    assert edges.count() < 70 * len(found)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert set(got.values()) == {0, 500} and len(got) == 203


def test_simhash_empty(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
