import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from studysift.llm import trie
from tests.llm.cases import words as split_words

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuild(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def expected(rows):
    convs = rebuild(rows)
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        own = (len(members[node]) - 1) * (len(split_words(node[-1][1])) if node else 0)
        saved[node] = own + sum(saved[k] for k in children[node])
    return sorted(
        (
            min(members[n]), len(n), min(members[n[:-1]]) if n else -1, len(members[n]), len(children[n]), leaves[n],
            saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest(),
        )
        for n in members
    )


def result(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def chats(seed, convs=150):
    rng = random.Random(seed)
    lines = ["hello there", "hello", "", None, "what is  this\t", "a b c d", "yes", "no \x0b no"]
    rows = []
    for c in range(convs):
        conv = rng.randrange(400) if c % 3 else c
        if any(r[0] == conv for r in rows):
            continue
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            text = rng.choice(lines[: 2 + turn]) if rng.random() < 0.9 else f"turn {rng.randrange(50)}"
            rows.append((conv, turn if turn else rng.choice([None, 0]), rng.choice(["user", "user", "bot", None]), text))
    copied = [r for r in rows if r[0] == rows[0][0]]
    rows += [(1000 + i, *r[1:]) for i in range(40) for r in copied]
    rows += [(None, 1, "user", "nobody's")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_rows,task_rows", [(0, 50), (6, 40), (10**9, 10**9)])
def test_against_plain_trie(spark, shard_rows, task_rows):
    rows = chats(shard_rows % 7)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", depth long, f1 long")
    assert result(trie.prefix_trie(df, shard_rows, task_rows)) == expected(rows)


def test_given_conversations(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert result(trie.prefix_trie(df)) == expected(rows)


def test_long_and_repeated(spark):
    """One conversation with most of all turns, another equal to it but for its end, repeated rows."""
    rows = [(20, i, "user", f"w {i % 7}") for i in range(9000)]
    rows += [(40, i, "user", f"w {i % 7}") for i in range(9000)] + [(40, 9000, "bot", "end")]
    rows += [(60, 0, "user", "same")] * 4
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["depth"], r["conv_id"]): r for r in trie.prefix_trie(df, 3000, 4000).collect()}
    assert len(got) == 1 + 9001 + 4
    root = got[0, 20]
    assert (root["n_convs"], root["n_children"], root["n_leaves"]) == (3, 2, 2)
    assert root["saved_tokens"] == 2 * 9000
    assert got[9001, 40]["parent_conv_id"] == 20 and got[9000, 20]["n_children"] == 1
    assert got[4, 60]["n_leaves"] == 1 and got[5, 20]["n_convs"] == 2


def test_empty(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_double_array():
    """Every sequence is found by BASE and CHECK, and no two states share a place."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 9, 300)
    codes = rng.integers(1, 30, sizes.sum())
    starts = np.cumsum(sizes) - sizes
    base, check, end = trie.place(codes, starts, sizes)
    by_path = {}
    for i in range(len(sizes)):
        state, path = 0, ()
        for code in codes[starts[i] : starts[i] + sizes[i]]:
            path += (int(code),)
            to = base[state] + code
            assert check[to] == state
            state = to
            assert by_path.setdefault(path, state) == state
        assert state == end[i]
    assert len(set(by_path.values())) == len(by_path) == (check >= 0).sum() - 1
