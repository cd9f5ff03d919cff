import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from studysift.llm import spelling
from tests.llm.cases import ODD, empty, odd


def counted(rows):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def expected(rows):
    words = counted(rows)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def corpus(seed, n=400):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    docs = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = stems[min(int(rng.expovariate(0.08)), 59)]
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + "d" + w[at + 1 :]])
            words.append(w.capitalize() if rng.random() < 0.2 else w)
        docs.append((i if i % 50 else None, rng.choice([" ", ", ", "1"]).join(words) if i % 40 else None))
    docs += [(1000 + i, "chainx " * 6 + "chainxy " * (i < 8) * 5 + "chainxyz" * (i < 7)) for i in range(60)]
    return docs


@pytest.mark.parametrize("symbols", [4, 8])
def test_against_all_pairs(spark, monkeypatch, symbols):
    monkeypatch.setattr(spelling, "SYMBOLS", (symbols,))
    docs = corpus(symbols)
    want = expected(docs)
    got = spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(got) == want and len(want) > 100
    assert any(w != form != root for w, form, root, *_ in want if form)


def test_given_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(spelling.spelling_variants(docs)) == expected(rows)


def test_odd_and_empty(spark):
    docs = odd(spark).unionByName(odd(spark))
    rows = [(i, t) for i, t, _ in ODD] * 2
    assert rows_of(spelling.spelling_variants(docs)) == expected(rows)
    assert spelling.spelling_variants(empty(spark)).count() == 0


def test_neighbourhood_is_whole():
    """Every string one edit away is made, in blocks or at once, and nothing twice but by deletion."""
    rng = random.Random(3)
    for length in (1, 2, 6, 11):
        word = "".join(rng.choice("abcd") for _ in range(length))
        around = {word}
        for i in range(length + 1):
            around |= {word[:i] + c + word[i:] for c in "abcd"}
            around |= {word[:i] + c + word[i + 1 :] for c in "abcd" if i < length}
            around |= {word[:i] + word[i + 1 :]} if i < length else set()
        want = {int(spelling._keys(spelling._codes([w]))[0]) if w else 0 for w in around}
        for cells in (4, 1 << 20):
            spelling.CELLS, kept = cells, spelling.CELLS
            found = np.concatenate([k for _, k in spelling.neighbourhood(spelling._codes([word]), 4)]).tolist()
            spelling.CELLS = kept
            assert set(found) == want and len(found) == len(want)


def test_very_long_run(spark):
    run = "abcdefghij" * 3000
    docs = spark.createDataFrame([(i, run + ("k" if i % 2 else "")) for i in range(60)], "doc_id long, text string")
    rows = rows_of(spelling.spelling_variants(docs))
    assert {(len(w), n_near) for w, _, _, _, n_near, _ in rows} == {(30_000, 1), (30_001, 1)}
