import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from studysift.operators import neighbours as nb
from studysift.operators import sparse_neighbours as sn

ROWS = "doc_id long, entries array<struct<_i:int,v:double>>"


def sparse_rows(seed, n, width=40, most=12):
    """Rows of few non-zero values; frequent dimensions, copies, rows without values and one row with all of them."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        at = np.unique((rng.random(rng.integers(0, most)) ** 3 * width).astype(int))
        rows.append((i, [(int(j), float(rng.choice([0.1, 0.25, 0.5, round(rng.random(), 3)]))) for j in at]))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, []), (n + 3, [(j, 0.2) for j in range(width)])]
    return rows


def nearest(train, queries, k, manhattan, exclude):
    out = {}
    for q, a in queries:
        a, gaps = dict(a), []
        for i, b in train:
            if exclude and i == q:
                continue
            b = dict(b)
            parts = [abs(a.get(j, 0) - b.get(j, 0)) for j in a.keys() | b.keys()]
            gaps.append((round(sum(parts) if manhattan else sum(p * p for p in parts), 12), i))
        out[q] = [i for _, i in sorted(gaps)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query"], []).append(r["neighbour"])
    return out


@pytest.mark.parametrize("metric,exclude,postings", [
    ("euclidean", False, 4096), ("euclidean", True, 7), ("manhattan", False, 7), ("manhattan", True, 4096), ("minkowski", True, 4096),
])
def test_sparse_neighbours_are_exact(spark, monkeypatch, metric, exclude, postings):
    monkeypatch.setattr(sn, "POSTINGS", postings)
    train = sparse_rows(1, 150)
    queries = train if exclude else [(1000 + i, e) for i, e in sparse_rows(2, 60, width=50)]
    got = sn.k_nearest_sparse(spark.createDataFrame(train, ROWS), spark.createDataFrame(queries, ROWS), 4, "doc_id", metric, exclude)
    assert found(got) == nearest(train, queries, 4, metric == "manhattan", exclude)


@pytest.mark.parametrize("metric,exclude", [("euclidean", False), ("euclidean", True), ("manhattan", True), ("manhattan", False)])
def test_sparse_blocks_are_exact(spark, monkeypatch, metric, exclude):
    """Where the bound rules out little both sides are compared in blocks: no pair is written out, results are the same."""
    monkeypatch.setattr(sn, "VISITED", 0)
    monkeypatch.setattr(sn, "BLOCK_ROWS", 40)
    monkeypatch.setattr(sn, "HEAD", 8)
    monkeypatch.setattr(sn, "candidates", None)
    rows = sparse_rows(1, 150)
    train = rows + [(2000 + i, e) for i, e in rows[:30]]
    queries = train if exclude else [(1000 + i, e) for i, e in sparse_rows(2, 60, width=50)]
    got = sn.k_nearest_sparse(spark.createDataFrame(train, ROWS), spark.createDataFrame(queries, ROWS), 4, "doc_id", metric, exclude)
    assert found(got) == nearest(train, queries, 4, metric == "manhattan", exclude)


@pytest.mark.parametrize("codes,whole", [(1024, 2048), (12, 20), (1, 30)])
def test_sparse_manhattan_blocks_are_compared_by_lower_bounds(monkeypatch, codes, whole):
    """Frequent dimensions of one or more cuts give bounds, as far as there is room; rare ones and copies count all the same."""
    for name, value in {"HEAD": 16, "TILE_ROWS": 32, "MOST_CODES": codes, "MOST_WHOLE": whole}.items():
        monkeypatch.setattr(sn, name, value)
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(600):
        at = np.flatnonzero(rng.random(60) < np.r_[np.linspace(0.9, 0.1, 30), np.full(30, 0.01)])
        rows.append((at, np.where(rng.random(len(at)) < 0.3, 0.25, np.round(rng.random(len(at)), 3))))
    rows[7] = rows[450]
    rows[8] = np.array([], int), np.array([])
    b = pd.DataFrame([(j, 1000 + j, i, v, v.sum()) for j, (i, v) in enumerate(rows)], columns=["kind", "id", "i", "v", "nx"])
    asked = [rows[j] for j in (7, 8, 450, *range(100, 140))] + [(np.array([2, 70, 90]), np.array([0.5, 0.1, 0.2]))]
    a = pd.DataFrame([(j, i, v, v.sum()) for j, (i, v) in enumerate(asked)], columns=["query", "i", "v", "nq"])
    assert sn._mostly_frequent(np.concatenate([i for i, _ in rows]), 600) or whole < 60
    monkeypatch.setattr(sn, "_mostly_frequent", lambda dims, n: False)
    want = sn._nearest_in_block(a, b, 5, True)
    monkeypatch.setattr(sn, "_mostly_frequent", lambda dims, n: True)
    compared = []
    plain = nb.Floors.plain
    monkeypatch.setattr(nb.Floors, "plain", lambda self, z, at: compared.append(len(at)) or plain(self, z, at))
    got = sn._nearest_in_block(a, b.sample(frac=1, random_state=1), 5, True)
    pd.testing.assert_frame_equal(got, want)
    assert codes < 1024 or np.mean(compared) < 100
    # values that single precision cannot hold are compared as before
    a.loc[0, "nq"] = 1e300
    assert len(sn._nearest_in_block(a, b, 5, True)) == len(want)


def test_sparse_with_few_or_no_rows(spark):
    train = spark.createDataFrame([(1, [(0, 1.0)]), (2, [])], ROWS)
    queries = spark.createDataFrame([(7, [(0, 0.9), (5, 0.1)]), (8, [])], ROWS)
    assert found(sn.k_nearest_sparse(train, queries, 5)) == {7: [1, 2], 8: [2, 1]}
    assert sn.k_nearest_sparse(train.where("false"), queries, 5).count() == 0
    assert sn.k_nearest_sparse(train, queries.where("false"), 5).count() == 0


def test_only_postings_within_reach_are_visited(spark):
    """A query whose bound is 0 goes to its rarest dimension only, and of its postings only what may equal it is met."""
    rng = np.random.default_rng(3)
    rows = [(i, [(0, 0.3), (1, 0.3)] + [(int(j), 0.5) for j in sorted(rng.choice(np.arange(2, 400), 4, False))]) for i in range(500)]
    train = spark.createDataFrame(rows, ROWS)
    queries = spark.createDataFrame([(9000 + i, e) for i, e in rows[:50]], ROWS)
    size = sn._size(False)
    known = train.select(F.col("doc_id").alias("id"), "entries", size.alias("nx"))
    postings = known.select("id", "nx", F.inline("entries")).withColumnsRenamed({"_i": "i", "v": "x"})
    asked = queries.select(F.col("doc_id").alias("query"), size.alias("nq"), F.inline("entries")).withColumnsRenamed({"_i": "i", "v": "q"})
    terms = postings.groupBy("i").agg(F.count("*").alias("n"), F.max("x").alias("top"))
    bound = asked.select("query").distinct().withColumn("bound", F.lit(0.0))
    visited = sn.visits(asked, terms, bound, False)
    assert visited.count() == 50 and visited.where("i < 2").isEmpty()
    assert sn.candidates(visited, postings, terms, False).count() < 50 * 20
    least = known.orderBy("nx", "id").limit(1).select("id", "nx")
    upper = {r["query"]: r["bound"] for r in sn.bounds(asked, postings, least, 1, False).collect()}
    assert len(upper) == 50 and all(0 <= b <= 2 * 1.18 for b in upper.values())


def test_entries_of_an_array(spark):
    df = spark.createDataFrame([([0.0, 2.0, 0.0, 1.5],)], "x array<double>")
    assert [tuple(e) for e in df.select(sn.sparse_entries(F.col("x")).alias("e")).first()["e"]] == [(1, 2.0), (3, 1.5)]


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 3, (30, width))
    return middles[rng.integers(0, 30, n)] + rng.normal(0, 1, (n, width))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_rough_distances_choose_and_plain_ones_decide(spark, monkeypatch, metric):
    """Far from the origin fast distances are off, within the error that is named; copies and rows of one's own key stay right."""
    monkeypatch.setattr(nb, "HEAD", 4)
    rng = np.random.default_rng(4)
    x = np.repeat(1e5 + rng.normal(0, 1e-2, (120, 6)), 2, axis=0)
    full = nb._distances(x[:9], x, metric)
    rough, error = nb._rough(x[:9], nb._prepared(x, metric), metric)
    assert (np.abs(rough - (full if metric == "manhattan" else full * full)) <= error[:, None]).all() and rough.shape == full.shape
    rows = [(i // 2 if i < 40 else i, v) for i, v in enumerate(x)]
    a = pd.DataFrame({"_q": [i for i, _ in rows], "_v": [v for _, v in rows]})
    got = nb._best_in_block(a, a.rename(columns={"_q": "_id"}), 3, metric, True)
    gaps = nb._distances(x, x, metric)
    want = []
    for at, (q, _) in enumerate(rows):
        want += [(q, i) for _, i in sorted((gaps[at, j], i) for j, (i, _) in enumerate(rows) if i != q)[:3]]
    assert list(zip(got["query"], got["neighbour"])) == want


def test_manhattan_blocks_are_compared_by_lower_bounds(monkeypatch):
    """One matrix product rules out most rows of a block, and none that is among the k nearest: copies, own rows, ties."""
    monkeypatch.setattr(nb, "HEAD", 64)
    monkeypatch.setattr(nb, "_rough", None)
    rng = np.random.default_rng(6)
    x = np.concatenate([clustered(900, 24, 6), np.full((30, 24), 0.5), rng.integers(0, 2, (70, 24)).astype(float)])
    x[950:960] = x[3]
    asked = np.r_[np.arange(0, 1000, 9), 3, 955, 920, 925]
    a = pd.DataFrame({"_q": asked.astype(float), "_v": list(x[asked])})
    a.loc[4, "_q"] = np.nan  # a key that is null
    b = pd.DataFrame({"_id": np.arange(1000), "_v": list(x)}).sample(frac=1, random_state=1)
    gaps = nb._distances(x[asked], x, "manhattan")
    floors, own = nb.Floors(x), [np.zeros(len(asked), int), np.zeros(len(asked), int)]
    near = list(floors.near(x[asked], 4, own))
    assert np.mean([len(rows) for rows in near[:90]]) < 100
    for exclude in (True, False):
        want = []
        for at, q in enumerate(a["_q"]):
            want += [i for _, i in sorted((gaps[at, j], j) for j in range(1000) if not (exclude and j == q))[:4]]
        got = nb._best_in_block(a, b, 4, "manhattan", exclude)
        assert got["neighbour"].tolist() == want
        assert got["distance"].tolist() == [gaps[i // 4, j] for i, j in enumerate(want)]


@pytest.mark.parametrize("odd", [np.nan, np.inf, 1e300])
def test_manhattan_blocks_with_odd_values(monkeypatch, odd):
    """Rows that single precision cannot hold are compared as before, on either side."""
    monkeypatch.setattr(nb, "HEAD", 8)
    x = clustered(200, 6, 7)
    x[5, 2] = x[150, 3] = odd
    for rows, asked in ((x, x[10:20]), (x[6:150], x[:8])):
        a, b = pd.DataFrame({"_q": -np.arange(1, len(asked) + 1), "_v": list(asked)}), pd.DataFrame({"_id": np.arange(len(rows)), "_v": list(rows)})
        got = nb._best_in_block(a, b, 3, "manhattan", True)
        gaps, want = nb._distances(asked, rows, "manhattan"), []
        for at in range(len(asked)):
            best = np.argsort(gaps[at], kind="stable")[:3]
            want += [(-at - 1, i) for i in best if np.isfinite(gaps[at, i])]
        assert list(zip(got["query"], got["neighbour"])) == want


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_approximate_recall(spark, metric):
    """At least nine of ten true neighbours are found, and every row that is returned has its true distance."""
    x = clustered(6000, 24, 5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    asked = df.where("id % 50 = 0")
    exact = {(r["query"], r["neighbour"]): r.distance for r in nb.k_nearest(df, asked, 10, "id", "v", metric, True).collect()}
    near = nb.k_nearest_approx(df, asked, 10, "id", "v", metric, True, bucket_rows=256).collect()
    assert len(near) == 1200
    hit = [r for r in near if (r["query"], r["neighbour"]) in exact]
    assert len(hit) / len(exact) >= 0.9
    assert all(r.distance == pytest.approx(exact[r["query"], r["neighbour"]]) for r in hit)


def test_approximate_with_copies_and_few_rows(spark):
    """Copies that no plane tells apart are dealt into blocks; a query with too few rows in its buckets is answered exactly."""
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(700)] + [(1000 + i, [float(i), 0.0, -5.0 * i]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    asked = df.where("id IN (5, 1029)")
    got = nb.k_nearest_approx(df, asked, 3, "id", "v", exclude_self=True, bucket_rows=50)
    want = nb.k_nearest(df, asked, 3, "id", "v", exclude_self=True)
    assert found(got)[5] == found(want)[5] == [0, 1, 2]
    assert len(found(got)[1029]) == 3
    few = df.where("id < 3")
    assert found(nb.k_nearest_approx(few, few, 5, "id", "v")) == {i: [0, 1, 2] for i in range(3)}
    assert nb.k_nearest_approx(df.where("false"), few, 5, "id", "v").count() == 0
