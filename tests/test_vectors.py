import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from studysift.operators import joins as jn
from studysift.operators import selection as sel
from studysift.operators import vectorise as vz
from studysift.operators.storage import stored

WORDS = "alpha beta gamma delta eps zeta the of".split()


def corpus(n=40, seed=3):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS, weights=[1, 1, 1, 1, 1, 1, 9, 5], k=rng.randint(2, 12))), i % 3 == 0)
            for i in range(n)]
    return [(i, t, int(label)) for i, t, label in rows] + [(n, "", 1), (n + 1, "a", 0)]


def grams(text):
    w = [x for x in text.lower().split() if len(x) > 1]
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, content string, label int").repartition(3)


def brute_weights(rows, train_ids):
    tf = {i: Counter(grams(t)) for i, t, _ in rows}
    df = Counter(t for i in train_ids for t in tf[i])
    idf = {t: math.log((1 + len(train_ids)) / (1 + d)) + 1 for t, d in df.items()}
    out = {}
    for i, counts in tf.items():
        raw = {t: c * idf[t] for t, c in counts.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out.update({(i, t): x / norm for t, x in raw.items()})
    return out


def test_term_counts(docs):
    got = {(r.doc_id, r.term): r.tf for r in vz.term_counts(docs).collect()}
    want = {(i, t): c for i, text, _ in corpus() for t, c in Counter(grams(text)).items()}
    assert got == want


def test_document_terms_are_distinct(docs):
    rows = [(r.doc_id, r.term) for r in vz.document_terms(docs).collect()]
    assert len(rows) == len(set(rows)) == len({(i, t) for i, text, _ in corpus() for t in grams(text)})


@pytest.mark.parametrize("rows_per_key", [1, 4, None])
def test_tfidf_against_brute_force(docs, rows_per_key):
    train = docs.where("doc_id < 30")
    weights = vz.tfidf(vz.term_counts(docs), vz.fit_idf(train), rows_per_key)
    got = {(r.doc_id, r.term): r.v for r in weights.collect()}
    want = brute_weights(corpus(), range(30))
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_norms_are_one_and_partitions_do_not_matter(spark, docs):
    def run(parts):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            w = vz.tfidf(vz.term_counts(docs.repartition(int(parts))), vz.fit_idf(docs))
            return sorted((r.doc_id, r.term, round(r.v, 9)) for r in w.collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")

    one, many = run("1"), run("16")
    assert one == many
    norms = defaultdict(float)
    for i, _, v in one:
        norms[i] += v * v
    assert all(abs(x - 1) < 1e-6 for x in norms.values())


def test_min_df(docs):
    kept = vz.fit_idf(docs, min_df=5).collect()
    assert kept and min(r.df for r in kept) >= 5


def dense(rows):
    weights = brute_weights(rows, [i for i, _, _ in rows])
    terms = sorted({t for _, t in weights})
    x = np.zeros((len(rows), len(terms)))
    for (i, t), v in weights.items():
        x[i, terms.index(t)] = v
    return terms, x, np.array([label for _, _, label in rows])


def brute_scores(name, x, y):
    n, n1, n0 = len(y), (y == 1).sum(), (y == 0).sum()
    out = []
    for col in x.T:
        a, b = col[y == 1], col[y == 0]
        if name == "affinity":
            d, d1, d0 = (col > 0).sum(), (a > 0).sum(), (b > 0).sum()
            out.append(d1 / (n1 + d - d1) - d0 / (n0 + d - d0))
        elif name == "chi2":
            e1, e0 = col.sum() * n1 / n, col.sum() * n0 / n
            out.append((a.sum() - e1) ** 2 / e1 + (b.sum() - e0) ** 2 / e0)
        elif name == "anova":
            between = n1 * (a.mean() - col.mean()) ** 2 + n0 * (b.mean() - col.mean()) ** 2
            within = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
            out.append(between / (within / (n - 2)))
        else:
            out.append(np.corrcoef(col, y)[0, 1])
    return out


@pytest.mark.parametrize("name", list(sel.SCORERS))
def test_scores_against_brute_force(docs, name):
    features = vz.tfidf(vz.term_counts(docs, keep=("doc_id", "label")), vz.fit_idf(docs))
    stats = sel.term_statistics(features)
    got = {r.term: r.score for r in sel.score_terms(stats, sel.class_sizes(docs), name).collect()}
    terms, x, y = dense(corpus())
    for term, score in zip(terms, brute_scores(name, x, y)):
        assert abs(got[term] - score) < 2e-6, term


def test_custom_scorer(docs):
    stats = sel.term_statistics(vz.document_terms(docs, keep=("doc_id", "label")), value=None)
    got = sel.score_terms(stats, sel.class_sizes(docs), lambda n1, n0: F.col("d1") / n1).collect()
    assert max(r.score for r in got) <= 1.0


def test_zero_variance_scores(spark):
    rows = [("sep", 2, 0, 2.0, 0.0, 2.0, 0.0), ("flat", 2, 2, 2.0, 2.0, 2.0, 2.0)]
    stats = spark.createDataFrame(rows, "term string, d1 int, d0 int, s1 double, s0 double, q1 double, q0 double")
    sizes = F.struct(F.lit(2).alias("n1"), F.lit(2).alias("n0"))
    scores = {r.term: r.score for r in sel.score_terms(stats, sizes, "anova").collect()}
    assert scores["sep"] == float("inf") and scores["flat"] is None
    assert sel.score_terms(stats, sizes, "pearson").where("term = 'flat'").first()["score"] is None
    best = sel.select_k_best(sel.score_terms(stats, sizes, "anova"), 10).collect()
    assert [(r.rank, r.term) for r in best] == [(1, "sep"), (2, "flat")]


def test_ties_go_to_the_last_term(spark):
    scores = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", None), ("d", 0.5)], "term string, score double")
    best = sel.select_k_best(scores, 3).collect()
    assert [r.term for r in best] == ["b", "a", "d"]


def test_vectors_are_sparse_and_not_renormalised(spark):
    studies = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, title string")
    features = spark.createDataFrame([(1, "a", 0.6), (1, "b", 0.8)], "doc_id long, term string, v double")
    best = spark.createDataFrame([(1, "b", 1.0), (2, "z", 0.5)], "rank int, term string, score double")
    got = {r.doc_id: r.features for r in sel.feature_vectors(studies, features, best, 5).collect()}
    assert got[1].size == 5 and dict(zip(got[1].indices, got[1].values)) == {0: 0.8}
    assert got[2].numNonzeros() == 0


def test_small_scores_are_told_apart(spark):
    scores = spark.createDataFrame([("a", 3e-9), ("b", 5e-9), ("z", 1e-9), ("y", None), ("x", 5e-9)], "term STRING, score DOUBLE")
    assert [r.term for r in sel.select_k_best(scores, 4).collect()] == ["x", "b", "a", "z"]


def test_whole_vocabulary_without_selection(spark):
    features = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.25), (2, "c", 1.0)], "doc_id INT, term STRING, v DOUBLE")
    best = sel.all_terms(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "term STRING, df LONG"))
    assert sorted(r["rank"] for r in best.collect()) == [1, 2, 3]
    studies = spark.createDataFrame([(1,), (2,), (3,)], "doc_id INT")
    rows = sel.feature_vectors(studies, features, best, 3, bounded=False).collect()
    assert sorted((r.doc_id, round(float(sum(r.features.toArray())), 3)) for r in rows) == [(1, 0.75), (2, 1.0), (3, 0.0)]


@pytest.mark.parametrize("rows_per_key", [1, None])
def test_term_store_gives_the_same_weights_and_scores(spark, docs, rows_per_key):
    """Norms and class sums from the store agree with the weights written out, for training rows and others."""
    store = vz.term_store(docs.withColumn("split", F.expr("IF(doc_id < 30, 'train', 'test')")), keep=("doc_id", "label", "split"))
    in_train = F.col("split") == "train"
    vocabulary = vz.vocabulary_of(store, in_train)
    want = brute_weights(corpus(), range(30))
    norms = vz.norms(store, vocabulary, rows_per_key)
    assert {r.term: r.n for r in vocabulary.collect()} == Counter(t for _, t in want)
    rows = vz.weighed(vz.exploded(store), vocabulary, rows_per_key).join(norms, "doc_id")
    got = {(r.doc_id, r.term): r.w / r.norm for r in rows.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    sums = {r.term: r for r in sel.class_sums(store, norms, 30, in_train).collect()}
    labels = {i: label for i, _, label in corpus()}
    assert sums.keys() == {t for _, t in want}
    for term, r in sums.items():
        own = [(want[i, t], labels[i]) for i, t in want if t == term and i < 30]
        assert abs(r.s1 - sum(v for v, c in own if c)) < 1e-12 and abs(r.q0 - sum(v * v for v, c in own if not c)) < 1e-12
        assert (r.d1, r.d0) == (sum(c for _, c in own), sum(1 - c for _, c in own))
    best = spark.createDataFrame([(1, "the", 0.0), (2, "alpha beta", 0.0)], "rank int, term string, score double")
    for bounded in (True, False):
        made = sel.chosen_vectors(docs, store, norms, vocabulary, best, 2, bounded)
        for r in made.collect():
            expected = {i: want[r.doc_id, t] for i, t in enumerate(("the", "alpha beta")) if (r.doc_id, t) in want}
            assert {e["_i"]: round(e["v"], 12) for e in r.entries} == {i: round(v, 12) for i, v in expected.items()}
            assert r.features.toArray().tolist() == pytest.approx([expected.get(i, 0.0) for i in range(2)])


def test_split_join_bounds_every_key(spark):
    """A key with more rows than the limit meets its table row in several parts, and no row is lost or doubled."""
    rows = spark.range(5000).selectExpr("id AS doc_id", "IF(id % 5 = 0, concat('t', id), 'hot') AS term")
    sizes = stored(rows.groupBy("term").agg(F.count("*").alias("n")), "sizes")
    table = sizes.select("term", F.length("term").alias("x"))
    joined = jn.join_split(rows, table, ["term"], sizes, rows_per_key=100)
    assert joined.count() == 5000 and joined.where("x <> length(term)").isEmpty()
    assert joined.columns == ["term", "doc_id", "x"]
    plan = joined._jdf.queryExecution().toString()
    assert "_part" in plan and "_part" not in jn.join_split(rows, table, ["term"], sizes)._jdf.queryExecution().toString()
    assert jn.rows_per_key_limit(10**13) * jn.MOST_SPLIT >= 10**13
    left = jn.join_split(rows, table.where("term = 'hot'"), ["term"], sizes, rows_per_key=100, how="left")
    assert left.count() == 5000 and left.where("x IS NULL").count() == 1000


def test_frequent_keys_are_known_from_sketches(spark):
    """Every key above the limit is named with at least its count, in any layout; the rest are left out."""
    rows = spark.range(60_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 50 = 1 THEN 'b' ELSE concat('t', id) END AS term")
    for parts in (1, 7):
        found = {r.term: r.n for r in jn.frequent_keys(rows.repartition(parts), "term", 500).collect()}
        assert found.keys() == {"a", "b"} and found["a"] >= 20_000 and found["b"] >= 800
    assert jn.frequent_keys(rows.where("false"), "term").count() == 0


@pytest.mark.parametrize("documents_per_term", [1, 1000])
def test_term_store_carries_frequencies_and_is_shuffled_once(docs, documents_per_term):
    """Weights and norms follow from the store's own rows: no long row is joined by key or shuffled again."""
    marked = docs.withColumn("mark", F.expr("IF(doc_id < 30, label, null)"))
    known = F.col("mark").isNotNull()
    store = vz.term_store(marked, keep=("doc_id", "mark"), in_train=known, documents_per_term=documents_per_term)
    tf = {i: Counter(grams(t)) for i, t, _ in corpus()}
    df, n = Counter(t for i in range(30) for t in tf[i]), Counter(t for c in tf.values() for t in c)
    got = {(r.doc_id, r.term): (r.tf, r.df, r.n) for r in store.collect()}
    assert got == {(i, t): (c, df[t], n[t]) for i, counts in tf.items() for t, c in counts.items()}
    weights = vz.store_tfidf(store, 30)
    want = brute_weights(corpus(), range(30))
    found = {(r.doc_id, r.term): r.v for r in weights.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)
    assert "Exchange hashpartitioning" not in weights._jdf.queryExecution().executedPlan().toString()
    norms = vz.store_norms(store, 30)
    plain = sel.term_statistics(vz.store_tfidf(store, 30).where(known).withColumnRenamed("mark", "label"))
    sums = {r.term: r for r in sel.class_sums(store, norms, 30, known, label="mark").collect()}
    assert sums.keys() == {r.term for r in plain.collect()}
    for r in plain.collect():
        assert all(abs(r[c] - sums[r.term][c]) < 1e-12 for c in ("d1", "d0", "s1", "s0", "q1", "q0"))


@pytest.mark.parametrize("deal, packs", [(1_000_000, 8), (7, 1)])
def test_term_rows_meet_in_packs(spark, monkeypatch, deal, packs):
    """All rows of a term come out of one task, sorted by term, without a sort of the long rows; keys may repeat."""
    monkeypatch.setattr(vz, "TERMS_PER_DEAL", deal)
    monkeypatch.setattr(vz, "PACKS_PER_TASK", packs)
    monkeypatch.setattr(vz, "TERMS_PER_BATCH", 5)
    rows = [(i % 40 if i % 11 else None, t, i % 3 if i % 3 else None) for i, t, _ in corpus()] + [(1, None, 1), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, content string, mark int").repartition(3)
    made = vz._met_by_term(docs, "content", ("doc_id", "mark"), (1, 3), F.col("mark").isNotNull(), 3)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and plan.count("Exchange hashpartitioning") == 1
    tf = [(i, mark, Counter(grams(t or ""))) for i, t, mark in rows]
    df = Counter(t for _, mark, c in tf if mark is not None for t in c)
    n = Counter(t for _, _, c in tf for t in c)
    want = Counter((i, mark, t, k, df[t], n[t]) for i, mark, c in tf for t, k in c.items())
    parts = [[tuple(r) for r in part] for part in made.rdd.glom().collect()]
    assert Counter(r for part in parts for r in part) == want
    terms = [[r[2] for r in part] for part in parts]
    assert terms == [sorted(t) for t in terms] and sum(len(set(t)) for t in terms) == len(n)
    assert vz._met_by_term(docs.where("false"), "content", ("doc_id", "mark"), (1, 3), F.lit(True), 3).count() == 0


def test_counted_terms_are_those_of_the_column_expressions(spark):
    """Words are found by the same pattern whether n-grams are counted in batches or built as a column."""
    odd = ["İstanbul ΣΑΣ Straße", "x² a_b ١٢ é", "été 𝒜bc 東京 a b cd", "", None, "a,bb;bb.bb\nbb", "don't 3.14 x"]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id int, content string")
    words = rows.select("doc_id", vz.tx.vector_words(F.col("content")).alias("w"))
    plain = words.select("doc_id", F.explode(vz.tx.ngrams(F.col("w"), 1, 3)).alias("term")).groupBy("doc_id", "term").count()
    assert {(r.doc_id, r.term, r.tf) for r in vz.term_counts(rows).collect()} == {tuple(r) for r in plain.collect()}
    with pytest.raises(ValueError):
        vz.term_counts(rows, ngram_range=(2, 1))
