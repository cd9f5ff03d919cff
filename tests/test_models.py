import dataclasses

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from studysift.config import ScreeningConfig
from studysift.operators import folds as fd
from studysift.operators import metrics as mt
from studysift.operators import models as md
from studysift.operators import neighbours as nb
from studysift.operators.stages import TermVectoriser
from studysift.plans import screening as sc
from studysift.plans.analysis import reviewer_agreement, sweep
from studysift.plans.pool import resplit
from studysift.plans.preparation import screen_bibliography
from studysift.sources.bib import LABELLED_FILES
from studysift.sources.records import studies
from studysift.sources.tables import read_result


def points(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, v array<double>")


def brute(train, queries, k, manhattan, exclude):
    out = {}
    for q, a in queries:
        gaps = []
        for i, b in train:
            if exclude and i == q:
                continue
            gap = np.array(a) - np.array(b)
            gaps.append((np.abs(gap).sum() if manhattan else np.sqrt((gap**2).sum()), i))
        out[q] = [i for _, i in sorted(gaps)[:k]]
    return out


@pytest.mark.parametrize("metric", nb.METRICS)
@pytest.mark.parametrize("exclude", [True, False])
def test_neighbours_are_exact(spark, metric, exclude):
    rng = np.random.default_rng(0)
    crowd = rng.normal(0, 0.1, (60, 3))
    rest = rng.normal(0, 5, (50, 3))
    rows = [(i, v) for i, v in enumerate(np.concatenate([crowd, rest, crowd[:10]]))]
    got = nb.k_nearest(
        points(spark, rows), points(spark, rows), 4, "id", "v", metric, exclude, pivots=6, block_rows=16
    ).collect()
    mine = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        mine.setdefault(r.query, []).append(r.neighbour)
    assert mine == brute(rows, rows, 4, metric == "manhattan", exclude)


def test_fewer_training_rows_than_k(spark):
    rows = [(0, [0, 0]), (1, [1, 1])]
    got = nb.k_nearest(points(spark, rows), points(spark, [(9, [0, 1])]), 5, "id", "v").collect()
    assert sorted(r.neighbour for r in got) == [0, 1]


def test_votes(spark):
    near = spark.createDataFrame(
        [(1, 10, 0.0, 1), (1, 11, 1.0, 2), (1, 12, 1.0, 3), (2, 11, 1.0, 1), (2, 10, 2.0, 2)],
        "query long, neighbour long, distance double, rank int",
    )
    labels = spark.createDataFrame([(10, 1), (11, 0), (12, 0)], "neighbour long, label int")
    uniform = {r.query: (r.label, round(r.share, 6)) for r in nb.vote(near, labels).collect()}
    assert uniform == {1: (0, 0.666667), 2: (0, 0.5)}
    weighed = {r.query: (r.label, round(r.share, 6)) for r in nb.vote(near, labels, "distance").collect()}
    assert weighed == {1: (1, 1.0), 2: (0, 0.666667)}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        label = int(i % 3 > 0)
        x = rng.normal(0.8 if label else -0.8, 0.6, 4)
        rows.append((i, i, 2000 + i // 15, label, "selected" if label else "removed", x.tolist()))
    df = spark.createDataFrame(
        rows, "doc_id long, entry_index long, year int, label int, category string, x array<double>"
    )
    return df.withColumn("features", array_to_vector("x")).drop("x").cache()


@pytest.mark.parametrize("name", list(md.REGISTRY))
def test_every_classifier_learns(vectors, name):
    train, test = vectors.where("doc_id < 90"), vectors.where("doc_id >= 90")
    spec = md.REGISTRY[name]
    params = {**spec.best, **({"n_estimators": 10} if name == "rforest" else {}), **({"landmarks": 40} if name == "svm" else {})}
    out = spec.fit(train, params, 42).transform(test)
    assert mt.binary_metrics(out, {"m": "pred"}).first()["f1"] > 0.8
    low, high, n = out.agg(F.min("proba"), F.max("proba"), F.count("*")).first()
    assert 0 <= low < 0.5 < high <= 1 and n == 30


def test_grid_sizes():
    sizes = {name: len(md.candidates(md.REGISTRY[name].full_grid)) for name in ("svm", "rforest", "knn")}
    assert sizes == {"svm": 8000, "rforest": 288, "knn": 66}


def test_grid_search(vectors):
    marked = fd.stratified_folds(vectors, 3)
    grid = {"criterion": ["gini"], "max_depth": [0, 3]}
    results, best = md.grid_search(marked, md.REGISTRY["dt"], grid, "recall_macro")
    assert results.count() == 6 and best == {"criterion": "gini", "max_depth": 3}


def test_year_and_series_validation(vectors):
    spec = md.REGISTRY["dt"]
    years = md.cross_validate_years(vectors, spec, n_splits=2).collect()
    assert sorted(r.fold for r in years) == [1, 2] and all(r.f1_macro > 0.5 for r in years)
    series = md.cross_validate_series(vectors, spec, n_splits=2).collect()
    assert sorted(r.fold for r in series) == [1, 2] and all(0 <= r.threshold <= 0.5 for r in series)


def test_config_checks():
    for bad in ({"k": 0}, {"k": 5001}, {"validation": "x"}, {"scoring": "x"}):
        with pytest.raises(ValueError):
            ScreeningConfig(**bad)


@pytest.mark.parametrize("validation,select", [("none", False), ("grid", True)])
def test_whole_run(spark, small, validation, select):
    config = ScreeningConfig(
        k=50, validation=validation, select_features=select, classifiers=("dt", "gaussianNB"), cv=2
    )
    grids = {"dt": {"max_depth": [2, 3]}, "gaussianNB": {}}
    out = sc.run_screening(studies(spark, small), config, grids)
    test = studies(spark, small).where("split = 'test'").count()
    assert out["predictions"].count() == out["probabilities"].count() == test
    assert {r.classifier for r in out["scores"].collect()} == {"DT", "GAUSSIANNB"}
    for r in out["analysis"].collect():
        assert r.true_negatives + r.true_positives + r.false_negatives + r.false_positives == test
    facts = {r.information: r.value for r in out["test_configuration"].collect()}
    assert facts["Number of features"] == "50" and facts["Pipeline Execution Time (hours)"].startswith("00h:")
    if validation == "grid":
        assert out["validation"].where("classifier = 'dt'").count() == 4
        assert out["parameters"].where("kind = 'tested' and param = 'cv'").count() >= 1


def test_resplit(spark, small):
    out = resplit(studies(spark, small).drop("content"), 42)
    assert sum(r.entries for r in out["sizes"].collect()) == studies(spark, small).count()
    assert out["studies"].where("position = 1").count() == 2


def test_vectoriser_in_a_pipeline(spark, small):
    rows = studies(spark, small)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    stages = [TermVectoriser(k=30, score="chi2", longest=2), LogisticRegression(maxIter=5)]
    out = Pipeline(stages=stages).fit(train).transform(test)
    assert out.count() == test.count() and out.first()["features"].size == 30


def test_tuned_pipeline_is_saved_and_read_back(spark, small, tmp_path):
    rows = studies(spark, small)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    vectoriser = TermVectoriser(score="chi2", longest=1)
    machine = LogisticRegression(maxIter=5)
    grid = ParamGridBuilder().addGrid(vectoriser.k, [5, 20]).build()
    search = CrossValidator(
        estimator=Pipeline(stages=[vectoriser, machine]), estimatorParamMaps=grid, foldCol="part", numFolds=2,
        evaluator=BinaryClassificationEvaluator(),
    )
    model = search.fit(train.withColumn("part", (F.col("doc_id") % 2).cast("int")))
    assert len(model.avgMetrics) == 2
    path = str(tmp_path / "tuned")
    model.bestModel.write().save(path)
    again = PipelineModel.load(path)
    asked = ("doc_id", "prediction", "probability")
    want = sorted(model.bestModel.transform(test).select(*asked).collect())
    assert sorted(again.transform(test).select(*asked).collect()) == want
    vectoriser.write().save(str(tmp_path / "stage"))
    assert TermVectoriser.load(str(tmp_path / "stage")).getOrDefault("longest") == 1
    own = TermVectoriser(k=7, scorer=lambda n1, n0: F.col("d1") / n1)
    assert own.copy().fit(train).best.count() == 7
    with pytest.raises(ValueError):
        own.write()


def test_run_takes_any_vectoriser(spark, small):
    rows = studies(spark, small)
    words = [
        RegexTokenizer(inputCol="content", outputCol="words"),
        HashingTF(inputCol="words", outputCol="features", numFeatures=64),
    ]
    config = ScreeningConfig(validation="years", n_splits=2, classifiers=("gaussianNB",))
    for stage in (Pipeline(stages=words), TermVectoriser(k=20)):
        out = sc.run_screening(rows, config, vectoriser=stage)
        assert out["predictions"].count() == rows.where("split = 'test'").count()
        assert out["validation"].count() == 6


def test_fold_sums_equal_separate_fits(vectors):
    """One pass for all folds gives what a fit on each fold's own training rows gives, in every validation."""
    shared = md.REGISTRY["gaussianNB"]
    apart = dataclasses.replace(shared, shared=None)
    for params in ({}, {"var_smoothing": 0.1}):
        for validate in (md.cross_validate_years, md.cross_validate_series):
            one, many = ([tuple(r) for r in validate(vectors, s, params, 3).sort("fold").collect()] for s in (shared, apart))
            assert len(one) == len(many) == 3 and all(a == pytest.approx(b) for a, b in zip(one, many))
    marked = fd.stratified_folds(vectors, 3)
    for scoring in ("f1", "f1_macro", "roc_auc"):
        grid = {"var_smoothing": [1e-9, 0.5]}
        (a, best_a), (b, best_b) = (md.grid_search(marked, s, grid, scoring) for s in (shared, apart))
        key = lambda r: (r.candidate, r.fold)
        assert [r.score for r in sorted(a.collect(), key=key)] == pytest.approx([r.score for r in sorted(b.collect(), key=key)])
        assert best_a == best_b


def test_bayes_by_hand(vectors):
    """Means, variances and priors of two classes, the usual Gaussian rule."""
    rows = vectors.collect()
    train, test = [r for r in rows if r.doc_id < 90], [r for r in rows if r.doc_id >= 90]
    x = {c: np.array([r.features.toArray() for r in train if r.label == c]) for c in (0, 1)}
    widest = np.concatenate(list(x.values())).var(axis=0).max()
    odds = []
    for c in (1, 0):
        spread = x[c].var(axis=0) + 1e-9 * widest
        asked = np.array([r.features.toArray() for r in test])
        odds.append(np.log(len(x[c])) - 0.5 * (np.log(spread) + (asked - x[c].mean(axis=0)) ** 2 / spread).sum(axis=1))
    got = md.fit_bayes(vectors.where("doc_id < 90"), {}, 1).transform(vectors.where("doc_id >= 90")).sort("doc_id").collect()
    assert [r.proba for r in got] == pytest.approx((1 / (1 + np.exp(odds[1] - odds[0]))).tolist())


def test_depths_from_one_tree(spark, monkeypatch):
    """A deep tree read to a depth is the tree fitted to that depth, and a search fits once per fold."""
    rng = np.random.default_rng(4)
    rows = [(i, Vectors.dense(rng.normal(size=5)), int(rng.random() < 0.4)) for i in range(400)]
    df = spark.createDataFrame(rows, ["doc_id", "features", "label"]).cache()
    tried = [{"max_depth": d, "min_samples_split": 4, "class_weight": "balanced"} for d in (0, 1, 3, 6, None)]
    for params, fitted in zip(tried, md.fit_tree_depths(df, tried, 1)):
        want = {r.doc_id: (r.pred, r.proba) for r in md.fit_tree(df, params, 1).transform(df).collect()}
        got = {r.doc_id: (r.pred, r.proba) for r in fitted.transform(df).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert [got[k][1] for k in want] == pytest.approx([v[1] for v in want.values()])
    fits = []
    plain = md.DecisionTreeClassifier.fit
    monkeypatch.setattr(md.DecisionTreeClassifier, "fit", lambda self, rows: fits.append(1) or plain(self, rows))
    marked = df.withColumn("fold", (F.col("doc_id") % 2 + 1).cast("int"))
    results, _ = md.grid_search(marked, md.REGISTRY["dt"], {"max_depth": [1, 2, 4], "criterion": ["gini", "entropy"]})
    assert len(fits) == 4 and results.count() == 12


def test_bibliography_to_report(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = {"selected": ["method", "study", "trial"], "removed": ["noise", "other", "thing"]}
    for name, split, category in LABELLED_FILES:
        with open(tmp_path / name, "w", encoding="utf-8") as f:
            for i in range(12):
                text = " ".join(rng.choice([*words[category], "common", "words"], 12))
                year = (2000 if split == "train" else 2015) + i % 6
                f.write(f"@article{{k,\n\ttitle = {{item {len(category)} {split[1]} {i}}},\n\tabstract = {{{text}}},\n\tyear = {year},\n\tuuid = {{{split}-{category}-{i}}}\n}}\n")
    config = ScreeningConfig(k=20, validation="years", n_splits=2, classifiers=("rforest",))
    lexicon = spark.createDataFrame([("word", "n", "word")], "surface string, pos string, lemma string")
    out = str(tmp_path / "report")
    tables = screen_bibliography(spark, str(tmp_path), config, out, lexicon, strict=True)
    assert read_result(spark, out, "predictions").count() == 24
    assert read_result(spark, out, "scores").first()["f1"] > 0.9
    assert read_result(spark, out, "validation").count() == 6
    probabilities = read_result(spark, out)
    assert sweep(probabilities).count() == 4
    verdicts = probabilities.select("uuid", "title", "was_selected", *[(F.col("was_selected") * 2.0).alias(r) for r in ("R1", "R2", "R3")])
    assert reviewer_agreement(probabilities, verdicts).count() > 0
    assert tables["validation"].count() == 6


def test_forest_is_the_same_in_any_layout(spark):
    import random

    rng = random.Random(3)
    rows = [(i, Vectors.dense([rng.random() for _ in range(6)]), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, ["doc_id", "features", "label"])
    found = []
    for n in (1, 3, 8):
        model = md.fit_forest(df.repartition(n), {"n_estimators": 10, "max_depth": 4}, 7)
        found.append({r.doc_id: r.proba for r in model.transform(df).select("doc_id", "proba").collect()})
    assert found[0] == found[1] == found[2]


def test_tolerance_reaches_the_machine(spark, monkeypatch):
    seen = []

    class Machine(md.LinearSVC):
        def __init__(self, **settings):
            seen.append((settings["tol"], settings["maxIter"]))
            super().__init__(**settings)

    monkeypatch.setattr(md, "LinearSVC", Machine)
    rows = [(i, Vectors.dense([i % 2 + 0.1 * (i % 3), 1.0]), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, ["doc_id", "features", "label"])
    md.fit_kernel_machine(df, {"tol": 0.8, "gamma": 1, "max_iter": 5}, 1)
    md.fit_kernel_machine(df, {"tol": 0.05, "gamma": "scale"}, 1)
    assert set(seen[:4]) == {(0.8, 5)} and set(seen[4:]) == {(0.05, md.MAX_ITERATIONS)}


def test_depth_beyond_the_limit_is_refused():
    with pytest.raises(ValueError):
        md._tree_settings({"max_depth": 31})


def test_equal_candidates_are_fitted_once(spark):
    fits = []

    def fit(train, params, seed):
        fits.append(params)
        return md.Fitted(lambda df: df.withColumn("pred", F.col("label")).withColumn("proba", F.col("label") * 1.0))

    rows = [(i, i % 2, i % 2 + 1) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id INT, label INT, fold INT")
    spec = md.Classifier("x", fit, {}, effective=md._effective_tree)
    results, best = md.grid_search(df, spec, {"min_samples_split": [2, 3, 8]}, parallelism=1)
    assert len(fits) == 4 and results.count() == 6 and best == {"min_samples_split": 2}


@pytest.mark.parametrize("scoring, expected", [
    ("accuracy", 4 / 6), ("precision", 2 / 3), ("recall", 2 / 3), ("f1", 2 / 3), ("precision_macro", 2 / 3),
    ("recall_macro", 2 / 3), ("f1_macro", 2 / 3), ("roc_auc", 7 / 9), ("average_precision", (1 + 2 / 3 + 3 / 5) / 3),
])
def test_scorings_by_hand(spark, scoring, expected):
    rows = [(1, 1, 0.9), (0, 1, 0.8), (1, 1, 0.8), (0, 0, 0.3), (1, 0, 0.3), (0, 0, 0.1)]
    df = spark.createDataFrame(rows, "label INT, pred INT, proba DOUBLE")
    assert md.score_predictions(df, scoring) == pytest.approx(expected)


def test_one_kernel_map_per_kernel_and_gamma(spark, vectors, monkeypatch):
    """Candidates that share kernel and gamma share one map, in all folds; with all rows as landmarks nothing changes."""
    marked = fd.stratified_folds(vectors.where("doc_id < 60"), 2)
    grid = {"kernel": ["rbf", "sigmoid"], "C": [0.5, 2.0], "gamma": [0.5], "landmarks": [100]}
    plain = dataclasses.replace(md.REGISTRY["svm"], prepare=None, prepared_by=())
    key = lambda r: (r.candidate, r.fold)
    want = [r.score for r in sorted(md.grid_search(marked, plain, grid)[0].collect(), key=key)]
    made, maps = [], md.kn.whitening
    monkeypatch.setattr(md.kn, "whitening", lambda *a: made.append(1) or maps(*a))
    got = [r.score for r in sorted(md.grid_search(marked, md.REGISTRY["svm"], grid)[0].collect(), key=key)]
    assert len(made) == 2 and got == pytest.approx(want, abs=0.1)


def test_deep_forests_keep_the_place_of_each_row(spark, monkeypatch):
    """Rows are not sent down every tree again for each group of nodes, and the forest is the one without that."""
    rng = np.random.default_rng(5)
    rows = [(i, Vectors.dense(x), int(x[0] + 0.3 * x[1] > 0.6)) for i, x in enumerate(rng.random((200, 4)).tolist())]
    train = spark.createDataFrame(rows, ["doc_id", "features", "label"])
    asked, plain = [], md.RandomForestClassifier
    monkeypatch.setattr(md, "RandomForestClassifier", lambda **k: asked.append(k) or plain(**k))
    params = {"n_estimators": 3, "max_depth": None}
    got = md.fit_forest(train, params, 7).transform(train).orderBy("doc_id").collect()
    monkeypatch.setattr(md, "RandomForestClassifier", lambda **k: plain(**{**k, "cacheNodeIds": False}))
    want = md.fit_forest(train, params, 7).transform(train).orderBy("doc_id").collect()
    assert asked[0]["cacheNodeIds"] and [r.proba for r in got] == [r.proba for r in want]
