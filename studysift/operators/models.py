"""Classifiers behind one interface, validation over folds, and grid search.

Every classifier takes a table with ``doc_id, features, label`` and gives a fitted model whose ``transform`` adds
``pred`` and ``proba`` (the probability of class 1).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import partial, reduce
from itertools import product
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studysift.functions import measures as ms
from studysift.operators import folds as fd
from studysift.operators import forest as fr
from studysift.operators import kernel as kn
from studysift.operators import metrics as mt
from studysift.operators import moments as mo
from studysift.operators import neighbours as nb
from studysift.operators import sparse_neighbours as sn
from studysift.operators import trees as tr
from studysift.operators.ranking import running_sums
from studysift.operators.storage import stored

Params = dict[str, Any]
MAX_TREE_DEPTH = 30
CALIBRATION_FOLDS = 3
MAX_ITERATIONS = 1000
PARALLEL_FITS = 4
FIT_PARTITIONS = 8
MAX_NODES = 4_000_000  # that the trees of a forest may come to in the driver


class Fitted:
    """A fitted classifier: ``transform`` adds ``pred`` and ``proba``."""

    def __init__(self, transform: Callable[[DataFrame], DataFrame]):
        self.transform = transform


@dataclass(frozen=True)
class Classifier:
    """A registered classifier.

    ``default`` are the settings of an untuned model, ``best`` the pinned ones of an earlier search; ``grid`` is a small
    grid and ``full_grid`` the whole one. ``effective`` gives what a candidate comes down to: candidates with the same
    outcome are fitted once. ``fit_axis`` fits candidates that differ only in the effective setting ``axis`` together;
    ``shared`` makes the models of all folds and candidates from one pass over the marked rows. ``prepare`` maps all rows
    once for the candidates that agree in the parameters ``prepared_by``.
    """

    name: str
    fit: Callable[[DataFrame, Params, int], Fitted]
    best: Params
    grid: dict[str, list] = field(default_factory=dict)
    full_grid: dict[str, list] = field(default_factory=dict)
    default: Params = field(default_factory=dict)
    effective: Callable[[Params], Params] = dict
    axis: str = ""
    fit_axis: Callable[[DataFrame, Sequence[Params], int], list[Fitted]] | None = None
    shared: Callable[[DataFrame], Any] | None = None
    prepare: Callable[[DataFrame, Params], DataFrame] | None = None
    prepared_by: tuple[str, ...] = ()


def candidates(grid: dict[str, list]) -> list[Params]:
    """All combinations of a parameter grid in its written order."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def _from_probability(model: Any) -> Fitted:
    def transform(df: DataFrame) -> DataFrame:
        proba = F.get(vector_to_array("probability"), 1)
        scored = model.transform(df)
        return scored.select(*df.columns, F.col("prediction").cast("int").alias("pred"), proba.alias("proba"))

    return Fitted(transform)


@contextmanager
def _weighted(train: DataFrame, params: Params, features: str = "features") -> Iterator[DataFrame]:
    """Training rows with their class weight, kept for the passes of one fit."""
    columns = _laid_out(train.select("doc_id", features, "label"), params)
    rows = mt.with_class_weight(columns, params.get("class_weight") == "balanced").persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def _tree_settings(params: Params) -> Params:
    # there is no exact counterpart of a minimum split size; half of it as the smallest leaf comes closest
    depth = params.get("max_depth")
    if depth is not None and depth > MAX_TREE_DEPTH:
        raise ValueError(f"max_depth {depth}: trees cannot be deeper than {MAX_TREE_DEPTH}")
    return {
        "impurity": params.get("criterion", "gini"),
        "maxDepth": MAX_TREE_DEPTH if depth is None else depth,
        "minInstancesPerNode": max(1, params.get("min_samples_split", 2) // 2),
        "weightCol": "weight",
    }


def _effective_tree(params: Params) -> Params:
    rest = {k: v for k, v in params.items() if k not in ("criterion", "max_depth", "min_samples_split")}
    return rest | _tree_settings(params)


def _laid_out(rows: DataFrame, params: Params) -> DataFrame:
    """Training rows in a layout of their own, dealt by key and sorted, so that a seed gives one model however they came.

    The number of partitions is the setting ``fit_partitions``; it never follows from the number of rows.
    """
    n = params.get("fit_partitions", FIT_PARTITIONS)
    return rows.repartition(n, "doc_id").sortWithinPartitions("doc_id")


def fit_tree(train: DataFrame, params: Params, seed: int) -> Fitted:
    tree = DecisionTreeClassifier(seed=seed, **_tree_settings(params))
    with _weighted(train, params) as rows:
        return _from_probability(tree.fit(rows))


def fit_tree_depths(train: DataFrame, tried: Sequence[Params], seed: int) -> list[Fitted]:
    """Trees that differ in depth only, from the deepest one read to each depth."""
    settings = [_tree_settings(p) for p in tried]
    deepest = max(settings, key=lambda s: s["maxDepth"])
    tree = DecisionTreeClassifier(seed=seed, **deepest)
    with _weighted(train, tried[0]) as rows:
        nodes = tr.node_table(tree.fit(rows))

    def read(depth: int) -> Fitted:
        return Fitted(lambda df: tr.with_probability(df, tr.to_depth(nodes, depth)))

    return [read(s["maxDepth"]) for s in settings]


def fit_forest(train: DataFrame, params: Params, seed: int) -> Fitted:
    """A forest; one that may have more nodes than the driver should hold is grown in the tasks and stays there."""
    trees, settings = params.get("n_estimators", 100), _tree_settings(params)
    if trees * 2 ** (settings["maxDepth"] + 1) > MAX_NODES and 2 * trees * (n := train.count()) > MAX_NODES:
        return _fit_deep_forest(train, n, trees, settings, params, seed)
    forest = RandomForestClassifier(
        numTrees=trees,
        featureSubsetStrategy="sqrt",
        seed=seed,
        maxMemoryInMB=512,
        cacheNodeIds=True,  # deep trees: a row keeps its place in every tree instead of being sent down again
        **settings,
    )
    with _weighted(train, params) as rows:
        return _from_probability(forest.fit(rows))


def _fit_deep_forest(train: DataFrame, n: int, trees: int, settings: Params, params: Params, seed: int) -> Fitted:
    labels = mt.with_class_weight(train.select("label"), params.get("class_weight") == "balanced")
    weights = {r["label"]: float(r["w"]) for r in labels.groupBy("label").agg(F.max("weight").alias("w")).collect()}
    if not weights.keys() <= {0, 1}:
        raise ValueError(f"labels must be 0 or 1, got {sorted(weights, key=str)}")
    width = train.select(F.size(vector_to_array("features"))).first()[0]
    by_class = weights.get(0, 1.0), weights.get(1, 1.0)
    asked = fr.Settings(trees, settings["maxDepth"], settings["minInstancesPerNode"], settings["impurity"], by_class, seed, width)
    return Fitted(fr.fit(train, n, asked).transform)


def fit_logistic(train: DataFrame, params: Params, seed: int) -> Fitted:
    # the usual penalty C = 1 on the summed loss is 1 / (C n) on the mean loss
    with _weighted(train, params) as rows:
        n = rows.count()
        penalty = 1.0 / (params.get("C", 1.0) * max(1, n))
        model = LogisticRegression(regParam=penalty, standardization=False, weightCol="weight")
        return _from_probability(model.fit(rows))


def _smoothing(params: Params) -> float:
    return params.get("var_smoothing", mo.SMOOTHING)


def fit_bayes(train: DataFrame, params: Params, seed: int) -> Fitted:
    sums = mo.fold_sums(train, None).of(lambda mark: True)
    table = mo.coefficient_table(train, [(0, sums, _smoothing(params))])

    def transform(df: DataFrame) -> DataFrame:
        scored = mo.with_probability(df.withColumn("_m", table.select("m").scalar()), F.col("_m"))
        return scored.drop("_m")

    return Fitted(transform)


class BayesFolds:
    """Naive Bayes of many training sets from one pass over the rows; ``fold`` marks them."""

    def __init__(self, marked: DataFrame):
        self.marked, self.sums = marked, mo.fold_sums(marked)

    def scored(
        self, models: Sequence[tuple[Params, Callable[[int], bool]]], numbers: Column
    ) -> DataFrame:
        """Rows with ``model``, ``pred`` and ``proba``: each by the models whose numbers the array ``numbers`` holds.

        A model is its parameters and the marks it is trained on.
        """
        table = mo.coefficient_table(
            self.marked, [(i, self.sums.of(chosen), _smoothing(params)) for i, (params, chosen) in enumerate(models)]
        )
        asked = self.marked.withColumn("model", F.explode(numbers)).join(F.broadcast(table), "model")
        return mo.with_probability(asked, F.col("m")).drop("m")


def fit_linear(train: DataFrame, params: Params, seed: int) -> Fitted:
    """Least squares on the 0/1 label; the fitted value cut at 0 and 1 stands in for a probability."""
    model = LinearRegression(solver="l-bfgs", regParam=params.get("alpha", 1e-6)).fit(_laid_out(train, params))

    def transform(df: DataFrame) -> DataFrame:
        value = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
        scored = model.transform(df)
        return scored.select(*df.columns, ms.at_least(F.col("prediction"), 0.5).alias("pred"), value.alias("proba"))

    return Fitted(transform)


def _margins(model: Any, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("margin", F.get(vector_to_array("rawPrediction"), 1))


def _platt(margins: DataFrame) -> Any:
    """Logistic map from margin to probability with Platt's smoothed targets, each given as two weighted rows."""
    sizes = margins.agg(
        F.struct(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0")).alias("s")
    ).scalar()
    target = F.when(F.col("label") == 1, (F.col("_s.n1") + 1) / (F.col("_s.n1") + 2)).otherwise(
        1 / (F.col("_s.n0") + 2)
    )
    soft = margins.withColumn("_s", sizes).select(
        "margin",
        F.inline(
            F.array(
                F.struct(F.lit(1.0).alias("y"), target.alias("w")),
                F.struct(F.lit(0.0).alias("y"), (1 - target).alias("w")),
            )
        ),
    )
    assembled = VectorAssembler(inputCols=["margin"], outputCol="m").transform(soft)
    return LogisticRegression(featuresCol="m", labelCol="y", weightCol="w", regParam=0.0).fit(assembled)


def _kernel_map(train: DataFrame, params: Params) -> Callable[[DataFrame], DataFrame]:
    """Adds ``kernel_features`` by the landmarks of the training rows."""
    kernel, gamma = params.get("kernel", "rbf"), params.get("gamma", "scale")
    gamma = kn.scaled_gamma(train) if gamma == "scale" else gamma
    marks = kn.landmark_matrix(train, params.get("landmarks", kn.LANDMARKS))
    white = kn.whitening(marks, kernel, gamma)
    return partial(kn.kernel_features, marks=marks, white=white, kernel=kernel, gamma=gamma)


def with_kernel_features(rows: DataFrame, params: Params) -> DataFrame:
    """All rows of a search with their kernel features, for every candidate with this kernel and gamma.

    The landmarks are rows of the whole set; no label takes part in choosing them.
    """
    return _kernel_map(rows, params)(rows)


def fit_kernel_machine(train: DataFrame, params: Params, seed: int) -> Fitted:
    """Kernel machine on landmark features; label from the margin, probability from out-of-fold calibration.

    Label and probability can disagree near the boundary; both are kept. Rows that bring ``kernel_features`` are used
    as they are.
    """
    ready = "kernel_features" in train.columns
    mapping = (lambda df: df) if ready else _kernel_map(train, params)

    def machine(rows: DataFrame) -> Any:
        n = rows.count()
        penalty = 1.0 / (params.get("C", 1.0) * max(1, n))
        return LinearSVC(
            featuresCol="kernel_features",
            regParam=penalty,
            maxIter=params.get("max_iter", MAX_ITERATIONS),
            tol=params.get("tol", 1e-3),
            weightCol="weight",
            standardization=False,
        ).fit(rows)

    mapped = mapping(train.select("doc_id", "kernel_features" if ready else "features", "label"))
    with _weighted(mapped, params, "kernel_features") as rows:
        model = machine(rows)
        fold = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION_FOLDS))
        held_out = [
            _margins(machine(rows.where(fold != i)), rows.where(fold == i)).select("label", "margin")
            for i in range(CALIBRATION_FOLDS)
        ]
        calibration = _platt(reduce(DataFrame.unionByName, held_out))
    slope, offset = float(calibration.coefficients[0]), float(calibration.intercept)

    def transform(df: DataFrame) -> DataFrame:
        scored = _margins(model, mapping(df))
        proba = 1.0 / (1.0 + F.exp(-(slope * F.col("margin") + offset)))
        return scored.select(*df.columns, F.col("prediction").cast("int").alias("pred"), proba.alias("proba"))

    return Fitted(transform)


def fit_neighbours(train: DataFrame, params: Params, seed: int) -> Fitted:
    """Vote of the k nearest; rows that carry their ``entries`` are compared by the inverted index, never made dense."""
    k, metric = params.get("n_neighbors", 5), params.get("metric", "euclidean")
    sparse = "entries" in train.columns
    known = train.select("doc_id", "label", "entries" if sparse else vector_to_array("features").alias("_a"))

    def transform(df: DataFrame) -> DataFrame:
        if sparse:
            near = sn.k_nearest_sparse(known, df.select("doc_id", "entries"), k, "doc_id", metric)
        else:
            asked = df.select("doc_id", vector_to_array("features").alias("_a"))
            search = nb.k_nearest_approx if params.get("approximate") else nb.k_nearest
            near = search(known, asked, k, "doc_id", "_a", metric)
        labels = known.select(F.col("doc_id").alias("neighbour"), "label")
        shares = nb.vote_shares(near, labels, params.get("weights", "uniform"))
        one = shares.groupBy("query").agg(
            F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("share"))), F.lit(0.0)).alias("proba")
        )
        voted = one.select(
            F.col("query").alias("doc_id"), (F.round("proba", 9) > 0.5).cast("int").alias("pred"), "proba"
        )
        return df.join(voted, "doc_id")

    return Fitted(transform)


_BALANCE = [None, "balanced"]
_SPLITS = [2, 10, 25, 50, 75, 100]

# The pinned best parameters, the full grids and the defaults of the four tuned classifiers.
REGISTRY: dict[str, Classifier] = {
    "dt": Classifier(
        "dt",
        fit_tree,
        {"criterion": "gini", "max_depth": 10, "min_samples_split": 10, "class_weight": "balanced"},
        {"criterion": ["gini", "entropy"], "max_depth": [5, 10]},
        {
            "criterion": ["gini", "entropy"],
            # depths above 30 cannot be asked for, so None stands for all of them
            "max_depth": [10, 20, 30, None],
            "min_samples_split": _SPLITS,
            "class_weight": _BALANCE,
        },
        {"criterion": "gini", "max_depth": None, "min_samples_split": 2, "class_weight": None},
        _effective_tree,
        "maxDepth",
        fit_tree_depths,
    ),
    "svm": Classifier(
        "svm",
        fit_kernel_machine,
        {"kernel": "rbf", "C": 0.65, "gamma": 1, "tol": 0.8, "class_weight": "balanced"},
        {"kernel": ["rbf", "sigmoid"], "C": [0.65], "gamma": [1], "tol": [0.8], "class_weight": ["balanced"]},
        {
            "kernel": ["rbf", "sigmoid"],
            "C": [
                0.5, 0.65, 0.8, 0.95, 1.1, 1.25, 1.4, 1.55, 1.7, 1.85, 2.0, 2.15, 2.3, 2.45, 2.6, 2.75, 2.9, 3.05, 3.2, 3.35,
            ],
            "gamma": [1, 0.1, 0.01, 0.001, 0.0001],
            "tol": [
                0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0,
            ],
            "class_weight": ["balanced", None],
        },
        {"kernel": "rbf", "C": 1.0, "gamma": "scale", "tol": 1e-3, "class_weight": None},
        prepare=with_kernel_features,
        prepared_by=("kernel", "gamma", "landmarks"),
    ),
    "knn": Classifier(
        "knn",
        fit_neighbours,
        {"n_neighbors": 5, "metric": "euclidean", "weights": "uniform"},
        {"n_neighbors": [3, 5], "metric": ["euclidean"], "weights": ["uniform", "distance"]},
        {
            "n_neighbors": [1, 3, 5, 7, 9, 11, 13, 15, 17, 19, 21],
            "metric": ["euclidean", "manhattan", "minkowski"],
            "weights": ["uniform", "distance"],
        },
        {"n_neighbors": 5, "metric": "minkowski", "weights": "uniform"},
    ),
    "rforest": Classifier(
        "rforest",
        fit_forest,
        {
            "n_estimators": 100,
            "criterion": "gini",
            "max_depth": 10,
            "min_samples_split": 10,
            "class_weight": "balanced",
        },
        {"n_estimators": [5, 20], "criterion": ["gini"], "max_depth": [10], "class_weight": ["balanced"]},
        {
            "n_estimators": [2, 5, 100],
            "criterion": ["gini", "entropy"],
            "max_depth": [10, 20, 30, None],
            "min_samples_split": _SPLITS,
            "class_weight": _BALANCE,
        },
        {"n_estimators": 100, "criterion": "gini", "max_depth": None, "min_samples_split": 2, "class_weight": None},
        _effective_tree,
    ),
    "log_reg": Classifier("log_reg", fit_logistic, {"C": 1.0}, {"C": [0.1, 1.0]}, default={"C": 1.0}),
    "gaussianNB": Classifier("gaussianNB", fit_bayes, {}, shared=BayesFolds),
    "lin_reg": Classifier("lin_reg", fit_linear, {}),
}


def _in_parallel(work: Sequence[Callable[[], Any]], parallelism: int) -> list[Any]:
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(work) or 1))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(w)) for w in work]]


def average_precision(df: DataFrame) -> float:
    """Sum of the precision at each score, weighted by the recall it adds."""
    points = df.groupBy("proba").agg(F.count_if(F.col("label") == 1).alias("_p"), F.count(F.lit(1)).alias("_n"))
    summed = running_sums(points, "proba", {"_tp": F.col("_p"), "_all": F.col("_n")}, descending=True)
    found = summed.agg(F.sum(F.col("_p") * F.col("_tp") / F.col("_all")).alias("s"), F.sum("_p").alias("t")).first()
    return float(found["s"] or 0.0) / float(found["t"]) if found["t"] else 0.0


def roc_auc(df: DataFrame) -> float:
    """Share of (selected, removed) pairs that the probability orders rightly, ties as one half."""
    points = df.groupBy("proba").agg(
        F.count_if(F.col("label") == 1).alias("_p"), F.count_if(F.col("label") == 0).alias("_q")
    )
    summed = running_sums(points, "proba", {"_above": F.col("_p")}, descending=True)
    pairs = F.col("_q") * (F.col("_above") - F.col("_p") / 2.0)
    found = summed.agg(F.sum(pairs).alias("s"), F.sum("_p").alias("p"), F.sum("_q").alias("q")).first()
    return float(found["s"]) / (found["p"] * found["q"]) if found["p"] and found["q"] else float("nan")


def score_predictions(df: DataFrame, scoring: str) -> float:
    """One of ``SCORINGS`` for rows with ``label, pred, proba``."""
    if scoring in ("roc_auc", "average_precision"):
        return {"roc_auc": roc_auc, "average_precision": average_precision}[scoring](df)
    if scoring.endswith("_macro"):
        return mt.macro_metrics(df).first()[scoring]
    return mt.add_metrics(df.agg(*mt.confusion_counts("label", F.col("pred")))).first()[scoring]


def _fold_scores(rows: DataFrame, models: Sequence[int], scoring: str) -> dict[int, float]:
    """The score of each model over its rows ``(model, label, pred, proba)``; counts of all models come from one pass."""
    if scoring in ("roc_auc", "average_precision"):
        return {m: score_predictions(rows.where(F.col("model") == m), scoring) for m in models}
    if scoring.endswith("_macro"):
        found = mt.macro_metrics(rows, ("model",))
    else:
        found = mt.add_metrics(rows.groupBy("model").agg(*mt.confusion_counts("label", F.col("pred"))))
    return {r["model"]: r[scoring] for r in found.select("model", scoring).collect()}


def _shared_search(
    train: DataFrame, spec: Classifier, tried: dict[str, Params], folds: list[int], scoring: str
) -> dict[tuple[str, int], float]:
    """Scores of a classifier whose models come from shared sums: one pass fits all, a second one scores all."""
    names = list(tried)
    models = [(tried[name], lambda mark, f=f: mark != f) for f in folds for name in names]
    place = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col("fold")).cast("int") - 1
    numbers = F.sequence(place * len(names), place * len(names) + len(names) - 1)
    rows = stored(spec.shared(train).scored(models, numbers).select("model", "label", "pred", "proba"), "scored-folds")
    got = _fold_scores(rows, range(len(models)), scoring)
    return {(name, f): float(got[i * len(names) + j]) for i, f in enumerate(folds) for j, name in enumerate(names)}


def grid_search(
    train: DataFrame,
    spec: Classifier,
    grid: dict[str, list] | None = None,
    scoring: str = "f1",
    seed: int = 42,
    parallelism: int = 4,
) -> tuple[DataFrame, Params]:
    """(results, best parameters) over the folds marked in ``train``; the first candidate wins ties.

    The driver holds one number per candidate and fold. Candidates that come down to the same settings are fitted
    once, those that differ only along the classifier's axis in one fit, and all of them from one pass where the
    classifier has shared sums. Otherwise fits run as concurrent Spark jobs.
    """
    tried = candidates(grid or spec.grid) or [spec.best]
    alike = [repr(sorted(spec.effective(p).items(), key=str)) for p in tried]
    once = {name: p for name, p in reversed(list(zip(alike, tried)))}
    folds = sorted(row["fold"] for row in train.select("fold").distinct().collect())

    def together(name: str) -> str:
        rest = {k: v for k, v in spec.effective(once[name]).items() if k != spec.axis}
        return repr(sorted(rest.items(), key=str)) if spec.fit_axis else name

    groups: dict[str, list[str]] = {}
    for name in once:
        groups.setdefault(together(name), []).append(name)

    def mapped_as(params: Params) -> tuple:
        return tuple(params.get(k) for k in spec.prepared_by)

    ready = {(): train}
    for params in once.values():
        if spec.prepare and mapped_as(params) not in ready:
            ready[mapped_as(params)] = stored(spec.prepare(train, params), "prepared")

    def one(names: list[str], fold: int) -> Callable[[], dict[tuple[str, int], float]]:
        def run() -> dict[tuple[str, int], float]:
            rest, held = fd.fold_parts(ready[mapped_as(once[names[0]])], fold, expanding=False)
            if spec.fit_axis:
                models = spec.fit_axis(rest, [once[n] for n in names], seed)
            else:
                models = [spec.fit(rest, once[n], seed) for n in names]
            return {(n, fold): float(score_predictions(m.transform(held), scoring)) for n, m in zip(names, models)}

        return run

    if spec.shared:
        scores = _shared_search(train, spec, once, folds, scoring)
    else:
        parts = _in_parallel([one(names, f) for names in groups.values() for f in folds], parallelism)
        scores = {key: value for part in parts for key, value in part.items()}
    rows = [
        (spec.name, c, {k: str(v) for k, v in params.items()}, int(fold), scores[alike[c], fold])
        for c, params in enumerate(tried)
        for fold in folds
    ]
    results = train.sparkSession.createDataFrame(
        rows, "classifier STRING, candidate INT, params MAP<STRING,STRING>, fold INT, score DOUBLE"
    )
    mean = results.groupBy("classifier", "candidate").agg(F.avg("score").alias("mean_score"))
    return results, tried[mt.best_candidate(mean).first()["candidate"]]


def cross_validate_years(
    train: DataFrame, spec: Classifier, params: Params | None = None, n_splits: int = 5, seed: int = 42
) -> DataFrame:
    """Macro metrics of each year fold, newest block first; every fold trains on earlier years only."""
    marked = stored(fd.year_folds(train, n_splits), "year-folds")
    params = spec.default if params is None else params

    def run(fold: int) -> DataFrame:
        rest, held = fd.year_fold_parts(marked, fold)
        return spec.fit(rest, params, seed).transform(held).select("label", "pred", F.lit(fold).alias("fold"))

    if spec.shared:
        models = [(params, lambda mark, f=f: mark > f) for f in range(1, n_splits + 1)]
        tested = F.when(F.col("fold").isNotNull(), F.array(F.col("fold") - 1))
        rows = spec.shared(marked).scored(models, tested).select("label", "pred", "fold")
    else:
        rows = reduce(
            DataFrame.unionByName, _in_parallel([partial(run, fold) for fold in range(1, n_splits + 1)], PARALLEL_FITS)
        )
    return mt.macro_metrics(rows, ("fold",))


def cross_validate_series(
    train: DataFrame, spec: Classifier, params: Params | None = None, n_splits: int = 5, seed: int = 42
) -> DataFrame:
    """``(fold, threshold, f1)`` over expanding folds; each uses the threshold that keeps all its training hits.

    Probabilities are compared at nine decimals.
    """
    marked = stored(fd.time_series_folds(train, n_splits), "series-folds")
    params = spec.default if params is None else params
    proba = F.round("proba", 9).alias("proba")

    def run(fold: int) -> tuple[DataFrame, DataFrame]:
        rest, held = fd.fold_parts(marked, fold, expanding=True)
        model = spec.fit(rest, params, seed)
        return tuple(model.transform(part).select(F.lit(fold).alias("fold"), "label", proba) for part in (rest, held))

    if spec.shared:
        # model i, from 0, is that of fold i + 1: it scores its own fold and all earlier rows
        models = [(params, lambda mark, f=f: mark < f) for f in range(1, n_splits + 1)]
        from_own = F.sequence(F.greatest(F.col("fold"), F.lit(1)) - 1, F.lit(n_splits - 1))
        scored = spec.shared(marked).scored(models, from_own)
        scored = stored(scored.select((F.col("model") + 1).alias("fold"), F.col("fold").alias("mark"), "label", proba), "scored-folds")
        seen, held = scored.where("mark < fold").drop("mark"), scored.where("mark = fold").drop("mark")
    else:
        parts = _in_parallel([partial(run, fold) for fold in range(1, n_splits + 1)], PARALLEL_FITS)
        seen, held = (reduce(DataFrame.unionByName, side) for side in zip(*parts))
    cuts = mt.full_recall_threshold(seen, ("fold",))
    rows = held.join(F.broadcast(cuts), "fold")  # one row per fold
    rows = rows.withColumn("pred", ms.unless_below(F.col("proba"), F.col("threshold")))
    counts = rows.groupBy("fold", "threshold").agg(*mt.confusion_counts("label", F.col("pred")))
    return mt.add_metrics(counts).select("fold", "threshold", "f1")


def attach_predictions(test: DataFrame, scored: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """Test rows with ``<LABEL>_pred`` and ``<LABEL>_proba`` of several classifiers, joined on the study's key."""
    out = test
    for name, df in scored.items():
        columns = [F.col("pred").alias(f"{name.upper()}_pred"), F.col("proba").alias(f"{name.upper()}_proba")]
        out = out.join(df.select(key, *columns), key)
    return out


def parameter_rows(spark: Any, chosen: dict[str, Params], tried: dict[str, dict[str, list]]) -> DataFrame:
    """``(classifier, kind, param, value)`` of best and tested parameters."""
    rows = [(n.upper(), "best", p, str(v)) for n, params in chosen.items() for p, v in params.items()]
    rows += [(n.upper(), "tested", p, str(v)) for n, grid in tried.items() for p, v in grid.items()]
    return spark.createDataFrame(rows, "classifier STRING, kind STRING, param STRING, value STRING")
