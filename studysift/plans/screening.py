"""Train on earlier studies, score later ones, report: the whole screening job."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studysift.config import ScreeningConfig
from studysift.functions import measures as ms
from studysift.operators import folds as fd
from studysift.operators import metrics as mt
from studysift.operators import models as md
from studysift.operators import selection as sel
from studysift.operators import vectorise as vz
from studysift.operators.storage import stored

CARRIED = ("doc_id", "mark")


@dataclass(frozen=True)
class Vectors:
    """Training and test studies with feature vectors, and the terms behind the vector positions."""

    train: DataFrame
    test: DataFrame
    best: DataFrame


@dataclass(frozen=True)
class Terms:
    """What one pass over the text leaves: the term store with its frequencies, the norms and sizes of its documents.

    ``n_docs`` is the number of training documents, ``sizes`` that of each class.
    """

    store: DataFrame
    norms: DataFrame
    n_docs: int
    sizes: Column


def in_train() -> Column:
    return F.col("split") == "train"


def _store(studies: DataFrame, config: ScreeningConfig) -> tuple[DataFrame, int]:
    """The term store of all studies with the frequencies of the training split, and the size of that split.

    Its long rows carry one number for split and label: ``mark`` is the label in training, -1 without one, and null
    elsewhere.
    """
    marked = studies.withColumn("mark", F.when(in_train(), F.coalesce("label", F.lit(-1))))
    store = vz.term_store(marked, keep=CARRIED, ngram_range=config.ngram_range, in_train=F.col("mark").isNotNull())
    return store, studies.where(in_train()).count()


def read_terms(studies: DataFrame, config: ScreeningConfig) -> Terms:
    """Terms of all studies with the vocabulary of the training split."""
    store, n_docs = _store(studies, config)
    sizes = sel.class_sizes(studies.where(in_train()))
    return Terms(store, vz.store_norms(store, n_docs, config.min_df), n_docs, sizes)


def weighted_terms(studies: DataFrame, config: ScreeningConfig) -> DataFrame:
    """TF-IDF rows of all studies with the vocabulary of the training split; the text is read once."""
    return vz.store_tfidf(*_store(studies, config), config.min_df)


def term_scores(terms: Terms, config: ScreeningConfig, score: str | sel.Scorer | None = None) -> DataFrame:
    """``(term, score)`` on the training split; affinity is the one score that needs no weights."""
    sums = sel.class_sums(terms.store, terms.norms, terms.n_docs, F.col("mark").isNotNull(), config.min_df, "mark")
    return sel.score_terms(sums, terms.sizes, score or config.score)


def select_terms(terms: Terms, config: ScreeningConfig) -> DataFrame:
    """The terms to use: the k best by score on the training split, or without selection the whole vocabulary."""
    if not config.select_features:
        return sel.all_terms(vz.store_vocabulary(terms.store, config.min_df))
    return sel.select_k_best(term_scores(terms, config), config.k)


def build_vectors(studies: DataFrame, config: ScreeningConfig) -> Vectors:
    """Vectors of both splits; the small vector table is what all model fits read."""
    terms = read_terms(studies, config)
    best = stored(select_terms(terms, config), "best-terms")
    width = config.k if config.select_features else best.count()
    kept = studies.select(
        "doc_id", "entry_index", "title", "year", "category", "label", "split", *[c for c in ("uuid",) if c in studies.columns]
    )
    made = sel.store_vectors(
        kept, terms.store, terms.norms, terms.n_docs, best, width, config.select_features, config.min_df
    )
    vectors = stored(made, "vectors")
    return Vectors(vectors.where(in_train()), vectors.where(F.col("split") == "test"), best)


def stage_vectors(studies: DataFrame, vectoriser: Estimator) -> Vectors:
    """Vectors by any ML stage that fits on training studies and adds ``features``.

    The terms behind the positions are known where the fitted stage names them in ``best``.
    """
    model = vectoriser.fit(studies.where(in_train()))
    made = stored(model.transform(studies).drop("content"), "vectors")
    nameless = studies.sparkSession.createDataFrame([], "rank INT, term STRING, score DOUBLE")
    return Vectors(made.where(in_train()), made.where(F.col("split") == "test"), getattr(model, "best", nameless))


def screen(
    vectors: Vectors, classifier: str, params: md.Params | None = None, seed: int = 42
) -> DataFrame:
    """Hold-out predictions of one classifier with its pinned parameters unless others are given.

    Validated runs without a search use the classifier's defaults instead.
    """
    spec = md.REGISTRY[classifier]
    model = spec.fit(vectors.train, spec.best if params is None else params, seed)
    return model.transform(vectors.test)


def run_screening(
    studies: DataFrame,
    config: ScreeningConfig,
    grids: dict[str, dict[str, list]] | None = None,
    vectoriser: Estimator | None = None,
) -> dict[str, DataFrame]:
    """The six report tables and ``validation`` for validated studies carrying ``split``, ``label``, ``entry_index``.

    ``grids`` overrides the small default grid of a classifier under grid validation; ``vectoriser`` is any ML stage
    that takes the place of the TF-IDF vectors and term choice of the settings.
    """
    started = time.time()
    spark = studies.sparkSession
    vectors = build_vectors(studies, config) if vectoriser is None else stage_vectors(studies, vectoriser)
    predicted: dict[str, DataFrame] = {}
    chosen: dict[str, md.Params] = {}
    tried: dict[str, dict[str, list]] = {}
    validation: list[DataFrame] = []
    for name in config.classifiers:
        spec = md.REGISTRY[name]
        params = spec.default
        if config.validation == "grid":
            grid = (grids or {}).get(name, spec.grid)
            marked = stored(fd.stratified_folds(vectors.train, config.cv), "stratified")
            results, params = md.grid_search(marked, spec, grid, config.scoring, config.seed)
            tried[name] = {**grid, "cv": [config.cv], "scoring": [config.scoring]}
            validation.append(
                results.select("classifier", "fold", F.lit(config.scoring).alias("metric"), "candidate", "score")
            )
        elif config.validation == "years":
            scores = md.cross_validate_years(vectors.train, spec, params, config.n_splits, config.seed)
            validation.append(_long(scores, name, ("precision_macro", "recall_macro", "f1_macro")))
        elif config.validation == "series":
            scores = md.cross_validate_series(vectors.train, spec, params, config.n_splits, config.seed)
            validation.append(_long(scores, name, ("threshold", "f1")))
        params = {**params, "fit_partitions": config.fit_partitions}
        chosen[name] = params
        predicted[name] = stored(screen(vectors, name, params, config.seed), f"scored-{name}")
    tables = report_tables(vectors.test, predicted)
    tables["parameters"] = md.parameter_rows(spark, chosen, tried)
    if validation:
        tables["validation"] = reduce(DataFrame.unionByName, validation)
    tables["test_configuration"] = run_facts(spark, config, started, time.time())
    return tables


def _long(scores: DataFrame, classifier: str, metrics: tuple[str, ...]) -> DataFrame:
    """Validation scores as ``(classifier, fold, metric, candidate, score)``."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in metrics])
    return scores.select(F.lit(classifier).alias("classifier"), "fold", F.inline(pairs)).select(
        "classifier", "fold", "metric", F.lit(0).alias("candidate"), "score"
    )


def report_tables(test: DataFrame, predicted: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Scores, analysis, predictions and probabilities of the hold-out studies."""
    names = [c for c in ("doc_id", "uuid", "title") if c in test.columns]
    base = test.select(*names, F.col("label").alias("was_selected"))
    wide = md.attach_predictions(base, predicted)
    labels = [name.upper() for name in predicted]
    columns = {label: f"{label}_pred" for label in labels}
    kept = (*names, "was_selected")
    return {
        "scores": mt.binary_metrics(wide, columns, "was_selected"),
        "analysis": mt.confusion(wide, columns, "was_selected"),
        "predictions": wide.select(*kept, *[f"{label}_pred" for label in labels]),
        "probabilities": wide.select(*kept, *[f"{label}_proba" for label in labels]),
    }


def run_facts(spark: SparkSession, config: ScreeningConfig, started: float, ended: float) -> DataFrame:
    """``(information, value)``: elapsed time, number of features and the settings."""
    rows = spark.createDataFrame(
        [("Number of features", str(config.k)), *config.as_rows()], "information STRING, value STRING"
    )
    elapsed = ms.duration_label(F.timestamp_seconds(F.lit(started)), F.timestamp_seconds(F.lit(ended)))
    timing = spark.range(1).select(
        F.lit("Pipeline Execution Time (hours)").alias("information"), elapsed.alias("value")
    )
    return timing.unionByName(rows)
