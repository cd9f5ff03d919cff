"""One query per operator over the given tables, each a function of (spark, folder).

The tables stand in for a study collection: labelled documents are studies, ``quality`` is the verdict and the source
gives the year. Metric queries use a probability computed from the key so that SQL can state the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studysift.config import ScreeningConfig
from studysift.functions import measures as ms
from studysift.functions import text as tx
from studysift.operators import agreement as ag
from studysift.operators import folds as fd
from studysift.operators import lexicon as lx
from studysift.operators import metrics as mt
from studysift.operators import models as md
from studysift.operators import neighbours as nb
from studysift.operators import selection as sel
from studysift.operators import sparse_neighbours as sn
from studysift.operators import validate as vd
from studysift.operators import vectorise as vz
from studysift.operators.storage import stored
from studysift.plans import pool as pl
from studysift.plans import preparation as pp
from studysift.plans import screening as sc
from studysift.sources import bib
from studysift.sources.records import documents, read_table, studies, texts

Query = Callable[[SparkSession, str], DataFrame]

SEED = 42
FOLDS = 5
CV_FOLDS = 3
TOP_K = 500
SMOOTHINGS = (1e-9, 1e-4, 1e-2)
CONFIG = ScreeningConfig(k=200)

def round6(column: Column | str) -> Column:
    return F.round(column, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, for results compared across engines."""
    return df.select(*[round6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Studies with two computed model probabilities and predictions at 0.5."""
    n = F.col("doc_id")
    return studies(spark, folder).select(
        "doc_id",
        "title",
        "year",
        "label",
        "split",
        ((n * 37 % 100) / 100.0).alias("RFOREST_proba"),
        ((n * 53 % 100) / 100.0).alias("SVM_proba"),
        ((n * 37 % 100) / 100.0 >= 0.5).cast("int").alias("RFOREST_pred"),
        ((n * 53 % 100) / 100.0 >= 0.5).cast("int").alias("SVM_pred"),
    )


PREDICTIONS = {"RFOREST": "RFOREST_pred", "SVM": "SVM_pred"}
PROBABILITIES = {"RFOREST": "RFOREST_proba", "SVM": "SVM_proba"}


def _long_scores(spark: SparkSession, folder: str) -> DataFrame:
    """One row per study and classifier: ``(classifier, label, proba)``."""
    pairs = F.array(*[F.struct(F.lit(n).alias("classifier"), F.col(c).alias("proba")) for n, c in PROBABILITIES.items()])
    return scored(spark, folder).select("doc_id", "label", F.inline(pairs))


def train_of(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "train")


# sources


def bib_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Every document rendered as a bibliography entry and parsed back."""
    fields = {c: F.col(c) for c in ("title", "abstract", "year")}
    entries = documents(spark, folder, text_work=True).select(
        bib.parse_entry(bib.render_entry(F.col("doc_id"), fields)).alias("e")
    )
    return entries.select(
        F.col("e.entry_type").alias("entry_type"),
        F.col("e.key").alias("key"),
        *[F.col("e.fields")[name].alias(name) for name in fields],
    )


def labelled_load(spark: SparkSession, folder: str) -> DataFrame:
    """Studies tagged with the set they belong to."""
    tag = F.concat_ws(
        "-",
        F.when(F.col("split") == "test", "Testing").otherwise("Training"),
        F.when(F.col("category") == "selected", "Included").otherwise("Excluded"),
    )
    return studies(spark, folder).select("doc_id", "split", "category", "year", tag.alias("set_name"))


def pool_label(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents as pool entries whose verdict is a field of the rendered entry."""
    pool = studies(spark, folder)
    mark = F.when(F.col("label") == 1, "true").otherwise("false")
    entry = bib.render_entry(F.col("doc_id"), {"title": F.col("title"), "inserir": mark})
    fields = pool.select("doc_id", bib.parse_entry(entry)["fields"].alias("fields"))
    return fields.select(
        "doc_id", F.col("fields")["title"].alias("title"), bib.pool_category(F.col("fields")["inserir"]).alias("category")
    )


# projections and filters


def required_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the required fields it lacks; a one-line document has no abstract."""
    checked = documents(spark, folder).withColumn("reasons", vd.missing_fields())
    return checked.select(
        "doc_id", "year", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("valid")
    )


def dataset_projection(spark: SparkSession, folder: str) -> DataFrame:
    return vd.dataset(studies(spark, folder), "doc_id")


def first_line(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select("doc_id", tx.first_line(F.col("text")).alias("content"))


def temporal_split(spark: SparkSession, folder: str) -> DataFrame:
    return fd.with_temporal_split(studies(spark, folder).select("doc_id", "year", "label"), 2013)


def outcome_rows(spark: SparkSession, folder: str) -> DataFrame:
    return mt.outcome_rows(scored(spark, folder), "RFOREST_pred", keep=("doc_id", "title"))


# validation and set operations


def dedupe_first(spark: SparkSession, folder: str) -> DataFrame:
    return vd.keep_first(studies(spark, folder).drop("content")).select("doc_id", "split", "category", "title")


def duplicate_titles(spark: SparkSession, folder: str) -> DataFrame:
    return vd.duplicate_titles(studies(spark, folder))


def set_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return vd.set_sizes(vd.keep_first(studies(spark, folder).drop("content")))


def surplus_titles(spark: SparkSession, folder: str) -> DataFrame:
    return vd.surplus_titles(documents(spark, folder).select("title", F.col("doc_id").alias("entry_index")))


def reviewer_join(spark: SparkSession, folder: str) -> DataFrame:
    """Model rows with the quality verdict, reviewer rows with their own (not toxic); where the two differ a study
    stays unmatched on both sides."""
    rows = scored(spark, folder).withColumnRenamed("doc_id", "uuid")
    model = rows.select("uuid", F.col("label").alias("was_selected"), "title", "RFOREST_proba", "SVM_proba")
    n = F.col("doc_id")
    reviewers = read_table(spark, folder, "labels").select(
        n.alias("uuid"),
        (1 - F.col("toxic")).alias("was_selected"),
        F.concat(F.lit("study "), n.cast("string")).alias("title"),
        *[(n * p % 3).cast("int").alias(r) for r, p in zip(ag.REVIEWERS, (5, 7, 11))],
    )
    return ag.reviewer_join(model, reviewers)


def agreement_distance(spark: SparkSession, folder: str) -> DataFrame:
    joined = ag.binned(reviewer_join(spark, folder), {"RF": "RFOREST_proba", "SVM": "SVM_proba"})
    return rounded(ag.distances(joined, ("RF", "SVM")))


def proba_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Bins of the model probabilities; every study the model did not score lands in bin 2."""
    joined = reviewer_join(spark, folder)
    return joined.select("uuid", "RFOREST_proba", ms.proba_bin(F.col("RFOREST_proba")).alias("RF"))


def model_disagreement(spark: SparkSession, folder: str) -> DataFrame:
    """Studies on which two rules come to the same outcome."""
    rows = scored(spark, folder)
    a = mt.outcome_rows(rows, "RFOREST_pred", keep=("doc_id", "title"))
    b = mt.outcome_rows(rows, "SVM_pred", keep=("doc_id", "title"))
    return mt.shared_outcomes(a, b).select("doc_id", "title", "outcome", "RFOREST_pred")


def year_profile_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return vd.year_profile_pivot(studies(spark, folder))


# text


def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of each token over all documents."""
    rows = lx.token_rows(texts(spark, folder), tx.tokens(F.col("text")))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last_position"))


def stopword_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Number of tokens of each document before and after stop-word removal."""
    toks = texts(spark, folder).select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return toks.select(
        "doc_id", F.size("t").alias("tokens"), F.size(tx.drop_stopwords()(F.col("t"))).alias("kept")
    )


def normalised_text(spark: SparkSession, folder: str) -> DataFrame:
    toks = texts(spark, folder).select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return toks.select("doc_id", tx.normalised(F.col("t"), [tx.drop_stopwords()]).alias("content"))


def _tag() -> Column:
    """A part of speech from the ending of ``token``, standing in for a tagger's column."""
    t = F.lower("token")
    return F.when(F.endswith(t, F.lit("ly")), "r").when(t.rlike("(ed|ing|is|are|was|be)$"), "v").otherwise("n")


def _token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``(token, pos, n)`` over all documents, written once."""
    rows = lx.token_rows(texts(spark, folder), tx.tokens(F.col("text")))
    counted = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return stored(counted.select("token", _tag().alias("pos"), "n"), "token-counts")


def _lexicon(counts: DataFrame) -> DataFrame:
    """A lexicon as large as the corpus makes it: words met at least three times are base forms, except that one on
    ``-on`` is an irregular form of the one on ``-an`` with the same beginning."""
    words = counts.where(F.col("token").rlike("^[a-z]{2,}$") & (F.col("n") >= 3))
    other = F.concat(F.expr("left(token, length(token) - 2)"), F.lit("an"))
    known = words.select(F.col("token").alias("lemma"), "pos")
    irregular = (
        words.where(F.endswith("token", F.lit("on")))
        .select(F.col("token").alias("surface"), "pos", other.alias("lemma"))
        .join(known, ["lemma", "pos"])
        .select("surface", "pos", "lemma")
    )
    irregular = stored(irregular, "irregular-forms")
    base = words.select(F.col("token").alias("surface"), "pos").join(irregular, ["surface", "pos"], "left_anti")
    return stored(base.withColumn("lemma", F.col("surface")).unionByName(irregular), "lexicon")


def lemmatize(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of each (token, part of speech, lemma)."""
    counts = _token_counts(spark, folder)
    return lx.lemma_counts(counts, _lexicon(counts))


def lemmatised_text(spark: SparkSession, folder: str) -> DataFrame:
    """The whole chain: tokens, lemmas, stop words, joined and lower-cased."""
    rows = texts(spark, folder).select("doc_id", F.col("text").alias("content"))
    return pp.normalise_studies(rows, _lexicon(_token_counts(spark, folder)), _tag())


def ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of each 2- and 3-gram over the studies."""
    grams = vz.term_counts(studies(spark, folder, text_work=True), ngram_range=(2, 3))
    return grams.groupBy("term").agg(F.sum("tf").alias("n"))


def title_preview(spark: SparkSession, folder: str) -> DataFrame:
    preview = tx.title_preview(F.col("title"), F.col("category"))
    return studies(spark, folder).select("doc_id", preview.alias("preview"))


def duration_label(spark: SparkSession, folder: str) -> DataFrame:
    """Time between the first and last event of each user."""
    spans = read_table(spark, folder, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    return spans.select("user_id", ms.duration_label(F.col("a"), F.col("z")).alias("duration"))


# vectors


def term_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return vz.term_counts(studies(spark, folder, text_work=True))


def document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return vz.document_frequency(vz.document_terms(train_of(studies(spark, folder, text_work=True))))


def vocabulary_size(spark: SparkSession, folder: str) -> DataFrame:
    return vz.vocabulary_size(vz.document_terms(train_of(studies(spark, folder, text_work=True))))


def idf(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(vz.fit_idf(train_of(studies(spark, folder, text_work=True))))


def tfidf(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sc.weighted_terms(studies(spark, folder, text_work=True), CONFIG).select("doc_id", "term", "v"))


def _train_scores(spark: SparkSession, folder: str, score: str) -> DataFrame:
    train = train_of(studies(spark, folder, text_work=True))
    if score == "affinity":
        terms = vz.document_terms(train, keep=("doc_id", "label"))
        return sel.score_terms(sel.term_statistics(terms, value=None), sel.class_sizes(train), score)
    return sc.term_scores(sc.read_terms(train, CONFIG), CONFIG, score)


def score_query(score: str) -> Query:
    return lambda spark, folder: rounded(_train_scores(spark, folder, score))


def select_k_best(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sel.select_k_best(_train_scores(spark, folder, "anova"), TOP_K))


def feature_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Non-zero entries of the vectors over the best terms, of both splits."""
    vectors = sc.build_vectors(studies(spark, folder, text_work=True), CONFIG)
    both = vectors.train.unionByName(vectors.test)
    entries = both.select("doc_id", F.posexplode(vector_to_array("features")).alias("position", "v"))
    return rounded(entries.where("v <> 0"))


# folds and orders


def _studies_narrow(spark: SparkSession, folder: str) -> DataFrame:
    return studies(spark, folder).select("doc_id", "entry_index", "year", "category", "label", "split")


def seeded_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    return fd.seeded_shuffle(documents(spark, folder).select("doc_id"), SEED)


def quota_split(spark: SparkSession, folder: str) -> DataFrame:
    return fd.quota_split(_studies_narrow(spark, folder), SEED).select("doc_id", "category", "year", "split")


def resplit_profile(spark: SparkSession, folder: str) -> DataFrame:
    return pl.resplit(_studies_narrow(spark, folder), SEED)["years"]


def year_order(spark: SparkSession, folder: str) -> DataFrame:
    return fd.year_order(_studies_narrow(spark, folder)).select("doc_id", "split", "year", "category", "position")


def year_folds(spark: SparkSession, folder: str) -> DataFrame:
    return fd.year_folds(train_of(_studies_narrow(spark, folder)), FOLDS).select("doc_id", "year", "fold")


def time_series_folds(spark: SparkSession, folder: str) -> DataFrame:
    return fd.time_series_folds(train_of(_studies_narrow(spark, folder)), FOLDS).select("doc_id", "fold")


def stratified_folds(spark: SparkSession, folder: str) -> DataFrame:
    return fd.stratified_folds(train_of(_studies_narrow(spark, folder)), FOLDS).select("doc_id", "label", "fold")


def head_n(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder).select("doc_id", "title", fd.shuffle_key(SEED).alias("k"))
    return fd.head_n(rows, 10, "k", "doc_id").select("doc_id", "title")


# metrics


def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return mt.confusion(scored(spark, folder), PREDICTIONS)


def binary_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mt.binary_metrics(scored(spark, folder), PREDICTIONS))


def macro_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Macro metrics per year, the year acting as the fold."""
    rows = scored(spark, folder).withColumnsRenamed({"RFOREST_pred": "pred", "year": "fold"})
    return rounded(mt.macro_metrics(rows, ("fold",)))


def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mt.threshold_sweep(scored(spark, folder), ScreeningConfig().thresholds, PROBABILITIES))


def full_recall_threshold(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored(spark, folder).select("label", F.col("RFOREST_proba").alias("proba"), F.col("year").alias("fold"))
    return rounded(mt.full_recall_threshold(rows, ("fold",)))


def pr_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mt.pr_curve(_long_scores(spark, folder), ("classifier",)))


def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mt.class_weights(studies(spark, folder)))


def best_candidate(spark: SparkSession, folder: str) -> DataFrame:
    """The best of several cut-offs by mean F1 over the year folds, for each of the two rules."""
    rows = scored(spark, folder)
    cuts = [0.3, 0.4, 0.5, 0.6, 0.7]
    counts = [
        F.struct(*mt.confusion_counts("label", ms.at_least(F.col(c), t))).alias(f"_{n}_{i}")
        for n, c in PROBABILITIES.items()
        for i, t in enumerate(cuts)
    ]
    entries = F.array(
        *[
            F.struct(F.lit(n).alias("classifier"), F.lit(i).alias("candidate"), f"_{n}_{i}.*")
            for n in PROBABILITIES
            for i in range(len(cuts))
        ]
    )
    per_fold = mt.add_metrics(rows.groupBy("year").agg(*counts).select("year", F.inline(entries)))
    results = per_fold.groupBy("classifier", "candidate").agg(round6(F.avg("f1")).alias("mean_score"))
    return mt.best_candidate(results)


# neighbours and models


def knn_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest other vectors of every embedding."""
    vectors = read_table(spark, folder, "embeddings")
    return rounded(nb.k_nearest(vectors, vectors, 5, "vec_id", "embedding", exclude_self=True))


def knn_vote(spark: SparkSession, folder: str) -> DataFrame:
    """Each embedding classified by its five nearest others, every other one counting alike."""
    vectors = read_table(spark, folder, "embeddings")
    near = nb.k_nearest(vectors, vectors, 5, "vec_id", "embedding", exclude_self=True)
    return rounded(nb.vote(near, vectors.select(F.col("vec_id").alias("neighbour"), "label")))


def knn_vote_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """The same by Manhattan distance with votes weighing 1/d."""
    vectors = read_table(spark, folder, "embeddings")
    near = nb.k_nearest(vectors, vectors, 5, "vec_id", "embedding", "manhattan", exclude_self=True)
    return rounded(nb.vote(near, vectors.select(F.col("vec_id").alias("neighbour"), "label"), "distance"))


def _screening(classifier: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        vectors = sc.build_vectors(studies(spark, folder, text_work=True), CONFIG)
        return sc.screen(vectors, classifier).select("doc_id", "title", "label", "pred", round6("proba").alias("proba"))

    return run


BAYES = "gaussianNB"


def grid_results(spark: SparkSession, folder: str) -> DataFrame:
    """F1 of naive Bayes with three amounts of smoothing on each of the stratified folds."""
    vectors = sc.build_vectors(studies(spark, folder, text_work=True), CONFIG)
    marked = stored(fd.stratified_folds(vectors.train, FOLDS), "stratified")
    results, _ = md.grid_search(marked, md.REGISTRY[BAYES], {"var_smoothing": list(SMOOTHINGS)}, seed=SEED)
    smoothing = F.col("params")["var_smoothing"].cast("double").alias("var_smoothing")
    return results.select("classifier", "candidate", smoothing, "fold", round6("score").alias("score"))


def cv_years(spark: SparkSession, folder: str) -> DataFrame:
    vectors = sc.build_vectors(studies(spark, folder, text_work=True), CONFIG)
    return rounded(md.cross_validate_years(vectors.train, md.REGISTRY[BAYES], {}, CV_FOLDS))


def cv_series(spark: SparkSession, folder: str) -> DataFrame:
    vectors = sc.build_vectors(studies(spark, folder, text_work=True), CONFIG)
    return rounded(md.cross_validate_series(vectors.train, md.REGISTRY[BAYES], {}, CV_FOLDS))


def tree_depths(spark: SparkSession, folder: str) -> DataFrame:
    """F1 of trees of three depths on each of the stratified folds, one fit per fold."""
    vectors = sc.build_vectors(studies(spark, folder, text_work=True), CONFIG)
    marked = stored(fd.stratified_folds(vectors.train, CV_FOLDS), "stratified")
    results, _ = md.grid_search(marked, md.REGISTRY["dt"], {"max_depth": [2, 5, 10]}, seed=SEED)
    return results.select("classifier", "candidate", F.col("params")["max_depth"].alias("max_depth"), "fold", round6("score").alias("score"))


def knn_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest training studies of every later study, by their chosen terms."""
    vectors = sc.build_vectors(studies(spark, folder, text_work=True), CONFIG)
    return rounded(sn.k_nearest_sparse(vectors.train, vectors.test, 5))


def knn_sparse_manhattan(spark: SparkSession, folder: str) -> DataFrame:
    vectors = sc.build_vectors(studies(spark, folder, text_work=True), CONFIG)
    return rounded(sn.k_nearest_sparse(vectors.train, vectors.train, 5, metric="manhattan", exclude_self=True))


def knn_approximate(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest other vectors of every embedding, as far as random-projection buckets find them."""
    vectors = read_table(spark, folder, "embeddings")
    return rounded(nb.k_nearest_approx(vectors, vectors, 5, "vec_id", "embedding", exclude_self=True))


def screening_report(spark: SparkSession, folder: str) -> DataFrame:
    """Scores and confusion counts of two classifiers on the hold-out studies."""
    config = ScreeningConfig(k=200, classifiers=("svm", "rforest"), validation="none")
    tables = sc.run_screening(studies(spark, folder, text_work=True), config)
    return rounded(tables["scores"].join(tables["analysis"], "classifier"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Confusion counts and metrics of the forest on the hold-out studies, end to end from the raw tables."""
    vectors = sc.build_vectors(studies(spark, folder, text_work=True), CONFIG)
    scored_rows = sc.screen(vectors, "rforest")
    return mt.add_metrics(mt.confusion(scored_rows, {"RFOREST": "pred"}))


def all_queries() -> dict[str, Query]:
    named: list[Query] = [
        bib_fields, labelled_load, pool_label,
        required_fields, first_line, temporal_split, outcome_rows,
        dedupe_first, duplicate_titles, set_sizes, surplus_titles,
        reviewer_join, agreement_distance, proba_bins, model_disagreement, year_profile_pivot,
        tokenize, stopword_filter, normalised_text, lemmatize, lemmatised_text, ngrams, title_preview, duration_label,
        term_frequency, document_frequency, vocabulary_size, idf, tfidf, select_k_best,
        feature_vectors,
        seeded_shuffle, quota_split, resplit_profile, year_order, year_folds, time_series_folds, stratified_folds,
        head_n, confusion, binary_metrics, macro_metrics, threshold_sweep, full_recall_threshold, pr_curve,
        class_weights, best_candidate, knn_neighbours, knn_vote, knn_vote_weighted,
        knn_sparse, knn_sparse_manhattan, knn_approximate,
        grid_results, cv_years, cv_series, tree_depths, screening_report,
    ]
    out: dict[str, Query] = {q.__name__: q for q in named}
    out["studies"] = dataset_projection
    out["set_overlap"] = lambda spark, folder: vd.set_overlap(studies(spark, folder))
    out["title_intersect"] = lambda spark, folder: vd.shared_titles(studies(spark, folder))
    out["year_profile"] = lambda spark, folder: vd.year_profile(studies(spark, folder))
    out["year_counts"] = lambda spark, folder: vd.year_counts(studies(spark, folder))
    for score in sel.SCORERS:
        out[f"score_{score}"] = score_query(score)
    for key, classifier in {
        "screening_rf": "rforest",
        "screening_dt": "dt",
        "screening_svm": "svm",
        "screening_knn": "knn",
        "screening_lr": "log_reg",
        "screening_nb": "gaussianNB",
        "screening_linreg": "lin_reg",
    }.items():
        out[key] = _screening(classifier)
    return out
