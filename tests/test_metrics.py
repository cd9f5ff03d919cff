import random

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from studysift.operators import agreement as ag
from studysift.operators import metrics as mt


def frame(spark, n=60, seed=5):
    rng = random.Random(seed)
    rows = [(i, f"t{i}", int(rng.random() < 0.4), rng.randint(0, 10) / 10) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, title string, label int, proba double")
    return df.withColumn("pred", (F.col("proba") >= 0.5).cast("int")), rows


def test_confusion_adds_up_and_agrees_with_ml(spark):
    df, rows = frame(spark)
    c = mt.confusion(df, {"M": "pred"}).first()
    assert c.true_negatives + c.true_positives + c.false_negatives + c.false_positives == len(rows)
    m = mt.binary_metrics(df, {"M": "pred"}).first()
    ml = df.select(F.col("label").cast("double"), F.col("pred").cast("double").alias("prediction"))
    for name, mine in (("precisionByLabel", m.precision), ("recallByLabel", m.recall), ("accuracy", m.accuracy)):
        evaluator = MulticlassClassificationEvaluator(labelCol="label", metricName=name, metricLabel=1.0)
        assert abs(evaluator.evaluate(ml) - mine) < 1e-12


def test_no_predicted_positives_give_zero(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, pred int")
    m = mt.binary_metrics(df, {"M": "pred"}).first()
    assert (m.accuracy, m.precision, m.recall, m.f1) == (0.5, 0.0, 0.0, 0.0)


def test_macro_ignores_absent_class(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "label int, pred int")
    m = mt.macro_metrics(df).first()
    assert (m.precision_macro, m.recall_macro, m.f1_macro) == (1.0, 1.0, 1.0)


def test_sweep_matches_single_thresholds(spark):
    df, rows = frame(spark)
    got = mt.threshold_sweep(df, {"M": (0.5, 0.7)}, {"M": "proba"}).collect()
    for r in got:
        assert r.true_positives == sum(1 for x in rows if x[2] == 1 and x[3] >= r.threshold)
        assert r.false_positives == sum(1 for x in rows if x[2] == 0 and x[3] >= r.threshold)


def test_pr_curve(spark):
    df, rows = frame(spark)
    got = {r.threshold: (r.precision, r.recall) for r in mt.pr_curve(df.withColumn("c", F.lit("x")), ("c",)).collect()}
    total, want = sum(r[2] for r in rows), {None: (1.0, 0.0)}
    for t in sorted({r[3] for r in rows}, reverse=True):
        hit = [r[2] for r in rows if r[3] >= t]
        want[t] = (sum(hit) / len(hit), sum(hit) / total)
        if sum(hit) == total:
            break
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_full_recall_threshold_is_capped(spark):
    df = spark.createDataFrame([(1, 1, 0.2), (1, 0, 0.1), (2, 1, 0.9)], "fold int, label int, proba double")
    assert {r.fold: r.threshold for r in mt.full_recall_threshold(df, ("fold",)).collect()} == {1: 0.2, 2: 0.5}


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    assert {r.label: r.weight for r in mt.class_weights(df).collect()} == {1: 2.0, 0: pytest.approx(2 / 3)}
    got = mt.with_class_weight(df, True).groupBy("label").agg(F.max("weight").alias("w")).collect()
    assert {r.label: r.w for r in got} == {1: 2.0, 0: pytest.approx(2 / 3)}


def test_best_candidate_first_on_ties(spark):
    df = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.7), ("a", 2, 0.7)], "classifier string, candidate int, mean_score double")
    assert mt.best_candidate(df).first()["candidate"] == 1


def test_shared_outcomes(spark):
    df, rows = frame(spark)
    other = df.withColumn("pred", (F.col("proba") >= 0.8).cast("int"))
    a = mt.outcome_rows(df, "pred", keep=("doc_id", "title"))
    b = mt.outcome_rows(other, "pred", keep=("doc_id", "title"))
    assert mt.shared_outcomes(a, b).count() == sum(1 for r in rows if (r[3] >= 0.5) == (r[3] >= 0.8))


def test_reviewer_join_and_distances(spark):
    model = spark.createDataFrame(
        [("a", 1, "A", 0.9), ("b", 0, "B", 0.55), ("c", 1, "C", 0.2), (None, 0, "N", 0.1)],
        "uuid string, was_selected int, title string, RFOREST_proba double",
    )
    people = spark.createDataFrame(
        [("a", 1, "A*", 2.0, 1.0, 0.0), ("b", 0, "B*", 0.0, None, 1.0), ("d", 1, "D", 2.0, 2.0, 2.0), (None, 0, "M", 0.0, 0.0, 0.0)],
        "uuid string, was_selected int, title string, R1 double, R2 double, R3 double",
    )
    joined = ag.reviewer_join(model, people)
    assert sorted(r.title for r in joined.collect()) == ["A", "B", "C", "D", "M", "N"]
    rows = ag.binned(joined, {"RF": "RFOREST_proba"})
    bins = {r.title: r.RF for r in rows.collect()}
    assert bins == {"A": 2, "B": 1, "C": 0, "D": 2, "M": 2, "N": 0}
    got = {r.measure: r.distance for r in ag.distances(rows, ("RF",)).collect()}
    assert len(got) == 14
    pdf = rows.toPandas()

    def gap(*names):
        return float(np.sqrt((((pdf[list(names)].sum(axis=1, skipna=False) / len(names)) - pdf["FR"]) ** 2).sum()))

    assert got["distance_R2_FR"] == pytest.approx(gap("R2"))
    assert got["distance_RF_FR"] == pytest.approx(gap("RF"))
    assert got["distance_pair_R1_RF"] == pytest.approx(gap("R1", "RF"))
    assert got["distance_group_R1_RF_R3"] == pytest.approx(gap("R1", "RF", "R3"))
