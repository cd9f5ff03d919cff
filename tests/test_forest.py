import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from studysift.operators import forest as fr
from studysift.operators import models as md


def labelled(spark, n, width, seed, first=0):
    """Rows with a rule, noise, zeros and values beyond the bins."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, width)) < 0.4, 0.0, np.round(rng.normal(0, 1, (n, width)), 1))
    y = ((x[:, 0] + x[:, 1] * x[:, 2 % width] > 0.2) ^ (rng.random(n) < 0.1)).astype(int)
    df = spark.createDataFrame([(first + i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "doc_id long, v array<double>, label int")
    return df.select("doc_id", array_to_vector("v").alias("features"), "label").cache(), x, y


@pytest.mark.parametrize("impurity,histogram", [("gini", 10**6), ("entropy", 1)])
def test_subtrees_split_as_the_library_does(spark, monkeypatch, impurity, histogram):
    """With every row once and all features at each node a subtree is the library's tree."""
    monkeypatch.setattr(fr, "HISTOGRAM", histogram)
    df, x, y = labelled(spark, 700, 2, 1)
    weights = {0: 1.0, 1: 1.7}
    weighed = df.withColumn("weight", F.when(F.col("label") == 1, 1.7).otherwise(1.0)).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=5, minInstancesPerNode=8, impurity=impurity, weightCol="weight").fit(weighed)
    proba = vector_to_array("probability")[1]
    want = [r[0] for r in model.transform(weighed).orderBy("doc_id").select(proba).collect()]
    s = fr.Settings(1, 5, 8, impurity, (weights[0], weights[1]), 3, 2)
    assert s.subset == 2
    cuts = [fr.cuts_of(c, np.where(y == 1, 1.7, 1.0)) for c in x.T]
    binned = fr.binned(x, cuts)
    tree = fr.grow(binned, y.astype(np.uint8), np.ones(700, np.uint8), 5, s, np.random.default_rng(0))
    assert (tree.rows[0] == np.bincount(y)).all() and len(tree.left) == model.numNodes
    weighed = tree.rows[tree.walk(binned, np.arange(700))] * [1.0, 1.7]
    assert np.allclose(weighed[:, 1] / weighed.sum(axis=1), want)


def test_leaves_of_one_class_are_one():
    s = fr.Settings(1, 3, 1, "gini", (1.0, 1.0), 0, 2)
    rows = np.array([[9, 5], [9, 1], [0, 4], [6, 0], [3, 1]])
    tree = fr.Tree(np.array([1, 3, -1, -1, -1]), np.array([2, 4, -1, -1, -1]), np.array([0, 1, -1, -1, -1]), np.zeros(5, int), rows)
    got = fr.pruned(tree, s)
    assert got.left.tolist() == [1, -1, -1] and got.rows.tolist() == rows[:3].tolist()
    # a subtree that goes on below one of them keeps them apart, one that is a leaf of the other class too
    assert fr.pruned(tree, s, {4: None}).left.tolist() == fr.pruned(tree, s, {4: 1}).left.tolist() == tree.left.tolist()
    assert fr.pruned(tree, s, {4: 0, 2: 0}).left.tolist() == [-1, -1, -1, -1, -1]


def test_cuts_and_bags():
    assert fr.cuts_of(np.array([3.0, 1.0, 1.0, 2.0]), np.ones(4)).tolist() == [1.5, 2.5]
    many = fr.cuts_of(np.arange(1000.0), np.ones(1000))
    assert len(many) == 31 and np.allclose(np.diff(many), 31.25, atol=1)
    drawn = fr.bags(np.random.default_rng(0).integers(-(2**63), 2**63, 20_000), 42, 8)
    assert abs(drawn.mean() - 1) < 0.02 and abs(drawn.var() - 1) < 0.03
    assert np.abs(np.corrcoef(drawn.T) - np.eye(8)).max() < 0.03


def test_large_forests_stay_in_the_tasks(spark, monkeypatch):
    """A forest with more nodes than the driver should hold is not fitted by the library, and predicts as well as that one."""
    train, _, _ = labelled(spark, 1500, 9, 1)
    asked, _, truth = labelled(spark, 400, 9, 2, first=5000)
    params = {"n_estimators": 30}

    def right(model):
        rows = model.transform(asked).orderBy("doc_id").collect()
        assert len(rows) == 400 and all(0 <= r["proba"] <= 1 and r["pred"] == (r["proba"] > 0.5) for r in rows)
        return np.mean([r["pred"] == t for r, t in zip(rows, truth)]), [r["proba"] for r in rows]

    plain, proba = right(md.fit_forest(train, params, 7))
    monkeypatch.setattr(md, "MAX_NODES", 10_000)
    monkeypatch.setattr(md, "RandomForestClassifier", None)
    for name, value in {"GROUP_VALUES": 3000, "PACK_VALUES": 900, "HISTOGRAM": 3000, "TOP_HISTOGRAM": 4000, "PART_ROWS": 400}.items():
        monkeypatch.setattr(fr, name, value)
    model = md.fit_forest(train, params, 7)
    got, mine = right(model)
    assert got >= plain - 0.03 and np.corrcoef(mine, proba)[0, 1] > 0.95
    again, others = right(md.fit_forest(train.repartition(3).orderBy(F.desc("label")), params, 7))
    assert mine == others
    # each subtree was grown from few rows, and all rows of the bags are in them
    kept = md._fit_deep_forest(train, 1500, 30, md._tree_settings(params), params, 7).transform.__self__
    assert min(len(t.left) for t in kept.tops) > 1
    sizes = [np.frombuffer(r["rows"], np.int64)[:2].sum() for r in kept.subtrees.select("rows").collect()]
    assert len(sizes) > 60 and max(sizes) <= 3000 // 9
    assert sum(sizes) > 0.7 * sum(t.rows[0].sum() for t in kept.tops)


def test_large_forests_with_copies_one_class_and_odd_keys(spark, monkeypatch):
    monkeypatch.setattr(md, "MAX_NODES", 1)
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, [0.0, 2.0], 0), (3, [0.0, 2.0], 0), (4, [0.0, 1.0], 0)] * 6
    df = spark.createDataFrame(rows, "doc_id long, v array<double>, label int").select("doc_id", array_to_vector("v").alias("features"), "label")
    params = {"n_estimators": 25, "class_weight": "balanced"}
    got = md.fit_forest(df, params, 7).transform(df)
    assert got.columns == ["doc_id", "features", "label", "pred", "proba"]
    rows = got.collect()
    assert len(rows) == 30 and all(r["pred"] == r["label"] for r in rows)
    one = md.fit_forest(df.where("label = 0"), params, 7).transform(df).collect()
    assert [(r["pred"], r["proba"]) for r in one] == [(0, 0.0)] * 30
    with pytest.raises(ValueError, match="labels"):
        md.fit_forest(df.withColumn("label", F.lit(None).cast("int")), {"n_estimators": 25}, 7)
    assert md.fit_forest(df, params, 7).transform(df.where("false")).count() == 0
