import random

import pytest
from pyspark.sql import functions as F

from studysift.operators import folds as fd
from studysift.operators.ranking import number_rows


def studies(spark, histogram, seed=1):
    rng = random.Random(seed)
    years = [y for y, n in histogram.items() for _ in range(n)]
    rng.shuffle(years)
    rows = [(i, i, y, int(rng.random() < 0.7)) for i, y in enumerate(years)]
    df = spark.createDataFrame(rows, "doc_id long, entry_index long, year int, label int")
    return df.withColumn("category", F.when(F.col("label") == 1, "selected").otherwise("removed")), rows


def in_order(rows):
    return sorted(rows, key=lambda r: (r[2], r[3], r[1]))


def walk(years, n_splits):
    """Row positions of each fold's test block, found by walking back one year at a time."""
    ends, out, current = len(years), [], max(years)
    for _ in range(n_splits):
        at = years.index(current)
        if len(years) - at < 5:
            current = max(years[:at])
            at = years.index(current)
        out.append(range(at, ends))
        ends = at
        current = max(years[:at])
    return out


@pytest.mark.parametrize(
    "histogram",
    [
        {2000: 9, 2001: 7, 2002: 8, 2003: 6, 2004: 9, 2005: 6},
        {2000: 9, 2001: 7, 2002: 8, 2003: 6, 2004: 1, 2005: 2},
        {2000: 9, 2001: 7, 2002: 8, 2003: 2, 2004: 1, 2005: 1},
        {1999: 3, 2000: 9, 2001: 7, 2002: 1, 2003: 1, 2004: 1, 2005: 1},
    ],
)
def test_year_folds(spark, histogram):
    df, rows = studies(spark, histogram)
    order = in_order(rows)
    got = {r.doc_id: r.fold for r in fd.year_folds(df, 3).collect()}
    want = {r[0]: None for r in order}
    for fold, block in enumerate(walk([r[2] for r in order], 3), start=1):
        want.update({order[p][0]: fold for p in block})
    assert got == want


def test_year_fold_parts_train_on_earlier_years(spark):
    df, _ = studies(spark, {2000: 9, 2001: 7, 2002: 8, 2003: 6})
    marked = fd.year_folds(df, 2)
    for fold in (1, 2):
        train, test = fd.year_fold_parts(marked, fold)
        assert train.agg(F.max("year")).first()[0] < test.agg(F.min("year")).first()[0]


def test_too_few_years_raise(spark):
    df, _ = studies(spark, {2000: 9, 2001: 9, 2002: 9})
    assert fd.year_folds(df, 2).count() == 27
    with pytest.raises(Exception, match="more distinct years"):
        fd.year_folds(df, 3).collect()


@pytest.mark.parametrize("n,k", [(23, 5), (12, 3), (24, 5)])
def test_time_series_folds(spark, n, k):
    df, rows = studies(spark, {2000: n // 2, 2003: n - n // 2})
    size = n // (k + 1)
    lead = n - k * size
    want = {r[0]: 0 if p < lead else 1 + (p - lead) // size for p, r in enumerate(in_order(rows))}
    assert {r.doc_id: r.fold for r in fd.time_series_folds(df, k).collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_stratified_folds(spark, seed):
    df, rows = studies(spark, {2000: 7, 2001: 11, 2002: 5}, seed)
    k, order = 4, in_order(rows)
    classes = list(dict.fromkeys(r[3] for r in order))
    line = [c for c in classes for r in order if r[3] == c]
    want = {}
    for c in classes:
        shares = [sum(1 for x in line[i::k] if x == c) for i in range(k)]
        fill = [i + 1 for i in range(k) for _ in range(shares[i])]
        want.update({r[0]: f for r, f in zip([r for r in order if r[3] == c], fill)})
    assert {r.doc_id: r.fold for r in fd.stratified_folds(df, k).collect()} == want


def test_number_rows_with_a_crowded_group(spark):
    df = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50 + 2).cast("int").alias("g")
    )
    got = [r.id for r in number_rows(df, "id", groups=("g",)).orderBy("position").collect()]
    assert got == [r.id for r in df.orderBy("g", "id").collect()]


def test_number_rows_keeps_null_groups(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, None), (None, 5)], "id long, g int")
    got = sorted((r.position, r.id, r.g) for r in number_rows(df, "id", groups=("g",)).collect() if r.id is not None)
    assert got == [(1, 1, None), (2, 3, None), (4, 2, 5)] or got == [(1, 1, None), (2, 3, None), (3, 2, 5)]
    assert number_rows(df, "id", groups=("g",)).count() == 4


def test_year_order_puts_removed_first(spark):
    df, rows = studies(spark, {2000: 6, 2001: 6})
    got = fd.year_order(df.withColumn("split", F.lit("train"))).orderBy("position").collect()
    assert [r.doc_id for r in got] == [r[0] for r in in_order(rows)]


def test_seeded_shuffle_is_a_stable_permutation(spark):
    df = spark.range(100).withColumnRenamed("id", "doc_id")

    def run(x, seed):
        return {r.doc_id: r.position for r in fd.seeded_shuffle(x, seed).collect()}

    first = run(df.repartition(1), 42)
    assert sorted(first.values()) == list(range(1, 101))
    assert first == run(df.repartition(7), 42) != run(df, 43)


def test_quota_split(spark):
    df, rows = studies(spark, {2000: 30, 2001: 30})
    got = fd.quota_split(df.withColumn("split", F.lit("")), 42, 5, 7)
    counts = {(r.category, r.split): r["count"] for r in got.groupBy("category", "split").count().collect()}
    selected = sum(r[3] for r in rows)
    assert counts == {
        ("selected", "test"): 5,
        ("selected", "train"): selected - 5,
        ("removed", "train"): 7,
        ("removed", "test"): 60 - selected - 7,
    }


def test_temporal_split_is_a_partition(spark):
    df, _ = studies(spark, {2000: 3, 2001: 4, 2002: 5})
    train, test = fd.temporal_split(df, 2001)
    assert (train.count(), test.count()) == (7, 5)
