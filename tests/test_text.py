import datetime as dt

import pytest
from pyspark.ml.feature import NGram
from pyspark.sql import functions as F

from studysift.functions import measures as ms
from studysift.functions import text as tx


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


def test_tokens_keep_case_and_marks(spark):
    assert one(spark, "Été 2nd: a_b!", tx.tokens(F.col("x"))) == ["Été", "2nd", ":", "a_b", "!"]


def test_vector_words_drop_single_letters(spark):
    assert one(spark, "A Bc d É éÉ x_1", tx.vector_words(F.col("x"))) == ["bc", "éé", "x_1"]


@pytest.mark.parametrize("words", [[], ["a"], ["a", "b"], ["a", "b", "c", "d"]])
def test_ngrams_of_short_arrays(spark, words):
    expected = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    assert one(spark, words, tx.ngrams(F.col("x"), 1, 3), "array<string>") == expected


def test_ngrams_agree_with_ml(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d", "e"],)], "w array<string>")
    ml = NGram(n=3, inputCol="w", outputCol="g").transform(df).first()["g"]
    assert df.select(tx.ngrams(F.col("w"), 3, 3).alias("g")).first()["g"] == ml


def test_stopwords_and_normalisation(spark):
    assert len(tx.ENGLISH_STOPWORDS) == len(set(tx.ENGLISH_STOPWORDS)) == 179
    keep = tx.normalised(tx.tokens(F.col("x")), [tx.drop_stopwords()])
    assert one(spark, "The Study OF Words", keep) == "study words"


def test_filters_run_in_order(spark):
    upper = lambda t: F.transform(t, F.upper)
    only_a = lambda t: F.filter(t, lambda w: w == "A")
    assert one(spark, "a b", tx.normalised(tx.tokens(F.col("x")), [upper, only_a])) == "a"
    assert one(spark, "a b", tx.normalised(tx.tokens(F.col("x")), [only_a, upper])) == ""


def test_lines(spark):
    assert one(spark, "t\na\nb", tx.first_line(F.col("x"))) == "t"
    assert one(spark, "t\na\nb", tx.after_first_line(F.col("x"))) == "a\nb"
    assert one(spark, "t", tx.after_first_line(F.col("x"))) is None


@pytest.mark.parametrize(
    "hours,expected", [(1, "01h:00m:00s"), (25.5, "01h:30m:00s"), (-0.5, "23h:30m:00s"), (0, "00h:00m:00s")]
)
def test_duration_drops_days(spark, hours, expected):
    start = dt.datetime(2024, 3, 30, 12)
    df = spark.createDataFrame([(start, start + dt.timedelta(hours=hours))], "a timestamp_ntz, z timestamp_ntz")
    assert df.select(ms.duration_label(F.col("a"), F.col("z"))).first()[0] == expected


@pytest.mark.parametrize("p,b", [(0.5, 0), (0.51, 1), (0.6, 1), (0.61, 2), (None, 2), (float("nan"), 2)])
def test_proba_bins(spark, p, b):
    assert one(spark, p, ms.proba_bin(F.col("x")), "double") == b


def test_strict_below(spark):
    assert one(spark, 0.3, ms.unless_below(F.col("x"), 0.3), "double") == 1
    assert one(spark, 0.29, ms.unless_below(F.col("x"), 0.3), "double") == 0
