import datetime as dt

import pytest
from pyspark.sql import functions as F

from studysift.config import ScreeningConfig
from studysift.functions import measures as ms
from studysift.operators import lexicon as lx
from studysift.operators.storage import stored
from studysift.operators.folds import temporal_split, with_temporal_split
from studysift.operators.validate import check_required
from studysift.plans.analysis import reviewer_agreement, sweep
from studysift.plans.preparation import screen_bibliography
from studysift.sources import bib, tables

BIB = """@comment{made up for the tests}
@article{k1,
\ttitle        = {A {Nested {Deep}} Title},
\tauthor       = {Doe, Jane},
\tYEAR         = 2006,
\tkeywords     = {one},
\tabstract     = {First line, with a = b
second line 100%.},
\tkeywords     = {two}
}
@inproceedings{article,
  title = "Quoted Title",
  abstract = "Says {x}",
  year = {2010},
  uuid = {u-2},
  inserir = {true}
}
@misc{article,
  title = {No Abstract},
  year = nov
}
"""


def entry(title, n, **more):
    fields = {"title": title, "abstract": f"text {n}", "year": 2000 + n, **more}
    return "@article{k,\n" + ",\n".join(f"  {k} = {{{v}}}" for k, v in fields.items()) + "\n}\n"


def test_bib_entries(spark, tmp_path):
    (tmp_path / "a.bib").write_text(BIB, encoding="utf-8")
    rows = bib.read_bib(spark, str(tmp_path / "a.bib")).orderBy("entry_index").collect()
    assert [(r.entry_type, r.key) for r in rows] == [("article", "k1"), ("inproceedings", "article"), ("misc", "article")]
    first = rows[0].fields
    assert first["title"] == "A {Nested {Deep}} Title" and first["year"] == "2006" and first["keywords"] == "two"
    assert first["abstract"] == "First line, with a = b\nsecond line 100%."
    assert rows[1].fields["title"] == "Quoted Title" and rows[1].fields["abstract"] == "Says {x}"
    assert rows[2].fields == {"title": "No Abstract", "year": "nov"}


def test_entry_order_over_many_splits(spark, tmp_path):
    (tmp_path / "big.bib").write_text("".join(entry(f"title {i}", i % 20) for i in range(3000)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = bib.study_fields(bib.read_bib(spark, str(tmp_path / "big.bib")))
        assert df.rdd.getNumPartitions() > 5
        got = [r.title for r in df.orderBy("entry_index").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"title {i}" for i in range(3000)]


def test_no_line_is_lost_at_split_starts(spark, tmp_path):
    """Values full of lines that start with ``@``, in splits of few bytes: some splits begin with one, some hold no head."""
    lines = "\n".join(f"@line {i} of a value" for i in range(40))
    text = "".join(entry(f"title {i}", i % 20, note=f"begin {i}\n{lines}\nend") for i in range(60))
    (tmp_path / "at.bib").write_text(text, encoding="utf-8")
    for size in ("300", "1000", "7777"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            rows = bib.read_bib(spark, str(tmp_path / "at.bib")).orderBy("entry_index").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert [r.fields["title"] for r in rows] == [f"title {i}" for i in range(60)]
        assert [r.fields["note"] for r in rows] == [f"begin {i}\n{lines}\nend" for i in range(60)]
        assert all(r.unread is None for r in rows)


def test_labelled_files(spark, tmp_path):
    for n, (name, _, _) in enumerate(bib.LABELLED_FILES):
        (tmp_path / name).write_text(entry(f"t{n}", n) + entry(f"t{n}", n + 5), encoding="utf-8")
    tagged = bib.read_labelled(spark, str(tmp_path))
    assert tagged.count() == 8
    studies = bib.deduplicated(tagged)
    got = {(r.split, r.category): (r.title, r.year) for r in studies.collect()}
    assert got["test", "removed"] == ("t0", 2000) and got["train", "selected"] == ("t3", 2003)


def test_pool_reads_every_file(spark, tmp_path):
    (tmp_path / "1.bib").write_text(entry("x", 1, inserir="true") + entry("y", 2), encoding="utf-8")
    (tmp_path / "2.bib").write_text(entry("x", 3) + entry("z", 4, inserir="false") + "@misc{q,\n title = {w}\n}\n", encoding="utf-8")
    studies, rejects = bib.read_pool(spark, str(tmp_path))
    assert {(r.title, r.category, r.year, r.content) for r in studies.collect()} == {
        ("x", "selected", 2001, "x"), ("y", "removed", 2002, "y"), ("z", "removed", 2004, "z")
    }
    assert [r.title for r in rejects.collect()] == ["w"]


def test_render_and_parse_long_value(spark):
    text = "word " * 20_000 + "end"
    df = spark.createDataFrame([(7, text)], "id long, abstract string")
    parsed = df.select(bib.parse_entry(bib.render_entry(F.col("id"), {"abstract": F.col("abstract")})).alias("e"))
    assert parsed.first()["e"]["fields"]["abstract"] == text


def test_report_round_trip_and_refusal(spark, tmp_path):
    out = str(tmp_path / "run")
    probabilities = spark.createDataFrame(
        [("a", "A", 1, 0.9, 0.8), ("b", "B", 0, 0.2, 0.76)],
        "uuid string, title string, was_selected int, RFOREST_proba double, SVM_proba double",
    )
    tables.write_report({"probabilities": probabilities}, out)
    back = tables.read_result(spark, out)
    assert back.count() == 2
    with pytest.raises(Exception, match="already exists"):
        tables.write_report({"probabilities": probabilities}, out)
    with pytest.raises(ValueError):
        tables.write_report({"other": probabilities}, out)
    with pytest.raises(ValueError):
        tables.read_result(spark, out, "other")
    swept = sweep(back, ScreeningConfig())
    assert swept.count() == 8
    assert swept.where("classifier = 'SVM' and threshold = 0.75").first()["false_positives"] == 1
    (tmp_path / "people.csv").write_text(
        "Unnamed: 0,uuid,Titles,Was Selected?,R1,R2,R3\n0,a,A,1,2,2,1\n1,b,B,0,0,1,0\n", encoding="utf-8"
    )
    people = tables.read_reviewers(spark, str(tmp_path / "people.csv"))
    assert people.columns == ["uuid", "title", "was_selected", "R1", "R2", "R3"]
    got = {(r.model, r.measure): r.distance for r in reviewer_agreement(back, people).collect()}
    assert len(got) == 28 and got["RF", "distance_RF_FR"] == 0.0 and got["SVM", "distance_SVM_FR"] == 2.0


def test_csv_report(spark, tmp_path):
    out = str(tmp_path / "run")
    tables.write_report({"scores": spark.createDataFrame([("M", 0.5)], "classifier string, f1 double")}, out, "csv")
    assert tables.read_result(spark, out, "scores", "csv").first()["f1"] == 0.5


LEXICON = [
    ("study", "n", "study"), ("man", "n", "man"), ("glass", "n", "glass"), ("glas", "n", "glas"),
    ("run", "v", "run"), ("ran", "v", "run"), ("bake", "v", "bake"), ("bak", "v", "bak"), ("box", "n", "box"),
]


@pytest.mark.parametrize("broadcast", [True, False])
def test_lemmas(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(lx, "MAX_BROADCAST_LEMMAS", 1)
    cases = [
        ("studies", "n", "study"), ("men", "n", "man"), ("ran", "v", "run"), ("ran", "n", "ran"),
        ("baked", "v", "bak"), ("boxes", "n", "box"), ("glasses", "n", "glass"), ("unknowns", "n", "unknowns"),
        ("glass", "n", "glas"), ("runs", "r", "runs"),
    ]
    tokens = spark.createDataFrame(
        [(i, 0, t, p) for i, (t, p, _) in enumerate(cases)], "doc_id long, position int, token string, pos string"
    )
    lexicon = spark.createDataFrame(LEXICON, "surface string, pos string, lemma string")
    got = {r.doc_id: r.lemma for r in lx.lemmatise(tokens, lexicon).collect()}
    assert got == {i: lemma for i, (_, _, lemma) in enumerate(cases)}
    words = {r.doc_id: r.tokens for r in lx.token_arrays(lx.lemmatise(tokens, lexicon, rows_per_key=1)).collect()}
    assert words[0] == ["study"]
    texts = [(1, ["The", "studies", "ran", "studies", "x"]), (2, ["men", "men"]), (3, []), (4, None), (5, ["plain"])]
    held = stored(spark.createDataFrame(texts, "doc_id long, tokens array<string>"), "tokens")
    pos = F.when(F.col("token") == "ran", "v").otherwise("n")
    changed = {r.doc_id: r.tokens for r in lx.lemmatised_tokens(held, lexicon, pos, rows_per_key=1).collect()}
    assert changed == {1: ["The", "study", "run", "study", "x"], 2: ["man", "man"], 3: [], 4: None, 5: ["plain"]}
    counts = stored(tokens.groupBy("token", "pos").agg(F.count("*").alias("n")), "counts")
    assert {(r.token, r.pos, r.lemma) for r in lx.lemma_counts(counts, lexicon).collect()} == set(cases)


@pytest.mark.parametrize("sent", [True, False])
def test_lemmas_are_looked_up_without_a_map_column(spark, monkeypatch, sent):
    """A large lexicon with few changed tokens moves no row, and no token searches a map from the front."""
    monkeypatch.setattr(lx, "MAX_BROADCAST_LEMMAS", 1)
    monkeypatch.setattr(lx, "MAX_SENT_LEMMAS", 4 if sent else 3)
    texts = [(1, ["The", "studies", None, "ran", "studies"]), (2, ["men", "boxes"]), (3, []), (4, None), (5, ["plain"])]
    held = stored(spark.createDataFrame(texts, "doc_id long, tokens array<string>"), "tokens")
    lexicon = spark.createDataFrame(LEXICON, "surface string, pos string, lemma string")
    made = lx.lemmatised_tokens(held, lexicon, F.when(F.col("token") == "ran", "v").otherwise("n"))
    want = {1: ["The", "study", None, "run", "study"], 2: ["man", "box"], 3: [], 4: None, 5: ["plain"]}
    assert {r.doc_id: r.tokens for r in made.collect()} == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "transform" not in plan and ("Exchange" in plan) != sent


def test_tags_fall_back_to_noun(spark):
    df = spark.createDataFrame([("NN",), ("VBZ",), ("RB",), ("JJ",), (".",)], "t string")
    assert [r[0] for r in df.select(lx.pos_of_tag(F.col("t"))).collect()] == ["n", "v", "r", "n", "n"]


def test_duration_of_aware_timestamps(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2, 1))], "a timestamp, z timestamp")
    assert df.select(ms.duration_label(F.col("a"), F.col("z"))).first()[0] == "01h:00m:00s"


HARD = r"""@article{a,
  title = {{A {\"{o}} {B {C {D {E}}}} title}},
  abstract = {A hook {\v{c}}, and a "quote"},
  year = 2001
}
@article{b,
  title = "A" # " joined " # {title},
  abstract = {Writes to
@someone on a line of its own, and
@another one},
  year = 2002,
}
@article{c,
  title = {Never closed,
  abstract = {x},
  year = 2003
}
@article{d, title = {Last}, abstract = {y}, year = 2004}
"""


def test_no_field_is_lost(spark, tmp_path):
    (tmp_path / "hard.bib").write_text(HARD, encoding="utf-8")
    rows = {r.key: r for r in bib.read_bib(spark, str(tmp_path / "hard.bib")).collect()}
    assert rows["a"].fields["title"] == r'{A {\"{o}} {B {C {D {E}}}} title}'
    assert rows["a"].fields["abstract"] == r'A hook {\v{c}}, and a "quote"'
    assert rows["b"].fields["title"] == "A joined title"
    assert rows["b"].fields["abstract"] == "Writes to\n@someone on a line of its own, and\n@another one"
    assert rows["b"].fields["year"] == "2002" and rows["d"].fields["title"] == "Last"
    assert [rows[k].unread is None for k in "abcd"] == [True, True, False, True]
    _, rejects = check_required(bib.study_fields(bib.read_bib(spark, str(tmp_path / "hard.bib"))))
    assert {r.key: "unread" in r.reasons for r in rejects.collect()} == {"c": True}


def test_existing_report_is_refused_before_any_work(spark, tmp_path):
    (tmp_path / "validation").mkdir()
    with pytest.raises(FileExistsError):
        screen_bibliography(spark, "/nowhere", ScreeningConfig(), out=str(tmp_path))


def test_no_year_is_in_no_split(spark):
    df = spark.createDataFrame([(1, 2000), (2, 2020), (3, None)], "doc_id INT, year INT")
    train, test = temporal_split(df, 2013)
    assert [train.count(), test.count()] == [1, 1]
    assert {r.doc_id: r.part for r in with_temporal_split(df, 2013).collect()} == {1: "train", 2: "test", 3: None}
