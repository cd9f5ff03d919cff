import pytest

from studysift.operators import validate as vd

SCHEMA = "split string, category string, entry_index long, title string, abstract string, year string, uuid string"


def entries(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


CLEAN = [
    ("train", "removed", 0, "a", "x", "2001", None),
    ("train", "selected", 0, "b", "x", "2002", "u1"),
    ("test", "removed", 0, "c", "x", "2015", "u2"),
    ("test", "selected", 0, "d", "x", "2016", "u3"),
]


def test_missing_fields(spark):
    rows = [
        ("train", "removed", 0, "t", "a", "2001", None),
        ("train", "removed", 1, None, "a", "2001", None),
        ("train", "removed", 2, "", "", "", None),
        ("train", "removed", 3, "t2", "a", "20x1", None),
        ("train", "removed", 4, "t3", None, None, None),
    ]
    ok, bad = vd.check_required(entries(spark, rows))
    assert [r.entry_index for r in ok.collect()] == [0]
    reasons = {r.entry_index: r.reasons for r in bad.collect()}
    assert reasons == {1: ["title"], 2: ["abstract", "year", "title"], 3: ["year"], 4: ["abstract", "year"]}


def test_clean_run_is_valid(spark):
    result = vd.validate(entries(spark, CLEAN), strict=True)
    assert result.is_valid() and result.studies.count() == 4
    row = result.studies.where("title = 'b'").first()
    assert (row.content, row.year, row.label) == ("b\nx", 2002, 1)


def test_repeats_within_a_set_are_dropped_but_valid(spark):
    extra = [("train", "removed", i, "a", f"later{i}", "2003", None) for i in (5, 6)]
    result = vd.validate(entries(spark, extra + CLEAN))
    assert result.is_valid()
    assert result.studies.where("title = 'a'").first()["content"] == "a\nx"
    assert [tuple(r) for r in result.duplicates.collect()] == [("train", "removed", "a", 3)]
    surplus = vd.surplus_titles(vd.to_studies(entries(spark, extra + CLEAN)), vd.SET)
    assert [r.title for r in surplus.collect()] == ["a", "a"]


def test_overlaps_are_reported_and_kept(spark):
    rows = [*CLEAN, ("train", "selected", 1, "a", "x", "2001", None), ("test", "removed", 1, "b", "x", "2015", None)]
    result = vd.validate(entries(spark, rows))
    assert not result.is_valid() and result.studies.count() == 6
    overlap = {r.comparison: r.overlap for r in result.overlap.collect()}
    assert overlap == {"Testing Set": 0, "Training Set": 1, "Training and Testing Sets": 2}
    shared = {(r.comparison, r.title) for r in vd.shared_titles(result.studies).collect()}
    assert shared == {("Training Set", "a"), ("Training and Testing Sets", "b")}
    with pytest.raises(ValueError):
        vd.validate(entries(spark, rows), strict=True)


def test_rejects_invalidate_the_run(spark):
    assert not vd.validate(entries(spark, [*CLEAN, ("test", "removed", 9, "e", "", "2015", None)])).is_valid()


def test_year_profiles(spark):
    studies = vd.validate(entries(spark, CLEAN)).studies
    totals = {(r.split, r.year): r.studies for r in vd.year_profile(studies).collect()}
    assert totals[None, None] == 4 and totals["train", None] == 2 and totals["test", 2016] == 1
    lines = [tuple(r) for r in vd.year_profile_side_by_side(studies).orderBy("line").collect()]
    assert lines == [(1, 2001, 1, 2015, 1), (2, 2002, 1, 2016, 1)]


def test_dataset_projection(spark):
    columns = vd.dataset(vd.validate(entries(spark, CLEAN)).studies).columns
    assert columns == ["uuid", "titles", "texts", "categories", "years"]
