import corpus_pipeline as cp
from studysift.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from tests.llm.cases import empty

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage_takes_effect(spark, small):
    """Each stage keeps what its operator says of the stage's own input, and the last packs all that is left."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(cp.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "near dedup", "decontamination", "packing"]
    labels = spark.read.parquet(f"{small}/labels.parquet")
    items = spark.read.parquet(f"{small}/benchmark.parquet")

    def expected(name, d):
        ids = lambda df: {r["doc_id"] for r in df.collect()}
        if name == "toxicity":
            return ids(toxicity.toxicity(d, labels).filter("predicted = 0"))
        if name == "exact dedup":
            return ids(exact_dedup.exact_duplicates(d).filter("kept"))
        if name == "near dedup":
            return ids(simhash.near_duplicates(d).filter("doc_id = component_id"))
        return ids(d) - ids(decontaminate.matches(d, items))

    for name, stage in cp.STAGES[:-1]:
        out = packing.stored(stage(spark, docs, small), "stage")
        assert sorted(out.columns) == sorted(DOCUMENT)
        kept = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(kept) == len(set(kept)) and set(kept) == expected(name, docs), name
        assert len(kept) <= docs.count()
        docs = out
    packed = {r["doc_id"] for r in stages["packing"](spark, docs, small).collect()}
    assert packed == set(kept) == {r["doc_id"] for r in cp.run(spark, small).collect()}


def test_stages_on_an_empty_table(spark, small):
    docs = empty(spark)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, small).count() == 0
