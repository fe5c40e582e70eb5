import importlib.util

import pytest
from fixtures import docs

import __spark_entry__

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("the pipeline is not installed", allow_module_level=True)
import corpus_pipeline


def test_stages_and_run(spark, sf):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    d = spark.read.parquet(f"{sf}/documents.parquet")
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf).cache()
        assert out.columns == corpus_pipeline.COLUMNS
        counts[name] = out.count()
        assert out.where("n_chars <> length(text)").count() == 0
        d = out
    assert counts["language ID"] >= 0.98 * 200 and counts["line dedup"] == counts["language ID"] > counts["SimHash near-dedup"] >= counts["mixing sources"] > 0
    got = corpus_pipeline.run(spark, sf)
    words = {r["doc_id"] for r in got.select("doc_id").distinct().collect()}
    assert words == {r["doc_id"] for r in d.select("doc_id").collect()}


def test_odd_tables(spark, sf):
    rows = [(i, f"the cat and the dog of the house number {i} and some more words to tell", "en", "s") for i in range(30)]
    odd = docs(spark, [*rows, (100, None, None, None), (101, "", "en", "s"), (None, "the cat and the dog of no number", "en", "s")])
    for d in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            if name == "language ID" and d.isEmpty():
                assert stage(spark, d, sf).count() == 0
            d = stage(spark, d, sf).cache()
        assert "sequence_id" in d.columns


def test_every_operator_has_one_query():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
