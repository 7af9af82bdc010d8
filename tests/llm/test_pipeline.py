"""The pipeline against plain versions of its stages, and its contract."""

import corpus_pipeline
from liftlake.llm.runtime import written

from . import brute
from .conftest import SF


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = written(stage(spark, docs, SF), "stage")
        ids = {r.doc_id for r in out.collect()}
        if number < 4:
            assert out.columns == columns
        if number == 0:
            assert 0 < len(ids) < len(before)
        if number == 1:
            assert ids == {i for i, x in brute.exact(before).items() if x[2]}
        if number == 2:
            assert ids == {i for i, x in brute.jaccard(before).items() if x[1] == i}
        if number == 3:
            assert ids == {i for i, x in brute.contamination(before, items).items() if not x[4]}
        if number == 4:
            assert ids == {i for i, _ in before} and out.where("not lossless").count() == 0
        docs = out
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ids


def test_registered(spark):
    import __spark_entry__ as entry
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_small_batches(spark, monkeypatch):
    """Every stage runs with small batches of texts, later work as before."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)

    def stage(spark, docs, sf_dir):
        seen.append(int(spark.conf.get(key)))
        return docs.limit(1)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage)])
    assert corpus_pipeline.run(spark, SF).count() == 1
    assert seen == [1000, 1000] and spark.conf.get(key) == before
