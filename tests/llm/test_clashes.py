"""Frames that are unions of scans, and documents with the operators' own column names."""

from pyspark.sql import functions as F

from liftlake.llm import decontaminate, exact, jaccard

from . import brute
from .conftest import SF


def test_helper_columns_keep_the_rows_values(spark, documents):
    own = ("_file", "_row", "_n_words", "_starts", "_ends", "_items", "keep_id", "own_id", "file", "row", "all")
    docs = documents.withColumns({c: F.lit(f"mine {c}") for c in own})
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    for kept in (exact.keep_first(docs, exact.exact_dedup(docs)), jaccard.keep_first(docs, jaccard.jaccard_classes(docs)),
                 decontaminate.keep_clean(docs, items)):
        assert kept.columns == docs.columns
        assert kept.select(*own).distinct().collect() == [tuple(f"mine {c}" for c in own)]


def test_unions_of_scans(spark, documents, rows):
    both = documents.where("doc_id % 2 = 0").unionByName(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 1"))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_dedup(both).collect()}
    assert got == brute.exact(rows)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(both).collect()}
    assert found == brute.jaccard(rows)


def test_items_without_ids_and_with_text_ids(spark):
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, words), (2, "other words only")], "doc_id long, text string")
    items = spark.createDataFrame([(None, words[:60]), ("gsm-1", words), ("gsm-1", words), ("z", "other words only")], "item_id string, text string")
    for block in (10 ** 6, 5):                                   # one block, a block for each item
        got = {r.doc_id: (r.n_hit, r.n_items, r.items, r.contaminated) for r in decontaminate.decontaminate(docs, items, block).collect()}
        assert got == {1: (30, 1, ["gsm-1"], True), 2: (3, 1, ["z"], True)}
    nameless = decontaminate.decontaminate(docs, items.where("item_id is null"))
    assert {r.doc_id: (r.n_hit > 12, r.n_items, r.contaminated) for r in nameless.collect()} == {1: (True, 0, True), 2: (False, 0, False)}
