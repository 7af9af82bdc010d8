"""Collocation mining against a plain version."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from liftlake.llm import collocations

from . import brute

OUT = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def of(df):
    return sorted(tuple(r[c] for c in OUT) for r in df.collect())


def plain(df, **more):
    return brute.collocations([(r.lang, r.text) for r in df.select("lang", "text").collect()], **more)


def test_table(documents):
    got = of(collocations.collocations(documents))
    assert got and got == plain(documents)


def test_edge(edge, empty):
    assert of(collocations.collocations(edge, least=3)) == plain(edge, least=3)
    assert collocations.collocations(empty).count() == 0


def test_ties_and_repeats(spark):
    """Phrases of equal scores, words that repeat, a language of its own for
    null, separators of every kind, a short report."""
    texts = ["a a a a a a", "b c\td  e f g", "b c.d e\nf g", "été à é", None, "X y!x Y?x y"] * 40
    df = spark.createDataFrame([(None if i % 4 else "en", t) for i, t in enumerate(texts)], "lang string, text string")
    for first in (2000, 3):
        assert of(collocations.collocations(df, least=20, first=first)) == plain(df, least=20, first=first)


@pytest.mark.parametrize("length", [2, 5])
def test_failures_expand(spark, length):
    """Phrases that the sample misses wholly: further passes find them, also
    those whose parts were missed too."""
    words = " ".join(f"w{j}" for j in range(length))
    docs = spark.createDataFrame([(i, "en", words) for i in range(4000)], "doc_id long, lang string, text string")
    ident = F.col("doc_id")
    missed = docs.where(F.pmod(F.xxhash64(ident), F.lit(collocations.SAMPLE)) != 0).limit(150)
    common = docs.where(F.pmod(F.xxhash64(ident), F.lit(collocations.SAMPLE)) == 0).limit(150).withColumn("text", F.lit("only these words"))
    both = missed.unionByName(common)
    bits, passes = collocations.frequent(both, ident=ident)
    assert passes == 2
    assert of(collocations.scored(collocations.count_phrases(both.select("lang", "text"), bits)).withColumn("rank", F.lit(0)))
    assert of(collocations.collocations(both)) == plain(both)


def test_small_bitmap_loses_nothing(documents, monkeypatch):
    """A full bitmap counts more and finds the same."""
    monkeypatch.setattr(collocations, "BITS", 1 << 15)
    assert of(collocations.collocations(documents)) == plain(documents)


def test_scores_pass_64_bits(spark):
    counts = spark.createDataFrame(
        [("en", "", 0, 9 * 10 ** 12), ("en", "a", 1, 3 * 10 ** 12), ("en", "b", 1, 2 * 10 ** 12 + 1), ("en", "a b", 2, 10 ** 12 + 7)],
        "lang string, phrase string, size int, f long")
    (row,) = collocations.scored(counts).collect()
    assert row.score == 1000 * (10 ** 12 + 7) * 9 * 10 ** 12 // (3 * 10 ** 12 * (2 * 10 ** 12 + 1))


def test_slices_agree(documents, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 1000)
    monkeypatch.setattr(collocations, "HELD", 500)
    assert of(collocations.collocations(documents)) == plain(documents)
    assert np.uint64(1) == collocations._U(1)


def test_small_batches_handed_on(spark):
    """A task hands on small batches, whatever it has gathered, and each of its
    phrases once."""
    class Docs:
        sparkSession = spark

        def mapInArrow(self, run, schema):
            self.run = run
            return spark.createDataFrame([], schema)

    words = 2 * collocations.GATHERED
    rows = pa.RecordBatch.from_pydict({"text": [f"w{i}" for i in range(words)] * 2, "lang": ["en"] * (2 * words)})
    every = np.full(collocations.BITS // 8, 255, np.uint8)
    for count, phrase in ((collocations.count_phrases, "phrase"), (collocations.count_hashes, "h")):
        docs = Docs()
        count(docs, every)
        out = list(docs.run(iter([rows])))
        assert max(map(len, out)) <= collocations.BATCH
        got = [x for b in out for x in b[phrase].to_pylist() if x != ""]
        assert len(got) == len(set(got)) == words
        assert sum(sum(b["f"].to_pylist()) for b in out) == (4 if phrase == "phrase" else 2) * words


def test_rows_handed_on_grow_with_phrases(spark, monkeypatch):
    """The rows of the last pass do not grow with the parts of the input: a task
    hands on its phrases once, and there are a few tasks a core."""
    made = []
    known = type(spark.range(1)).mapInArrow

    def kept(self, run, schema, *more):
        df = known(self, run, schema, *more)
        if "phrase" in schema:
            made.append(df)
        return df
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", kept)
    texts = [(i, "en", "one two three four. five six") for i in range(600)]
    few, many = (spark.createDataFrame(texts, "doc_id long, lang string, text string").repartition(n) for n in (4, 60))
    assert of(collocations.collocations(few)) == of(collocations.collocations(many)) == plain(few)
    phrases = 4 + 3 + 2 + 1 + 2 + 1 + 1                          # the last is the row of all words
    cores = spark.sparkContext.defaultParallelism
    assert [df.count() for df in made] == [4 * phrases, collocations.TASKS * cores * phrases]
    (total,) = made[1].where("size = 0").agg(F.sum("f")).first()
    assert total == 6 * len(texts)
