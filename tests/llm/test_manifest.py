"""The Merkle manifest against a plain version."""

import pytest

from liftlake.llm import manifest

from . import brute

OUT = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def of(df):
    return sorted((tuple(r[c] for c in OUT) for r in df.collect()), key=str)


def plain(df):
    return brute.manifest([tuple(r) for r in df.select(*manifest.FIELDS).collect()])


def test_table(documents):
    assert of(manifest.manifest(documents)) == plain(documents)


def test_edge(edge, empty):
    """Nulls, empty and long texts, clashing columns; an empty table."""
    assert of(manifest.manifest(edge)) == plain(edge)
    assert manifest.manifest(empty).count() == 0


@pytest.mark.parametrize("rows", [1, 2, 16, 17, 257, 300])
def test_shapes(spark, rows):
    """Lone rows, full runs, a last run of one, three levels; repeated rows,
    one id with several texts, null ids and a null source."""
    data = [(None if i % 50 == 7 else i // 2 if i > 100 else i, None if i % 97 == 3 else "hot" if i % 9 else f"é{i}", "en", i,
             None if i % 31 == 5 else f"Text {i % 3}") for i in range(rows)]
    df = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string")
    assert of(manifest.manifest(df)) == plain(df)


def test_many_sources(spark):
    """The tree above the sources has levels of its own."""
    df = spark.createDataFrame([(i, f"s{i % 290:03d}", None, None, "A") for i in range(600)],
                               "doc_id long, source string, lang string, n_chars long, text string")
    got = of(manifest.manifest(df))
    assert got == plain(df)
    assert {r[6] for r in got} == {True, False}
