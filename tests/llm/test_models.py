"""Trained operators: held-out accuracy, folds, and odd inputs."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from liftlake.llm import language, personal, pieces, quality, toxicity
from liftlake.llm.labelled import sample

from .conftest import EDGE_TEXTS

SF01 = "/root/testdata/sf0.01"


def crc(i):
    return zlib.crc32(str(i).encode())


def test_language(spark, edge, empty):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = language.train(docs, per_language=100)
    got = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    odd = {r.doc_id: r for r in language.predict(edge, model).collect()}
    assert len(odd) == len(EDGE_TEXTS)
    for i, t in enumerate(EDGE_TEXTS):
        assert (odd[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    assert language.predict(empty, model).count() == 0
    assert {r.lang_pred for r in language.predict(edge, language.train(empty)).collect()} == {"und"}


def test_quality(spark, edge, empty):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").where("quality is not null").collect()
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.quality == r.predicted for r in held]) > 0.95
    odd = quality.score(edge, model).collect()
    assert len(odd) == len(EDGE_TEXTS) and all(0 <= r.score <= 1 for r in odd)
    assert quality.score(empty, model).count() == 0
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(edge, none).collect()} == {0.5}
    kept = quality.keep_good(edge, model)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in odd if r.predicted}


def test_toxicity(spark, edge, empty):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").where("toxic is not null").collect()
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([r.toxic == r.predicted for r in got if r.held_out]) > 0.9
    odd = toxicity.score(edge, model).collect()
    assert len(odd) == len(EDGE_TEXTS) and all(0 <= r.score <= 1 for r in odd)
    assert not any(r.predicted for r in odd if not (EDGE_TEXTS[r.doc_id] or "").strip())
    assert toxicity.score(empty, model).count() == 0
    assert {r.score for r in toxicity.score(edge, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}


def test_toxicity_finds_spaced_and_dotted_texts(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    rows = (docs.select("doc_id", "text", "lang").join(labels.select("doc_id", "toxic"), "doc_id")
            .where("text is not null and toxic is not null and lang = 'en'").orderBy("doc_id").collect())
    learnt = [r for r in rows if crc(r.doc_id) % 5]
    model = toxicity.fit([r.text for r in learnt], np.array([r.toxic for r in learnt]))
    texts, label = [r.text for r in rows], np.array([r.toxic for r in rows])
    bad = [t for t, y in zip(texts, label) if y == 1]
    plain = model.scores(pa.array(bad, pa.large_string())) >= 0.5
    assert plain.mean() >= 0.9
    assert (model.scores(pa.array([t for t, y in zip(texts, label) if y == 0], pa.large_string())) < 0.5).mean() > 0.99
    for sep in (" ", "."):
        got = model.scores(pa.array([sep.join(t) for t in bad], pa.large_string())) >= 0.5
        assert got.mean() >= 0.85, sep


def test_toxicity_words():
    texts = pa.array(["i d i o t x yz", "a\nb", "é c", "a", " a", None, "", "ÉTÉ été", "a  b"], pa.large_string())
    w = toxicity.cut_words(*pieces.byte_view(texts))
    got = [(int(t), w.chars[a + 1:a + n - 1].tobytes()) for t, a, n in zip(w.text, w.start, w.size)]
    fold = "été".encode()
    assert got == [(0, b"i\1d\1i\1o\1t\1x"), (0, b"yz"), (1, b"a\1b"), (2, "é".encode() + b"\1c"), (3, b"a"), (4, b"a"),
                   (7, fold), (7, fold), (8, b"a"), (8, b"b")]


def test_toxicity_tolerates_inserted_characters():
    clean = [f"the nation was {w} and the idea of {w} stood in the station there" for w in "red blue green north south old new warm cold kind".split()] * 4
    toxic = [t.replace("stood", "idiot").replace("idea", "moron") for t in clean]
    model = toxicity.fit(clean + toxic, np.array([0] * 40 + [1] * 40))
    words = toxicity.cut_words(*pieces.byte_view(pa.array(["idiot id.iot i-diot idioot station nation stood"], pa.large_string())))
    v = toxicity.word_values(words, model.weight)
    assert min(v[:4]) > max(v[4:])


def test_samples_are_bounded_and_leave_the_fold_out(spark, documents):
    label = documents.select("doc_id", F.col("lang").alias("label"))
    got = sample(documents, label.unionByName(spark.createDataFrame([(None, "en"), (3, None)], "doc_id long, label string")), 5, 0, 7).collect()
    assert all(crc(r.doc_id) % 5 for r in got)
    counts = {}
    for r in got:
        counts[r.label] = counts.get(r.label, 0) + 1
    assert max(counts.values()) == 7


def test_samples_are_bounded_for_repeated_ids(spark):
    rows = [(1, f"text {i:03d} 12345", "en") for i in range(500)] + [(2, None, "en"), (2, "b@c.de", "en"), (3, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = sample(docs.select("doc_id", "text"), docs.select("doc_id", "label"), 5, 9, 7).collect()
    assert sorted((r.doc_id, r.text, r.label) for r in got) == [(1, "text 000 12345", "en"), (2, "b@c.de", "en"), (3, None, "en")]
    assert personal.train(docs, texts=7) is not None


def test_pieces_round_trip(documents, edge, empty):
    for docs in (documents, edge):
        found = pieces.encode(docs)
        assert found.where("not lossless").count() == 0
        back = pieces.decode(found).join(docs.select("doc_id", F.col("text").alias("was")), "doc_id")
        assert back.where("not (text <=> was)").count() == 0
    assert pieces.encode(empty).count() == 0
    ids = {r.doc_id: r.ids for r in pieces.encode(edge).collect()}
    assert ids[0] is None and ids[1] == []


def test_pieces_reproducible_by_row_key(documents):
    one = {r.doc_id: r.ids for r in pieces.encode(documents).collect()}
    two = {r.doc_id: r.ids for r in pieces.encode(documents.repartition(5)).collect()}
    other = {r.doc_id: r.ids for r in pieces.encode(documents, seed=12).collect()}
    assert one == two and sum(one[i] != other[i] for i in one) > len(one) / 2


def test_pieces_are_sampled_by_weight():
    """Frequencies of the segmentations of a word, against all its paths; the
    array path and the one for long segments draw alike."""
    voc = pieces.Vocabulary(pieces.load_vocabulary(), 1.0)

    def paths(b):
        if not b:
            yield (), 0.0
        for n in range(1, len(b) + 1):
            i = voc.pieces.get(b[:n])
            if i is not None:
                yield from (((i,) + p, w + voc.weight[i]) for p, w in paths(b[n:]))
    every = dict(paths(b" hello"))
    total = sum(np.exp(w) for w in every.values())
    n = 20_000
    keys = pieces.mix64(np.arange(n, dtype=np.uint64))
    for limit in (pieces.ARRAY_BYTES, 0):
        old, pieces.ARRAY_BYTES = pieces.ARRAY_BYTES, limit
        try:
            m = n if limit else 3000
            ids, counts = pieces.encode_arrays(voc, pa.array(["hello"] * m), keys[:m])
        finally:
            pieces.ARRAY_BYTES = old
        ends = np.cumsum(counts)
        seen = {}
        for a, b in zip(ends - counts, ends):
            seen[tuple(ids[a:b])] = seen.get(tuple(ids[a:b]), 0) + 1
        assert set(seen) <= set(every)
        for path, w in every.items():
            p = np.exp(w) / total
            assert abs(seen.get(path, 0) / m - p) < 5 * np.sqrt(p / m) + 1e-3


def test_pieces_long_segment():
    voc = pieces.Vocabulary(pieces.load_vocabulary(), 1.0)
    text = pa.array(["x" * 3000 + "é" * 200, "0123456789abcdef" * 40])
    ids, counts = pieces.encode_arrays(voc, text, pieces.mix64(np.arange(2, dtype=np.uint64)))
    raw, off = pieces.decode_arrays(voc, ids, counts)
    assert [raw[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:])] == text.to_pylist()


def test_quality_learns_from_all_pairs(spark):
    """The loss of every pair of a good and a bad row is least at the weights,
    and the cut lies between the strengths of as many rows as are bad."""
    rng = np.random.default_rng(3)
    y = (rng.random(700) < 0.4).astype(int)
    x = rng.normal(size=(700, 3)) + y[:, None] * [1.0, 0.5, 0.0]
    rows = spark.createDataFrame([(int(k), [float(c) for c in r]) for k, r in zip(y, x)], "label int, x array<double>")
    model = quality.fit(rows.repartition(5))
    z = np.clip((x - x.mean(0)) / x.std(0), -6, 6)
    diff = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 3)
    gradient = -(diff * (1 / (1 + np.exp(diff @ model.weights)))[:, None]).mean(0) + 1e-2 * model.weights
    assert np.abs(gradient).max() < 1e-5
    s = np.sort(z @ model.weights)
    assert abs(model.cut - s[(y == 0).sum() - 1:(y == 0).sum() + 1].mean()) < 1e-9
    assert quality.fit(rows.where("label = 1")) is None


def test_quality_learns_from_every_labelled_row(spark):
    ids = [i for i in range(14000) if crc(i) % 3 != 1][:9000]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(ids[0], "a text")], "doc_id long, text string")
    rows = quality.learnt(docs, spark.createDataFrame([(i, 0) for i in ids], "doc_id long, label int"), 3, 1)
    assert rows.count() == 9000 and rows.where(F.col("doc_id") == ids[0]).first().text == "a text"
