"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest

from liftlake.llm import neighbours

from . import brute
from .conftest import SF

KIND = "vec_id long, embedding array<float>, label int, v string, node string, w string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "clash", "clash", "clash")
                                  for i, v in vectors], KIND)


def of(df):
    got = df.collect()
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert len(out) == len(got)
    return out


def rounded(vectors):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]


def clustered(seed=5, dim=24):
    """Strangers, pairs around the threshold, a dense group, a wide one, chains."""
    rng = np.random.default_rng(seed)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1)[:, None])(rng.standard_normal((n, dim)))
    strangers = unit(900)
    pairs = strangers[:300] + 0.33 * unit(300)
    dense = unit(1)[0] + 0.08 * unit(500)
    wide = unit(1)[0] + 0.24 * unit(250)
    axes = unit(2)
    chain = [np.cos(t) * axes[0] + np.sin(t) * axes[1] for t in np.arange(60) * 0.2]
    x = np.concatenate([strangers, pairs, dense, wide, np.array(chain)])
    x *= rng.uniform(0.1, 9, len(x))[:, None]
    return [(int(i), v) for i, v in zip(rng.permutation(len(x)), x)]


def test_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert of(neighbours.near_duplicates(df)) == brute.neighbours([(r.vec_id, r.embedding) for r in df.collect()])


def test_edge(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, []), (2, [0, 0, 0]), (3, [1, None, 0]), (4, [1, nan, 0]), (5, [inf, 0, 0]), (6, [1, 2, 3]), (7, [2, 4, 6]),
            (8, [1, 2, 3]), (9, [-1, -2, -3]), (10, [3e38, 0, 1]), (11, [1, 0, 0]), (12, [1e-30, 0, 0]), (14, [0, 0, 5]), (13, [0, 0, 5])]
    got = of(neighbours.near_duplicates(frame(spark, rows)))
    assert got == brute.neighbours(rows)
    mixed = frame(spark, [(1, [1, 0]), (2, [1, 0, 0]), (3, [2, 0])])
    assert of(neighbours.near_duplicates(mixed)) == {1: (1, 1, True), 2: (0, 2, True), 3: (1, 1, False)}
    assert neighbours.near_duplicates(frame(spark, [])).count() == 0
    assert neighbours.near_duplicates(frame(spark, rows[:6])).where("n_links = 0 and kept").count() == 6


def test_repeated_and_null_ids(spark):
    got = neighbours.near_duplicates(frame(spark, [(5, [1, 0]), (5, [1, 0]), (None, [1, 0.01]), (None, [0, 1])])).collect()
    assert sorted((tuple(r) for r in got), key=str) == [(5, 2, 5, True), (5, 2, 5, True), (None, 0, None, True), (None, 2, 5, False)]


@pytest.mark.parametrize("leaf, block, core", [(1500, 2048, 64), (60, 50, 20), (60, 40, 10 ** 6)])
def test_groups(spark, monkeypatch, leaf, block, core):
    """One leaf; trees, cores and many blocks; trees without cores."""
    monkeypatch.setattr(neighbours, "LEAF_ROWS", leaf)
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "CORE_ROWS", core)
    vectors = rounded(clustered())
    got, want = of(neighbours.near_duplicates(frame(spark, vectors))), brute.neighbours(vectors)
    links = sum(n for n, _, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)            # none below the threshold, none twice
    assert sum(n for n, _, _ in got.values()) >= 0.995 * links
    if leaf == 1500:
        assert got == want


def test_recall(spark, monkeypatch):
    """Pairs at the threshold alone: nine tenths are asked, the forest finds nearly all."""
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 40)
    rng, dim = np.random.default_rng(3), 64
    x = rng.standard_normal((2000, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    off = rng.standard_normal((2000, dim))
    off -= (off * x).sum(axis=1)[:, None] * x
    y = 0.951 * x + np.sqrt(1 - 0.951 ** 2) * off / np.linalg.norm(off, axis=1)[:, None]
    vectors = rounded(list(enumerate(np.concatenate([x, y]))))
    got = of(neighbours.near_duplicates(frame(spark, vectors)))
    assert sum(n for n, _, _ in got.values()) >= 0.99 * sum(n for n, _, _ in brute.neighbours(vectors).values())
