"""Quality classifier by Bradley-Terry pairwise ranking (dealt operator 5).

A document's strength is a linear function of surface features of its whole
text.  The chance that one document is preferred to another is the logistic
function of the difference of their strengths, so the weights are learned by
logistic loss on feature differences of preference pairs: every labelled text
of label 1 against every one of label 0, outside the held-out fold.  A row's
part in the sums over its pairs depends on its own strength and on how the
other class's strengths are distributed, so a pass over the rows gives the sums
over all pairs.  The cut between keep and reject is a quantile of the strengths:
the share of label 0 among the training rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from liftlake.llm.labelled import fold, learnt
from liftlake.llm.runtime import column, lists, map_slices, written
from liftlake.llm.words import SPACE_SPLIT, byte_view, shingles, words
from liftlake.operators.ordered import positions

#: Distance of the points that strengths of the other class are counted at (a
#: row counts at both points beside it, by its distance to them), and the
#: points for one cell of the sums that only steer the steps.
CELL, CELLS = 1 / 64, 8
FOLDS, HELD_OUT = 3, 1

_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ",
            b"\t\n\x0b\x0c\r", b".,;:'\"?-()", b"!", b"|", b"#$%&*", b"@/\\_+=<>[]{}~^`", bytes(range(128, 256)))


def _class_table() -> np.ndarray:
    table = np.full(256, len(_CLASSES), np.uint8)
    for k, members in enumerate(_CLASSES):
        table[np.frombuffer(members, np.uint8)] = k
    return table


_CLASS_OF = _class_table()


def _distinct_share(h: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[first], minlength=len(n)) / np.maximum(n, 1)


def features(texts: pa.Array) -> np.ndarray:
    """One row of surface features for each text; an empty text has zeros."""
    raw, off = byte_view(texts)
    n_docs, size = len(off) - 1, np.diff(off)
    doc_of = np.repeat(np.arange(n_docs), size)
    k = len(_CLASSES) + 1
    share = np.bincount(doc_of * k + _CLASS_OF[raw], minlength=n_docs * k).reshape(n_docs, k) / np.maximum(size, 1)[:, None]
    h, first = words(raw, off, SPACE_SPLIT)
    n = np.diff(first)
    own = np.repeat(np.arange(n_docs), n)
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    g, gdoc, _ = shingles(h, first, 3)
    cols = [share, np.log1p(200 * share),
            np.log1p(n), np.minimum(size / np.maximum(n, 1), 40),
            _distinct_share(h, own, n), np.bincount(own[same], minlength=n_docs) / np.maximum(n, 1),
            _distinct_share(g, gdoc, np.bincount(gdoc, minlength=n_docs)), size > 0]
    return np.column_stack([np.asarray(c, np.float64) for c in cols])


@dataclass
class Ranking:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return _scaled(x, self.mean, self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.cut, -500, 500)))


def _scaled(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / spread, -6, 6)


def _totals(rows: DataFrame, fn: Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums over all rows (label, x).  ``fn(x, label)`` gives parts (number,
    places, values); the result has the places of each part and their sums.
    Tasks add up their batches first, so the sums alone reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = column(batch, "x").flatten().to_numpy().reshape(batch.num_rows, -1)
            for part, at, v in fn(x, column(batch, "label").to_numpy()):
                low, size = int(at.min()), int(at.max() - at.min()) + 1
                begin, held = total.get(part, (low, np.zeros(0)))
                first, last = min(begin, low), max(begin + len(held), low + size)
                grown = np.zeros(last - first)
                grown[begin - first:begin - first + len(held)] = held
                grown[low - first:low - first + size] += np.bincount(at - low, v, size)
                total[part] = first, grown
        for part, (first, held) in total.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), pa.array(at + first), pa.array(held[at])],
                                             names=["part", "at", "v"])
    found = rows.mapInArrow(run, "part int, at long, v double").groupBy("part", "at").agg(F.sum("v")).collect()
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for part in {r[0] for r in found}:
        mine = sorted((r[1], r[2]) for r in found if r[0] == part)
        out[part] = np.array([at for at, _ in mine], np.int64), np.array([v for _, v in mine])
    return out


def _dense(total: tuple[np.ndarray, np.ndarray] | None, first: int, size: int) -> np.ndarray:
    out = np.zeros(size)
    if total is not None:
        out[total[0] - first] = total[1]
    return out


def _chance(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def _between(rows: DataFrame, scaled: Callable[[np.ndarray], np.ndarray], w: np.ndarray, pairs: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature in ``w`` of the mean logistic loss of all pairs."""
    d = len(w)

    def spread_out(x: np.ndarray, label: np.ndarray):
        s = scaled(x) @ w / CELL
        low = np.floor(s).astype(np.int64)
        for k in (0, 1):
            mine = label == k
            if mine.any():
                yield k, np.concatenate([low[mine], low[mine] + 1]), np.concatenate([1 - (s - low)[mine], (s - low)[mine]])
    counts = _totals(rows, spread_out)
    first = min(int(at[0]) for at, _ in counts.values())
    size = max(int(at[-1]) for at, _ in counts.values()) - first + 1
    # of each point: the sums, over the rows of the other class, of the chance
    # that the pair stands the wrong way round, and of that chance's slope
    wrong = _chance(np.arange(1 - size, size) * CELL)
    slope = wrong * (1 - wrong)
    good, bad = _dense(counts.get(1), first, size), _dense(counts.get(0), first, size)
    chance = [np.convolve(good, wrong)[size - 1:2 * size - 1], np.convolve(bad, wrong[::-1])[size - 1:2 * size - 1]]
    curve = [np.convolve(good, slope)[size - 1:2 * size - 1], np.convolve(bad, slope)[size - 1:2 * size - 1]]
    points = np.arange(first, first + size) * CELL

    def sums(x: np.ndarray, label: np.ndarray):
        z = scaled(x)
        s = z @ w
        for k in (0, 1):
            mine, at = z[label == k], s[label == k]
            if len(mine):
                yield 2, np.arange(d), (2 * k - 1) * (np.interp(at, points, chance[k]) @ mine)
                yield 3, np.arange(d * d), ((mine * np.interp(at, points, curve[k])[:, None]).T @ mine).ravel()
                cell = np.floor(at / (CELL * CELLS)).astype(np.int64)
                yield k, (cell[:, None] * d + np.arange(d)).ravel(), mine.ravel()
    found = _totals(rows, sums)
    gradient = -_dense(found.get(2), 0, d) / pairs
    crossed = np.zeros((d, d))
    if 0 in found and 1 in found:
        low = min(int(found[k][0][0]) // d for k in (0, 1))
        n = max(int(found[k][0][-1]) // d for k in (0, 1)) - low + 1
        one, zero = (_dense(found[k], low * d, n * d).reshape(n, d) for k in (1, 0))
        p = _chance((np.arange(n)[:, None] - np.arange(n)) * (CELL * CELLS))
        crossed = one.T @ (p * (1 - p)) @ zero
    return gradient, (_dense(found.get(3), 0, d * d).reshape(d, d) - crossed - crossed.T) / pairs


def fit(rows: DataFrame, ridge: float = 1e-2) -> Ranking | None:
    """Weights from all preference pairs of the rows (label, x) by Newton steps,
    and the cut; None without both classes."""
    shape = _totals(rows, lambda x, label: [(0, label.astype(np.int64), np.ones(len(label))),
                                            (1, np.arange(x.shape[1]), x.sum(0)), (2, np.zeros(1, np.int64) + x.shape[1], np.ones(1))])
    if not shape or len(shape[0][0]) < 2:
        return None
    (bad, good), d = shape[0][1], int(shape[2][0][0])
    mean = _dense(shape[1], 0, d) / (bad + good)
    off = _totals(rows, lambda x, label: [(0, np.arange(d), ((x - mean) ** 2).sum(0))])
    spread = np.sqrt(_dense(off.get(0), 0, d) / (bad + good))
    spread[spread < 1e-9] = 1

    def scaled(x: np.ndarray) -> np.ndarray:
        return _scaled(x, mean, spread)
    w = np.zeros(d)
    for _ in range(30):
        gradient, curve = _between(rows, scaled, w, good * bad)
        step = np.linalg.solve(curve + ridge * np.eye(d), gradient + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    # sums may come in any order
    model = Ranking(mean, spread, np.round(w, 9), 0.0)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = column(batch, "x").flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(model.strength(x))], names=["s"])
    placed = positions(rows.mapInArrow(strengths, "s double"), [F.asc("s")], "place")
    model.cut = float(np.mean([r.s for r in placed.where(F.col("place").isin(int(bad), int(bad) + 1)).collect()]))
    return model


def train(docs: DataFrame, labels: DataFrame) -> Ranking | None:
    """Fit on all labelled rows outside the held-out fold."""
    label = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)")

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = features(column(part, "text"))
        yield pa.RecordBatch.from_arrays([column(part, "label"), lists(x.ravel(), np.full(len(x), x.shape[1]), pa.float64())],
                                         names=["label", "x"])
    return fit(written(map_slices(learnt(docs, label, FOLDS, HELD_OUT), run, "label int, x array<double>"), "quality-features"))


def _scores(model: Ranking | None, texts: pa.Array) -> np.ndarray:
    return np.full(len(texts), 0.5) if model is None else model.score(features(texts))


def score(docs: DataFrame, model: Ranking | None) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (0/1).

    Null and empty texts get the score of the feature row of an empty text;
    without both labels to learn from every score is 0.5.  Repeated rows are
    scored each; an empty table gives an empty result; only doc_id and text
    are read.
    """
    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(_scores(model, column(part, "text")))],
                                         names=["doc_id", "score"])
    found = map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
                        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Ranking | None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is predicted 1."""
    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield part.filter(pa.array(_scores(model, column(part, "text")) >= 0.5))
    return map_slices(docs, run, docs.schema)
