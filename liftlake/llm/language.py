"""Language identification with string kernels (dealt operator 3).

The blended-spectrum presence kernel of two texts is the number of byte
n-grams (n = 1 to 4) that occur in both, divided by the geometric mean of
their numbers of n-grams.  Nyström landmarks turn it into finite features, and
one-versus-rest kernel ridge regression on them gives one value a language.
Texts are scored in batches: a presence matrix times the landmarks' matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from liftlake.llm.labelled import fold, sample
from liftlake.llm.runtime import column, map_slices
from liftlake.llm.words import byte_view

#: Texts of each language that the model is fitted on, and landmarks of each.
SAMPLE_PER_LANGUAGE = 400
LANDMARKS_PER_LANGUAGE = 24
#: n-grams of the landmarks that the kernel counts, at most.
VOCABULARY = 4096
FOLDS, HELD_OUT = 5, 0
_BITS = 18

_FOLDED = np.full(256, 0x20, np.uint8)
_FOLDED[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLDED[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLDED[0x80:] = np.arange(0x80, 0x100)
_LETTER = _FOLDED != 0x20


def _codes(raw: np.ndarray, n: int) -> np.ndarray:
    """A number below 2 ** _BITS for the n bytes from every position on."""
    c = _FOLDED[raw].astype(np.uint32)
    out = np.full(len(c) - n + 1, n, np.uint32) if len(c) >= n else np.zeros(0, np.uint32)
    for j in range(n):
        out = (out * np.uint32(0x9E3779B1)) ^ (c[j:len(c) - n + 1 + j] * np.uint32(0x85EBCA6B))
    return (out ^ (out >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - _BITS)


def presence(texts: pa.Array, place: np.ndarray, width: int) -> np.ndarray:
    """Which n-grams occur in which text, as a 0/1 matrix of ``width`` columns;
    ``place`` gives an n-gram code's column, or ``width`` for none."""
    raw, off = byte_view(texts)
    out = np.zeros((len(off) - 1, width + 1), np.uint8)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    for n in range(1, 5):
        code = _codes(raw, n)
        inside = doc[:len(code)] == doc[n - 1:] if len(code) else np.zeros(0, bool)
        col = place[code]
        inside &= col < width
        out[doc[:len(code)][inside], col[inside]] = 1
    return out[:, :width]


@dataclass
class Model:
    names: list[str]
    place: np.ndarray
    landmarks: np.ndarray   # n-grams x landmarks, columns of length 1
    weights: np.ndarray     # landmarks x languages
    bias: np.ndarray

    def kernel(self, texts: pa.Array) -> np.ndarray:
        x = presence(texts, self.place, self.landmarks.shape[0]).astype(np.float32)
        return (x @ self.landmarks) / np.sqrt(np.maximum(x.sum(1), 1))[:, None]

    def values(self, texts: pa.Array) -> np.ndarray:
        return self.kernel(texts) @ self.weights + self.bias


def fit(texts: list[str], langs: list[str], ridge: float = 1e-3) -> Model | None:
    """Landmarks, Nyström features and ridge weights from a sorted sample."""
    names = sorted(set(langs))
    if not names:
        return None
    y = np.array([names.index(x) for x in langs])
    chosen = np.concatenate([np.flatnonzero(y == k)[:LANDMARKS_PER_LANGUAGE] for k in range(len(names))])
    every = np.arange(1 << _BITS, dtype=np.int32)
    seen = np.zeros(1 << _BITS, np.int64)
    for i in chosen:
        seen += presence(pa.array([texts[i]]), every, 1 << _BITS)[0]
    # the n-grams in most landmarks; ties by code, so the choice is fixed
    top = np.lexsort((every, -seen))[:VOCABULARY]
    top = np.sort(top[seen[top] > 0])
    place = np.full(1 << _BITS, len(top), np.int32)
    place[top] = np.arange(len(top))
    rows = np.concatenate([presence(pa.array(texts[a:a + 64]), place, len(top)) for a in range(0, len(texts), 64)]).astype(np.float32)
    rows /= np.sqrt(np.maximum(rows.sum(1), 1))[:, None]
    marks = rows[chosen].T
    between = (marks.T @ marks).astype(np.float64)
    value, vector = np.linalg.eigh(between)
    value = np.maximum(value, 1e-6)
    root = vector / np.sqrt(value) @ vector.T
    z = rows.astype(np.float64) @ marks @ root
    z1 = np.column_stack([z, np.ones(len(z))])
    target = np.eye(len(names))[y] * 2 - 1
    # every language weighs the same, however many texts it has
    weight = (1 / np.bincount(y))[y][:, None]
    solved = np.linalg.solve((z1 * weight).T @ z1 + ridge * np.eye(z1.shape[1]), (z1 * weight).T @ target)
    return Model(names, place, marks.astype(np.float32), (root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32))


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Fit on a bounded sample of texts with a language, outside the held-out fold."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string").alias("label"))
    rows = sample(docs.select("doc_id", "text"), docs.where("text is not null").select("doc_id", "label"),
                  FOLDS, HELD_OUT, per_language).where("length(text) > 0").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in rows], [r.label for r in rows])


def _has_letter(texts: pa.Array) -> np.ndarray:
    raw, off = byte_view(texts)
    ascii_letter = _LETTER[raw] & (raw < 0x80)
    before = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = before[off[1:]] > before[off[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return found


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1).

    Texts that are null or have no letter are ``und`` with score 0, and so is
    every text where no language could be learned.  Of languages with equal
    values the first by name wins.  Repeated rows are predicted each; an empty
    table gives an empty result; only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m, texts = shared.value, column(part, "text")
        name, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        if m is not None:
            known = _has_letter(texts)
            value = m.values(texts)
            best = value.argmax(1)
            power = np.exp(4.0 * (value - value.max(1, keepdims=True)))
            share = power.max(1) / power.sum(1)
            name = np.where(known, np.array(m.names, object)[best], "und")
            score = np.where(known, share, 0.0)
        yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(name, pa.string()), pa.array(score, pa.float64())],
                                         names=["doc_id", "lang_pred", "score"])
    found = map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run,
                       "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
