"""Toxicity by a subsequence string-kernel SVM (dealt operator 6).

Two words are alike as far as they share subsequences of three characters;
a subsequence may skip up to ``REACH - 1`` characters between its letters, and
each skipped character scales it down by ``DECAY`` (the gap-weighted kernel of
Lodhi et al. 2002 with bounded gaps), so an insult with characters put in
between stays close to the insult.  Kernel values are divided by both words'
own lengths, so gaps scale a word and its length alike.  Nyström landmarks, words of the training texts, give finite
features; a linear SVM (squared hinge) is trained on words in place of
sentences: words of clean texts are negatives, words with evidence over whole
toxic texts are positives, among them those that are the most toxic of their
text, chosen anew in every round.  White space ends a word, except between
words of one letter each, where it is a gap (``i d i o t``); abuse that only
several longer words make is missed.  Because the features are linear in kernel values, the trained SVM is
one weight for each subsequence, and whole texts are scored with array
operations.  A text's score is a logistic function, fitted on the training
texts, of its most toxic words' values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from liftlake.llm.labelled import fold, sample
from liftlake.llm.runtime import column, map_slices
from liftlake.llm.words import byte_view, mix64

#: Labelled texts of each class that the model is fitted on, at most.
SAMPLE_PER_CLASS = 1500
#: Candidate words kept from a class, and landmarks.
WORDS_PER_CLASS = 600
HARD_WORDS = 3000
LANDMARKS = 256
#: Evidence (texts times log ratio of its rates) that makes a word a positive.
EVIDENCE = 16.0
REACH = 3
DECAY = 0.65
FOLDS, HELD_OUT = 5, 0
_BITS = 16
_GAPS = [(a, b) for a in range(1, REACH + 1) for b in range(1, REACH + 1)]

# letters and non-ASCII bytes, lower-cased, are the kernel's characters; white
# space ends a word, and other characters within a word only make gaps
_CHAR = np.full(256, 1, np.uint8)
_CHAR[[0x20, *range(0x09, 0x0E)]] = 0
_CHAR[0x61:0x7B] = np.arange(0x61, 0x7B)
_CHAR[0x41:0x5B] = np.arange(0x61, 0x7B)
_CHAR[0x80:] = np.arange(0x80, 0x100)


@dataclass
class Words:
    """Words of a run of texts, with a mark character before and after."""
    chars: np.ndarray       # bytes of all words, padded by REACH + 1 zeros between
    start: np.ndarray       # first position of each word (its mark)
    size: np.ndarray        # with both marks
    letters: np.ndarray     # without the characters that only make gaps, with both marks
    text: np.ndarray        # index of the text
    hashed: np.ndarray


def _folded(raw: np.ndarray) -> np.ndarray:
    """The kernel's characters of UTF-8 bytes; accented capitals are folded too."""
    c = _CHAR[raw]
    # U+00C0 to U+00DE but the multiplication sign: C3 80-9E, small ones are C3 A0-BE
    second = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)) + 1
    c[second] += 0x20
    return c


def _runs_joined(c: np.ndarray, raw: np.ndarray, off: np.ndarray, s: np.ndarray, e: np.ndarray):
    """Neighbouring words of one letter each, with one white space between, are
    one word whose white space makes gaps."""
    letters = np.r_[0, np.cumsum(((raw & 0xC0) != 0x80) & (c > 1))]
    single = (letters[e] - letters[s] == 1) & (e - s <= 4)
    text = np.searchsorted(off, s, side="right")
    tied = single[:-1] & single[1:] & (s[1:] - e[:-1] == 1) & (text[1:] == text[:-1])
    c[e[:-1][tied]] = 1
    return s[np.r_[True, ~tied]], e[np.r_[~tied, True]]


def cut_words(raw: np.ndarray, off: np.ndarray) -> Words:
    c = _folded(raw)
    inside = c > 0
    lead = inside.copy()
    lead[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    some = np.diff(off) > 0
    lead[off[:-1][some]] = inside[off[:-1][some]]
    ends[off[1:][some] - 1] = inside[off[1:][some] - 1]
    s, e = np.flatnonzero(lead), np.flatnonzero(ends) + 1
    if len(s) > 1:
        s, e = _runs_joined(c, raw, off, s, e)
    n = e - s
    # each word: mark 2, its characters, mark 2, then zeros that end all reach
    step = n + 2 + 2 * REACH
    at = np.cumsum(step) - step
    out = np.zeros(int(step.sum()), np.uint8)
    out[at] = 2
    out[at + n + 1] = 2
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    letters = c[np.repeat(s, n) + place]
    out[np.repeat(at + 1, n) + place] = letters
    # edge punctuation takes no part: the closing mark would else lie behind it
    power = mix64(np.arange(1, 258, dtype=np.uint64))[:256]
    value = power[letters] * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1))
    h = np.add.reduceat(value, np.cumsum(n) - n) if len(n) else np.zeros(0, np.uint64)
    real = np.add.reduceat((letters > 1).astype(np.int64), np.cumsum(n) - n) if len(n) else n
    return Words(out, at, n + 2, real + 2, np.searchsorted(off, s, side="right") - 1, mix64(h + n.astype(np.uint64)))


def _code(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    h = (x.astype(np.uint32) << np.uint32(16)) | (y.astype(np.uint32) << np.uint32(8)) | z
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS)


def _subsequences(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of steps: the codes, at which positions, and the weight."""
    c = w.chars
    real = c > 1
    for a, b in _GAPS:
        n = len(c) - a - b
        if n <= 0:
            continue
        ok = np.flatnonzero(real[:n] & real[a:a + n] & real[a + b:a + b + n])
        yield _code(c[ok], c[ok + a], c[ok + a + b]), ok, DECAY ** (a + b - 2)


#: Least length that a word's kernel values are divided by: that of one subsequence.
SHORTEST = 1.0


def _length(w: Words) -> np.ndarray:
    """Every word's kernel length, as if no subsequence occurred twice: a closed
    form of its size, but for words with gaps, whose subsequences are counted."""
    square = sum(np.maximum(w.size - a - b, 0) * DECAY ** (2 * (a + b - 2)) for a, b in _GAPS).astype(float)
    gaps = np.flatnonzero(w.letters != w.size)
    if len(gaps):
        step = w.size[gaps] + 2 * REACH
        at = np.cumsum(step) - step
        real = w.chars[np.repeat(w.start[gaps] - at, step) + np.arange(int(step.sum()))] > 1
        counted = np.zeros(len(real))
        for a, b in _GAPS:
            n = len(real) - a - b
            counted[:n] += (real[:n] & real[a:a + n] & real[a + b:a + b + n]) * DECAY ** (2 * (a + b - 2))
        square[gaps] = np.add.reduceat(counted, at)
    return np.sqrt(np.maximum(square, SHORTEST))


def word_values(w: Words, weight: np.ndarray) -> np.ndarray:
    """The trained value of every word: its subsequences' weights over the
    word's own kernel length, so gaps scale both alike."""
    total = np.zeros(len(w.chars) + 1)
    gathered = np.zeros(len(w.chars))
    for code, at, scale in _subsequences(w):
        gathered[at] += weight[code] * scale
    np.cumsum(gathered, out=total[1:])
    return (total[w.start + w.size] - total[w.start]) / _length(w)


def explicit(words: list[bytes]) -> np.ndarray:
    """Subsequence vectors of a few words, divided by their lengths."""
    at = np.cumsum([0, *map(len, words)])
    w = cut_words(np.frombuffer(b"".join(words), np.uint8), at)
    out = np.zeros((len(w.start), 1 << _BITS), np.float32)
    for code, at, scale in _subsequences(w):
        np.add.at(out, (np.searchsorted(w.start, at, side="right") - 1, code), scale)
    return out / _length(w)[:, None]


def top_values(value: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """For every text: its three highest word values and the log number of words."""
    out = np.full((n_texts, 4), -1.0)
    order = np.lexsort((-value, text))
    t = text[order]
    rank = np.arange(len(t)) - np.searchsorted(t, t)
    top = rank < 3
    out[t[top], rank[top]] = value[order][top]
    out[:, 3] = np.log1p(np.bincount(text, minlength=n_texts))
    return out


@dataclass
class Model:
    weight: np.ndarray      # one for each subsequence code
    mean: np.ndarray
    spread: np.ndarray
    logit: np.ndarray       # of the text features, the last is the constant

    def scores(self, texts: pa.Array) -> np.ndarray:
        w = cut_words(*byte_view(texts))
        x = top_values(word_values(w, self.weight), w.text, len(texts))
        z = (x - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(z @ self.logit[:-1] + self.logit[-1], -50, 50)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 4.0) -> np.ndarray:
    """Linear squared-hinge SVM with a constant, by Newton steps."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    for _ in range(40):
        slack = 1 - y * (x1 @ w)
        live = slack > 0
        xa, wa = x1[live], weight[live][:, None]
        gradient = w - cost * ((xa * wa).T @ (y[live] * slack[live]))
        step = np.linalg.solve(np.eye(len(w)) + cost * (xa * wa).T @ xa, gradient)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x1, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -50, 50)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + ridge * np.eye(len(w)), x1.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _parts(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, Words, int]]:
    """(index of the first text, words, number of texts), a bounded part of the
    texts at a time."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= limit):
            size += len(texts[stop])
            stop += 1
        yield at, cut_words(*byte_view(pa.array(texts[at:stop], pa.large_string()))), stop - at
        at = stop


def fit(texts: list[str], label: np.ndarray, rounds: int = 4, seed: int = 5) -> Model | None:
    """Train on texts with 0/1 labels (sorted beforehand, so runs agree)."""
    if not (label == 1).any() or not (label == 0).any():
        return None
    # in how many toxic and clean texts every word occurs
    hashed, text = [], []
    for base, w, _ in _parts(texts):
        order = np.lexsort((w.hashed, w.text))
        h, t = w.hashed[order], w.text[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])] if len(h) else np.zeros(0, bool)
        hashed.append(h[new])
        text.append(t[new] + base)
    hashed, text = np.concatenate(hashed), np.concatenate(text)
    names, where = np.unique(hashed, return_inverse=True)
    if not len(names):
        return None
    toxic = label[text] == 1
    in_toxic, in_clean = np.bincount(where[toxic], minlength=len(names)), np.bincount(where[~toxic], minlength=len(names))
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    lift = np.log((in_toxic + 0.5) / (n1 + 1)) - np.log((in_clean + 0.5) / (n0 + 1))
    evidence = in_toxic * np.maximum(lift, 0)

    spelling: dict[int, bytes] = {}

    def spelt(k: int) -> bytes:
        return spelling[k]

    def spell(w: Words, i: int, k: int) -> None:
        if k not in spelling:
            spelling[k] = w.chars[w.start[i] + 1:w.start[i] + w.size[i] - 1].tobytes()

    rng = np.random.default_rng(seed)
    order = np.lexsort((names, -evidence))
    bad = [int(k) for k in order[:WORDS_PER_CLASS] if evidence[k] >= EVIDENCE and lift[k] > 1]
    if not bad:
        bad = [int(k) for k in order[:1]]
    common = in_clean / max(in_clean.sum(), 1)
    good = [int(k) for k in rng.choice(len(names), min(WORDS_PER_CLASS * 4, int((common > 0).sum())), replace=False, p=common)]
    good = sorted(set(good) - set(bad))
    wanted = np.sort(names[sorted(set(good) | set(bad))])
    for _, w, _ in _parts(texts):
        for i in np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, w.hashed), len(wanted) - 1)] == w.hashed):
            spell(w, i, int(np.searchsorted(names, w.hashed[i])))
    negatives, positives, hard = good, bad, {}
    for _ in range(rounds):
        # landmarks: the most telling words, and for contrast common clean
        # words and those that the last rounds took for toxic
        worst = sorted(hard, key=lambda k: (-hard[k], k))[:LANDMARKS // 4]
        chosen = list(dict.fromkeys([*bad[:LANDMARKS // 2], *worst, *good]))[:LANDMARKS]
        marks = explicit([spelt(k) for k in chosen])
        used = np.flatnonzero(marks.any(0))
        marks = marks[:, used]
        value, vector = np.linalg.eigh((marks @ marks.T).astype(float))
        root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T

        def nystroem(rows: list[int]) -> np.ndarray:
            out = [explicit([spelt(k) for k in rows[a:a + 128]])[:, used] @ marks.T for a in range(0, len(rows), 128)]
            return np.concatenate(out).astype(float) @ root

        x = np.concatenate([nystroem(positives), nystroem(negatives)] if negatives else [nystroem(positives)])
        y = np.concatenate([np.ones(len(positives)), -np.ones(len(negatives))])
        # a positive counts by its evidence, a negative by how common it is
        share = np.concatenate([evidence[positives] / max(evidence[positives].mean(), 1e-9),
                                np.sqrt(1.0 + in_clean[negatives])])
        solved = _svm(x, y, share)
        weight = np.zeros(1 << _BITS)
        weight[used] = marks.T.astype(float) @ (root @ solved[:-1])
        # the most toxic words of every text: of toxic texts a positive where
        # they also tell, of clean texts hard negatives, which are kept
        told = set()
        for base, w, _ in _parts(texts):
            value = word_values(w, weight)
            order = np.lexsort((-value, w.text))
            t = w.text[order]
            first = order[np.arange(len(t)) - np.searchsorted(t, t) < 3]
            for i, k in zip(first.tolist(), np.searchsorted(names, w.hashed[first]).tolist()):
                spell(w, i, k)
                if label[w.text[i] + base] == 0:
                    hard[k] = max(hard.get(k, -np.inf), float(value[i]))
                elif evidence[k] >= EVIDENCE / 2:
                    told.add(k)
        positives = sorted(set(bad) | told)
        worst = sorted(set(hard) - set(positives), key=lambda k: (-hard[k], k))[:HARD_WORDS]
        negatives = sorted((set(good) | set(worst)) - set(positives))
    x = np.concatenate([top_values(word_values(w, weight), w.text, n) for _, w, n in _parts(texts)])
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    logit = _logistic((x - mean) / spread, label.astype(float))
    return Model(weight.astype(np.float32), mean, spread, logit)


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    """Fit on a bounded sample of the labelled rows outside the held-out fold."""
    label = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("label")).where("label in (0, 1)")
    rows = sample(docs, label, FOLDS, HELD_OUT, per_class).where("text is not null").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    if not rows:
        return None
    return fit([r.text for r in rows], np.array([r.label for r in rows]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (0/1).

    Null and empty texts get the score of a text without words; without both
    labels to learn from every score is 0.  Repeated rows are scored each; an
    empty table gives an empty result; only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        None if model is None else (model.weight, model.mean, model.spread, model.logit))

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = column(part, "text")
        value = np.zeros(len(texts)) if shared.value is None else Model(*shared.value).scores(texts)
        yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(value)], names=["doc_id", "score"])
    found = map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
                        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
