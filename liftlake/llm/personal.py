"""Personal data by a skip-chain conditional random field (dealt operator 9).

Base patterns give spans of four kinds.  The field's nodes are the base spans,
other writings of their values (numbers in groups over spaces or lines, inside
words of any length), and the remaining runs with a digit or an at sign;
neighbours in the text are joined by chain edges, and nodes with the same
value, however far apart, by skip edges: an
occurrence that no pattern matches with every matched one of the document, and
with the unmatched one before.  Loopy belief propagation over both kinds of
edges makes labels agree across a document, so an unmatched occurrence takes
the label of its matched repeats.  A matched occurrence is observed and its
message never changes, so it reaches all repeats at once, in any number;
messages between unmatched nodes go ``ROUNDS`` edges far.  Weights are learned from a
bounded sample of texts, with the base spans as labels.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from liftlake.llm.runtime import column, map_slices
from liftlake.llm.words import byte_view

#: Texts that the field's weights are fitted on, at most.
SAMPLE_TEXTS = 2000
#: Characters of a text of that sample, at most.
SAMPLE_LONGEST = 20_000
#: Belief above which an unmatched word becomes a span.
BELIEF = 0.9
ROUNDS = 12
#: Characters before and after a node that are looked at for digits.
NEAR = 12
#: Keys of fewer characters have no skip edges: no base span's key is so short.
KEY = 5
KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the same matches as the contract's pattern, in linear time: a match can
# only begin where a run of digits begins
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_RUN = re.compile(r"[A-Za-z0-9._%+@()/=-]+")
_RUN_OF_DIGITS = re.compile(r"[0-9]+")
# digits in groups: what lies between is no letter and ends no field
_GROUPS = re.compile(r"""[0-9]++(?:[^\w,;:@"'|<>{}=]++[0-9]++)*""")
# an address with something about its at sign
_ADDRESS = re.compile("(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++[\\s\\[({<]*+[@\uff20][\\s\\])}>]*+[A-Za-z0-9.-]++")
_AT = re.compile("[\\s\\[({<]*+[@\uff20][\\s\\])}>]*+")
_EDGE = "()[]{}<>,;:!?\"'`*#$%&|"


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """(start, end) of every kind in code points, leftmost, not overlapping."""
    out: list[list[tuple[int, int]]] = [[], [], [], []]
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _is_local(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out[0].append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out[1].append(m.span())
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and _luhn(d):
            out[2].append(m.span())
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out[3].append(m.span())
    return out


def _is_local(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c in "._%+-")


_FEATURES = 26


def _shape(word: str, before: str, after: str) -> list[float]:
    """What a node looks like, and whether there are digits close to it."""
    n = sum("0" <= c <= "9" for c in word)
    letters = sum(c.isalpha() for c in word)
    at, dots = word.count("@"), word.count(".")
    return [1.0, n == 0, 1 <= n <= 2, n == 3, n == 4, 5 <= n <= 7, 8 <= n <= 12, 13 <= n <= 15, 16 <= n <= 19, n >= 20,
            at == 1, at > 1, dots == 0, dots == 3, dots in (1, 2), letters == 0, letters > n, word.startswith("+"),
            "-" in word, "(" in word and ")" in word, "/" in word, "_" in word, "=" in word,
            bool(_MARK.search(before)), bool(_MARK.search(after)), n + letters == len(word)]


@dataclass
class Nodes:
    """The field's nodes of a run of texts."""
    text: list          # index of the text
    span: list          # (start, end) without punctuation at the edges
    x: list             # features
    key: list           # what repeats are known by
    label: list         # 0: no base span, else 1 + kind


def _plain(s: str) -> str:
    return "".join(c for c in s.lower() if c.isalnum())


def _base_key(value: str, kind: int) -> str:
    """An address in lower case with a bare at sign, an IP as it is, the digits
    of a card or phone number."""
    return _AT.sub("@", value).rstrip(".-").lower() if kind == 0 else value if kind == 1 else _digits(value)


def _written_apart(text: str, a: int, b: int, numbers: set, addresses: set) -> list[tuple[int, int, str]]:
    """(start, end, key) of neighbouring groups of digits that together make a
    matched number, leftmost and longest first."""
    out, longest = [], max(map(len, numbers), default=0)
    for m in _GROUPS.finditer(text, a, b):
        groups, i = [g.span() for g in _RUN_OF_DIGITS.finditer(text, *m.span())], 0
        while i < len(groups):
            start, best, digits = groups[i][0], None, ""
            for j in range(i, len(groups)):
                if len(digits) + groups[j][1] - groups[j][0] > longest:
                    break
                digits += text[groups[j][0]:groups[j][1]]
                if digits in numbers:
                    best = j, digits
            four = groups[i:i + 4]
            if best is None and len(four) == 4 and addresses and not _SPACE.search(text, start, four[3][1]):
                dotted = ".".join(text[s:e] for s, e in four)
                best = (i + 3, dotted) if dotted in addresses else None
            if best:
                out.append((start, groups[best[0]][1], best[1]))
            i = best[0] + 1 if best else i + 1
    return out


def _rest(spans: list, a: int, b: int) -> Iterator[tuple[int, int]]:
    """What the sorted spans leave of [a, b)."""
    for s, e, *_ in spans:
        if a < s:
            yield a, min(s, b)
        a = max(a, e)
    if a < b:
        yield a, b


def _found(text: str, base: list) -> list[tuple[int, int, str, int]]:
    """(start, end, key, label) of a text's nodes: the base spans; outside them
    repeats of their values in other writing, in words of any length; and the
    remaining runs of letters, digits and signs with a digit or an at sign."""
    flat = sorted((s, e, k) for k, spans in enumerate(base) for s, e in spans)
    out = [(s, e, _base_key(text[s:e], k), k + 1) for s, e, k in flat]
    mails, addresses = {x[2] for x in out if x[3] == 1}, {x[2] for x in out if x[3] == 2}
    numbers = {x[2] for x in out if x[3] > 2}
    bare = {_plain(x): x for x in sorted(mails) if len(_plain(x)) >= KEY}
    for a, b in _rest(flat, 0, len(text)):
        if not _MARK.search(text, a, b) and not mails:
            continue
        own = _written_apart(text, a, b, numbers, addresses) if numbers or addresses else []
        if mails:
            for c, d in list(_rest(own, a, b)):
                for m in _ADDRESS.finditer(text, c, d):
                    key = _base_key(m[0], 0)
                    if key in mails:
                        own.append((m.start(), m.start() + len(m[0].rstrip(".-")), key))
            own.sort()
        for c, d in list(_rest(own, a, b)):
            for m in _WORD.finditer(text, c, d):
                if not _MARK.search(m[0]):
                    continue
                runs = [m.span()] if bare and _plain(m[0]) in bare else [r.span() for r in _RUN.finditer(text, *m.span())]
                for s, e in runs:
                    run = text[s:e]
                    s, e = e - len(run.lstrip(_EDGE)), s + len(run.rstrip(_EDGE + "."))
                    if s < e and _MARK.search(text, s, e):
                        key = _plain(text[s:e])
                        own.append((s, e, bare.get(key, key)))
        out += [(s, e, key, 0) for s, e, key in own]
    return sorted(out)


def nodes(texts: list[str], bases: list) -> Nodes:
    out = Nodes([], [], [], [], [])
    for t, (text, base) in enumerate(zip(texts, bases)):
        if not _MARK.search(text):
            continue
        for s, e, key, label in _found(text, base):
            out.text.append(t)
            out.span.append((s, e))
            out.x.append(_shape(text[s:e], text[max(0, s - NEAR):s], text[e:e + NEAR]))
            out.key.append(key)
            out.label.append(label)
    return out


def edges(n: Nodes) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring nodes, and of nodes with their last repeat."""
    chain, skip, seen = [], [], {}
    for i, (t, key) in enumerate(zip(n.text, n.key)):
        if i and n.text[i - 1] == t and n.span[i][0] - n.span[i - 1][1] <= 3:
            chain.append((i - 1, i))
        if len(key) >= KEY:
            if (t, key) in seen:
                skip.append((seen[t, key], i))
            seen[t, key] = i
    shape = lambda e: np.array(e, np.int64).reshape(-1, 2)
    return shape(chain), shape(skip)


def _unmatched(n: Nodes) -> np.ndarray:
    """Pairs of unmatched nodes with their last unmatched repeat."""
    skip, seen = [], {}
    for i, (t, key, label) in enumerate(zip(n.text, n.key, n.label)):
        if not label and len(key) >= KEY:
            if (t, key) in seen:
                skip.append((seen[t, key], i))
            seen[t, key] = i
    return np.array(skip, np.int64).reshape(-1, 2)


@dataclass
class Field:
    unary: np.ndarray   # features x labels
    chain: np.ndarray   # labels x labels, log potentials
    skip: np.ndarray

    def _observed(self, n: Nodes) -> np.ndarray:
        """What all matched repeats in the document say to an unmatched node:
        one message a label, times the number of repeats that have it."""
        k = self.skip.shape[0]
        met: dict = {}
        for t, key, label in zip(n.text, n.key, n.label):
            if label and len(key) >= KEY:
                met.setdefault((t, key), np.zeros(k))[label] += 1
        out = np.zeros((len(n.key), k))
        if met:
            for i, (t, key, label) in enumerate(zip(n.text, n.key, n.label)):
                if not label and (t, key) in met:
                    out[i] = met[t, key] @ self.skip
        return out

    def beliefs(self, n: Nodes) -> np.ndarray:
        """Marginals after loopy belief propagation; base spans are observed."""
        k = self.unary.shape[1]
        score = np.array(n.x, float).reshape(-1, _FEATURES) @ self.unary
        label = np.array(n.label, np.int64)
        seen = np.flatnonzero(label > 0)
        score[seen] = -30.0
        score[seen, label[seen]] = 0
        score += self._observed(n)
        chain, skip = edges(n)[0], _unmatched(n)
        pair = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
        link = np.concatenate([chain, skip])
        a, b = np.concatenate([link[:, 0], link[:, 1]]), np.concatenate([link[:, 1], link[:, 0]])
        pot = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(link)) + len(link), np.arange(len(link))])
        message = np.zeros((len(a), k))
        for _ in range(ROUNDS if len(a) else 0):
            total = score.copy()
            np.add.at(total, b, message)
            out = (total[a] - message[back])[:, :, None] + pot
            top = out.max(1, keepdims=True)
            new = (top + np.log(np.exp(out - top).sum(1, keepdims=True)))[:, 0]
            message = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
        np.add.at(score, b, message)
        p = np.exp(score - score.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _agreement(label: np.ndarray, pairs: np.ndarray, k: int, prior: float) -> np.ndarray:
    """Log of how much oftener two labels meet on an edge than by chance; before
    any edge is seen, labels are taken to agree in 999 of 1000."""
    met = np.full((k, k), 0.001 * prior / (k - 1)) + np.eye(k) * prior
    np.add.at(met, (label[pairs[:, 0]], label[pairs[:, 1]]), 1.0)
    met = met + met.T
    share = met.sum(1) / met.sum()
    return np.log(met / met.sum() / (share[:, None] * share[None]))


def fit(texts: list[str], ridge: float = 1.0, steps: int = 300) -> Field | None:
    """Unary weights by softmax regression, edge potentials by counts; None
    if no text has a node."""
    n = nodes(texts, [base_spans(t) for t in texts])
    if not n.label:
        return None
    x, y, k = np.array(n.x, float), np.array(n.label), 1 + len(KINDS)
    w, velocity, target = np.zeros((_FEATURES, k)), 0.0, np.eye(k)[y]
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        gradient = x.T @ (p / p.sum(1, keepdims=True) - target) / len(x) + ridge * w / len(x)
        velocity = 0.9 * velocity - 0.5 * gradient
        w = w + velocity
    chain, skip = edges(n)
    return Field(w, _agreement(y, chain, k, 20.0), _agreement(y, skip, k, 20.0))


def train(docs: DataFrame, texts: int = SAMPLE_TEXTS, longest: int = SAMPLE_LONGEST) -> Field | None:
    """Fit on the ``texts`` documents with a digit or at sign whose hashed id is
    smallest (a bounded sample; the labels are the base patterns' own), each of
    at most ``longest`` characters; of several such rows of an id the smallest
    text counts."""
    fit_for = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
               .where("doc_id is not null and text rlike '[0-9@]'").where(F.length("text") <= longest))
    chosen = fit_for.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(texts).distinct()
    rows = fit_for.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    return fit(sorted(r.text for r in rows))


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def added_spans(texts: list[str], bases: list, field: Field, belief: float) -> list[list[tuple[int, int, int]]]:
    """Nodes that no base span touches and the field is sure of, by text;
    neighbours of one kind with one space between make one span, unless one of
    them is a matched value's repeat and so whole."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    n = nodes(texts, bases)
    if not n.label:
        return out
    p = field.beliefs(n)
    best = p[:, 1:].argmax(1)
    whole = {(t, key) for t, key, label in zip(n.text, n.key, n.label) if label}
    open_end = [True] * len(texts)
    for i in np.flatnonzero((np.array(n.label) == 0) & (p[:, 1:].max(1) >= belief)):
        t, (s, e), k = n.text[i], n.span[i], int(best[i])
        part = (t, n.key[i]) not in whole
        if out[t] and part and open_end[t] and out[t][-1][0] == k and s - out[t][-1][2] <= 1:
            out[t][-1] = (k, out[t][-1][1], e)
        else:
            out[t].append((k, s, e))
        open_end[t] = part
    return out


def personal_data(docs: DataFrame, field: Field | None, belief: float = BELIEF) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans (base and added), n_added.

    Positions are code points, ends exclusive; the counts and the digest are of
    the base spans.  A null or empty text has no span; without a fitted field
    nothing is added; repeated rows get the same spans; an empty table gives an
    empty result; only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(None if field is None else (field.unary, field.chain, field.skip))

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, off = byte_view(column(part, "text"))
        mark = np.concatenate([[0], np.cumsum((raw == 0x40) | ((raw >= 0x30) & (raw <= 0x39)))])
        some = np.flatnonzero(mark[off[1:]] > mark[off[:-1]])
        texts = [raw[off[i]:off[i + 1]].tobytes().decode("utf-8", "replace") for i in some]
        bases = [base_spans(t) for t in texts]
        extra = added_spans(texts, bases, Field(*shared.value), belief) if shared.value is not None else [[] for _ in texts]
        empty = hashlib.sha256(b"").hexdigest()
        count = np.zeros((part.num_rows, len(KINDS)), np.int64)
        digest, spans, added = [empty] * part.num_rows, [""] * part.num_rows, [0] * part.num_rows
        for i, base, more in zip(some, bases, extra):
            own = [(k, s, e) for k, found in enumerate(base) for s, e in found]
            if own or more:
                count[i] = [len(x) for x in base]
                digest[i] = hashlib.sha256(_join(own).encode()).hexdigest()
                spans[i], added[i] = _join(own + more), len(more)
        yield pa.RecordBatch.from_arrays(
            [column(part, "doc_id"), *(pa.array(count[:, k]) for k in range(len(KINDS))), pa.array(digest, pa.string()),
             pa.array(spans, pa.string()), pa.array(added, pa.int64())],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])
    return map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run,
                      "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
