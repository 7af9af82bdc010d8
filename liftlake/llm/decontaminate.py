"""Benchmark decontamination by winnowing (dealt operator 7).

Documents and benchmark items become sequences of lower-cased words.  Of
every run of ``WINDOW_WORDS - K + 1`` consecutive k-grams the one with the
smallest hash is kept as a fingerprint (winnowing, Schleimer et al. 2003).
Two texts that share ``WINDOW_WORDS`` consecutive words share the k-grams of
that span, pick the same one of them, and so share a fingerprint.  Documents
and items are joined on fingerprints, every joint fingerprint is extended word
by word in both directions, and what reaches ``WINDOW_WORDS`` words is a hit.

The items are a query set: they are taken in blocks of at most
``BLOCK_WORDS`` words, each block is broadcast (its size is bounded by that
parameter and the longest item) and all documents are read against it, so no
document text is shuffled.  Items of fewer than ``WINDOW_WORDS`` words are one
window each: they are looked up as whole n-grams of their own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from liftlake.llm.runtime import column, lists, map_slices
from liftlake.llm.words import ALNUM_SPLIT, byte_view, mix64, words

WINDOW_WORDS = 13
K = 5
BLOCK_WORDS = 2_000_000
_SPAN = WINDOW_WORDS - K + 1


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words (document bounds not respected)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    odd = mix64(np.arange(n * 100 + 1, n * 100 + 1 + n, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out += h[j:len(h) - n + 1 + j] * odd[j]
    return mix64(out)


def _owner(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def _winnow(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints: of every ``_SPAN`` k-grams in
    a row of one text, the (leftmost) smallest."""
    g = _grams(h, K)
    if len(h) < WINDOW_WORDS:
        return np.zeros(0, np.int64), g[:0]
    own = _owner(first)
    n = len(h) - WINDOW_WORDS + 1
    whole = own[:n] == own[WINDOW_WORDS - 1:]
    low, at = g[:n].copy(), np.arange(n)
    for j in range(1, _SPAN):
        less = g[j:n + j] < low
        low = np.where(less, g[j:n + j], low)
        at = np.where(less, np.arange(j, n + j), at)
    at = np.unique(at[whole])
    return at, g[at]


class Block:
    """One block of benchmark items, ready to be looked up."""

    def __init__(self, ids: np.ndarray, texts: pa.Array):
        self.ids = ids
        self.h, self.first = words(*byte_view(texts), ALNUM_SPLIT)
        at, g = _winnow(self.h, self.first)
        order = np.argsort(g, kind="stable")
        self.g, self.at = g[order], at[order]
        own, n = _owner(self.first), np.diff(self.first)
        self.item = own
        self.short = {}
        for length in np.unique(n[(n > 0) & (n < WINDOW_WORDS)]):
            which = np.flatnonzero(n == length)
            g = _grams(self.h, int(length))[self.first[which]]
            order = np.argsort(g, kind="stable")
            self.short[int(length)] = (g[order], which[order])

    def pairs(self, g: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (in g, in sorted keys) of equal hashes."""
        lo, hi = np.searchsorted(keys, g, "left"), np.searchsorted(keys, g, "right")
        count = hi - lo
        left = np.repeat(np.arange(len(g)), count)
        return left, np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + lo[left]

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, end, item) of every maximal shared span in the texts."""
        own, found = _owner(first), []
        at, g = _winnow(h, first)
        i, j = self.pairs(g, self.g)
        if len(i):
            d, t = at[i], self.at[j]
            stop_d, stop_t = first[own[d] + 1], self.first[self.item[t] + 1]
            begin_d, begin_t = first[own[d]], self.first[self.item[t]]
            left, right = np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
            live = np.arange(len(d))
            while len(live):
                a, b = d[live] + right[live], t[live] + right[live]
                live = live[(a < stop_d[live]) & (b < stop_t[live])]
                live = live[h[d[live] + right[live]] == self.h[t[live] + right[live]]]
                right[live] += 1
            live = np.arange(len(d))
            while len(live):
                a, b = d[live] - left[live] - 1, t[live] - left[live] - 1
                live = live[(a >= begin_d[live]) & (b >= begin_t[live])]
                live = live[h[d[live] - left[live] - 1] == self.h[t[live] - left[live] - 1]]
                left[live] += 1
            long = left + right >= WINDOW_WORDS
            found.append((d[long] - left[long], d[long] + right[long], self.item[t[long]]))
        for length, (keys, which) in self.short.items():
            g = _grams(h, length)
            i, j = self.pairs(g, keys)
            inside = own[i] == own[np.minimum(i + length - 1, len(own) - 1)] if len(i) else np.zeros(0, bool)
            found.append((i[inside], i[inside] + length, which[j[inside]]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[Block]:
    """The items in blocks, read partition by partition."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text is not null")
    for row in rows.toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1]) // 2 + 1
        if size >= block_words:
            yield Block(np.array(ids, object), pa.array(texts, pa.large_string()))
            ids, texts, size = [], [], 0
    if ids:
        yield Block(np.array(ids, object), pa.array(texts, pa.large_string()))


def _merged(starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document, overlapping and touching ones as one."""
    order = np.lexsort((starts, doc))
    s, e, d = starts[order], ends[order], doc[order]
    if not len(s):
        return s, e, d
    # a document's spans lie beyond all spans of the documents before it
    width = int(e.max()) + 1
    reach = np.maximum.accumulate(e + d * width)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] + d[1:] * width > reach[:-1]
    begin = np.flatnonzero(new)
    last = reach[np.append(begin[1:], len(s)) - 1]
    return s[begin], last - d[begin] * width, d[begin]


def _flat(part: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end, and the row of each."""
    col = column(part, name)
    count = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.asarray(col.flatten(), np.int64), np.repeat(np.arange(len(count)), count)


def _scan(rows: DataFrame, block: Block | None) -> DataFrame:
    """The rows with the hits of one block put to those found before."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = part.num_rows
        h, first = words(*byte_view(column(part, "text")), ALNUM_SPLIT)
        starts, doc = _flat(part, "_starts")
        ends, _ = _flat(part, "_ends")
        own = column(part, "_items")
        items = np.array(own.flatten().to_pylist(), object)
        item_doc = np.repeat(np.arange(n), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        if shared.value is not None:
            s, e, item = shared.value.hits(h, first)
            d = _owner(first)[s] if len(s) else s
            pair = np.unique(np.stack([d, item], 1), axis=0) if len(d) else np.zeros((0, 2), np.int64)
            starts, ends, doc = (np.concatenate(x) for x in ((starts, s - first[d]), (ends, e - first[d]), (doc, d)))
            # an item without an id hits words, but has no id to list
            ids = shared.value.ids[pair[:, 1]]
            named = np.array([i is not None for i in ids], bool)
            items, item_doc = np.concatenate([items, ids[named]]), np.concatenate([item_doc, pair[named, 0]])
            order = np.argsort(item_doc, kind="stable")
            items, item_doc = items[order], item_doc[order]
        starts, ends, doc = _merged(starts, ends, doc)
        new = {"_n_words": pa.array(np.diff(first), pa.int64()),
               "_starts": lists(starts, np.bincount(doc, minlength=n), pa.int64()),
               "_ends": lists(ends, np.bincount(doc, minlength=n), pa.int64()),
               "_items": lists(items, np.bincount(item_doc, minlength=n), pa.string())}
        yield pa.RecordBatch.from_arrays([new.get(c, column(part, c)) for c in part.schema.names], names=part.schema.names)
    return map_slices(rows, run, rows.schema)


def with_hits(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of ``docs`` and _n_words, _starts, _ends (merged hit spans, in
    words) and _items (ids of the items hit); no shuffle, whatever the blocks."""
    none = F.expr("cast(array() as array<bigint>)")
    rows = docs.withColumns({"_n_words": F.lit(0).cast("long"), "_starts": none, "_ends": none,
                             "_items": F.expr("cast(array() as array<string>)")})
    any_block = False
    for block in _blocks(benchmark, block_words):
        rows, any_block = _scan(rows, block), True
    return rows if any_block else _scan(rows, None)


def _n_hit() -> Column:
    return F.aggregate(F.zip_with("_ends", "_starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)


def _contaminated() -> Column:
    return (_n_hit() > 0) & (_n_hit() * 20 >= F.col("_n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, items (item ids), starts, ends (merged hit spans, in words).

    A document is contaminated if it has a hit and at least a twentieth of its
    words is hit.  Null, empty and word-free texts have no words and are
    clean; a null or empty item has no window and matches nothing; the words of
    an item without an id are hit, but it is not listed; ids may be numbers or
    text, and several items of one id are one; repeated rows are judged each on its own; empty
    tables give empty (documents) or all-clean (benchmark) results.  Only
    doc_id and text, and item_id and text, are read, so other columns of any
    name do not matter.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ids = F.array_sort(F.array_distinct("_items"))
    return with_hits(docs, benchmark, block_words).select(
        "doc_id", F.col("_n_words").alias("n_words"), _n_hit().alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), _contaminated().alias("contaminated"),
        ids.alias("items"), F.col("_starts").alias("starts"), F.col("_ends").alias("ends"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    # all but the text as one column, so that the columns of the hits hide none
    rest = [c for c in docs.columns if c != "text" or docs.schema[c].dataType.simpleString() != "string"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.struct(*[F.col(f"`{c}`") for c in rest]).alias("all"))
    clean = with_hits(rows, benchmark, block_words).where(~_contaminated())
    return clean.select(*[F.col("all")[c].alias(c) if c in rest else F.col("text") for c in docs.columns])
