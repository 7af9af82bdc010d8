"""Phrase collocation mining by Toivonen's sampling method (dealt operator 11).

A sample of the documents proposes the frequent phrases, by a lowered
threshold; its negative border are the phrases that are not proposed though
all their parts are (the parts of a phrase are contiguous, so its longest
prefix and suffix decide).  A full pass counts both.  Border phrases that
turn out frequent are failures: they extend the proposal, and a further pass
counts all phrases that contain one, however long.  The set is then closed:
every phrase with frequent parts has been counted over all documents.  The
sample itself is mined in the same way from nothing, but a word at a time,
since there every phrase would be an extension.

Phrases are known by 64-bit hashes while the set is found, and the set is held
as a bitmap of fixed size: a collision or a full bitmap only lets more phrases
be counted, none is lost.  The last pass counts the texts of the phrases found
themselves, so no count, phrase or score rests on a hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from liftlake.llm import words as _words
from liftlake.llm.runtime import column, slices, small_batches, written

#: Longest phrase, in words.
LONGEST = 5
#: A candidate has this many occurrences in its language, or more.
LEAST = 100
#: One document in so many is in the sample.
SAMPLE = 8
#: Bits of the phrase bitmap (8 MB); with more phrases it lets more be counted.
BITS = 1 << 26
#: Text bytes of one round of array operations, the distinct phrases that a task
#: holds before it hands them on, and the rows of a batch that it hands on.
SLICE, HELD, BATCH = 1 << 20, 1 << 20, 1 << 15
#: Rows of phrase texts that a task gathers at least before it merges them.
GATHERED = 1 << 17
#: Tasks a core that count phrase texts.
TASKS = 2
#: The report's length for each language.
FIRST = 2000

_U = np.uint64
#: Fixed separators of the contract.
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True
_IS_WORD = ~(_BREAK | _GAP)


class Phrases:
    """The words of some texts and the hashes of their phrases."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        raw, off = _words.byte_view(texts)
        self.raw = _words._LOWER[raw]
        inside = _IS_WORD[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[off] = True
        starts = inside & np.concatenate([[True], ~inside[:-1]]) if len(raw) else inside
        ends = inside & np.concatenate([~inside[1:], [True]]) if len(raw) else inside
        starts |= inside & edge[:-1]
        ends |= inside & edge[1:]
        self.s, self.e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        # pieces: a break or a new text between two words parts them
        breaks = np.cumsum(_BREAK[raw] | edge[:-1]) if len(raw) else np.zeros(0, np.int64)
        self.piece = breaks[self.s]
        self.doc = np.searchsorted(off, self.s, side="right") - 1
        names = langs.dictionary_encode()
        seed, seed_off = _words.byte_view(names.dictionary.cast(pa.string()))
        lang = _words.span_hashes(_words._BYTE_HASH[seed], seed_off[:-1], seed_off[1:]) if len(seed_off) > 1 else np.zeros(0, _U)
        self.lang_of = names.indices.to_numpy(zero_copy_only=False)
        self.langs = names.dictionary
        own = _words.mix64(lang + _U(1))[self.lang_of][self.doc] if len(self.s) else np.zeros(0, _U)
        word = _words.span_hashes(_words._BYTE_HASH[self.raw], self.s, self.e)
        self.word = _words.mix64(word ^ own)

    def walk(self, bits: np.ndarray, old: np.ndarray | None = None, ahead: bool = False) -> Iterator[tuple]:
        """For k = 1, 2, ...: the first words and hashes of the k-word phrases
        whose parts are all in a set (a bitmap), which of them are in it, and
        which belong to a former set ``old`` or its border (with ``ahead``, the
        others count as in the set, so all their extensions come too)."""
        n = len(self.s)
        at, h, known = np.arange(n), self.word, self.word.copy()
        had = np.full(n, old is not None)
        for k in range(1, LONGEST + 1):
            inside = _has(bits, h)
            yield k, at, h, inside, had
            member, before = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
            member[at[inside | ~had if ahead else inside]] = True
            if old is not None:
                before[at] = had & _has(old, h)
            go = member[:-1] & member[1:]
            if k == 1 and n:
                go[:-1] &= self.piece[:-1] == self.piece[1:]
            at = np.flatnonzero(go)
            had = before[at] & before[at + 1]
            if k < LONGEST:
                h = known[at] = _words.mix64(known[at] * _U(0x9E3779B97F4A7C15) + self.word[at + k])


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    p = h >> _U(64 - (8 * len(bits)).bit_length() + 1)
    return ((bits[(p >> _U(3)).astype(np.int64)] >> (p & _U(7)).astype(np.uint8)) & 1).astype(bool)


def _packed(bits: np.ndarray | None) -> bytes | None:
    """A bitmap as sent to tasks: one with few phrases takes little room."""
    return None if bits is None else zlib.compress(bits.tobytes(), 1)


def _unpacked(sent: bytes | None) -> np.ndarray | None:
    return None if sent is None else np.frombuffer(zlib.decompress(sent), np.uint8)


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Phrases]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            yield Phrases(column(part, "text"), column(part, "lang"))


def count_hashes(docs: DataFrame, bits: np.ndarray, old: np.ndarray | None = None, ahead: bool = False) -> DataFrame:
    """(h, f): occurrences over ``docs`` (lang, text) of the phrases of a set and
    its border, less those of the set ``old`` and its border."""
    shared = docs.sparkSession.sparkContext.broadcast((_packed(bits), _packed(old)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, old = map(_unpacked, shared.value)
        keys, counts = np.zeros(0, _U), np.zeros(0, np.int64)

        def out():
            for i in range(0, len(keys), BATCH):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[i:i + BATCH].view(np.int64)), pa.array(counts[i:i + BATCH])], names=["h", "f"])
        for texts in _pieces(batches):
            for _, _, h, _, had in texts.walk(bits, old, ahead and old is not None):
                own = np.sort(h[~had])
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
                keys = np.concatenate([keys, own[first]])
                counts = np.concatenate([counts, np.diff(np.append(first, len(own)))])
            if len(keys) > HELD:
                keys, counts = _merge(keys, counts)
                if len(keys) > HELD // 2:
                    yield from out()
                    keys, counts = keys[:0], counts[:0]
        keys, counts = _merge(keys, counts)
        yield from out()
    return docs.mapInArrow(run, "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))


def _bitmap(keys: DataFrame) -> np.ndarray:
    """The bitmap of hashes (column h): as large whatever their number.  The
    hashes are dealt by place first, so each part of it is built once."""
    place = F.shiftrightunsigned("h", 64 - BITS.bit_length() + 1)
    rows = (keys.select(place.alias("p")).withColumn("bucket", F.expr("p div 32768")).repartition("bucket")
            .groupBy("bucket").agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits")))
    bits = np.zeros(BITS // 8, np.uint8)
    for row in rows.toLocalIterator():
        bits[row.bucket * 4096:row.bucket * 4096 + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return bits


def expand(docs: DataFrame, bits: np.ndarray, least: int, ahead: bool) -> tuple[np.ndarray, int]:
    """The bitmap of all phrases with ``least`` occurrences in ``docs`` (lang,
    text), starting from a proposed set, and the number of passes.

    The first pass counts the set and its border.  What turns out frequent
    outside the set extends it; a further pass counts the border that this
    adds, and so on, or with ``ahead`` all that contains a new phrase: any
    frequent phrase not yet counted contains one, so that pass is the last.
    """
    old, passes, found = None, 0, np.zeros_like(bits)
    while True:
        found |= _bitmap(count_hashes(docs, bits, old, ahead).where(F.col("f") >= least))
        passes += 1
        if not (found & ~bits).any() or ahead and passes == 2:
            return found, passes
        old, bits = bits, bits | found


def frequent(docs: DataFrame, least: int = LEAST, sample: int = SAMPLE, ident: Column | None = None) -> tuple[np.ndarray, int]:
    """The bitmap of all phrases of 1 to 5 words with ``least`` occurrences in
    their language (columns lang, text), and the number of full passes.  One
    document in ``sample`` is taken by the hash of ``ident``."""
    # Toivonen's lowered threshold: a deviation under the expected count
    expected = least / sample
    low = max(1, int(expected - expected ** 0.5))
    part = docs.where(F.pmod(F.xxhash64(ident if ident is not None else F.col("text")), F.lit(sample)) == 0)
    proposed, _ = expand(written(part.select("lang", "text"), "phrase-sample"), np.zeros(BITS // 8, np.uint8), low, ahead=False)
    return expand(docs.select("lang", "text"), proposed, least, ahead=True)


def count_phrases(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(lang, phrase, size, f): exact occurrences, by text, of the phrases in a
    bitmap; size 0 (and an empty phrase) counts all words of a language."""
    shared = docs.sparkSession.sparkContext.broadcast(_packed(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, n, distinct = _unpacked(shared.value), [], 0, 0

        def merged() -> list[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).group_by(["lang", "phrase", "size"], use_threads=False).aggregate([("f", "sum")])
            held.clear()
            rows = rows.select(["lang", "phrase", "size", "f_sum"]).rename_columns(["lang", "phrase", "size", "f"])
            pa.default_memory_pool().release_unused()
            return rows.to_batches(max_chunksize=BATCH)
        for texts in _pieces(batches):
            for rows in _texts(texts, bits):
                held.append(rows)
                n += len(rows)
            # phrases that recur in the task are handed on once; what is held
            # grows with the distinct phrases, not with the rows gathered
            if n > max(GATHERED, 2 * distinct):
                held = merged()
                n = distinct = sum(map(len, held))
                if distinct > HELD // 2:
                    yield from held
                    held, n, distinct = [], 0, 0
        if held:
            yield from merged()
    return (docs.mapInArrow(run, "lang string, phrase string, size int, f long")
            .groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")))


def few_tasks(docs: DataFrame) -> DataFrame:
    """The same rows in a few tasks for each core of the cluster.  A task hands on
    each phrase that it meets, so with a task for each part of the input the rows
    grow as parts times phrases; with these, as the phrases."""
    return docs.coalesce(TASKS * docs.sparkSession.sparkContext.defaultParallelism)


def _texts(texts: Phrases, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of ``count_phrases`` for some texts."""
    def rows(lang: np.ndarray, phrase: pa.Array, size: int, f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [texts.langs.take(pa.array(lang)), phrase, pa.array(np.full(len(f), size, np.int32)), pa.array(f)],
            names=["lang", "phrase", "size", "f"])
    own = np.bincount(texts.lang_of[texts.doc], minlength=len(texts.langs)).astype(np.int64)
    yield rows(np.arange(len(own)), pa.array([""] * len(own), pa.string()), 0, own)
    # the words once more with one space after each: a phrase is then one run of bytes
    size = texts.e - texts.s
    end = np.cumsum(size + 1)
    flat = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
    flat[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = texts.raw[_runs(texts.s, size)]
    for k, at, h, inside, _ in texts.walk(bits):
        h, at = h[inside], at[inside]
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        f = np.diff(np.append(first, len(h)))
        at = at[first]
        begin, stop = end[at] - size[at] - 1, end[at + k - 1] - 1
        length = stop - begin
        offsets = np.zeros(len(at) + 1, np.int64)
        np.cumsum(length, out=offsets[1:])
        phrase = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(flat[_runs(begin, length)]))
        yield rows(texts.lang_of[texts.doc[at]], phrase.cast(pa.string()), k, f.astype(np.int64))


def _runs(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for length[0] places, then begin[1], ..."""
    return np.arange(int(length.sum())) + np.repeat(begin - np.cumsum(length) + length, length)


def scored(counts: DataFrame, least: int = LEAST, cover: int = 100) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates: phrases of two words
    or more with ``least`` occurrences, by their lowest-scoring cut, less those
    whose words lie inside a longer candidate of ``cover`` percent of their
    occurrences or more.  Products are decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    total = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    cand = counts.where((F.col("size") >= 2) & (F.col("f") >= least)).select(
        "lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("w"))
    # a longer candidate covers the phrases inside it
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    covered = (cand.where("size > 2").select("lang", F.explode(inside).alias("phrase"), "a")
               .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = (cand.join(covered, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover)))
    cuts = kept.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    part = counts.where("size between 1 and 4")
    cuts = (cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
            # languages: a row each, and no more rows than that
            .join(total, "lang"))
    score = F.expr("(cast(a * 1000 as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r", "n"))
    return (cuts.groupBy("lang", "phrase", "a").agg(lowest.alias("cut"))
            .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score"))


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, sample: int = SAMPLE) -> DataFrame:
    """Each language's ``first`` collocations: lang, rank, phrase, a, l, r, n, score.

    A null language is ``und`` (and one with an ``und`` of the table), a null
    text is empty.  Equal scores are ordered by occurrences, then by phrase in
    byte order; repeated rows and ids all count.  A language without a
    candidate has no row, an empty table gives an empty result, and other
    columns do not matter.
    """
    ident = F.struct(F.col("doc_id").cast("long"), F.length("text")) if "doc_id" in docs.columns else F.col("text")
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), ident.alias("ident"))
    # texts come to the tasks in small batches: a task holds one on both sides
    with small_batches(docs.sparkSession):
        bits, _ = frequent(docs, least, sample, F.col("ident"))
        counts = written(count_phrases(few_tasks(docs.select("lang", "text")), bits).where((F.col("f") >= least) | (F.col("size") == 0)), "phrases")
    found = scored(counts, least)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first rows of each part of a language, then of the language
    salt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(16))).orderBy(*order)
    found = found.withColumn("place", F.row_number().over(salt)).where(F.col("place") <= first).drop("place")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
