"""Repeated-substring removal by a run-length index (dealt operator 8).

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts
in a document with a smaller id.  A window of ``LENGTH`` bytes has an anchor,
its k-gram with the smallest hash; equal windows have the same anchor at the
same place, so all occurrences of a repeated string meet at its anchor.

1. One pass counts anchors: each slice of texts sends every anchor's hash
   once, and hashes that come twice or more mark a bit of a fixed-size bitmap.
2. A second pass sends, for anchors whose bit is set, the bytes of the windows
   they are the anchor of (some 67 bytes for 18 of text), to the task of the
   anchor's hash.  The bitmap is only a prefilter: a bit set by chance costs a
   context that nothing matches.
3. A task builds the run-length index of its contexts, laid out by their
   anchors: column by column a positional Burrows-Wheeler transform, kept as
   runs of equal bytes; whole runs are moved by the last-to-first mapping, and
   the divergence (where a context's match with its neighbour begins, its
   matching statistic) changes at run heads alone.  Contexts whose divergence
   spans ``LENGTH`` columns hold the same window; the samples of each such
   interval give its smallest document, and the window is marked in all
   others.
4. Marked windows are merged by document and cut out of the text.

Contexts that several documents of a task share are sent once, for the
smallest of them so far; the others' windows are marked on the spot.  Anchors found in
``HOT_SLICES`` slices or more (passages that a large share of all documents
holds) go by their windows' hashes instead, which spread over all tasks; a task
sends these once, too.  What a task has sent lies in a few sorted parts, so a
slice costs no pass over all of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from liftlake.llm.membership import id_filter
from liftlake.llm.runtime import column, map_slices, slices, small_batches, written
from liftlake.llm.words import _BYTE_HASH, byte_view, mix64, span_hashes

LENGTH = 50
K = 16
#: Bits of each of the two bitmaps (repeated, hot): 8 MB each.
BITMAP_BITS = 26
HOT_SLICES = 4000
_BUCKET_BITS = 15           # bits in one block of a bitmap
_NO_ID = (1 << 63) - 1      # stands for a null id: larger than all
_GROUP_ROWS = 20_000
_SLICE = 1 << 19             # text bytes taken at a time by the two passes


def anchors(raw: np.ndarray, off: np.ndarray, length: int, k: int):
    """(hash, position, first and last window start, document) of every anchor."""
    span = length - k + 1
    n = len(raw) - length + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 4
    at = np.arange(len(raw) - k + 1)
    h = mix64(span_hashes(_BYTE_HASH[raw], at, at + k))
    low = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    whole = np.flatnonzero(doc[:n] == doc[length - 1:])
    pos = (low[:n][whole] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]]) if len(pos) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(pos)] - 1 if len(pos) else new
    p = pos[new]
    # mixed anew: smallest hashes of windows are no even spread of bits
    return mix64(h[p] + np.uint64(0x9E3779B97F4A7C15)), p, whole[new], whole[last], doc[p].astype(np.int64)


def _place(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def anchor_bitmaps(docs: DataFrame, length: int, k: int, hot_slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of hashes that occur in two documents or more, and in
    ``hot_slices`` slices or more."""
    def each(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h, _, _, _, doc = anchors(*byte_view(column(part, "text")), length, k)
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        if len(h):
            edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            several = np.maximum.reduceat(doc, edge) > np.minimum.reduceat(doc, edge)
            # a hash of several documents of this slice comes twice, so that
            # it counts as repeated whatever other slices send
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(h[edge], 1 + several).view(np.int64))], names=["h"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            kept.append(batch.column(0).to_numpy().view(np.uint64))
            size += len(kept[-1])
            if size >= 4_000_000:       # sorted by bucket: all but the last are whole
                h = np.concatenate(kept)
                stop = int(np.searchsorted(h >> np.uint64(64 - BITMAP_BITS + _BUCKET_BITS), h[-1] >> np.uint64(64 - BITMAP_BITS + _BUCKET_BITS)))
                if stop:
                    yield from blocks(h[:stop])
                kept, size = [h[stop:]], len(h) - stop
        if size:
            yield from blocks(np.concatenate(kept))

    def blocks(h: np.ndarray) -> Iterator[pa.RecordBatch]:
        names, count = np.unique(h, return_counts=True)
        names, count = names[count > 1], count[count > 1]
        place = _place(names)
        bucket, bit = place >> _BUCKET_BITS, place & ((1 << _BUCKET_BITS) - 1)
        out = []
        for b in np.unique(bucket):
            mine = bucket == b
            bits = np.zeros((2, 1 << _BUCKET_BITS), bool)
            bits[0, bit[mine]] = True
            bits[1, bit[mine & (count >= hot_slices)]] = True
            out.append((int(b), np.packbits(bits[0]).tobytes(), np.packbits(bits[1]).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()),
                                              pa.array([o[2] for o in out], pa.binary())], names=["bucket", "repeated", "hot"])
    bucket = F.shiftrightunsigned("h", 64 - BITMAP_BITS + _BUCKET_BITS)
    rows = (map_slices(docs, each, "h long", limit=_SLICE).repartition(bucket).sortWithinPartitions(bucket)
            .mapInArrow(mark, "bucket long, repeated binary, hot binary"))
    tables = np.zeros((2, 1 << (BITMAP_BITS - 3)), np.uint8)
    width = 1 << (_BUCKET_BITS - 3)
    for row in rows.collect():      # a row for each block of the bitmaps: fixed size
        for t, bits in enumerate((row.repeated, row.hot)):
            tables[t, row.bucket * width:(row.bucket + 1) * width] |= np.frombuffer(bits, np.uint8)
    return tables[0], tables[1]


def _is_set(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = _place(h)
    return (table[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


def _chunks(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes [start, start + size) of every row."""
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size) + np.repeat(start, size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[at].tobytes())])


#: place is start * 128 + kind: 2 and more for a context (2 + the anchor's place in
#: it, whose bytes follow), 1 for a window (its second hash follows), 0 for a mark
#: (its length follows).
_ROW = "h long, doc_id long, place long, context binary"


def _rows(h, doc_id, start, kind, context) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(h.view(np.int64)), pa.array(doc_id, pa.int64()), pa.array(start * 128 + kind, pa.int64()), context],
        names=["h", "doc_id", "place", "context"])


def _words8(values: np.ndarray) -> pa.Array:
    """64-bit values as 8 bytes each."""
    n = np.arange(len(values))
    return _chunks(np.ascontiguousarray(values).view(np.uint8), n * 8, np.full(len(values), 8))


def _smallest_only(key1: np.ndarray, key2: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """Whether a row's document is the smallest of its key's."""
    order = np.lexsort((doc_id, key2, key1))
    a, b = key1[order], key2[order]
    edge = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    low = doc_id[order][np.maximum.accumulate(np.where(edge, np.arange(len(order)), 0))]
    out = np.zeros(len(order), bool)
    out[order] = doc_id[order] == low
    return out


class _Sent:
    """Keys that a task has sent, each with the smallest document it was sent for:
    sorted parts, each less than half as long as the one before it."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def smaller(self, key: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
        """Whether a key was sent for a document smaller than ``doc_id``."""
        out = np.zeros(len(key), bool)
        for keys, ids in self.parts:
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            out |= (keys[at] == key) & (ids[at] < doc_id)
        return out

    def add(self, key: np.ndarray, doc_id: np.ndarray) -> None:
        if not len(key):
            return
        part = self._sorted(key, doc_id)
        while self.parts and 2 * len(part[0]) >= len(self.parts[-1][0]):
            part = self._sorted(*(np.concatenate(x) for x in zip(self.parts.pop(), part)))
        self.parts.append(part)

    @staticmethod
    def _sorted(key: np.ndarray, doc_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((doc_id, key))
        key, doc_id = key[order], doc_id[order]
        new = np.r_[True, key[1:] != key[:-1]]
        return key[new], doc_id[new]


def contexts(docs: DataFrame, repeated: np.ndarray, hot: np.ndarray, length: int, k: int) -> DataFrame:
    """Contexts of repeated anchors, windows of hot ones, and marks (see _ROW)."""
    shared = docs.sparkSession.sparkContext.broadcast((repeated, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Sent(), _Sent()
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                yield from each(part, *known)

    def each(part: pa.RecordBatch, known: _Sent, windows: _Sent) -> Iterator[pa.RecordBatch]:
        """One slice; ``known``: the contexts that the task has sent, ``windows``:
        those of hot anchors."""
        repeated, hot = shared.value
        raw, off = byte_view(column(part, "text"))
        ids = column(part, "doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        h, p, wa, wb, doc = anchors(raw, off, length, k)
        some = _is_set(repeated, h)
        h, p, wa, wb, doc = h[some], p[some], wa[some], wb[some], doc[some]
        if not len(h):
            return
        value = _BYTE_HASH[raw]
        own, rel, stop = ids[doc], (p - wa).astype(np.int64), wb + length
        marks: list = []
        is_hot = _is_set(hot, h)
        cold = np.flatnonzero(~is_hot)
        if len(cold):
            text_key = mix64(span_hashes(value, wa[cold], stop[cold]) + rel[cold].astype(np.uint64))
            first = _smallest_only(h[cold], text_key, own[cold]) & ~known.smaller(text_key, own[cold])
            send, other = cold[first], cold[~first]
            marks.append((own[other], (wa - off[doc])[other], (stop - off[doc])[other]))
            yield _rows(h[send], own[send], (wa - off[doc])[send], 2 + rel[send], _chunks(raw, wa[send], (stop - wa)[send]))
            known.add(text_key[first], own[send])
        for a in range(0, int(is_hot.sum()), 20_000):
            mine = np.flatnonzero(is_hot)[a:a + 20_000]
            n = wb[mine] - wa[mine] + 1
            s = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(wa[mine], n)
            whose, begin = np.repeat(own[mine], n), s - np.repeat(off[doc[mine]], n)
            one = span_hashes(value, s, s + length)
            two = mix64(span_hashes(mix64(value), s, s + length))
            text_key = mix64(mix64(one) + two)
            first = _smallest_only(mix64(one), two, whose) & ~windows.smaller(text_key, whose)
            windows.add(text_key[first], whose[first])
            marks.append((whose[~first], begin[~first], begin[~first] + length))
            yield _rows(mix64(one)[first], whose[first], begin[first], 1, _words8(two[first]))
        d, s, e = (np.concatenate(x) for x in zip(*marks)) if marks else (np.zeros(0, np.int64),) * 3
        d, s, e = merge(d, s, e)
        if len(d):
            yield _rows(mix64(d.view(np.uint64) + s.view(np.uint64)), d, s, 0, _words8(e - s))
    return docs.mapInArrow(run, _ROW)


def merge(doc: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Intervals of every document, overlapping and touching ones as one,
    sorted by document and place."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    group = np.cumsum(np.r_[False, doc[1:] != doc[:-1]])
    width = int(stop.max()) + 2
    reach = np.maximum.accumulate(stop + group * width)
    new = np.flatnonzero(np.r_[True, (start + group * width)[1:] > reach[:-1]])
    last = reach[np.r_[new[1:], len(doc)] - 1]
    return doc[new], start[new], last - group[new] * width


def run_length_index(group: np.ndarray, doc_id: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Which windows are repeats: a 0/1 matrix, contexts x window starts.

    ``cells`` has the contexts' symbols by column (0: none), rows sorted by
    ``group``; a context takes part in the windows from ``low`` to ``high``.
    Works through the columns with the permuted column kept as runs.
    """
    rows, columns = cells.shape
    out = np.zeros((rows, columns - length + 1), bool)
    order = np.arange(rows)
    group_of = group
    begun = np.where(np.r_[True, group[1:] != group[:-1]], columns + 1, 0)
    for c in range(columns):
        symbol = cells[order, c]
        # runs of one symbol within one group
        head = np.flatnonzero(np.r_[True, (symbol[1:] != symbol[:-1]) | (group_of[1:] != group_of[:-1])])
        size = np.diff(np.r_[head, rows])
        key = group_of[head].astype(np.int64) * 512 + symbol[head]
        to = np.argsort(key, kind="stable")
        # last-to-first mapping of whole runs
        moved = np.arange(rows) - np.repeat(np.cumsum(size[to]) - size[to], size[to]) + np.repeat(head[to], size[to])
        peak = np.maximum.reduceat(begun, head)
        new_head = np.cumsum(size[to]) - size[to]
        follows = np.r_[False, key[to][1:] == key[to][:-1]]
        begun_new = begun[moved]
        begun_new[new_head[~follows]] = c + 1
        if follows.any():
            j = to[follows]
            i = to[np.flatnonzero(follows) - 1]
            pair = np.stack([i + 1, j], 1).ravel()
            between = np.maximum.reduceat(peak, pair)[::2]
            begun_new[new_head[follows]] = np.maximum(between, begun[head[j]])
        group_edge = np.r_[True, group_of[moved][1:] != group_of[moved][:-1]]
        order, begun, group_of = order[moved], begun_new, group_of[moved]
        begun[group_edge] = columns + 1
        s = c - length + 1
        if s >= 0:
            # intervals of contexts that agree on all of the window's columns
            edge = np.flatnonzero(begun > s)
            part = (low[order] <= s) & (s <= high[order])
            least = np.minimum.reduceat(np.where(part, doc_id[order], np.iinfo(np.int64).max), edge)
            least = np.repeat(least, np.diff(np.r_[edge, rows]))
            out[order, s] = part & (least < doc_id[order])
    return out


def _index(length: int, k: int):
    columns, reach = 2 * length - k, length - k

    def number(rows, flat, offset):
        return flat[offset[rows][:, None] + np.arange(8)].view(np.uint64)[:, 0] if len(rows) else np.zeros(0, np.uint64)

    def judge(h, doc_id, place, flat, offset) -> tuple:
        start, rel, size_of = place >> 7, (place & 127) - 2, np.diff(offset)
        m, w = np.flatnonzero(rel == -2), np.flatnonzero(rel == -1)
        found = [(doc_id[m], start[m], start[m] + number(m, flat, offset).astype(np.int64))]
        known = w[~_smallest_only(h[w], number(w, flat, offset), doc_id[w])] if len(w) else w
        found.append((doc_id[known], start[known], start[known] + length))
        c = np.flatnonzero(rel >= 0)
        c = c[np.lexsort((doc_id[c], h[c]))]
        edge = np.flatnonzero(np.r_[True, h[c][1:] != h[c][:-1], True]) if len(c) else np.zeros(1, np.int64)
        # anchors of one document need no index
        apart = np.diff(edge) > 1
        keep = np.repeat(apart, np.diff(edge))
        c = c[keep]
        if len(c):
            group = np.cumsum(np.r_[False, h[c][1:] != h[c][:-1]])
            cut = [0]
            for g in np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1:
                if g - cut[-1] >= _GROUP_ROWS or g == len(c):
                    cut.append(int(g))
            for a, b in zip(cut[:-1], cut[1:]):
                rows = c[a:b]
                size = size_of[rows]
                cells = np.zeros((len(rows), columns), np.uint16)
                r = np.repeat(np.arange(len(rows)), size)
                t = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                low = reach - rel[rows]
                cells[r, low[r] + t] = flat[offset[rows][r] + t].astype(np.uint16) + 1
                marked = run_length_index(group[a:b], doc_id[rows], cells, low, low + size - length, length)
                i, s = np.nonzero(marked)
                begin = start[rows][i] + s - low[i]
                found.append((doc_id[rows][i], begin, begin + length))
        return merge(*(np.concatenate(x) for x in zip(*found)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0

        def flush(whole: bool):
            nonlocal kept, rows
            table = pa.Table.from_batches(kept).combine_chunks()
            h = table.column("h").to_numpy()
            stop_at = len(h) if whole else int(np.searchsorted(h, h[-1]))
            if stop_at:
                done = table.slice(0, stop_at)
                col = done.column("context").combine_chunks()
                col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
                flat, off = byte_view(col)
                d, s, e = judge(done.column("h").to_numpy().view(np.uint64), done.column("doc_id").to_numpy(),
                                done.column("place").to_numpy(), flat, off)
                if len(d):
                    yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(e)], names=["doc_id", "start", "stop"])
            rest = table.slice(stop_at)
            kept, rows = ([b for b in rest.to_batches()] if rest.num_rows else []), rest.num_rows

        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows >= 4 * _GROUP_ROWS:
                yield from flush(False)
        if rows:
            yield from flush(True)
    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks sorted by document: a row for each document, its spans packed."""
    kept: list = []
    rows = 0

    def flush(doc, start, stop):
        doc, start, stop = merge(doc, start, stop)
        edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        packed = np.stack([start, stop], 1)
        ends = np.r_[edge[1:], len(doc)]
        return pa.RecordBatch.from_arrays([pa.array(doc[edge]), pa.array([packed[a:b].tobytes() for a, b in zip(edge, ends)], pa.binary())],
                                          names=["doc_id", "spans"])
    for batch in batches:
        kept.append([batch.column(i).to_numpy() for i in range(3)])
        rows += batch.num_rows
        if rows >= 1_000_000:
            cols = [np.concatenate(x) for x in zip(*kept)]
            stop = int(np.searchsorted(cols[0], cols[0][-1]))
            if stop:
                yield flush(*(c[:stop] for c in cols))
            kept, rows = [[c[stop:] for c in cols]], len(cols[0]) - stop
    if rows:
        yield flush(*(np.concatenate(x) for x in zip(*kept)))


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K, hot_slices: int = HOT_SLICES) -> DataFrame:
    """doc_id and spans (packed pairs of 64-bit start and end, in bytes) of the
    documents that have any; a null id is given as the largest long."""
    repeated, hot = anchor_bitmaps(docs, length, k, hot_slices)
    return (contexts(docs, repeated, hot, length, k).repartition("h").sortWithinPartitions("h")
            .mapInArrow(_index(length, k), "doc_id long, start long, stop long")
            .repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_gather, "doc_id long, spans binary"))


def _cut(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    raw, off = byte_view(column(part, "text"))
    packed = column(part, "spans")
    n_removed, n_spans, digest, text = [], [], [], []
    for i in range(part.num_rows):
        data = raw[off[i]:off[i + 1]]
        pairs = np.frombuffer(packed[i].as_buffer(), np.int64).reshape(-1, 2) if packed[i].is_valid else np.zeros((0, 2), np.int64)
        parts, at = [], 0
        for s, e in pairs:
            parts.append(data[at:s])
            at = e
        body = b"".join(x.tobytes() for x in [*parts, data[at:]])
        n_removed.append(len(data) - len(body))
        n_spans.append(len(pairs))
        digest.append(hashlib.sha256(body).hexdigest())
        text.append(body)
    yield pa.RecordBatch.from_arrays(
        [column(part, "doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
         pa.array(digest, pa.string()), pa.array(text, pa.binary())],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, hot_slices: int = HOT_SLICES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    kept (the remaining bytes; they need not be valid UTF-8).

    Null texts are empty; texts shorter than ``length`` lose nothing.  Matches
    within one document, or between rows of one id, count for nothing.  Rows
    of one id are one document: what is marked in one is cut from all, so they
    must have one text.  A null id counts as larger than all others.  Empty
    tables give an empty result; only doc_id and text are read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with small_batches(docs.sparkSession):
        found = written(repeated_spans(docs, length, k, hot_slices), "repeats")
    keyed = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)))
    some = id_filter(keyed, found.select("doc_id")).join(found, "doc_id", "left")
    rest = id_filter(keyed, found.select("doc_id"), inside=False).withColumn("spans", F.lit(None).cast("binary"))
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = map_slices(some.select("doc_id", "text", "spans").unionByName(rest), _cut, kind)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID)))
