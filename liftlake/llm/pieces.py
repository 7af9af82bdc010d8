"""SentencePiece sampling encode and lossless decode (dealt operator 10).

A text's lattice has a node at every character boundary and an edge for every
vocabulary piece; a character without a piece has an edge of byte pieces.
Forward filtering sums the weights of all paths into each node, backward
sampling then draws one path from the end, so a segmentation is drawn with a
probability in proportion to its weight.  The random numbers are a hash of the
row key and of the place in the text: the same row gives the same sample on
any cluster and after any retry.

A path's weight is the product of its pieces' weights (1 / (rank + 10)) **
alpha, by the vocabulary's merge rank.  No piece spans two bytes that never
are neighbours within a piece, so every path passes such places: texts are cut
there, and the short segments of a slice of texts are filtered and sampled
together as arrays, each distinct one filtered once.

Decoding joins the pieces' bytes and takes the leading space off; every text
comes back byte for byte.  Spaces are spelt as in the model's pieces, a text's
own U+2581 goes by byte pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from liftlake.llm.runtime import column, lists, map_slices
from liftlake.llm.words import _BASE, _BYTE_HASH, _INVERSE, _powers, byte_view, mix64, span_hashes

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
SEED = 11
#: Longer segments (in bytes) are filtered one by one.
ARRAY_BYTES = 24
_SLOT_BITS = 20


def load_vocabulary(path: str = MODEL_PATH) -> dict:
    """The pieces of a model file as plain arrays (read on the driver, then
    broadcast: its size is the vocabulary's)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = {}, np.zeros(256, np.int32)
    for i in range(model.vocab_size()):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[3:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i)):
            pieces[model.id_to_piece(i).replace("▁", " ").encode()] = i
    return {"pieces": pieces, "byte_ids": byte_ids, "size": model.vocab_size()}


class Vocabulary:
    """Look-up tables of the pieces, built in each worker from the plain arrays."""

    def __init__(self, plain: dict, alpha: float):
        self.pieces, self.byte_ids = plain["pieces"], plain["byte_ids"]
        rank = np.arange(plain["size"], dtype=np.float64)
        self.weight = alpha * -np.log(rank + 10)
        self.byte_weight = alpha * -np.log(plain["size"] + 10.0)
        names = list(self.pieces)
        data = np.frombuffer(b"".join(names), np.uint8)
        size = np.array([len(x) for x in names], np.int64)
        end = np.cumsum(size)
        key = span_hashes(_BYTE_HASH[data], end - size, end)
        ids = np.array([self.pieces[x] for x in names], np.int32)
        self.longest = int(size.max())
        self.near = np.zeros((256, 256), bool)
        inner = np.ones(len(data) - 1, bool)
        inner[end[:-1] - 1] = False
        self.near[data[:-1][inner], data[1:][inner]] = True
        # every key has its own slot in one of a few tables
        self.tables, left = [], np.arange(len(key))
        for turn in range(8):
            slot = self.slot(key, turn)
            _, first = np.unique(slot[left], return_index=True)
            owner = np.full(1 << _SLOT_BITS, -1, np.int32)
            owner[slot[left[first]]] = left[first]
            self.tables.append(owner)
            left = np.delete(left, first)
            if not len(left):
                break
        self.key, self.ids = np.append(key, 0), np.append(ids, -1)
        # bytes of every id, for decoding
        self.size = np.zeros(plain["size"], np.int64)
        self.size[ids] = size
        self.size[self.byte_ids] = 1
        self.start = np.zeros(plain["size"], np.int64)
        self.start[ids] = end - size
        self.start[self.byte_ids] = len(data) + np.arange(256)
        self.data = np.concatenate([data, np.arange(256, dtype=np.uint8)])

    @staticmethod
    def slot(key: np.ndarray, turn: int) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15 + 2 * turn * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> np.uint64(64 - _SLOT_BITS)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Piece id of every hash, or -1."""
        out = np.full(key.shape, -1, np.int32)
        for turn, owner in enumerate(self.tables):
            at = owner[self.slot(key, turn)]
            out = np.where((self.key[at] == key) & (at >= 0), self.ids[at], out)
        return out


def _uniform(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = mix64(key + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _filter_arrays(voc: Vocabulary, values, lead, s: np.ndarray, n: int):
    """Forward filtering of segments of one length n: for every end j the
    cumulative chances of the starts, and the piece ids (-2: byte pieces)."""
    table, rows = {}, len(s)
    forward = np.full((n + 1, rows), -np.inf)
    forward[0] = 0
    for j in range(1, n + 1):
        begin = max(0, j - max(voc.longest, 4))
        i = np.arange(begin, j)
        # all substrings [i, j) of all segments at once
        key = values(np.repeat(s, len(i)) + np.tile(i, rows), np.repeat(s + j, len(i)))
        ids = voc.find(key).reshape(rows, len(i)).T
        w = np.where(ids >= 0, voc.weight[ids], -np.inf)
        ended = lead[s + j] | (j == n)
        for k in range(max(0, len(i) - 4), len(i)):
            # one character without a piece of its own: byte pieces
            alone = lead[s + i[k]] & ended & (ids[k] < 0)
            for m in range(i[k] + 1, j):
                alone &= ~lead[s + m]
            w[k] = np.where(alone, voc.byte_weight * (j - i[k]), w[k])
            ids[k] = np.where(alone, -2, ids[k])
        path = forward[begin:j] + w
        top = path.max(0)
        safe = np.where(np.isfinite(top), top, 0)
        mass = np.exp(path - safe)
        total = mass.sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            forward[j] = np.where(total > 0, safe + np.log(total), -np.inf)
            chance = np.cumsum(mass, 0) / total
        table[j] = (begin, ids, chance)
    return table


def _one(voc: Vocabulary, text: bytes, key: np.ndarray, place: np.ndarray) -> list[list[tuple[int, int]]]:
    """The same for one long segment and all places where it occurs."""
    lead = [(b & 0xC0) != 0x80 for b in text] + [True]
    n, edges = len(text), []
    forward = np.full(n + 1, -np.inf)
    forward[0] = 0
    for j in range(1, n + 1):
        into = []
        if lead[j]:
            i = j - 1
            while i > 0 and not lead[i]:
                i -= 1
            single = voc.pieces.get(text[i:j])
            if single is None:
                into.append((i, -2, voc.byte_weight * (j - i)))
            for i in range(max(0, j - voc.longest), j):
                piece = voc.pieces.get(text[i:j]) if lead[i] else None
                if piece is not None:
                    into.append((i, piece, voc.weight[piece]))
        into.sort()
        edges.append(into)
        path = np.array([forward[i] + w for i, _, w in into])
        if len(path) and np.isfinite(path.max()):
            forward[j] = path.max() + np.log(np.exp(path - path.max()).sum())
    out = []
    for k, at in zip(key, place):
        j, drawn = n, []
        while j > 0:
            into = edges[j - 1]
            path = np.array([forward[i] + w for i, _, w in into])
            chance = np.cumsum(np.exp(path - path.max()))
            u = _uniform(np.array([k], np.uint64), np.array([at + j]))[0]
            i, piece, _ = into[min(int(np.searchsorted(chance / chance[-1], u, side="right")), len(into) - 1)]
            drawn.append((i, piece))
            j = i
        out.append(drawn)
    return out


def encode_arrays(voc: Vocabulary, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of all texts, end to end, and their number per text."""
    raw0, off0 = byte_view(texts)
    some = np.diff(off0) > 0
    # the model's leading space before every text that is not empty
    raw = np.insert(raw0, off0[:-1][some], 0x20)
    off = off0 + np.concatenate([[0], np.cumsum(some)])
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
    lead = np.append((raw & 0xC0) != 0x80, True)
    cut = np.ones(len(raw), bool)
    cut[1:] = ~voc.near[raw[:-1], raw[1:]] & lead[1:-1]
    cut[off[:-1][some]] = True
    s = np.flatnonzero(cut)
    e = np.append(s[1:], len(raw))
    doc = np.searchsorted(off, s, side="right") - 1
    key, place = keys[doc], s - off[doc]
    hashed = _BYTE_HASH[raw]
    total = np.zeros(len(raw) + 1, np.uint64)
    power, inverse = _window_powers(len(raw))
    np.cumsum(hashed * power, out=total[1:])

    def values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    ids_at = np.full(len(raw), -1, np.int32)
    size = e - s
    which = values(s, e)
    for n in np.unique(size):
        mine = np.flatnonzero(size == n)
        _, first, back = np.unique(which[mine], return_index=True, return_inverse=True)
        if n > ARRAY_BYTES:
            for d, f in enumerate(first):
                occ = mine[back == d]
                drawn = _one(voc, raw[s[mine[f]]:e[mine[f]]].tobytes(), key[occ], place[occ])
                for o, path in zip(occ, drawn):
                    for i, piece in path:
                        ids_at[s[o] + i] = piece
            continue
        table = _filter_arrays(voc, values, lead, s[mine[first]], int(n))
        at = np.full(len(mine), n, np.int64)
        for j in range(int(n), 0, -1):
            here = np.flatnonzero(at == j)
            if not len(here):
                continue
            begin, ids, chance = table[j]
            row = back[here]
            u = _uniform(key[mine[here]], place[mine[here]] + j)
            k = np.minimum((chance[:, row] <= u).sum(0), chance.shape[0] - 1)
            at[here] = begin + k
            ids_at[s[mine[here]] + begin + k] = ids[k, row]
    # byte pieces: one id for every byte of the character
    for p in np.flatnonzero(ids_at == -2):
        stop = p + 1
        while not lead[stop]:
            stop += 1
        ids_at[p:stop] = voc.byte_ids[raw[p:stop]]
    pos = np.flatnonzero(ids_at >= 0)
    return ids_at[pos], np.diff(np.searchsorted(pos, off))


def _window_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, n), _powers(_INVERSE, n)


def decode_arrays(voc: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, end to end, and the n + 1 offsets."""
    size = voc.size[ids]
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    at = np.arange(total) - np.repeat(end - size, size) + np.repeat(voc.start[ids], size)
    raw = voc.data[at]
    off = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(counts)])]
    some = np.diff(off) > 0
    keep = np.ones(total, bool)
    keep[off[:-1][some]] = False
    return raw[keep], off - np.concatenate([[0], np.cumsum(some)])


_WORKER: dict = {}


def _vocabulary(shared, alpha: float) -> Vocabulary:
    have = _WORKER.get((id(shared), alpha))
    if have is None:
        have = _WORKER[(id(shared), alpha)] = Vocabulary(shared.value, alpha)
    return have


def _keys(part: pa.RecordBatch, seed: int) -> np.ndarray:
    ids = column(part, "doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return mix64(ids.view(np.uint64) + np.uint64(seed) * np.uint64(0xA0761D6478BD642F))


def encode(docs: DataFrame, model_path: str = MODEL_PATH, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, ids (array of int), n_tokens, lossless.

    The sample depends on the text, doc_id, alpha and seed alone; repeated
    rows get the same pieces.  A null text has null ids and null n_tokens and
    is lossless; an empty text has no ids.  A null doc_id counts as -1.  Empty
    tables give an empty result; only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        voc, texts = _vocabulary(shared, alpha), column(part, "text")
        ids, counts = encode_arrays(voc, texts, _keys(part, seed))
        raw, off = decode_arrays(voc, ids, counts)
        raw0, off0 = byte_view(texts)
        same = np.diff(off) == np.diff(off0)
        if len(raw) == len(raw0) and same.all():
            wrong = np.concatenate([[0], np.cumsum(raw != raw0)])
            same = wrong[off0[1:]] == wrong[off0[:-1]]
        null = texts.is_null()
        none = np.asarray(null.to_numpy(zero_copy_only=False), bool)
        array = lists(ids, counts, pa.int32())
        if none.any():
            array = pa.array([None if x else v for x, v in zip(none, array.to_pylist())], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [column(part, "doc_id"), array, pa.array(counts, pa.int64(), mask=none), pa.array(same, pa.bool_())],
            names=["doc_id", "ids", "n_tokens", "lossless"])
    return map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run,
                      "doc_id long, ids array<int>, n_tokens long, lossless boolean")


def decode(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id and text of rows of ids; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            voc = _vocabulary(shared, ALPHA)
            ids = column(batch, "ids")
            none = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
            counts = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, off = decode_arrays(voc, np.asarray(ids.flatten(), np.int64), counts)
            text = pa.array([None if x else raw[a:b].tobytes().decode() for x, a, b in zip(none, off[:-1], off[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), text], names=["doc_id", "text"])
    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
