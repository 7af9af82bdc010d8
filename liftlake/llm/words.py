"""Word and shingle hashing for batches of texts (numpy on UTF-8 bytes).

Small helpers for functions that Spark runs over Arrow batches: the texts of
one batch are laid end to end as bytes, and one pass of array operations
gives the words of all of them.  Every byte of a multi-byte character is at
least 0x80, so classes of ASCII characters can be told on bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64


def _table() -> np.ndarray:
    """256 fixed 64-bit values, one for each byte (splitmix64 of the byte)."""
    return mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def mix64(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    h = h.astype(_U, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


_BYTE_HASH = _table()
_BASE = 0x5851F42D4C957F2D          # odd, so it has an inverse modulo 2**64
_POWERS: dict[int, np.ndarray] = {}
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64 (kept for the longest asked for)."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(n, base, dtype=_U)
        have[:1] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


#: Word characters of the near-duplicate contract: all but space and \x09-\x0D.
SPACE_SPLIT = np.ones(256, dtype=bool)
SPACE_SPLIT[[0x20, *range(0x09, 0x0E)]] = False
#: Word characters of the benchmark contract: digits, letters and all non-ASCII.
ALNUM_SPLIT = np.zeros(256, dtype=bool)
ALNUM_SPLIT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string/binary array and the n + 1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    texts = texts.fill_null(b"") if texts.null_count else texts
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def span_hashes(values: np.ndarray, s: np.ndarray, e: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Hash of every span [s, e) of an array of 64-bit values, from prefix sums
    of value * base ** (position within a block of fixed length).  A span that
    crosses the edge of a block (rare) is summed by itself."""
    if len(s) == 0:
        return np.zeros(0, _U)
    power = _powers(_BASE, min(block, len(values)))
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * (np.tile(power, -(-len(values) // block))[:len(values)] if len(values) > block else power), out=total[1:])
    h = (total[e] - total[s]) * _powers(_INVERSE, min(block, len(values)))[s % block]
    for i in np.flatnonzero((s // block) != ((e - 1) // block)):
        own = values[s[i]:e[i]]
        h[i] = (own * _powers(_BASE, len(own))).sum(dtype=_U)
    return h + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93)


def words(raw: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words and, for each document, the index of its
    first word (n + 1 entries).  Words never cross documents."""
    if len(raw) == 0:
        return np.zeros(0, _U), np.zeros(len(off), np.int64)
    inside = is_word[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    first, last = off[:-1][np.diff(off) > 0], off[1:][np.diff(off) > 0] - 1
    starts[first] = inside[first]
    ends[last] = inside[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return mix64(span_hashes(_BYTE_HASH[_LOWER[raw]], s, e)), np.searchsorted(s, off)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every k-word shingle with its document's index and its first
    word's index; a document of fewer words, but not none, has one shingle,
    the whole sequence."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype)))
    count = np.bincount(doc, minlength=len(n))
    start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][doc]
    out = np.zeros(len(doc), _U)
    odd = mix64(np.arange(7, 7 + k, dtype=_U))| _U(1)
    have = n[doc]
    for j in range(k):
        there = np.minimum(start + j, max(len(h) - 1, 0))
        out += np.where(have > j, h[there] * odd[j], _U(0)) if (have < k).any() else h[there] * odd[j]
    return mix64(out + np.minimum(have, k).astype(_U)), doc, start
