"""Vectorised text primitives over numpy buffers, shared by the shingle operators.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z, which is exactly
what ``bytes.lower().split()`` does; here the same cut is made for a whole Arrow batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_INV = np.uint64(pow(int(BASE), -1, 1 << 64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        step[0] = 1
        have = _powers[name] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column with nulls as empty strings, without copying where possible."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int):
    """Row ranges whose texts hold about ``limit`` bytes; a longer text is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, word ends and each document's first word number (n + 1 entries)."""
    low = _LOWER[buf]
    inside = np.empty(len(low) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[low], out=inside[1:-1])
    edge = inside[1:] & ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(low))]
    edge[cuts] = inside[1:][cuts]  # a word never crosses a document's end
    starts = np.flatnonzero(edge[:-1])
    last = inside[1:-1] & ~inside[2:]
    last[cuts - 1] = inside[1:-1][cuts - 1]
    ends = np.flatnonzero(last) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(low: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (byte + 1) * BASE**j over j < i, modulo 2**64."""
    out = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power(BASE, "up", len(low)), out=out[1:], dtype=np.uint64)
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands."""
    down = _power(_INV, "down", len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M2)


def rolling_hash(buf: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the ``n`` bytes from each position on."""
    prefix = prefix_hash(buf)
    out = prefix[n:] - prefix[:-n]
    out *= _power(_INV, "down", len(prefix))[: len(out)]
    return mix(out)


def shingles(word_hash: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every document's k-word shingles (all words as one where there are fewer) and their offsets.

    A document without words has none.
    """
    n_words = np.diff(first)
    counts = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    out_first = np.zeros(len(first), dtype=np.int64)
    np.cumsum(counts, out=out_first[1:])
    n = len(word_hash)
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        if n > j:
            rolled[: n - j] = rolled[: n - j] * BASE + word_hash[j:]
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(out_first[-1]) - out_first[doc] + first[doc]
    hashes = rolled[at]
    for d in np.flatnonzero((n_words > 0) & (n_words < k)):
        value = np.uint64(n_words[d])
        for h in word_hash[first[d] : first[d + 1]]:
            value = np.uint64((int(value) * int(BASE) + int(h)) & 0xFFFFFFFFFFFFFFFF)
        hashes[out_first[d]] = value
    return mix(hashes), out_first


def shingle_sets(column: pa.Array, k: int, limit: int = 4 << 20):
    """(row range, sorted distinct shingle hashes, their offsets) for a text column, piece by piece."""
    buf, offsets = string_buffer(column)
    for a, b in pieces(offsets, limit):
        own = offsets[a : b + 1] - offsets[a]
        low, starts, ends, first = words(buf[offsets[a] : offsets[b]], own)
        hashes, at = shingles(span_hash(prefix_hash(low), starts, ends), first, k)
        kept = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(b - a)]
        sizes = np.zeros(b - a + 1, dtype=np.int64)
        np.cumsum([len(x) for x in kept], out=sizes[1:])
        yield a, b, np.concatenate(kept) if kept else hashes[:0], sizes
