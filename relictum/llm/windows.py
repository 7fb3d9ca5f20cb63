"""Repeated-window search shared by the byte-level and the word-level substring dedup.

A window is ``width`` consecutive units (bytes, or words) of one document. Windows of a document are dealt into
*segments*: maximal runs of windows that have the same smallest k-gram hash, the segment's key. The key depends only on a
window's content, so equal windows always carry equal keys, wherever they stand; each window lies in exactly one segment.
Work on equal windows can therefore be dealt by key, and only keys that occur twice have to move any text.

Everything here is numpy over the UTF-8 buffer of an Arrow batch; no per-unit Python.
"""

from __future__ import annotations

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Window starts handled at once, so that the arrays of a very long document stay small.
CHUNK = 1 << 19
#: Longest run kept as one segment; longer runs (periodic text) are cut, which leaves each window in one segment.
MAX_RUN = 4096

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 values (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: One random-looking value for each byte.
BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _B)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_B**i and _B**-i for i < n, modulo 2**64."""
    size = 1 << max(12, int(n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        full = np.full(size, _B)
        full[0] = 1
        inverse = np.full(size, _BINV)
        inverse[0] = 1
        _powers[size] = np.multiply.accumulate(full), np.multiply.accumulate(inverse)
    p, q = _powers[size]
    return p[:n], q[:n]


def prefix(units: np.ndarray) -> np.ndarray:
    """Prefix sums from which `gram` reads the hash of any stretch."""
    out = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * powers(len(units))[0], out=out[1:])
    return out


def gram(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end)."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def grams(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all stretches of k units, in order."""
    n = len(sums) - k
    return mix((sums[k:] - sums[:n]) * powers(n)[1]) if n > 0 else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by block-wise running minima (three passes, whatever w is)."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    if w == 1:
        return x
    padded = np.full(-(-len(x) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def segments(units: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, digest, start, number of windows and weight of each segment of one document.

    digest: a second hash, of all the segment's units. weight: 2 if the segment may repeat a window within itself
    (its key's k-gram occurs in it twice), else 1.
    """
    parts = []
    total = len(units) - width + 1
    for at in range(0, max(0, total), CHUNK):
        n = min(CHUNK, total - at)
        own = units[at : at + n + width - 1]
        sums = prefix(own)
        hashes = grams(sums, k)
        low = sliding_min(hashes, width - k + 1)
        change = low[1:] != low[:-1]
        start = np.concatenate([[0], np.flatnonzero(change) + 1])
        length = np.diff(np.concatenate([start, [n]]))
        twice = np.zeros(n, bool)
        twice[:-1] = (hashes[: n - 1] == low[:-1]) & ~change
        weight = 1 + np.logical_or.reduceat(twice, start)
        if length.max() > MAX_RUN:
            pieces = -(-length // MAX_RUN)
            which = np.repeat(np.arange(len(start)), pieces)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.minimum(length[which] - nth * MAX_RUN, MAX_RUN)
            start, weight = start[which] + nth * MAX_RUN, weight[which]
        digest = gram(sums, start, start + length + width - 1) ^ mix(length.astype(np.uint64))
        parts.append((low[start], digest, start + at, length, weight))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column (null: empty) and the n + 1 offsets into them."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def word_spans(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~((text == 32) | ((text >= 9) & (text <= 13)))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_codes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = []
    for at in range(0, len(starts), CHUNK // 4):
        s, e = starts[at : at + CHUNK // 4], ends[at : at + CHUNK // 4]
        own = text[s[0] : e[-1]]
        out.append(gram(prefix(BYTE_CODE[own]), s - s[0], e - s[0]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals [start, end) as sorted maximal runs; touching ones join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], s[1:] > e[:-1]])
    at = np.flatnonzero(first)
    return s[at], e[np.concatenate([at[1:] - 1, [len(s) - 1]])]
