"""Vectorised word hashing and shingling of Arrow text columns (a helper of several operators).

Words are maximal runs outside ``[\\x20\\x09-\\x0D]``, with A-Z lower-cased; every word gets a 64-bit
hash from a polynomial over its bytes (prefix sums modulo 2^64, then mixed). A batch is handled in
chunks cut between words, so the working memory follows the chunk, not the batch; one longer word
makes its chunk longer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def seeds(n: int, start: int = 1) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(start, start + n, dtype=np.uint64) * _GOLD)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256)
_FOLD[0x41:0x5B] += 0x20
_BYTE = seeds(256, 1000)[_FOLD]
_P = int(seeds(1, 7)[0]) | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_P, _P_INV)):
                t = np.full(max(n, CHUNK + 1), base, np.uint64)
                t[0] = 1
                _powers[k] = np.cumprod(t)
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets of each text's words)."""
    raw, off = text_bytes(column)
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)           # a text border lies before byte i
    edge[off] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
    del inside, begin, last, edge
    out = np.empty(len(s), np.uint64)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(s):
            b = max(a + 1, int(np.searchsorted(e, s[a] + CHUNK, "right")))
            lo, hi = int(s[a]), int(e[b - 1])
            p, q = _power_tables(hi - lo + 1)
            acc = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTE[raw[lo:hi]] * p[:hi - lo], out=acc[1:])
            st, en = s[a:b] - lo, e[a:b] - lo
            out[a:b] = mix((acc[en] - acc[st]) * q[st] + (en - st).astype(np.uint64) * _GOLD)
            a = b
    return out, np.searchsorted(s, off, "left")


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, offsets). A text of fewer than ``size`` words
    has its whole word sequence as its only shingle; one without words has none."""
    words, off = word_hashes(column)
    mult = seeds(size, 50) | np.uint64(1)
    parts, ends = [], [0]
    with np.errstate(over="ignore"):
        for a, b in zip(off[:-1], off[1:]):
            w = words[a:b]
            if len(w) >= size:
                h = np.zeros(len(w) - size + 1, np.uint64)
                for k in range(size):
                    h += w[k:len(w) - size + 1 + k] * mult[k]
                parts.append(np.unique(mix(h)))
            elif len(w):
                h = (w * mult[:len(w)]).sum(dtype=np.uint64) + np.uint64(len(w)) * _GOLD
                parts.append(mix(np.array([h], np.uint64)))
            ends.append(ends[-1] + (len(parts[-1]) if len(w) else 0))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array(ends, np.int64)


def slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20):
    """Parts of a batch whose texts together have about ``limit`` bytes (a longer text stands alone)."""
    sizes = np.array([len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(column)], np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
