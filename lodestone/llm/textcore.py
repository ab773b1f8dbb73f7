"""Vectorised text primitives over Arrow string columns (numpy only).

A column is seen as one byte buffer with row offsets; words, shingles and
rolling hashes of all its rows are computed at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
#: splitmix64 multipliers (fixed values).
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_GOLD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x *= _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


def random_u64(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _GOLD + _U(seed))


def space_table() -> np.ndarray:
    """True for bytes that belong to words split on [\\x20\\x09-\\x0D]."""
    t = np.ones(256, bool)
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return t


def alnum_table() -> np.ndarray:
    """True for ASCII letters, digits and every byte of non-ASCII characters."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words(raw: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the row offsets into the words."""
    n = len(raw)
    w = is_word[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = w.copy()
    start[1:] &= ~w[:-1] | edge[1:n]
    end = w.copy()
    end[:-1] &= ~w[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def word_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes at a time."""
    size = (e - s).astype(np.int64)
    h = size.astype(_U) * _GOLD + _U(seed)
    padded = np.zeros(len(raw) + 16, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 8,), np.dtype("<u8"), padded.data, 0, (1,))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], _U)
    live, at = None, 0
    while True:
        rest = size - at if live is None else size[live] - at
        where = s + at if live is None else s[live] + at
        x = eight[where] & masks[np.minimum(rest, 8)]
        if live is None:
            h = mix(h ^ (x * _M2))
        else:
            h[live] = mix(h[live] ^ (x * _M2))
        at += 8
        if at > 64:
            break
        live = np.flatnonzero(size > at) if live is None else live[size[live] > at]
        if not len(live):
            return h
    for i in np.flatnonzero(size > 64):
        h[i] = xxhash.xxh64_intdigest(raw[s[i] : e[i]].tobytes(), seed=seed & 0xFFFFFFFF)
    return h


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles; a row with
    fewer words has its whole sequence as one, a row without words none."""
    c = random_u64(77, k) | _U(1)
    n = len(h)
    if n >= k:
        full = np.zeros(n - k + 1, _U)
        for j in range(k):
            full += h[j : n - k + 1 + j] * c[j]
        full = mix(full)
    else:
        full = np.zeros(0, _U)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            x = np.sort(full[a : b - k + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
            out.append(x)
        elif b > a:
            out.append(mix(np.array([(h[a:b] * c[: b - a]).sum(dtype=_U) + _U(b - a)], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=off[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, kind))
