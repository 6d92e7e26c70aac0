"""Vectorised word splitting and hashing over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

_M = np.uint64
#: Odd multiplier of the polynomial word hash and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = np.asarray(x, _M).copy()
    x ^= x >> _M(33)
    x *= _M(0xFF51AFD7ED558CCD)
    x ^= x >> _M(33)
    x *= _M(0xC4CEB9FE1A85EC53)
    x ^= x >> _M(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_M))
_POW = np.ones(1, _M)
_IPOW = np.ones(1, _M)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers and their inverses; kept up to 4 million, longer ones are made for the call."""
    global _POW, _IPOW
    if len(_POW) >= n:
        return _POW[:n], _IPOW[:n]
    size = 1 << (n - 1).bit_length()
    with np.errstate(over="ignore"):
        a, b = np.full(size, _P, _M), np.full(size, _INV, _M)
        a[0] = b[0] = 1
        a, b = np.cumprod(a), np.cumprod(b)
    if size <= 1 << 22:
        _POW, _IPOW = a, b
    return a[:n], b[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] for each span, from one prefix sum of a polynomial modulo 2**64."""
    n = len(values)
    if not len(starts):
        return np.zeros(0, _M)
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, _M)
        np.cumsum(values * up[:n], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        return mix(h + (ends - starts).astype(_M))


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every text: hash, text index, byte start and end. A-Z are lowered; words end at ASCII white space or a text's end."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return np.zeros(0, _M), e, e, e
    low = _LOWER[data]
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = solid[cut]
    last[cut - 1] = solid[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = span_hashes(_BYTE[low], starts, ends)
    doc = np.searchsorted(offsets, starts, "right") - 1
    return h, doc, starts, ends


def windows(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of `size` words within a text, and its text; a text of fewer words has one run of all its words."""
    if not len(h):
        return h, doc
    change = np.flatnonzero(np.diff(doc)) + 1
    begin = np.concatenate([[0], change])
    end = np.concatenate([change, [len(doc)]])
    left = np.repeat(end, end - begin) - np.arange(len(doc))
    short = (end - begin) < size
    keep = left >= size
    keep[begin[short]] = True
    at = np.flatnonzero(keep)
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), _M)
        span = left[at]
        for k in range(size):
            more = k < span
            out = np.where(more, (out ^ h[np.minimum(at + k, len(h) - 1)]) * _M(_P) + _M(k + 1), out)
    return mix(out), doc[at]
