"""Vectorised word hashing: words of many texts at once, without a Python object per word."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


BASE_INV = np.uint64(_inverse(int(BASE)))


def _lut(fold: bool) -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    if fold:
        out[65:91] += 32
    out[[32, *range(9, 14)]] = 0
    return out


#: Bytes with white space as 0, A-Z lower-cased in the first.
FOLD, PLAIN = _lut(True), _lut(False)
#: What each byte counts in a hash, with and without folding; bytes outside white space.
_FOLDED, _PLAIN, _INSIDE = FOLD.astype(np.uint64) + np.uint64(1), PLAIN.astype(np.uint64) + np.uint64(1), PLAIN > 0
_INSIDE[0] = True
# NUL bytes of a text are word characters, not white space: they are hashed as a byte value past 255
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(18, int(n).bit_length())
    if size not in _pow:
        _pow.clear()
        out = []
        for b in (BASE, BASE_INV):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        _pow[size] = (out[0], out[1])
    return _pow[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes outside white space (space, tab to carriage return)."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _INSIDE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(raw: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of a byte array; with fold, A-Z count as a-z."""
    starts, ends = word_spans(raw)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    up, down = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _PLAIN)[raw] * up[: len(raw)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48))), starts, ends


#: Odd multipliers of the places in a shingle.
PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(h: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes (63 bits) of all runs of `size` words; with fewer words, of the whole sequence; without words, none."""
    if not len(h):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        if len(h) < size:
            out = np.uint64(len(h)) * PLACES[4] + (h * PLACES[: len(h)]).sum(keepdims=True)
        else:
            n = len(h) - size + 1
            out = h[:n] * PLACES[0]
            for j in range(1, size):
                out = out + h[j : n + j] * PLACES[j]
        return (mix(out) >> np.uint64(1)).astype(np.int64)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct 5-word shingles of a whole text."""
    if not text:
        return np.zeros(0, np.int64)
    return np.unique(shingles(word_hashes(np.frombuffer(text.encode(), np.uint8))[0]))
