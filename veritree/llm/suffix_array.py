"""Suffix order of one block of text by a difference cover, and what repeats in it.

A difference cover modulo v is a set of residues such that for any two positions some shift below v
moves both onto residues of the set. The block's cover samples (positions with those residues) are
ranked first; then suffixes are sorted by their first v bytes, and ties longer than that are resolved by
the ranks of the samples at the shift the two positions have in common. Memory is a constant number of
machine words per byte of the block.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from veritree.llm.wordhash import _powers

#: The cover's modulus; sorted prefixes are V bytes long.
V = 31


@lru_cache
def cover(v: int = V) -> np.ndarray:
    """A smallest-first difference cover modulo v, found by search: the fewest residues whose differences are all residues."""

    def extend(chosen: list[int], seen: set[int], size: int) -> list[int] | None:
        if len(seen) == v:
            return chosen
        if len(chosen) == size or len(seen) + sum(2 * k for k in range(len(chosen), size)) < v:
            return None
        for c in range(chosen[-1] + 1, v):
            if found := extend([*chosen, c], seen | {(c - x) % v for x in chosen} | {(x - c) % v for x in chosen}, size):
                return found
        return None

    return next(np.array(f) for size in range(1, v + 1) if (f := extend([0], {0}, size)))


@lru_cache
def shifts(v: int = V) -> np.ndarray:
    """shifts[i, j]: the least shift that moves residues i and j onto the cover."""
    inside = np.zeros(v, bool)
    inside[cover(v)] = True
    k = np.arange(v)
    on = inside[(k[:, None] + k[None]) % v]  # residue, shift
    return (on[:, None, :] & on[None, :, :]).argmax(2).astype(np.int64)


def _ranks(keys: np.ndarray) -> np.ndarray:
    """The dense rank of each key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.empty(len(k), np.int64)
    new[:1] = 0
    np.cumsum(k[1:] != k[:-1], out=new[1:])
    out = np.empty(len(k), np.int64)
    out[order] = new
    return out


def _ahead(r: np.ndarray, by: int) -> np.ndarray:
    out = np.full(len(r), -1, np.int64)
    out[: max(0, len(r) - by)] = r[by:]
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << np.int64(32)) | (b + 1)


def prefix_ranks(text: np.ndarray) -> np.ndarray:
    """The rank of each suffix by its first V bytes; beyond the block's end all is 0."""
    word = np.zeros(len(text), np.uint64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j : j + len(text)]
    r = _ranks(word)
    r = _ranks(_pair(r, _ahead(r, 8)))  # 16 bytes
    return _ranks(_pair(r, _ahead(r, V - 16)))  # V bytes, the last 16 over again in part


def sample_ranks(prefix: np.ndarray, length: int) -> np.ndarray:
    """At cover positions the rank of the suffix by its first `length` bytes or more, elsewhere -1."""
    n = len(prefix)
    inside = np.zeros(V, bool)
    inside[cover()] = True
    at = np.flatnonzero(inside[np.arange(n) % V])
    r = np.full(n + 1, -1, np.int64)
    r[at] = _ranks(prefix[at])
    known = V
    while known < length:
        # a sample and the place `known` (a multiple of V) further are both in the cover
        r[at] = _ranks(_pair(r[at], r[np.minimum(at + known, n)]))
        known *= 2
    return r


def suffix_order(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """starts in the order of the suffixes there, by their first `length` bytes at least; equal ones are neighbours."""
    prefix = prefix_ranks(text)
    ranks = sample_ranks(prefix, length)
    p = prefix[starts]
    order = starts[np.argsort(p, kind="stable")]
    group = prefix[order]
    table = shifts()
    lo = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    hi = np.r_[lo[1:], len(order)]
    open_ = hi - lo > 1
    lo, hi = lo[open_], hi[open_]
    # every group of ties at once: parted by a pivot into less, equal and greater, as in quicksort
    while len(lo):
        size = hi - lo
        inner = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        which = np.repeat(np.arange(len(lo)), size)
        own = order[inner]
        pivot = order[lo + size // 2][which]
        shift = table[own % V, pivot % V]
        last = len(text)
        side = np.sign(ranks[np.minimum(own + shift, last)] - ranks[np.minimum(pivot + shift, last)])
        key = which * 3 + side + 1
        by = np.argsort(key, kind="stable")
        order[inner] = own[by]
        key = key[by]
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        end = np.r_[cut[1:], len(key)]
        again = (key[cut] % 3 != 1) & (end - cut > 1)
        lo, hi = inner[cut[again]], inner[cut[again]] + (end - cut)[again]
    return order


def repeated(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which starts have a string of `length` bytes that another start has too; no such string may pass the block's end."""
    if len(starts) < 2:
        return np.zeros(len(starts), bool)
    order = suffix_order(text, starts, length)
    up, down = _powers(len(text) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=sums[1:])
        print_ = (sums[order + length] - sums[order]) * down[order]
    same = print_[1:] == print_[:-1]
    # neighbours with equal fingerprints are compared byte by byte, in slices of bounded memory
    hits = np.flatnonzero(same)
    step = np.arange(length)
    for at in range(0, len(hits), 1 << 14):
        h = hits[at : at + (1 << 14)]
        same[h] = (text[order[h][:, None] + step] == text[order[h + 1][:, None] + step]).all(1)
    flag = np.zeros(len(text) + 1, bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return flag[starts]
