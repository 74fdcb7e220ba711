"""Suffix arrays by prefix doubling, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def _ordered(first: np.ndarray, after: np.ndarray, i: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``i`` in the order of (first, after), and the pairs as numbers. All are ``n`` at most."""
    bits = n.bit_length()
    if 3 * bits > 63:
        key = first * (n + 1) + after
        by = np.argsort(key)
        return i[by], key[by]
    # all three in one number, which is sorted faster than looked up
    key = first << bits
    key |= after
    key <<= bits
    key |= i
    key.sort()
    return key & ((1 << bits) - 1), key >> bits


def suffix_array(t: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Positions of a byte string in the order of their suffixes, as far as ``depth`` bytes tell them apart.

    Suffixes are sorted by their first seven bytes as one number; then those
    still tied by the ranks of the suffixes 7, 14, 28 ... bytes on (at last by
    what is left of the depth), until none is tied or the depth is reached. A suffix that ends comes before those that
    go on. ``wanted`` marks the suffixes to return, all by default; the others
    are ranked as far as those need them.
    """
    n = len(t)
    if n < 2:
        return np.arange(n) if wanted is None else np.flatnonzero(wanted)
    padded, h = np.zeros(n + 8, np.uint8), 7
    padded[:n] = t
    key = np.ndarray(n, ">u8", padded, strides=(1,)).astype(np.uint64)
    # last how many of the bytes are there, so that the end sorts below a zero byte
    key &= np.uint64(0xFFFFFFFFFFFFFF00)
    key |= np.uint64(h)
    key[-h:] += np.arange(min(n, h), 0, -1).astype(np.uint64) - np.uint64(h)
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    # the rank of a suffix is where those tied with it begin, counted from 1; 0 is the end
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + min(n, depth), np.int32 if n < 1 << 31 else np.int64)
    rank[order] = first + 1
    while h < depth:
        step = min(h, depth - h)
        if wanted is not None and h + step == depth:  # nothing is ranked by this order any more
            keep = wanted[order]
            order, first = order[keep], first[keep]
            new = np.r_[True, first[1:] != first[:-1]][: len(order)]
        at = np.flatnonzero(~new | ~np.r_[new[1:], True])
        if not len(at):
            break
        i = order[at]
        order[at], key = _ordered(first[at], rank[np.minimum(i + step, len(rank) - 1)], i, n)
        h += step
        if h == depth:
            return order
        new[at] = np.r_[True, key[1:] != key[:-1]]
        first[at] = np.maximum.accumulate(np.where(new[at], at, 0))
        rank[order[at]] = first[at] + 1
    return order if wanted is None or len(order) < n else order[wanted[order]]


def permuted_common_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each position, how many bytes (``most`` at most) its suffix shares with the one before it in order."""
    n = len(t)
    padded = np.concatenate([t, np.zeros(most + 16, np.uint8)])
    word = np.ndarray(n + most + 8, "<u8", padded, strides=(1,)).astype(np.uint64)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, dtype=np.int64)
    at = np.flatnonzero(before >= 0)
    done = 0
    while len(at) and done < most:
        x = word[at + done] ^ word[before[at] + done]
        same = x == 0
        low = x[~same] & (~x[~same] + np.uint64(1))
        out[at[~same]] = done + np.log2(low.astype(np.float64)).astype(np.int64) // 8
        at = at[same]
        done += 8
        out[at] = done
    # no suffix is longer than the string's end
    out = np.minimum(out, np.minimum(n - np.arange(n), n - np.maximum(before, 0)))
    return np.minimum(out, most)
