"""Vectorised word shingles of Arrow text columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240131)
#: A random odd multiplier (3 modulo 4) and its inverse modulo 2**64; a random value for each byte, A-Z as a-z.
_P = 0x9E3779B97F4A7C17 | 3
_P_INV = pow(_P, -1, 1 << 64)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are hashed at once, cut between words: the arrays behind it take some 60 bytes for each.
PIECE = 1 << 19
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and the n + 1 offsets of the texts in them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw and n else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if n else 0)


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _IS_SPACE, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, ...]:
    """Hash of each word (A-Z lower-cased), and where each text's words begin (n + 1 places).

    ``between`` marks the bytes that separate words. For each of ``prefixes``
    an array follows with the hash of every word's first so many bytes, 0 for
    words that are no longer than that.
    """
    hashes: list[np.ndarray] = []
    starts: list[np.ndarray] = []
    heads: list[list[np.ndarray]] = [[] for _ in prefixes]
    lo = 0
    while lo < len(data):
        hi = min(lo + PIECE, len(data))
        while hi < len(data) and not between[data[hi]]:
            gaps = np.flatnonzero(between[data[hi : hi + PIECE]])
            hi += int(gaps[0]) if len(gaps) else len(data[hi : hi + PIECE])
        fresh = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        h, at, first = _word_hashes(data[lo:hi], fresh, between, prefixes)
        hashes.append(h)
        starts.append(at + lo)
        for known, x in zip(heads, first):
            known.append(x)
        lo = hi
    none = [np.zeros(0, np.uint64)]
    where = np.searchsorted(np.concatenate(starts), offsets) if starts else np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes or none), where, *[np.concatenate(x or none) for x in heads]


def _word_hashes(
    data: np.ndarray, offsets: np.ndarray, between: np.ndarray, prefixes: tuple[int, ...]
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hashes, starts and prefix hashes of the words of one piece; texts begin at ``offsets``."""
    word = np.zeros(len(data) + 2, dtype=bool)
    word[1:-1] = ~between[data]
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[offsets] = True
    starts = np.flatnonzero(word[1:] & (~word[:-1] | fresh))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | fresh))
    p, inv = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * p[: len(data)], out=sums[1:])
    first = sums[starts], inv[starts]
    heads = []
    for n in prefixes:
        h = mixed((sums[np.minimum(starts + n, len(data))] - first[0]) * first[1] + np.uint64(n))
        heads.append(np.where(ends - starts > n, h, np.uint64(0)))
    return mixed((sums[ends] - first[0]) * first[1]), starts, heads


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``width`` words.

    Fewer words make one shingle of the whole sequence; null and wordless
    texts have none. Shingles are 64-bit hashes of the word sequence; two
    different shingles of a pair of texts agree with a chance of about
    (shingles)^2 / 2^64.
    """
    data, offsets = text_bytes(texts)
    h, at = word_hashes(data, offsets)
    many = max(len(h) - width + 1, 0)
    s = h[:many].copy()
    for k in range(1, width):
        s *= np.uint64(_P)
        s += h[k : many + k]
    s = mixed(s)
    out: list[np.ndarray] = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            x = np.sort(s[a : b - width + 1])
            new = np.ones(len(x), dtype=bool)
            np.not_equal(x[1:], x[:-1], out=new[1:])
            out.append(x[new])
        elif b > a:
            one = np.array([b - a], np.uint64)
            for x in h[a:b]:
                one = mixed(one * np.uint64(0x2545F4914F6CDD1D) + x)
            out.append(one)
        else:
            out.append(h[:0])
    return out
