"""Vectorised text hashing for the operators that use Python: words, shingles and XXH64 over whole batches."""

from __future__ import annotations

import numpy as np
import xxhash

_P = [np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each ``data[start:end]``."""
    n = ends - starts
    padded = data + b"\0" * 8
    w64 = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    h = (n.astype(np.uint64) + np.uint64(seed)) + _P[4]
    at = starts.astype(np.int64).copy()
    for k in range(3):
        i = np.flatnonzero((n >> 3) > k)
        if len(i):
            x = w64[at[i]] * _P[1]
            x = _rotl(x, 31) * _P[0]
            h[i] = _rotl(h[i] ^ x, 27) * _P[0] + _P[3]
            at[i] += 8
    i = np.flatnonzero(n & 4)
    if len(i):
        x = (w64[at[i]] & np.uint64(0xFFFFFFFF)) * _P[0]
        h[i] = _rotl(h[i] ^ x, 23) * _P[1] + _P[2]
        at[i] += 4
    for k in range(3):
        i = np.flatnonzero((n & 3) > k)
        if len(i):
            x = (w64[at[i]] & np.uint64(0xFF)) * _P[4]
            h[i] = _rotl(h[i] ^ x, 11) * _P[0]
            at[i] += 1
    h ^= h >> np.uint64(33)
    h *= _P[1]
    h ^= h >> np.uint64(29)
    h *= _P[2]
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(n >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]], seed)
    return h


def word_bounds(units: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Units of space-joined words → one buffer, word starts and ends in it, and each unit's first word (with an end mark)."""
    data = b"\n".join(units)
    raw = np.frombuffer(data, np.uint8)
    gap = np.flatnonzero((raw == 32) | (raw == 10))
    starts = np.concatenate([np.zeros(1, np.int64), gap + 1])
    ends = np.concatenate([gap, np.array([len(raw)], np.int64)])
    real = ends > starts
    lens = np.fromiter(map(len, units), np.int64, len(units))
    unit_start = np.concatenate([np.zeros(1, np.int64), np.cumsum(lens + 1)])
    starts, ends = starts[real], ends[real]
    return data, starts, ends, np.searchsorted(starts, unit_start)


def shingles(units: list[bytes], size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every ``size``-word shingle, and each unit's bounds among them; a shorter unit is one shingle, an empty one none."""
    data, starts, ends, first = word_bounds(units)
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
    begin = np.repeat(first[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    width = np.repeat(np.minimum(n, size), count)
    if not len(begin):
        return np.zeros(0, np.uint64), bounds
    return xxh64(data, starts[begin], ends[begin + width - 1], seed), bounds


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_UP = np.multiply.accumulate(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def word_hashes(units: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the units, and each unit's first word (with an end mark)."""
    data, starts, ends, first = word_bounds(units)
    return xxh64(data, starts, ends, seed), first


def shingles_of(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Like ``shingles``, of word hashes; made from the words' hashes, not from their text."""
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
    begin = np.repeat(first[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    width = np.repeat(np.minimum(n, size), count)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    h = width.astype(np.uint64)
    for j in range(size):
        h += np.where(width > j, padded[begin + j] * _UP[j], np.uint64(0))
    return _mix(h), bounds


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours."""
    n = -(-len(h) // w) * w
    x = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    x[: len(h)] = h
    x = x.reshape(-1, w)
    pre = np.minimum.accumulate(x, axis=1).ravel()
    suf = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(h) - w + 1
    return np.minimum(suf[:m], pre[w - 1 : w - 1 + m])


def pieces(words: np.ndarray, first: np.ndarray, reach: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of ``least`` words or more, cut where a pair of words has the least hash of all pairs within ``reach`` words.

    The cuts depend on the words around them alone, so the same passage is cut alike wherever it stands.
    Returns each piece's unit, first word in it, number of words, and 128-bit hash as two columns."""
    n = np.diff(first)
    unit = np.flatnonzero(n >= max(least, 2))
    n = n[unit]
    if not len(unit):
        return unit, unit, unit, np.zeros((0, 2), np.uint64)
    begin = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(begin, n)
    w = words[np.repeat(first[unit], n) + place]
    pair = _mix(w * _UP[1] + np.append(w[1:], np.uint64(0)) * _UP[2])
    high = np.iinfo(np.uint64).max
    pair[begin + n - 1] = high  # a unit's last word begins no pair
    at = np.arange(len(w)) + reach * (np.repeat(np.arange(len(unit)), n) + 1)
    wide = np.full(len(w) + reach * (len(unit) + 1), high, np.uint64)
    wide[at] = pair
    cut = (window_min(wide, 2 * reach + 1)[at - reach] == pair) & (pair != high)
    cut[begin] = True
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, len(w)))
    # word hashes by their place in the piece, summed: two sums of independent multipliers
    off = (np.arange(len(w)) - np.repeat(start, size)).astype(np.uint64)
    ids = np.empty((len(start), 2), np.uint64)
    for k in range(2):
        salted = _mix(w ^ _mix(off * _P[k] + _P[k + 2]))
        ids[:, k] = _mix(np.add.reduceat(salted, start) + size.astype(np.uint64))
    whole = size > reach  # what a unit's ends cut off shorter is no piece
    return np.repeat(unit, n)[start][whole], place[start][whole], size[whole], ids[whole]
