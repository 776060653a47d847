"""XXH64 of many byte slices at once (numpy), equal to the public definition."""

from __future__ import annotations

import numpy as np
import xxhash

# The five primes of XXH64 (fixed values of the public definition).
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)
#: Longer slices are hashed one at a time.
LONG = 512


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc, lane):
    return _rotate(acc + lane * P2, 31) * P1


def xxh64_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of ``data[s:e]`` for each pair; ``data`` holds bytes (uint8)."""
    seed = np.uint64(seed)
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    four = np.ndarray((len(data) + 1,), "<u4", padded.data, 0, (1,))
    h = np.full(len(size), seed + P5, np.uint64)
    at = starts.copy()
    big = np.flatnonzero((size >= 32) & (size <= LONG))
    if len(big):
        with np.errstate(over="ignore"):
            acc = [np.full(len(big), x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        left, pos = size[big] // 32, at[big].copy()
        live = np.arange(len(big))
        while len(live):
            for k in range(4):
                acc[k][live] = _round(acc[k][live], eight[pos[live] + 8 * k])
            pos[live] += 32
            left[live] -= 1
            live = live[left[live] > 0]
        total = _rotate(acc[0], 1) + _rotate(acc[1], 7) + _rotate(acc[2], 12) + _rotate(acc[3], 18)
        for k in range(4):
            total = (total ^ _round(np.zeros(len(big), np.uint64), acc[k])) * P1 + P4
        h[big], at[big] = total, pos
    h += size.astype(np.uint64)
    rest = np.where(size <= LONG, ends - at, 0)
    zero = np.uint64(0)
    for k in range(3):
        i = np.flatnonzero(rest >= 8)
        if not len(i):
            break
        h[i] = _rotate(h[i] ^ _round(zero, eight[at[i]]), 27) * P1 + P4
        at[i] += 8
        rest[i] -= 8
    i = np.flatnonzero(rest >= 4)
    h[i] = _rotate(h[i] ^ (four[at[i]].astype(np.uint64) * P1), 23) * P2 + P3
    at[i] += 4
    rest[i] -= 4
    for k in range(3):
        i = np.flatnonzero(rest > 0)
        if not len(i):
            break
        h[i] = _rotate(h[i] ^ (data[at[i]].astype(np.uint64) * P5), 11) * P1
        at[i] += 1
        rest[i] -= 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]].tobytes(), int(seed))
    return h
