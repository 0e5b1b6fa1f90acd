"""Hamming distances of many fingerprints at once, on bit planes.

Fingerprints are stored vertically: plane b holds bit b of all rows, 64 rows to a word. One
word of a plane against the same plane moved down by `lag` rows compares 64 pairs in one
operation; carry-save adders sum eight planes at a time into vertical counters. A word whose
pairs have all passed the radius is abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GROUP = 8  # planes summed before the counters are looked at
CHUNK = 1 << 13  # words, each of 64 pairs, compared at once


def planes_of(fps: np.ndarray, bits: list[int] | None = None) -> np.ndarray:
    """(bits, words): word w of plane b holds bit b of the rows 64 w to 64 w + 63."""
    flat = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    flat = flat if bits is None else flat[:, bits]
    padded = np.zeros((flat.shape[1], (len(fps) // 64 + 1) * 64), np.uint8)
    padded[:, : len(fps)] = flat.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Full adder: sum and carry."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _above(counter: list[np.ndarray], limit: int) -> np.ndarray:
    """In which lanes a vertical number, lowest bit first, is greater than the limit."""
    above = np.zeros_like(counter[0])
    for bit, plane in enumerate(counter):
        above = above & plane if limit >> bit & 1 else above | plane
    return above


def close_pairs(fps: np.ndarray, end: np.ndarray, radius: int, bits: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j < end[i], of rows that differ in at most `radius` of the bits, by chunks.

    `fps` is a matrix of uint64, `end` says for each row where its bucket ends. The number of
    bits is a multiple of 8. A chunk has at most 64 * CHUNK pairs.
    """
    n = len(fps)
    left = np.zeros((n // 64 + 1) * 64, np.int64)
    left[:n] = end - np.arange(n) - 1
    left = left.reshape(-1, 64)
    most = left.max(axis=1)  # lags for which a word has a pair
    total = int(most.sum())
    if not total:
        return
    planes = planes_of(fps, bits)
    planes = np.concatenate([planes, np.zeros((len(planes), int(most.max()) // 64 + 2), np.uint64)], axis=1)
    high = (len(planes) // GROUP).bit_length()
    ends = np.cumsum(most)
    for begin in range(0, total, CHUNK):
        number = np.arange(begin, min(begin + CHUNK, total))
        at = np.searchsorted(ends, number, side="right")
        lag = number - (ends[at] - most[at]) + 1
        alive = np.packbits(left[at] >= lag[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
        counter = [np.zeros(len(at), np.uint64) for _ in range(3 + high)]
        ahead, shift = at + lag // 64, (lag % 64).astype(np.uint64)
        for group in range(0, len(planes), GROUP):
            x = []
            for plane in planes[group : group + GROUP]:
                moved = (plane[ahead] >> shift) | ((plane[ahead + 1] << np.uint64(1)) << (np.uint64(63) - shift))
                x.append(plane[at] ^ moved)
            ones, a = _add(counter[0], x[0], x[1])
            ones, b = _add(ones, x[2], x[3])
            twos, f = _add(counter[1], a, b)
            ones, a = _add(ones, x[4], x[5])
            ones, b = _add(ones, x[6], x[7])
            twos, g = _add(twos, a, b)
            fours, carry = _add(counter[2], f, g)
            counter[:3] = ones, twos, fours
            for bit in range(3, 3 + high):
                counter[bit], carry = counter[bit] ^ carry, counter[bit] & carry
            alive = alive & ~_above(counter[3:], radius // 8)
            go = np.flatnonzero(alive)
            if len(go) < 0.75 * len(alive):
                at, lag, ahead, shift, alive = at[go], lag[go], ahead[go], shift[go], alive[go]
                counter = [c[go] for c in counter]
                if not len(go):
                    break
        alive = alive & ~_above(counter, radius)
        hits = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little"))
        if len(hits):
            i = at[hits // 64] * 64 + hits % 64
            yield i, i + lag[hits // 64]


def roots_of(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def nearest_forest(fps: np.ndarray, end: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Close pairs that connect all that close pairs connect, fewer than there are rows.

    In each chunk every class takes up its nearest pairs first, until no close pair of the
    chunk lies between two classes.
    """
    parent = np.arange(len(fps))
    out = [np.zeros((0, 2), np.int64)]
    for i, j in close_pairs(fps, end, radius):
        root = parent = roots_of(parent)
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        distance = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1)
        while len(i):
            rows, mates = np.concatenate([root[i], root[j]]), np.tile(np.arange(len(i)), 2)
            order = np.lexsort((mates, np.tile(distance, 2), rows))
            first = np.unique(rows[order], return_index=True)[1]
            taken = []
            for edge in np.unique(mates[order[first]]):
                a, b = i[edge], j[edge]
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    taken.append(edge)
            out.append(np.stack([i[taken], j[taken]], axis=1))
            root = parent = roots_of(parent)
            apart = root[i] != root[j]
            i, j, distance = i[apart], j[apart], distance[apart]
    pairs = np.concatenate(out)
    return pairs[:, 0], pairs[:, 1]
