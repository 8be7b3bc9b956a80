"""Co-occurrence counts of categories by packed bits."""

from __future__ import annotations

import numpy as np

#: Clusters whose bits are packed and multiplied together.
STRIDE = 1 << 13


def packed(members: np.ndarray, clusters: np.ndarray, n_members: int, n_clusters: int) -> np.ndarray:
    """[member, word]: bit c of a member's words says whether (member, c) is given."""
    bits = np.zeros((n_members, -(-n_clusters // 64) * 64), np.uint8)
    bits[members, clusters] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def shared_bits(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """[i, j]: bits set in both row i of one and row j of many."""
    out = np.empty((len(one), len(many)), np.int64)
    for i, words in enumerate(one):
        np.bitwise_count(many & words).sum(axis=1, dtype=np.int64, out=out[i])
    return out


def cells(left: tuple, right: tuple) -> tuple[np.ndarray, ...]:
    """h1 < h2, a, b, c, d and shared of categories of two tiles of one block of clusters.

    A tile is (category, cluster, call) of its observed pairs, each at most once. a, b, c, d count the
    clusters that both, only the first, only the second and neither call, among those both observe. A tile
    with itself (the same object) is sorted and packed once.
    """
    same = left is right
    names1, rows1 = np.unique(left[0], return_inverse=True)
    names2, rows2 = (names1, rows1) if same else np.unique(right[0], return_inverse=True)
    every, at = np.unique(left[1] if same else np.concatenate([left[1], right[1]]), return_inverse=True)
    at1, at2 = at[: len(rows1)], at if same else at[len(rows1) :]
    total = np.zeros((4, len(names1), len(names2)), np.int64)
    for lo in range(0, len(every), STRIDE):
        tiles = []
        for rows, place, call, n in ((rows1, at1, left[2], len(names1)), (rows2, at2, right[2], len(names2)))[: 1 if same else 2]:
            here = (place >= lo) & (place < lo + STRIDE)
            size = min(STRIDE, len(every) - lo)
            tiles += [packed(rows[here], place[here] - lo, n, size), packed(rows[here & call], place[here & call] - lo, n, size)]
        seen1, called1, seen2, called2 = tiles * 2 if same else tiles
        total += [shared_bits(seen1, seen2), shared_bits(called1, called2), shared_bits(called1, seen2), shared_bits(seen1, called2)]
    shared, a, first, second = total
    i, j = np.nonzero(shared)
    keep = names1[i] < names2[j]
    i, j = i[keep], j[keep]
    shared, a, first, second = shared[i, j], a[i, j], first[i, j], second[i, j]
    return names1[i], names2[j], a, first - a, second - a, shared - first - second + a, shared
