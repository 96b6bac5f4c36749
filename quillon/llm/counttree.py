"""Count-vector R-tree: bounds the overlap of token sets by summed coordinate minima.

Tokens (64-bit hashes) fall into groups by their leading bits; a set's point
holds its token count per group.  The overlap of two sets is at most the sum
over groups of the smaller count, and for a tree node at most the sum of the
minima with the node's upper corner.  A pair can only reach the similarity if
that bound does.
"""

from __future__ import annotations

import numpy as np

LEAF = 8
FAN = 8


def groups_for(sizes: np.ndarray) -> int:
    """A power of two near an eighth of the largest set, so that unrelated sets differ in most coordinates."""
    return 1 << int(np.clip(int(max(1, sizes.max(initial=1)) // 8).bit_length(), 4, 10))


def points(sets: list[np.ndarray], groups: int) -> np.ndarray:
    shift = np.uint64(64 - (groups.bit_length() - 1))
    return np.stack([np.bincount((s >> shift).astype(np.int64), minlength=groups) for s in sets]).astype(np.int32) if sets else np.zeros((0, groups), np.int32)


class CountTree:
    """Sets packed by size, then by their fullest coordinates, into nodes with upper corners and size ranges."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, num: int, den: int):
        self.vectors, self.sizes, self.num, self.den = vectors, sizes, num, den
        spread = vectors.var(axis=0) if len(vectors) else np.zeros(1)
        lead = np.argsort(-spread, kind="stable")[:2]
        self.order = np.lexsort(tuple(vectors[:, c] for c in lead[::-1]) + (sizes,)) if len(vectors) else np.zeros(0, np.int64)
        #: levels from the leaves up: (corner, smallest, largest size), each node of FAN below it
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        corner, low, high, width = vectors[self.order], sizes[self.order], sizes[self.order], LEAF
        while len(corner) > 1:
            at = np.arange(0, len(corner), width)
            corner, low, high = np.maximum.reduceat(corner, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((corner, low, high))
            width = FAN

    def _reaches(self, bound: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
        return (self.num + self.den) * bound.astype(np.int64) >= self.num * (a + b.astype(np.int64))

    def candidates(self, vector: np.ndarray, size: int) -> np.ndarray:
        """Indexes of the sets whose bound with this one reaches the similarity."""
        num, den = self.num, self.den
        least, most = -(-num * size // den), size * den // num
        nodes = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.order))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, low, high = (x[nodes] for x in self.levels[depth])
            bound = np.minimum(corner, vector).sum(axis=1)
            ok = (high >= least) & (low <= most) & self._reaches(bound, size, np.maximum(low, least))
            width = FAN if depth else LEAF
            below = len(self.levels[depth - 1][0]) if depth else len(self.order)
            nodes = (nodes[ok][:, None] * width + np.arange(width)).ravel()
            nodes = nodes[nodes < below]
        found = self.order[nodes]
        return found[self._reaches(np.minimum(self.vectors[found], vector).sum(axis=1), size, self.sizes[found])]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class Forest:
    """Union-find with the smallest member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def linked(sets: list[np.ndarray], known: list[object], probe: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links (index pairs) that join all sets which a chain of links joins; sets of equal ``known`` count as joined.

    Only pairs with a ``probe`` on one side are looked at.  A pair that is joined
    already isn't verified again, so near copies of one text cost a verification
    each, not one per pair.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    forest, first = Forest(len(sets)), {}
    for i, k in enumerate(known):
        if k in first:
            forest.join(first[k], i)
        first.setdefault(k, i)
    vectors = points(sets, groups_for(sizes))
    tree = CountTree(vectors, sizes, num, den)
    out = []
    for i in np.flatnonzero(probe & (sizes > 0)).tolist():
        for j in tree.candidates(vectors[i], int(sizes[i])).tolist():
            if i == j or (probe[j] and j < i) or forest.root(i) == forest.root(j):
                continue
            if (num + den) * overlap(sets[i], sets[j]) >= num * int(sizes[i] + sizes[j]):
                forest.join(i, j)
                out.append((i, j))
    return out
