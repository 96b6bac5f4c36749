"""Which classes of equal sets may be linked: blocks of count vectors, and bounds between points.

Tokens are hashed into groups, and a set's point holds how many fall into each.
The overlap of two sets is at most the sum over groups of the smaller count, so
linked sets differ by at most D over all groups, where D follows from their
sizes.  Groups are dealt to D + 1 blocks; in at least one of them the points of
linked sets agree.  A set's keys are its blocks' counts, hashed, in a directory
of its range of sizes and in the one below, whose sets it may be linked with:
nothing is lost.  Where blocks would hold too few tokens to tell sets apart (a
similarity below ``BLOCKS_FROM``), keys are banded minimum hashes instead, so many
that a pair at the similarity shares none with a probability under ``MISS``.

Sets that share a key meet as points in a tree, and those whose bound reaches the
similarity are an edge.  A key of very many sets makes them all one cluster
without that test; the exact join inside clusters takes it from there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut
from .counttree import CountTree, Forest, points
from .wordhash import mix

#: Similarity from which blocks hold six tokens or more on average.
BLOCKS_FROM = 0.87
#: Probability that minimum hashes miss a pair just at the similarity.
MISS = 1e-8
#: Groups of a point, and of a block.
GROUPS, BLOCK_GROUPS = 64, 256
#: Sets of one batch, and of all, that share a key, from which on it makes them one cluster.
HOT, MOST = 8, 2048
_U = np.uint64
_FAR = 65535


def bands(similarity: float) -> tuple[int, int]:
    """(rows of a band, bands): the longest rows whose bands stay within 160 hashes."""
    best = (1, 1)
    for rows in range(1, 9):
        hit = similarity**rows
        count = 1 if hit >= 1 else math.ceil(math.log(MISS) / math.log1p(-hit))
        if rows * count <= 160:
            best = (rows, count)
    return best


class Bands:
    def __init__(self, similarity: float):
        self.rows, self.count = bands(similarity)
        n = self.rows * self.count
        odd = mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
        self.factors = odd[:, None]
        self.salt = mix(np.arange(1, self.count + 1, dtype=_U) * _U(0xD1B54A32D192ED03))

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        low = np.full(self.rows * self.count, ~_U(0), _U)
        for at in range(0, len(tokens), 2048):
            np.minimum(low, (tokens[None, at : at + 2048] * self.factors).min(axis=1), out=low)
        low = low.reshape(self.count, self.rows)
        out = self.salt.copy()
        for j in range(self.rows):
            out = mix(out * _U(0xE7037ED1A0B428DB) + low[:, j])
        return out


class Blocks:
    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        #: smallest sizes of the directories, each den/num times the one before
        self.least = [1]
        self.weight = mix(np.arange(1, BLOCK_GROUPS + 1, dtype=_U) * _U(0xA0761D6478BD642F))

    def directories(self, size: int) -> list[tuple[int, int]]:
        """(directory, D) where sets of this size have keys; none where no different set can be linked."""
        while self.least[-1] <= size:
            self.least.append(max(self.least[-1] + 1, self.least[-1] * self.den // self.num))
        own = next(i for i in range(len(self.least) - 1, -1, -1) if self.least[i] <= size)
        out = []
        for i in (own, own - 1):
            # in directory i the smaller set of a pair has a size of it, the larger den/num times as many tokens at most
            if i < 0:
                continue
            while len(self.least) <= i + 1:
                self.least.append(max(self.least[-1] + 1, self.least[-1] * self.den // self.num))
            small = self.least[i + 1] - 1
            large = small * self.den // self.num
            apart = (small + large) * (self.den - self.num) // (self.den + self.num)
            if size <= large and apart:
                out.append((i, apart))
        return out

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        out = []
        for i, apart in self.directories(len(tokens)):
            h = mix(tokens + _U((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            block = ((h >> _U(32)) % _U(apart + 1)).astype(np.int64)
            sums = np.zeros(apart + 1, _U)
            np.add.at(sums, block, self.weight[(h & _U(BLOCK_GROUPS - 1)).astype(np.int64)])
            out.append(mix(sums + mix(np.arange(apart + 1, dtype=_U) + _U((i + 1) << 40))))
        return np.concatenate(out) if out else np.zeros(0, _U)


def router(num: int, den: int) -> Blocks | Bands:
    return Blocks(num, den) if num >= BLOCKS_FROM * den else Bands(num / den)


def packed(tokens: np.ndarray) -> bytes:
    """The set's point; a count of ``_FAR`` stands for any number."""
    return np.minimum(points([tokens], GROUPS)[0], _FAR).astype(np.uint16).tobytes()


def _unpacked(column: pa.Array) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, GROUPS).astype(np.int32)
    flat[flat == _FAR] = 1 << 24
    return flat


def _offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) rows; of a key that many sets of a batch share, the first, marked, and edges from it to the others."""
    for batch in batches:
        keys = batch.column(1).flatten().to_numpy()
        ids = np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy())
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(keys)))
        hot, first = np.repeat(size > HOT, size), np.zeros(len(keys), bool)
        first[start] = True
        keep = ~hot | first
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(ids[keep]), pa.nulls(int(keep.sum()), pa.int64()), pa.array(hot[keep])], names=["key", "a", "b", "hot"])
        hub = np.repeat(ids[start], size)
        yield from _edges(hub[~keep], ids[~keep], ["key", "a", "b", "hot"])


def _edges(a: np.ndarray, b: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    pairs = np.unique(np.stack([a, b]), axis=1)
    if pairs.shape[1]:
        key = mix(pairs[0].astype(np.int64).view(_U) + mix(pairs[1].astype(np.int64).view(_U))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(pairs[0]), pa.array(pairs[1]), pa.array(np.zeros(pairs.shape[1], bool))][: len(names)], names=names)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key.  Of keys that several sets share, the members (b null) or, of hot ones, edges; edges pass."""
    names = ["key", "a", "b"]
    key, a, hot = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def groups(key, a, hot) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        star = np.repeat(np.logical_or.reduceat(hot, start) | (size > MOST), size)
        hub = np.repeat(a[start], size)
        yield from _edges(hub[star & (hub != a)], a[star & (hub != a)], names)
        some = ~star & np.repeat(size > 1, size)
        yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(a[some]), pa.nulls(int(some.sum()), pa.int64())], names=names)

    for batch in batches:
        edge = batch.column(2).is_valid()
        passing = batch.filter(edge)
        if passing.num_rows:
            yield pa.RecordBatch.from_arrays(passing.columns[:3], names=names)
        rest = batch.filter(pa.compute.invert(edge))
        key, a, hot = np.concatenate([key, rest.column(0).to_numpy()]), np.concatenate([a, rest.column(1).to_numpy()]), np.concatenate([hot, rest.column(3).to_numpy(zero_copy_only=False)])
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1], "left"))
        yield from groups(key[:last], a[:last], hot[:last])
        key, a, hot = key[last:], a[last:], hot[last:]
        if len(key) > MOST:  # all that follows of this key hangs on its first set
            yield from _edges(np.full(len(a) - 1, a[0]), a[1:], names)
            key, a, hot = key[:1], a[:1], np.ones(1, bool)
    yield from groups(key, a, hot)


def _bound(num: int, den: int):
    """Edges between sets of one key whose bound reaches the similarity; rows (key, id, n, point) come sorted by key."""

    def within(ids: np.ndarray, n: np.ndarray, vectors: np.ndarray) -> list[tuple[int, int]]:
        tree, forest, out = CountTree(vectors, n, num, den), Forest(len(ids)), []
        for i in range(len(ids)):
            out += [(int(ids[i]), int(ids[j])) for j in tree.candidates(vectors[i], int(n[i])).tolist() if j > i and forest.join(i, j)]
        return out

    def groups(key, ids, n, vectors) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(key)))
        two = start[size == 2]
        ok = (num + den) * np.minimum(vectors[two], vectors[two + 1]).sum(axis=1, dtype=np.int64) >= num * (n[two] + n[two + 1])
        pairs = [(ids[two[ok]], ids[two[ok] + 1])]
        for s, k in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            found = within(ids[s : s + k], n[s : s + k], vectors[s : s + k])
            pairs.append((np.array([p for p, _ in found], np.int64), np.array([p for _, p in found], np.int64)))
        a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, GROUPS), np.int32))
        for batch in batches:
            if not batch.num_rows:
                continue
            new = (*(batch.column(i).to_numpy() for i in range(3)), _unpacked(batch.column(3)))
            held = tuple(np.concatenate([x, y]) for x, y in zip(held, new))
            last = int(np.searchsorted(held[0], held[0][-1], "left"))
            yield groups(*(x[:last] for x in held))
            held = tuple(x[last:] for x in held)
        yield groups(*held)

    return run


def edges(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) between classes (id, n, point, keys) that may be linked, so that a chain of edges joins any that are."""
    offered = classes.select("id", "keys").mapInArrow(_offer, "key long, a long, b long, hot boolean").repartition("key").sortWithinPartitions("key", "a")
    met = cut(offered.mapInArrow(_meet, "key long, a long, b long"))
    members = met.where("b is null").select("key", F.col("a").alias("id")).distinct().join(classes.select("id", "n", "point"), "id")
    near = members.select("key", "id", "n", "point").repartition("key").sortWithinPartitions("key", "id").mapInArrow(_bound(num, den), "a long, b long")
    return met.where("b is not null").select("a", "b").union(near)
