"""Keys and bounds lose no linked pair."""

import numpy as np
import pytest

pytest.importorskip("quillon.llm")

from quillon.llm import routing  # noqa: E402
from quillon.llm.counttree import overlap  # noqa: E402


@pytest.mark.parametrize(("num", "den"), [(90, 100), (87, 100), (95, 100)])
def test_blocks_lose_nothing(num, den):
    """Pairs of all sizes right at the similarity, whatever the differences are, share a key."""
    rng = np.random.default_rng(4)
    blocks = routing.Blocks(num, den)
    linked = 0
    for _ in range(3000):
        n = int(rng.integers(1, 400))
        base = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        gone = int(rng.integers(0, max(1, n // 8) + 1))
        more = int(rng.integers(0, max(1, n // 8) + 1))
        other = np.unique(np.concatenate([rng.permutation(base)[gone:], rng.integers(0, 1 << 63, more, np.uint64)]))
        both = overlap(base, other)
        if len(other) and not np.array_equal(base, other) and den * both >= num * (len(base) + len(other) - both):
            linked += 1
            assert np.intersect1d(blocks.keys(base), blocks.keys(other)).size, (len(base), len(other), both)
    assert linked > 200


def test_blocks_tell_others_apart():
    rng = np.random.default_rng(5)
    blocks = routing.Blocks(90, 100)
    keys = [blocks.keys(np.unique(rng.integers(0, 1 << 63, 200, np.uint64))) for _ in range(300)]
    flat = np.concatenate(keys)
    assert len(flat) - len(np.unique(flat)) < 0.02 * len(flat)
    assert all(len(k) < 0.25 * 200 + 4 for k in keys)


def test_points_beyond_their_range():
    """A count that a point can't hold stands for any number."""
    import pyarrow as pa

    tokens = np.arange(70_000, dtype=np.uint64)  # all in one group
    spot = routing._unpacked(pa.array([routing.packed(tokens)], pa.binary()))
    assert spot.max() > 70_000 and spot.shape == (1, routing.GROUPS)


@pytest.mark.parametrize(("hot", "most"), [(8, 2048), (1, 2), (2, 3)])
def test_edges_reach_every_linked_pair(spark, monkeypatch, hot, most):
    """Also where keys are hot in a batch or over all batches."""
    monkeypatch.setattr(routing, "HOT", hot)
    monkeypatch.setattr(routing, "MOST", most)
    rng = np.random.default_rng(6)
    base = [np.unique(rng.integers(0, 1 << 63, int(n), np.uint64)) for n in rng.integers(20, 200, 12)]
    sets = [np.unique(np.concatenate([rng.permutation(b)[int(rng.integers(0, 4)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 4)), np.uint64)])) for b in base for _ in range(10)]
    blocks = routing.Blocks(90, 100)
    rows = [(i, len(s), bytearray(routing.packed(s)), blocks.keys(s).view(np.int64).tolist()) for i, s in enumerate(sets)]
    classes = spark.createDataFrame(rows, "id long, n long, point binary, keys array<long>").repartition(3)
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for r in routing.edges(classes, 90, 100).collect():
        x, y = root(r.a), root(r.b)
        up[max(x, y)] = min(x, y)
    for i, a in enumerate(sets):
        for j in range(i):
            both = overlap(a, sets[j])
            if 100 * both >= 90 * (len(a) + len(sets[j]) - both):
                assert root(i) == root(j)
