"""The communication matrix: its law, at any size, and rows that change between passes."""

import numpy as np
import pytest

pytest.importorskip("quillon.llm")

from quillon.llm import sharding  # noqa: E402


def test_law_of_large_draws():
    """The sampler for large populations has the mean, the spread and the frequencies of the library's."""
    rng = np.random.default_rng(3)
    for good, bad, n in ((5, 3, 4), (900, 100, 500), (40, 10_000, 700), (10**5, 10**5, 10**5)):
        ours = np.array([sharding._large(rng, good, bad, n) for _ in range(4000)])
        theirs = rng.hypergeometric(good, bad, n, 4000)
        assert abs(ours.mean() - theirs.mean()) < 6 * theirs.std() / np.sqrt(2000) + 1e-9
        assert 0.9 < ours.std() / theirs.std() < 1.1
        assert all(abs((ours <= q).mean() - (theirs <= q).mean()) < 0.06 for q in np.quantile(theirs, [0.1, 0.5, 0.9]))
    assert sharding._large(rng, 10, 0, 4) == 4 and sharding._large(rng, 0, 10, 4) == 0 and sharding._large(rng, 7, 5, 12) == 7


def test_matrix_of_a_hundred_thousand_million_rows():
    ends = np.cumsum([0, *[12_500_000_000] * 8])
    per, capacity = sharding.plan(int(ends[-1]), 40)
    rows = [sharding.matrix_row(ends, p, capacity, 5) for p in range(8)]
    assert (np.sum(rows, axis=0) == capacity).all() and all(r.sum() == 12_500_000_000 for r in rows)
    share = rows[3] / capacity
    assert abs(share.mean() - 1 / 8) < 1e-9 and share.min() > 0.12 and share.max() < 0.13


def test_uniform(spark):
    """Over many seeds every row is as likely in every shard, and pairs are as likely together."""
    df = spark.range(12).repartition(3)
    rows = [sorted((r.id, r.shard, r.slot) for r in sharding.assign(df, 3, seed).collect()) for seed in range(30)]
    seen = np.array([[s for _, s, _ in run] for run in rows])
    assert (np.bincount(seen.ravel(), minlength=3) == 120).all()
    together = [(seen[:, i] == seen[:, j]).mean() for i in range(12) for j in range(i)]
    assert abs(np.mean(together) - 3 / 11) < 1e-9 and max(together) < 0.65
    assert len({tuple(map(tuple, run)) for run in rows}) == 30


def test_rows_that_change_between_passes(spark, monkeypatch):
    cumsum = np.cumsum
    for change, word in ((1, "fewer"), (-1, "more")):
        with monkeypatch.context() as patch:  # as if the first pass had counted a row more or less
            patch.setattr(sharding.np, "cumsum", lambda x, *a, change=change, **k: cumsum(np.asarray(x) + change if len(x) == 1 else x, *a, **k))
            out = sharding.assign(spark.range(10).coalesce(1), 2)
        with pytest.raises(Exception, match=word):
            out.collect()


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, i, "k", i, i, "t" * i) for i in range(9)], "doc_id long, _bucket long, _key string, shard long, slot long, text string")
    got = sharding.assign(df, 2)
    assert got.columns == [*df.columns, "shard_", "slot_"]
    assert sorted((r.doc_id, r["_bucket"], r.shard, r.slot) for r in got.collect()) == [(i, i, i, i) for i in range(9)]
    rows = sharding.report(df, shards=2).collect()
    assert sorted((r.doc_id, r.size) for r in rows) == [(i, i + 16) for i in range(9)]
    assert sorted((r.shard, r.slot) for r in rows) == [(0, i) for i in range(5)] + [(1, i) for i in range(4)]
