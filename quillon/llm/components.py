"""Connected components of a distributed edge list by smallest labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, discard

#: Edges that a task contracts at a time.
EDGES = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a run of edges by edges from each of their nodes to the smallest node that the run joins it with."""
    up: dict[int, int] = {}
    seen = 0

    def root(i: int) -> int:
        top = i
        while (n := up.setdefault(top, top)) != top:
            top = n
        while up[i] != top:
            up[i], i = top, up[i]
        return top

    def stars() -> pa.RecordBatch:
        pairs = [(r, n) for n in list(up) if (r := root(n)) != n]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen >= EDGES:
            yield stars()
            up.clear()
            seen = 0
    yield stars()


def few(df: DataFrame) -> DataFrame:
    """In a few partitions per core, without a shuffle: edges and labels are small rows."""
    return df.coalesce(3 * df.sparkSession.sparkContext.defaultParallelism)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node that its chain of edges reaches.

    Tasks first contract the edges that they happen to hold.  Each round takes the smallest label among neighbours, then the label's own
    label, which halves the way to the root; rounds end when nothing changes.
    Sums and minima are combined before they are shuffled, so a hub costs no more
    than its edges.
    """
    edges = cut(few(edges.select("a", "b")).mapInArrow(_contract, "a long, b long"))
    both = cut(few(edges.union(edges.select("b", "a")).toDF("u", "v").distinct()))
    labels = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"))
    labels = cut(few(labels))
    discard(edges)
    last = labels
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("m"))
        lowest = near.join(labels, near["u"] == labels["node"]).select("node", F.least("label", "m").alias("low"), F.col("label").alias("was"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("top"))
        moved = cut(few(lowest.join(up, "low").select("node", F.least("low", "top").alias("label"), "was")))
        discard(last)
        last, labels = moved, moved.select("node", "label")
        if moved.where("label <> was").isEmpty():
            discard(both)
            return labels
