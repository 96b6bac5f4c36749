"""Uniform sharding by an exact hypergeometric communication matrix.

A uniform shuffle of all rows into buckets of given sizes sends a number of rows
from each input partition to each bucket that follows the multivariate
hypergeometric law.  The matrix of these counts is drawn by recursive halving of
the partitions: a node of the halving tree splits its bucket capacities between
its two sides, from a seed of its own, so a task draws just the path to its own
row of the matrix and all tasks agree without the matrix ever being in one
place.  A task then permutes its row of bucket numbers over its rows, rows are
exchanged once, and each bucket permutes what it received by random keys.

Shards hold equal numbers of rows, at most one apart (law ``rows``).  A shard
has as many buckets as its rows need, so no task has to hold a shard.

Any number of rows can be dealt: counts of populations too large for the
library's sampler are drawn by inverting the law around its mode.

Defined results: a null text has size 16 and checksum 0; repeated rows, equal
texts and texts of any length are dealt like any others; an empty table gives an
empty table; fewer rows than shards leave shards empty; other columns stay out of
``report`` and are passed on by ``assign``, whose own get underscores behind their
names where the input has such columns.  A partition that has more or fewer rows
when they are dealt than when they were counted raises an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut, fresh

SHARDS = 40
BUCKET_ROWS = 2048
MOST_BUCKETS = 50_000


def plan(total: int, shards: int) -> tuple[int, np.ndarray]:
    """(buckets of a shard, capacity of every bucket); bucket b belongs to shard b // buckets."""
    per = max(1, min(-(-total // (shards * BUCKET_ROWS)), max(1, MOST_BUCKETS // shards)))
    shard = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    inner = np.arange(per, dtype=np.int64)
    return per, (shard[:, None] // per + (inner[None, :] < shard[:, None] % per)).ravel()


#: Populations from which the library draws.
LIBRARY = 900_000_000


def _large(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric count of any size: of n drawn without return from good and bad, the good ones."""
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    total = good + bad
    spread = math.sqrt(max(1.0, n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))))
    first, last = max(low, mode - int(12 * spread) - 60), min(high, mode + int(12 * spread) + 60)
    # log of the ratio of each count's probability to that of the one before, from the mode both ways
    k = np.arange(first, last, dtype=np.float64)
    ratio = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    logs -= logs[mode - first]
    sums = np.cumsum(np.exp(logs))
    return first + int(np.searchsorted(sums, rng.random() * sums[-1], "right"))


def draw(rng: np.random.Generator, capacity: np.ndarray, n: int) -> np.ndarray:
    """How many of n drawn without return have each colour, by halving the colours: all halves of one size at a time."""
    width = 1 << max(0, len(capacity) - 1).bit_length()
    levels = [np.concatenate([capacity, np.zeros(width - len(capacity), np.int64)])]
    while len(levels[-1]) > 1:
        levels.append(levels[-1][0::2] + levels[-1][1::2])
    taken = np.array([n], np.int64)
    for below in levels[-2::-1]:
        good, bad = below[0::2], below[1::2]
        left = np.zeros(len(good), np.int64)
        small = good + bad <= LIBRARY
        left[small] = rng.hypergeometric(good[small], bad[small], taken[small])
        for i in np.flatnonzero(~small):
            left[i] = _large(rng, int(good[i]), int(bad[i]), int(taken[i]))
        taken = np.stack([left, taken - left], axis=1).ravel()
    return taken[: len(capacity)]


def matrix_row(ends: np.ndarray, partition: int, capacity: np.ndarray, seed: int) -> np.ndarray:
    """Rows of the partition that go to each bucket; ``ends`` are running sums of the partitions' rows, from 0."""
    low, high, left = 0, len(ends) - 1, capacity
    while high - low > 1:
        mid = (low + high) // 2
        first = draw(np.random.default_rng([seed, low, high]), left, int(ends[mid] - ends[low]))
        if partition < mid:
            high, left = mid, first
        else:
            low, left = mid, left - first
    return left


def _plain(df: DataFrame) -> bool:
    """Whether the plan only reads files, row by row, so that its partitions are the same each time."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().split(" ")[0] not in ("Project", "Filter", "Relation", "LogicalRelation"):
            return False
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return True


def assign(df: DataFrame, shards: int = SHARDS, seed: int = 20) -> DataFrame:
    """The rows with shard (int) and slot (long, gapless from 0 in each shard) added."""
    if not _plain(df):
        df = cut(df)
    tallies = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    parts = max((r.p for r in tallies), default=-1) + 1
    rows = np.zeros(parts, np.int64)
    for r in tallies:
        rows[r.p] = r["count"]
    ends = np.concatenate([[0], np.cumsum(rows)])
    total = int(ends[-1])
    per, capacity = plan(total, shards)
    shared = df.sparkSession.sparkContext.broadcast((ends, capacity))
    own = [T.StructField(fresh("_bucket", df.columns), T.IntegerType()), T.StructField(fresh("_key", df.columns), T.LongType())]
    schema = T.StructType([*df.schema.fields, *own])
    bucket, key = (F.col(f"`{f.name}`") for f in own)
    names = [f.name for f in schema]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, capacity = shared.value
        p, at, order, keys = TaskContext.get().partitionId(), 0, None, None
        rows = int(ends[p + 1] - ends[p]) if p < len(ends) - 1 else 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if order is None and rows:
                order = np.repeat(np.arange(len(capacity), dtype=np.int32), matrix_row(ends, p, capacity, seed))
                rng = np.random.default_rng([seed, 1, p])
                rng.shuffle(order)
                keys = rng.integers(-(1 << 63), (1 << 63) - 1, len(order), np.int64)
            if at + batch.num_rows > rows:
                raise RuntimeError("the input has more rows than in the first pass")
            part = slice(at, at + batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order[part]), pa.array(keys[part])], names=names)
            at += batch.num_rows
        if at < rows:
            raise RuntimeError("the input has fewer rows than in the first pass")

    dealt = df.mapInArrow(deal, schema)
    shard, inner = F.floor(bucket / per).cast("int"), bucket % per
    size = F.lit(total // shards) + (shard < total % shards).cast("long")
    begin = inner * F.floor(size / per) + F.least(inner.cast("long"), size % per)
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(key))
    return dealt.select(*[F.col(f"`{c}`") for c in df.columns], shard.alias(fresh("shard", df.columns)), (begin + rank - 1).cast("long").alias(fresh("slot", df.columns)))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    slim = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("text"))
    t = F.coalesce(F.col("text"), F.lit(""))
    slim = slim.toDF("key", "text")
    return assign(slim, shards).select(
        F.col("key").alias(key),
        (F.octet_length(t) + 16).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
