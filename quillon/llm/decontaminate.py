"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's windows are its runs of ``window`` words (a shorter item is one
window).  A window must occur whole, so its containment threshold is 1 and the
prefix that a join needs is a single shingle.  Shingles are ordered by rarity:
one pass over the documents counts, in a table of ``SLOTS`` counters, those that
the benchmark's shingles fall into, and each window enters the join by its rarest
shingle.  A match at a document position fixes where the window would begin;
that must leave room for the words before and after it (positional and length
bound), and the words are then compared one by one.  A second pass over the
documents makes the join; their number of passes doesn't grow with the benchmark.

A benchmark of at most ``slice_bytes`` of text is sent to every worker as an
index of flat arrays, and nothing but the counters is shuffled.  A larger one
stays distributed: documents send the words around each shingle that a filter of
fixed size lets through to the windows that join by it.

Defined results: a null text, or one without words, has no words and no hits;
items without words have no windows; items of one item_id count once, a null one
as ``None``; repeated documents each have a row; texts of any length are taken
whole; an empty benchmark hits nothing; other columns, whatever their names, are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ROWS, cut, fresh, keyed_text
from .wordhash import ALNUM, Words, mix, slices, whole

WINDOW = 10
SHINGLE = 5
SLICE_BYTES = 8 << 20
#: Counters of rarity, a power of two.
SLOTS = 1 << 20
#: Bits of the filter of a large benchmark's shingles, a power of two.
FILTER_BITS = 1 << 27
_U = np.uint64


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> _U(64 - (SLOTS.bit_length() - 1))).astype(np.int64)


class Windows:
    """The distinct windows of a run of items: where each begins in the run, its words, and the items that have it."""

    def __init__(self, run: Words, window: int, shingle: int):
        self.run, self.shingle = run, shingle
        lengths = np.diff(run.first)
        item = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(run.hashes))
        size = np.minimum(lengths, window)[item] if len(at) else at
        ok = at + size <= run.first[1:][item] if len(at) else np.zeros(0, bool)
        at, item, size = at[ok], item[ok], size[ok]
        # hashes of runs of other lengths are seeded differently
        hashes = np.zeros(len(at), _U)
        for m in np.unique(size):
            mine = size == m
            hashes[mine] = run.shingles(int(m))[at[mine]]
        _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        self.begin, self.size = at[first].astype(np.int32), size[first].astype(np.int32)
        pairs = np.sort(number * max(1, len(lengths)) + item)
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        self.owners = (pairs % max(1, len(lengths))).astype(np.int32)
        self.owner_from = np.searchsorted(pairs // max(1, len(lengths)), np.arange(len(first) + 1))

    def grams(self) -> np.ndarray:
        """Every shingle of every window."""
        out = [np.zeros(0, _U)]
        for k in np.unique(np.minimum(self.size, self.shingle)):
            mine = np.minimum(self.size, self.shingle) == k
            grams = self.run.shingles(int(k))
            most = int((self.size[mine] - k).max(initial=0))
            for o in range(most + 1):
                fits = mine & (self.size - k >= o)
                out.append(grams[self.begin[fits] + o])
        return np.unique(np.concatenate(out))

    def rarest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingle, its length, its offset) by which each window joins: the one counted least, of those the smallest hash."""
        least = np.minimum(self.size, self.shingle)
        gram, offset = np.zeros(len(self.size), _U), np.zeros(len(self.size), np.int64)
        for k in np.unique(least):
            grams = self.run.shingles(int(k))
            mine = np.flatnonzero(least == k)
            best = grams[self.begin[mine]]
            cost, where = counts[_slot(best)], np.zeros(len(mine), np.int64)
            for o in range(1, int((self.size[mine] - k).max(initial=0)) + 1):
                fits = np.flatnonzero(self.size[mine] - k >= o)
                g = grams[self.begin[mine[fits]] + o]
                c = counts[_slot(g)]
                better = (c < cost[fits]) | (c == cost[fits]) & (g < best[fits])
                fits, g, c = fits[better], g[better], c[better]
                best[fits], cost[fits], where[fits] = g, c, o
            gram[mine], offset[mine] = best, where
        return gram, least, offset


def _positions(run: Words, k: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, shingles of k words there) of one text each that fall into a marked slot."""
    grams = run.shingles(k)[: max(0, len(run.hashes) - k + 1)]
    at = np.flatnonzero(bits[_slot(grams)])
    text = np.searchsorted(run.first, at, "right")
    at = at[at + k <= run.first[text]]
    return at, grams[at]


class Index:
    """The windows of a bounded benchmark in flat arrays, by the shingle through which each joins."""

    def __init__(self, ids: list[str], texts: list[str], window: int, shingle: int, counts: np.ndarray):
        self.ids = ids
        self.windows = w = Windows(whole(pa.array(texts, pa.string()), ALNUM), window, shingle)
        gram, k, offset = w.rarest(counts)
        self.join = {}
        for length in np.unique(k):
            mine = np.flatnonzero(k == length)
            mine = mine[np.argsort(gram[mine], kind="stable")]
            bits = np.zeros(SLOTS, bool)
            bits[_slot(gram[mine])] = True
            self.join[int(length)] = (gram[mine], mine, offset[mine], bits)

    def hits(self, run: Words) -> list[tuple[int, int, int]]:
        """(text, first word in the run, window) of every occurrence."""
        out = []
        for k, (order, number, offset, bits) in self.join.items():
            at, grams = _positions(run, k, bits)
            low, high = np.searchsorted(order, grams, "left"), np.searchsorted(order, grams, "right")
            n = high - low
            if not n.sum():
                continue
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            begin, window = np.repeat(at, n) - offset[entry], number[entry]
            text = np.repeat(np.searchsorted(run.first, at, "right") - 1, n)
            size = self.windows.size[window]
            ok = (begin >= run.first[text]) & (begin + size <= run.first[text + 1])
            begin, window, text, size = begin[ok], window[ok], text[ok], size[ok]
            own = self.windows.run
            for j in range(int(size.max(initial=0))):
                more = j < size
                same = ~more | (run.hashes[np.where(more, begin + j, 0)] == own.hashes[np.where(more, self.windows.begin[window] + j, 0)])
                begin, window, text, size = begin[same], window[same], text[same], size[same]
            out += [(t, b, w) for t, b, w, s in zip(text.tolist(), begin.tolist(), window.tolist(), size.tolist()) if self._same(run, b, int(self.windows.begin[w]), s)]
        return out

    def _same(self, run: Words, a: int, b: int, n: int) -> bool:
        own = self.windows.run
        return all(np.array_equal(run.data[run.lo[a + j] : run.hi[a + j]], own.data[own.lo[b + j] : own.hi[b + j]]) for j in range(n))

    def items(self, window: int) -> set[str]:
        w = self.windows
        return {self.ids[i] for i in w.owners[w.owner_from[window] : w.owner_from[window + 1]].tolist()}


class _Shared:
    """A broadcast that is told apart by its number, so that a worker builds an index once."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return self.broadcast, self.id

    def __setstate__(self, state):
        self.broadcast, self.id = state

    def __hash__(self):
        return hash(self.id)

    def __eq__(self, other):
        return self.id == other.id


@lru_cache(maxsize=1)
def _built(shared: _Shared) -> Index:
    return Index(*shared.broadcast.value)


def _items(benchmark: DataFrame, item_key: str, text: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(f"`{item_key}`").cast("string"), F.lit("None")).alias("item"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")


def rarity(texts: DataFrame, items: DataFrame, window: int, shingle: int) -> np.ndarray:
    """Occurrences over all documents of the shingles in each slot that a shingle of the benchmark falls into."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, run in slices(batch.column(1), ALNUM):
                w = Windows(run, window, shingle)
                least = np.unique(np.minimum(w.size, shingle))
                found = np.unique(_slot(w.grams()))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([found, -least])).cast(pa.int32())], names=["slot"])

    found = items.mapInArrow(slots, "slot int").distinct().toArrow().column(0).to_numpy()
    lengths, bits = sorted(-found[found < 0]), np.zeros(SLOTS, bool)
    bits[found[found >= 0]] = True
    counts = np.zeros(SLOTS, np.int64)
    if not lengths:
        return counts
    marked = texts.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sums = np.unpackbits(marked.value).astype(bool), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, run in slices(batch.column(0), ALNUM):
                for k in lengths:
                    np.add.at(sums, _slot(_positions(run, int(k), bits)[1]), 1)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["slot", "n"])

    sums = texts.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts[sums.column("slot").to_numpy()] = sums.column("n").to_numpy()
    return counts


def _small(benchmark: DataFrame, slice_bytes: int) -> bool:
    return benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] <= slice_bytes


def _shared(slim: DataFrame, items: DataFrame, window: int, shingle: int) -> _Shared:
    rows = items.collect()  # at most slice_bytes of text
    return _Shared(slim.sparkSession.sparkContext.broadcast(([r.item for r in rows], [r.text for r in rows], window, shingle, rarity(slim, items, window, shingle))))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            yield whole.slice(at, ROWS)


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Per document: key, n_words, hits (array<int>, the sorted positions of hit words), items (array<string>, sorted item ids)."""
    slim = keyed_text(docs, key, text).toDF("key", "text")
    items = _items(benchmark, item_key, "text")
    if not _small(items, slice_bytes):
        return _joined(slim, items, window, shingle).withColumnRenamed("key", key)
    shared = _shared(slim, items, window, shingle)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _built(shared)
        for batch in _batches(batches):
            n_words = np.zeros(batch.num_rows, np.int64)
            hits: list[set[int]] = [set() for _ in range(batch.num_rows)]
            owners: list[set[str]] = [set() for _ in range(batch.num_rows)]
            for start, run in slices(batch.column(1), ALNUM):
                n_words[start : start + len(run.first) - 1] = np.diff(run.first)
                for t, begin, w in index.hits(run):
                    hits[start + t].update(range(begin - int(run.first[t]), begin - int(run.first[t]) + int(index.windows.size[w])))
                    owners[start + t] |= index.items(w)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array([sorted(h) for h in hits], pa.list_(pa.int32())), pa.array([sorted(o) for o in owners], pa.list_(pa.string()))], names=["key", "n_words", "hits", "items"])

    return slim.mapInArrow(scan, f"key {slim.schema[0].dataType.simpleString()}, n_words long, hits array<int>, items array<string>").withColumnRenamed("key", key)


def _words(run: Words, a: int, b: int) -> bytes:
    return b" ".join(run.data[run.lo[j] : run.hi[j]].tobytes() for j in range(a, b))


def _entries(items: DataFrame, counts, window: int, shingle: int) -> DataFrame:
    """(gram, k, skip, words, item): the windows of each item by their rarest shingle, of k words after the first ``skip``."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, run in slices(batch.column(1), ALNUM):
                w = Windows(run, window, shingle)
                gram, k, offset = w.rarest(counts.value)
                n = np.diff(w.owner_from)
                of = np.repeat(np.arange(len(n)), n)
                words = [_words(run, b, b + s) for b, s in zip(w.begin.tolist(), w.size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[of].view(np.int64)), pa.array(k[of].astype(np.int32)), pa.array(offset[of].astype(np.int32)), pa.array([words[i] for i in of.tolist()], pa.binary()), pa.array([ids[start + i] for i in w.owners.tolist()], pa.string())],
                    names=["gram", "k", "skip", "words", "item"],
                )

    return items.mapInArrow(run_, "gram long, k int, skip int, words binary, item string").distinct()


def _bit(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a shingle in the filter."""
    most = _U(FILTER_BITS - 1)
    return (mix(grams) & most).astype(np.int64), (mix(grams ^ _U(0x9E3779B97F4A7C15)) & most).astype(np.int64)


def _filter(entries: DataFrame) -> np.ndarray:
    """A filter of fixed size of the shingles, put together from one per task."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for place in _bit(batch.column(0).to_numpy().view(_U)):
                bits[place] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in entries.select("gram").coalesce(16).mapInArrow(mark, "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return out


def _joined(slim: DataFrame, items: DataFrame, window: int, shingle: int) -> DataFrame:
    """``find`` for a benchmark of any size, by a shuffle join."""
    context = slim.sparkSession.sparkContext
    counts = context.broadcast(rarity(slim, items, window, shingle))
    entries = cut(_entries(items, counts, window, shingle))
    lengths = sorted(r.k for r in entries.select("k").distinct().collect())
    marked = context.broadcast(_filter(entries))
    kind = slim.schema[0].dataType.simpleString()

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document (gram null), and one per shingle that may be an entry's, with the words around it."""
        bits = marked.value
        for batch in _batches(batches):
            rows = batch.column(0).to_numpy()
            n_words = np.zeros(batch.num_rows, np.int64)
            out: list[tuple] = []
            for start, run in slices(batch.column(2), ALNUM):
                n_words[start : start + len(run.first) - 1] = np.diff(run.first)
                for k in lengths:
                    grams = run.shingles(k)[: max(0, len(run.hashes) - k + 1)]
                    a, b = _bit(grams)
                    at = np.flatnonzero((bits[a >> 3] >> (7 - (a & 7))) & (bits[b >> 3] >> (7 - (b & 7))) & 1)
                    text = np.searchsorted(run.first, at, "right")
                    ok = at + k <= run.first[text]
                    for p, t in zip(at[ok].tolist(), (text[ok] - 1).tolist()):
                        first, low, high = int(run.first[t]), max(int(run.first[t]), p - window + 1), min(int(run.first[t + 1]), p + window)
                        out.append((int(rows[start + t]), int(grams[p].view(np.int64)), k, low - first, p - low, _words(run, low, high)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words), *[pa.nulls(batch.num_rows, x) for x in kinds]], names=names)
            columns = list(zip(*out)) or [()] * 6
            row, gram, k, low, lead, words = columns
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.nulls(len(row), batch.schema.field(1).type), pa.nulls(len(row), pa.int64()), *[pa.array(v, x) for v, x in zip((gram, k, low, lead, words), kinds)]], names=names)

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    names = ["row", "key", "n_words", "gram", "k", "low", "lead", "around"]
    offered = cut(slim.select(F.monotonically_increasing_id().alias("row"), "key", "text").mapInArrow(offer, f"row long, key {kind}, n_words long, gram long, k int, low int, lead int, around binary"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, low, lead, around, skip, words, item = (c.to_pylist() for c in batch.columns)
            out = []
            for i, own in enumerate(words):
                own, there, at = own.split(b" "), around[i].split(b" "), lead[i] - skip[i]
                if at >= 0 and there[at : at + len(own)] == own:
                    out.append((row[i], low[i] + at, len(own), item[i]))
            r, b, n, o = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(b, pa.int32()), pa.array(n, pa.int32()), pa.array(o, pa.string())], names=["row", "begin", "n", "item"])

    met = offered.where("gram is not null").join(entries, ["gram", "k"]).select("row", "low", "lead", "around", "skip", "words", "item")
    found = met.mapInArrow(verify, "row long, begin int, n int, item string").groupBy("row").agg(F.collect_set(F.struct("begin", "n")).alias("at"), F.array_sort(F.collect_set("item")).alias("items"))
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["begin"], x["begin"] + x["n"] - 1)))))
    nothing = lambda kind: F.array().cast(f"array<{kind}>")
    out = offered.where("gram is null").select("row", "key", "n_words").join(found.select("row", places.alias("hits"), "items"), "row", "left")
    return out.select("key", "n_words", F.coalesce("hits", nothing("int")).alias("hits"), F.coalesce("items", nothing("string")).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find(docs, benchmark, **options)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs``, whole, that hold no window of any item."""
    items = _items(benchmark, item_key, "text")
    if not _small(items, slice_bytes):
        row = fresh("_row", docs.columns)
        numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
        dirty = find(numbered, benchmark, row, text, item_key, window, shingle, slice_bytes).where(F.size("hits") > 0).select(row)
        return numbered.join(dirty, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    shared = _shared(docs.select(F.col(f"`{text}`").cast("string").alias("text")), items, window, shingle)
    at = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _built(shared)
        for batch in _batches(batches):
            keep = np.ones(batch.num_rows, bool)
            for start, run in slices(batch.column(at).cast(pa.string()), ALNUM):
                for t, _, _ in index.hits(run):
                    keep[start + t] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)


#: DuckDB's view of ``report`` with windows of ten words.
REPORT_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), cut AS (
  SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, m, array_to_string(w[p : p + m - 1], ' ') AS body FROM cut
), sizes AS (SELECT DISTINCT m FROM windows),
places AS (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, sizes WHERE len(w) >= m
), met AS (
  SELECT x.doc_id, x.p, x.m, v.item FROM places AS x JOIN windows AS v ON v.m = x.m AND v.body = array_to_string(x.w[x.p : x.p + x.m - 1], ' ')
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM met) AS y GROUP BY doc_id
), owners AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM met) AS z GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered AS c ON c.doc_id = d.doc_id LEFT JOIN owners AS o ON o.doc_id = d.doc_id
"""
