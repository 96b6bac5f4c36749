"""N-gram Jaccard join: count vectors of shingle sets in a distributed index and R-trees.

1.  One pass over the texts gives each document's shingle count, a 128-bit digest
    of its set, its point (how many shingles fall into each group) and its keys in
    the index.  Equal sets become one class, kept by its smallest document, so
    exact copies never meet each other again.
2.  Classes that share a key, a block of the count vectors in which linked sets
    must agree, meet as points, and pairs whose summed coordinate minima reach the
    similarity become edges (``routing``; below a similarity of 0.87 keys are
    minimum hashes).
3.  Chains of edges make clusters, and each cluster is joined in chunks of at
    most ``CHUNK`` classes: R-tree candidates by summed coordinate minima, then
    exact verification of every surviving pair that isn't joined already.
4.  A cluster of more than one chunk goes on: the smallest classes of its parts
    are joined with each other in further rounds, and at last every class outside
    the cluster's largest part is held against all of the cluster, in bounded
    blocks.  No pair is dropped, and no task gets more than two chunks.

Result: one row per document with its set's size and component, the smallest
doc_id that links reach.  Defined results: a null or wordless text has an empty
set, 0 shingles and itself as component; a text of fewer than ``k`` words has
its whole word sequence as one shingle; repeated rows link as copies; an empty
table gives an empty table; other columns are not looked at.  Keys are whole
numbers, any other type raises TypeError; a null key has a null component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ROWS, cut, discard, keyed_text
from .components import components, few
from .counttree import linked
from .routing import edges, packed, router
from .wordhash import SPACED, sets, slices

CHUNK = 128
ROUNDS = 3
SALTS = 64
#: A class of more than this part of the rows is large; there are fewer such classes than this.
LARGE = 2000
def _summarise(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = router(num, den)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n, d1, d2, spots, keys = [], [], [], [], []
                for _, words in slices(batch.column(1), SPACED):
                    grams = words.shingles(k)
                    for row in range(len(words.first) - 1):
                        tokens = sets(words, row, grams, k)
                        digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                        n.append(len(tokens))
                        d1.append(int.from_bytes(digest[:8], "little", signed=True))
                        d2.append(int.from_bytes(digest[8:], "little", signed=True))
                        spots.append(packed(tokens) if len(tokens) else None)
                        keys.append(keyed.keys(tokens).view(np.int64) if len(tokens) else np.zeros(0, np.int64))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in keys])]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(spots, pa.binary()), flat], names=["id", "n", "d1", "d2", "point", "keys"])

    return run


def _verify(k: int, num: int, den: int):
    """Links in one chunk: rows (id, d1, known, probe, text)."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, d1, known, probe = (group.column(c).to_pylist() for c in ("id", "d1", "known", "probe"))
        tokens: list[np.ndarray] = []
        for _, words in slices(group.column("text"), SPACED):
            grams = words.shingles(k)
            tokens += [sets(words, row, grams, k) for row in range(len(words.first) - 1)]
        # of repeated ids, the row whose text the id's class is of
        keep, seen = [], set()
        for i, s in enumerate(tokens):
            mine = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=16).digest()[:8], "little", signed=True)
            if mine == d1[i] and (ids[i], probe[i]) not in seen:
                seen.add((ids[i], probe[i]))
                keep.append(i)
        keep.sort(key=lambda i: (ids[i], probe[i]))
        links = linked([tokens[i] for i in keep], [known[i] for i in keep], np.array([probe[i] for i in keep], bool), num, den)
        pairs = sorted({(min(ids[keep[i]], ids[keep[j]]), max(ids[keep[i]], ids[keep[j]])) for i, j in links if ids[keep[i]] != ids[keep[j]]})
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def _chunks(rows) -> F.Column:
    return F.ceil(rows / F.lit(CHUNK)).cast("int")


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) per document; pairs link when den * |A & B| >= num * |A | B|."""
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} is no whole number")
    slim = keyed_text(docs, key, text).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    all_docs = cut(slim.mapInArrow(_summarise(k, num, den), "id long, n long, d1 long, d2 long, point binary, keys array<long>"))
    classes = cut(all_docs.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("point").alias("point"), F.first("keys").alias("keys")))
    coarse = components(edges(classes, num, den))
    sizes = coarse.groupBy("label").agg(F.count("*").alias("size"))
    clusters = coarse.join(sizes, "label").join(classes.select(F.col("id").alias("node"), "d1"), "node")
    members = cut(slim.join(clusters.withColumnRenamed("node", "id"), "id").select("label", "size", "id", "d1", "text"))
    verify = _verify(k, num, den)

    def links(chunked: DataFrame) -> DataFrame:
        """Of rows (label, at, id, d1, known, probe, text), grouped by label and the chunk ``at``."""
        return chunked.groupBy("label", "at").applyInArrow(verify, "a long, b long")

    chunk = F.pmod(F.xxhash64("id"), _chunks(F.col("size"))).cast("string")
    found = cut(links(members.select("label", chunk.alias("at"), "id", "d1", F.col("id").alias("known"), F.lit(True).alias("probe"), "text")))
    large = members.where(F.col("size") > CHUNK)
    if not large.isEmpty():
        found = _across(large, found, links)
    labels = components(found).withColumnRenamed("node", "id")
    discard(found, members, classes)
    out = _labelled(all_docs, labels)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"))


def _labelled(all_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with their class's component.

    Classes of more than a ``LARGE``-th of the rows, fewer than ``LARGE``, are
    broadcast; the others are joined by digest, and none of them is large.
    """
    reps = all_docs.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("id"), F.count("*").alias("c"))
    parts = cut(few(reps.join(labels, "id", "left").select("d1", "d2", "c", F.coalesce("label", "id").alias("component"))))
    least = all_docs.count() // LARGE
    large = F.broadcast(parts.where(F.col("c") > least).drop("c")) if least else None
    slim = all_docs.select("id", "n", "d1", "d2")
    if large is None:
        return slim.join(parts.drop("c"), ["d1", "d2"], "left")
    rest = slim.join(large.select("d1", "d2"), ["d1", "d2"], "left_anti").join(parts.where(F.col("c") <= least).drop("c"), ["d1", "d2"], "left")
    return slim.join(large, ["d1", "d2"]).unionByName(rest)


def _across(large: DataFrame, found: DataFrame, links) -> DataFrame:
    """Links between the chunks of clusters that have more than one."""

    def parts(found: DataFrame) -> DataFrame:
        labels = components(found).withColumnRenamed("label", "part").withColumnRenamed("node", "id")
        return large.join(labels, "id", "left").withColumn("part", F.coalesce("part", "id"))

    # rounds on the smallest class of each part merge what chunks have in common
    before, whole = None, False
    for turn in range(ROUNDS):
        state = parts(found)
        heads = state.where("part = id")
        per = heads.groupBy("label").agg(F.count("*").alias("heads"))
        left, most = per.agg(F.sum(F.col("heads") - 1), F.max("heads")).first()
        if not left or left == before or whole:
            break
        before, whole = left, most <= CHUNK  # one chunk holds all heads of a cluster: another round would find nothing more
        at = F.pmod(F.xxhash64("id", F.lit(turn)), _chunks(F.col("heads"))).cast("string")
        more = links(heads.join(per.where("heads > 1"), "label").select("label", at.alias("at"), "id", "d1", F.col("id").alias("known"), F.lit(True).alias("probe"), "text"))
        found = cut(few(found.union(more)))
    # then whatever lies outside a cluster's largest part meets all of the cluster
    state = cut(parts(found))
    by_part = state.groupBy("label", "part").agg(F.count("*").alias("c"))
    main = by_part.groupBy("label").agg(F.max(F.struct("c", "part"))["part"].alias("main"), F.sum("c").alias("all"), F.max("c").alias("c")).withColumn("rest", F.col("all") - F.col("c")).where("rest > 0").select("label", "main", "all", "rest")
    # few labels may have most of the rows, so the small side is repeated over salts
    salts = main.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    state = state.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(99)), F.lit(SALTS)).cast("int")).join(salts, ["label", "salt"]).drop("salt")
    k_all, k_rest = _chunks(F.col("all")), _chunks(F.col("rest"))
    spread = F.sequence(F.lit(0), F.col("k") - 1)
    row = ["label", "id", "d1", F.col("part").alias("known"), "text"]
    targets = state.withColumn("k", k_rest).withColumn("other", F.explode(spread)).select(*row, F.lit(False).alias("probe"), F.concat_ws("-", F.pmod(F.xxhash64("id"), k_all), "other").alias("at"))
    probes = state.where("part <> main").withColumn("k", k_all).withColumn("other", F.explode(spread)).select(*row, F.lit(True).alias("probe"), F.concat_ws("-", "other", F.pmod(F.xxhash64("id"), k_rest)).alias("at"))
    return cut(found.union(links(targets.unionByName(probes))))


def keep_first(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that are their component's smallest document; of repeated rows of that one, all are kept."""
    groups = join(docs, k, num, den, key, text)
    gone = groups.where(F.col("component_id") < F.col(key)).select(F.col(key).alias("_gone")).distinct()
    return docs.join(gone, docs[f"`{key}`"] == gone["_gone"], "left_anti")


#: DuckDB's view of ``join`` with three words and a similarity of 0.9.
JOIN_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS p FROM d WHERE len(w) > 0) AS x
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), classes AS (
  SELECT min(doc_id) AS doc_id, n, digest FROM (SELECT g.doc_id, any_value(n) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS digest FROM grams AS g JOIN sizes AS s ON s.doc_id = g.doc_id GROUP BY g.doc_id) AS y GROUP BY n, digest
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams AS a JOIN grams AS b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE a.doc_id IN (SELECT doc_id FROM classes) AND b.doc_id IN (SELECT doc_id FROM classes) GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE 100 * shared.n >= 90 * (x.n + y.n - shared.n)
), ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, l.b FROM reach AS r JOIN ways AS l ON l.a = r.b),
lowest AS (SELECT c.digest, c.n, least(c.doc_id, coalesce(min(r.b), c.doc_id)) AS component FROM classes AS c LEFT JOIN reach AS r ON r.a = c.doc_id GROUP BY c.digest, c.n, c.doc_id),
own AS (SELECT g.doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS digest, count(*) AS n FROM grams AS g GROUP BY g.doc_id)
SELECT d.doc_id, CAST(coalesce(own.n, 0) AS BIGINT) AS n_shingles, coalesce(lowest.component, d.doc_id) AS component_id
FROM d LEFT JOIN own ON own.doc_id = d.doc_id LEFT JOIN lowest ON lowest.digest = own.digest AND lowest.n = own.n
"""
