"""Language identification: nearest clustered centroid of TF-IDF n-gram vectors.

A text is lower-cased, everything but letters becomes a single space, and its
byte trigrams are counted in hashed buckets, weighted by TF-IDF and normalised.
Each language has several centroids, from spherical k-means over its training
vectors.  The prediction is the language of the centroid with the largest
cosine, which is the score; a text further from it than all but a small share of
that language's training texts is marked ``rejected``.

The model is fitted on about ``SAMPLE_ROWS`` labelled documents of at most
``SAMPLE_CHARS`` characters, drawn by a hash over the whole table from those not
held out (crc32 of doc_id modulo 4 is not 2): of each language its share, but
about ``LEAST_ROWS`` at least, or all where it has fewer.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if there is no labelled document; of centroids that are equally
near, that of the first language by name wins; texts of any length are predicted
from the whole text; repeated rows are predicted alike; an empty table gives an
empty table; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import per_batch

SAMPLE_ROWS = 4000
SAMPLE_CHARS = 20_000
LEAST_ROWS = 100
BUCKETS = 1 << 13
CENTROIDS = 6
ROUNDS = 8
REJECT_SHARE = 0.002
_LETTER = re.compile(r"[^\W\d_]")
_KEEP = np.zeros(256, bool)
_KEEP[97:123] = True
_KEEP[128:] = True


def counts(texts: list[str | None]) -> np.ndarray:
    """Trigram counts, a row per text."""
    raw = [b" " + (t or "").lower().encode("utf-8", "replace") + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    row = np.repeat(np.arange(len(raw)), sizes)
    letter = _KEEP[data]
    use = letter.copy()
    use[1:] |= letter[:-1]  # the first of each run of other bytes is the space
    use[np.cumsum(sizes) - sizes] = True  # every text begins with one
    code, row = np.where(letter[use], data[use], 32).astype(np.uint32), row[use]
    if len(code) < 3:
        return np.zeros((len(texts), BUCKETS), np.float32)
    gram = (code[:-2] << 16) | (code[1:-1] << 8) | code[2:]
    bucket = ((gram * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)
    ok = row[:-2] == row[2:]
    return np.bincount(row[:-2][ok] * BUCKETS + bucket[ok], minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    def __init__(self, texts: list[str], langs: list[str]):
        parts = [counts(texts[i : i + 256]) for i in range(0, len(texts), 256)]
        raw = np.concatenate(parts) if parts else np.zeros((0, BUCKETS), np.float32)
        df = (raw > 0).sum(axis=0)
        self.idf = np.log((1 + len(raw)) / (1 + df)).astype(np.float32) + 1
        vectors = self.weigh(raw)
        rows = defaultdict(list)
        for i, lang in enumerate(langs):
            rows[lang].append(i)
        self.langs, centroids, self.limit = [], [], {}
        for lang in sorted(rows):
            mine = vectors[rows[lang]]
            found = self._cluster(mine)
            near = (mine @ found.T).max(axis=1)
            self.limit[lang] = float(np.quantile(near, REJECT_SHARE))
            centroids.append(found)
            self.langs += [lang] * len(found)
        self.centroids = np.concatenate(centroids) if centroids else np.zeros((0, BUCKETS), np.float32)

    def weigh(self, raw: np.ndarray) -> np.ndarray:
        return _unit(np.sqrt(raw) * self.idf)

    @staticmethod
    def _cluster(x: np.ndarray) -> np.ndarray:
        k = min(CENTROIDS, len(x))
        seeds = [0]
        while len(seeds) < k:  # each further seed is the vector furthest from those so far
            seeds.append(int((x @ x[seeds].T).max(axis=1).argmin()))
        c = x[seeds]
        for _ in range(ROUNDS):
            mine = (x @ c.T).argmax(axis=1)
            c = _unit(np.stack([x[mine == j].mean(axis=0) if (mine == j).any() else c[j] for j in range(k)]))
        return c

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        # rounded, as the last digits depend on what else is in the batch
        near = np.round((self.weigh(counts(texts)) @ self.centroids.T).astype(float), 5)
        best = near.argmax(axis=1)
        lang, score, rejected = [], [], []
        for i, t in enumerate(texts):
            known = bool(t) and _LETTER.search(t) is not None
            lang.append(self.langs[best[i]] if known else "und")
            score.append(float(np.clip(near[i, best[i]], 0, 1)) if known else 0.0)
            rejected.append(not known or score[-1] < self.limit[lang[-1]])
        return lang, score, rejected


def _held_out(key: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    t, rate = F.col(f"`{text}`").cast("string"), 1 << 40
    usable = docs.where(~_held_out(key) & F.col(f"`{lang}`").isNotNull() & t.isNotNull() & (F.length(t) <= SAMPLE_CHARS)).select(
        t.alias("t"), F.col(f"`{lang}`").cast("string").alias("l"), F.xxhash64(F.col(f"`{key}`"), t, F.lit(7)).alias("h")
    )
    sizes = {r.l: r.n for r in usable.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return Model([], [])
    share = SAMPLE_ROWS / sum(sizes.values())
    below = [(k, rate if n <= LEAST_ROWS or share >= 1 else int(rate * min(1.0, max(share, LEAST_ROWS / n)))) for k, n in sizes.items()]
    below = docs.sparkSession.createDataFrame(below, "l string, below long")
    rows = usable.join(F.broadcast(below), "l").where(F.pmod("h", F.lit(rate)) < F.col("below")).groupBy("l", "h").agg(F.min("t").alias("t")).collect()
    rows.sort(key=lambda r: (r.l, r.h))
    rows = [r for r in rows if _LETTER.search(r.t)]
    return Model([r.t for r in rows], [r.l for r in rows])


def predict(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None) -> DataFrame:
    """Per document: key, held_out, lang_pred, score, rejected."""
    known = docs.sparkSession.sparkContext.broadcast(model or fit(docs, key, text, lang))
    slim = docs.select(F.col(f"`{key}`").alias(key), _held_out(key).alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, rejected = known.value.predict(batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[key, "held_out", "lang_pred", "score", "rejected"])

    return per_batch(slim, step, f"`{key}` {slim.schema[0].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean", rows=128)
