"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list of parts.  Each adjacent pair that the
vocabulary knows waits in the bucket of its merge rank; a two-level bitmap over
the ranks finds the first rank with a bucket, and the leftmost live pair in it
merges next.  Entries whose pair has changed since are skipped when popped.  A
merge costs a few bitmap operations whatever the pre-token's length, so a
pre-token of a megabyte takes near-linear time.

Defined results: a null text encodes as an empty one (no ids); an empty table
gives an empty table; repeated rows give repeated rows; other columns are not
carried.  Ids that the vocabulary does not hold make ``decode`` raise.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import keyed_text, per_batch

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens in each of the two generations of a worker's memory; what it has forgotten it merges again.
REMEMBERED = 300_000
#: Pre-tokens of at most so many bytes keep a bucket's positions in a bitmap.
SHORT = 256
_BITS = 8
_BIT = [1 << i for i in range(1024)]


class Encoder:
    """Merge ranks and the rank queue over them."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.longest = max(map(len, self.ranks))
        self.top_rank = max(self.ranks.values())
        pieces: list[bytes] = [b""] * (self.top_rank + 1)
        for token, rank in self.ranks.items():
            pieces[rank] = token
        self.pieces = pa.array(pieces, pa.large_binary())
        self.lengths = np.array([len(x) for x in pieces], np.int64)
        self.known = np.zeros(self.top_rank + 1, bool)
        self.known[list(self.ranks.values())] = True
        self.pair_ranks = [[self.ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]
        self.buckets = [0] * (self.top_rank + 1)
        self.words = [0] * ((self.top_rank >> _BITS) + 1)
        self.split = regex.compile(pattern).findall
        self.memo = _Memo(self)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        return self._merge_short(piece) if len(piece) <= SHORT else self._merge_long(piece)

    def _merge_short(self, piece: bytes) -> tuple[int, ...]:
        """A bucket is a bitmap of positions here, so the leftmost entry is a find-first-set too.

        Buckets and the bitmap's words are arrays of the encoder's own; both are
        all zero again when the queue has run empty.
        """
        rank_of, buckets, words, rows = self.ranks.get, self.buckets, self.words, self.pair_ranks
        n = len(piece)
        after = list(range(1, n + 2))
        before = list(range(-1, n + 1))
        live = [rows[a][b] for a, b in zip(piece, piece[1:])]
        live.append(-1)
        top = 0
        bit = 1
        for r in live:
            if r >= 0:
                if not buckets[r]:
                    w = r >> 8
                    words[w] |= _BIT[r & 255]
                    top |= _BIT[w]
                buckets[r] |= bit
            bit <<= 1
        while top:
            w = (top & -top).bit_length() - 1
            bits = words[w]
            r = (w << 8) + (bits & -bits).bit_length() - 1
            bucket = buckets[r]
            i = (bucket & -bucket).bit_length() - 1
            bucket &= bucket - 1
            buckets[r] = bucket
            if not bucket:
                bits &= bits - 1
                words[w] = bits
                if not bits:
                    top ^= _BIT[w]
            if live[i] != r:
                continue  # stale
            j = after[i]
            k = after[i] = after[j]
            live[j] = live[i] = -1
            before[k] = i
            if k < n:
                q = rank_of(piece[i : after[k]])
                if q is not None:
                    live[i] = q
                    if not buckets[q]:
                        w = q >> 8
                        words[w] |= _BIT[q & 255]
                        top |= _BIT[w]
                    buckets[q] |= 1 << i
            p = before[i]
            if p >= 0:
                q = rank_of(piece[p:k])
                if q is None:
                    live[p] = -1
                else:
                    live[p] = q
                    if not buckets[q]:
                        w = q >> 8
                        words[w] |= _BIT[q & 255]
                        top |= _BIT[w]
                    buckets[q] |= 1 << p
        ranks, out, i = self.ranks, [], 0
        while i < n:
            k = after[i]
            out.append(ranks[piece[i:k]])
            i = k
        return tuple(out)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap of positions in each bucket, as bitmaps of positions would be long."""
        ranks, longest = self.ranks, self.longest
        n = len(piece)
        after = list(range(1, n + 1))
        before = list(range(-1, n))
        live = [-1] * n  # rank of the pair that starts here, -1 if there is none
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}  # second level of the bitmap: bits of the ranks in a word
        top = 0  # first level: bits of the words that are not empty
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                live[i] = r
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    w = r >> _BITS
                    words[w] = words.get(w, 0) | 1 << (r & 255)
                    top |= 1 << w
        while top:
            w = (top & -top).bit_length() - 1
            bits = words[w]
            r = (w << _BITS) | ((bits & -bits).bit_length() - 1)
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                bits &= bits - 1
                words[w] = bits
                if not bits:
                    top &= ~(1 << w)
            if live[i] != r:
                continue  # stale
            j = after[i]
            k = after[j]
            after[i] = k
            live[j] = -1
            if k < n:
                before[k] = i
            for at, end in ((before[i], k), (i, after[k] if k < n else 0)):
                if at < 0:
                    continue
                q = ranks.get(piece[at:end], -1) if 0 < end - at <= longest else -1
                if q == live[at] and at != i:
                    continue  # the same entry still waits
                live[at] = q
                if q >= 0:
                    if q in buckets:
                        heappush(buckets[q], at)
                    else:
                        buckets[q] = [at]
                        v = q >> _BITS
                        words[v] = words.get(v, 0) | 1 << (q & 255)
                        top |= 1 << v
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.split(text))), np.int32).tolist()

    def encode_batch(self, texts: list[str | None]) -> pa.Array:
        """A list<int32> array; null texts give empty lists."""
        memo, split = self.memo.__getitem__, self.split
        ends, parts = [0], []
        for text in texts:
            ids = b"".join(map(memo, split(text))) if text else b""
            parts.append(ids)
            ends.append(ends[-1] + len(ids) // 4)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))

    def decode_batch(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list; null lists give empty bytes."""
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        if len(flat) and (flat.min() < 0 or flat.max() > self.top_rank or not self.known[flat].all()):
            raise ValueError("an id is not in the vocabulary")
        count = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        joined = self.pieces.take(pa.array(flat, pa.int64()))
        data = joined.buffers()[2] or pa.py_buffer(b"")
        byte_ends = np.concatenate([[0], np.cumsum(self.lengths[flat])])
        offsets = byte_ends[np.concatenate([[0], np.cumsum(count)])].astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets), data]).cast(pa.binary())


class _Memo(dict):
    """The ids of pre-tokens as bytes, which take less room than tuples.

    Two generations: when the young one is full it becomes the old one, whose entries come back as they are used.
    """

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", self.encoder.merge(piece.encode("utf-8", "replace"))).tobytes()
            if len(piece) > 64:
                return ids
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _place(path: str | None) -> str:
    return path or public_tokenizers.path(VOCABULARY)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(key, ids array<int>) of every text, as the reference tokenizer would give them, without special tokens."""
    path, slim = _place(path), keyed_text(docs, key, text)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = encoder(path, pattern).encode_batch(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return per_batch(slim, step, f"`{key}` {slim.schema[0].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The rows of ``encode`` with the column ``decoded`` (binary) added."""
    path = _place(path)
    slim = tokens.select(F.col(f"`{key}`").alias(key), F.col(f"`{ids}`").alias("ids"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), encoder(path, pattern).decode_batch(batch.column(1))], names=[key, "ids", "decoded"])

    return per_batch(slim, step, f"`{key}` {slim.schema[0].dataType.simpleString()}, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``decode(encode(...))`` in one pass, so that a task needs one Python worker: key, ids, decoded."""
    path, slim = _place(path), keyed_text(docs, key, text)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = encoder(path, pattern)
        ids = known.encode_batch(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), ids, known.decode_batch(ids)], names=[key, "ids", "decoded"])

    return per_batch(slim, step, f"`{key}` {slim.schema[0].dataType.simpleString()}, ids array<int>, decoded binary")


def digests(docs: DataFrame, with_ids: bool = False, key: str = "doc_id", **options) -> DataFrame:
    """Per document: key, n_tokens, ids_sha256, decoded_sha256 of a full round trip, and the ids if asked for."""
    return round_trip(docs, key, **options).select(
        F.col(f"`{key}`"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(["ids"] if with_ids else []),
    )
