"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs of bytes that a 256-entry class table maps to a non-zero
byte (the table also folds A-Z).  A word's 64-bit hash is a polynomial over its
folded bytes, read off one cumulative sum for a whole batch, then mixed; words
of more than ``LONG`` bytes get a BLAKE2 hash instead, as polynomials modulo
2**64 are weak on very long structured strings.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
LONG = 512
CHUNK = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


def _table(is_word) -> np.ndarray:
    lut = np.zeros(256, np.uint8)
    for b in range(256):
        if is_word(b):
            lut[b] = b + 32 if 65 <= b <= 90 else b
    return lut


#: Words [^\x20\x09-\x0D]+ with A-Z folded.  NUL bytes are words too: they map to 255, which UTF-8 never holds.
SPACED = _table(lambda b: b != 0x20 and not 9 <= b <= 13)
SPACED[0] = 255
#: Words of ASCII letters, digits and every non-ASCII character, with A-Z folded.
ALNUM = _table(lambda b: b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def up(base: int) -> np.ndarray:
        out = np.full(n, base, U)
        out[0] = 1
        return np.cumprod(out, dtype=U)

    return up(_P), up(_PINV)


def seed(k: int) -> np.uint64:
    return U(k * 0xA0761D6478BD642F % (1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays (xor-shift and multiply rounds)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Words:
    """Words of a run of texts: ``hashes``, byte bounds ``lo``/``hi`` in ``data`` (folded) and ``raw``, and ``first`` (word offsets per text)."""

    __slots__ = ("data", "first", "hashes", "hi", "lo", "raw")

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lut: np.ndarray):
        n = len(data)
        folded = lut[data]
        inside = np.zeros(n + 1, np.int8)
        inside[:n] = folded != 0
        turn = np.empty(n + 1, np.int8)
        turn[0] = inside[0]
        np.subtract(inside[1:], inside[:-1], out=turn[1:])
        start, stop = turn == 1, turn == -1
        # a text border splits a word that touches it on both sides
        cut = bounds[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < n)])
        cut = cut[(inside[cut - 1] == 1) & (inside[cut] == 1)]
        start[cut] = stop[cut] = True
        lo, hi = np.flatnonzero(start), np.flatnonzero(stop)
        size = max(CHUNK, 1 << max(0, n - 1).bit_length())
        up, down = _powers(size)
        total = np.zeros(n + 1, U)
        np.cumsum(folded * up[:n], dtype=U, out=total[1:])
        h = (total[hi] - total[lo]) * down[lo]
        long = np.flatnonzero(hi - lo > LONG)
        h = mix(h + (hi - lo).astype(U) * U(0xD6E8FEB86659FD93))
        for i in long:
            h[i] = int.from_bytes(hashlib.blake2b(folded[lo[i] : hi[i]].tobytes(), digest_size=8).digest(), "little")
        self.raw, self.data, self.lo, self.hi, self.hashes = data, folded, lo, hi, h
        self.first = np.searchsorted(lo, bounds)

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the k words from each position on; positions whose k words cross into another text hold rubbish."""
        h, n = self.hashes, len(self.hashes)
        out = np.full(n, seed(k), U)
        for j in range(k):
            out[: n - j] = mix(out[: n - j] * U(0xE7037ED1A0B428DB) + h[j:])
        return out


def whole(texts: pa.Array, lut: np.ndarray) -> Words:
    """The words of all texts as one run, hashed run by run."""
    runs = [run for _, run in slices(texts, lut)]
    out = object.__new__(Words)
    bytes_, words = (np.cumsum([0, *map(len, parts)]) for parts in ([r.data for r in runs], [r.hashes for r in runs]))
    joined = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)])
    out.data, out.hashes = joined([r.data for r in runs], np.uint8), joined([r.hashes for r in runs], U)
    out.lo, out.hi = (joined([getattr(r, x) + a for r, a in zip(runs, bytes_)], np.int64) for x in ("lo", "hi"))
    out.first = np.concatenate([np.zeros(1, np.int64), *[r.first[1:] + a for r, a in zip(runs, words)]])
    return out


def slices(texts: pa.Array, lut: np.ndarray):
    """Yield (first row, Words) for runs of about ``CHUNK`` bytes; a longer text is a run of its own.  Null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lut)
        i = j


def sets(words: Words, row: int, shingle: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text of the run; of fewer than k words, the whole sequence is one shingle."""
    a, b = int(words.first[row]), int(words.first[row + 1])
    if b - a >= k:
        return np.unique(shingle[a : b - k + 1])
    if b == a:
        return np.zeros(0, U)
    out = np.full(1, seed(b - a), U)
    for h in words.hashes[a:b]:
        out = mix(out * U(0xE7037ED1A0B428DB) + h)
    return out
