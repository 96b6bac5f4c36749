"""Edit-aware token counts: a pre-token segment tree per document.

A document's pre-tokens lie in leaves of a binary tree whose nodes hold sums of
characters and tokens.  An edit finds its leaves by character position, goes
back to the last pre-token border that the edit cannot reach (the pattern looks
at most two characters past a pre-token's end), splits the text from there again
until a border past the edit falls on an old one, encodes only the pre-tokens in
between, and updates the sums above the touched leaves.

Defined results: a null text is empty and has 0 tokens; an edit's start and
length are cut to the text; a null list of edits is an empty one; edits apply
one after the other, each to the text that the ones before it left; texts of any
length are counted whole; repeated rows count alike; an empty table gives an
empty table; other columns, whatever their names, stay out.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import per_batch
from .bpe import VOCABULARY

LEAF = 64
#: Characters past a pre-token's end that its match may have looked at.
REACH = 2
#: Pre-tokens in each generation of a worker's memory of counts.
REMEMBERED = 200_000


class Counter(dict):
    """Pre-token -> number of tokens, with a memory in two generations."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.library = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.old: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            n = len(self.library.encode_ordinary(piece))
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = n
        return n


@lru_cache(maxsize=4)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


class Tree:
    """Sums over the pre-tokens of one text; ``encoded`` counts the pre-tokens that edits encoded again."""

    def __init__(self, text: str, count: Counter):
        self.count = count
        self.encoded = 0
        self._build(count.pattern.findall(text))

    def _build(self, pieces: list[str]) -> None:
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars = [0] * (2 * self.size)
        self.tokens = [0] * (2 * self.size)
        for i in range(len(self.leaves)):
            self._leaf(i)
        for node in range(self.size - 1, 0, -1):
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _leaf(self, i: int) -> None:
        self.chars[self.size + i] = sum(map(len, self.leaves[i]))
        self.tokens[self.size + i] = sum(map(self.count.__getitem__, self.leaves[i]))

    def _update(self, i: int) -> None:
        self._leaf(i)
        node = (self.size + i) >> 1
        while node:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            node >>= 1

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def _find(self, position: int) -> tuple[int, int]:
        """(leaf, characters before it) of the character at ``position``; past the end, the last leaf."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if position >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def edit(self, start: int, length: int, text: str) -> None:
        """Replace ``length`` characters at ``start`` by ``text``."""
        start = max(0, min(start, self.chars[1]))
        end = min(self.chars[1], start + max(0, length))
        first, at = self._find(max(0, start - REACH - 1))
        pieces = self.leaves[first]
        kept = 0
        while kept < len(pieces) and at + len(pieces[kept]) + REACH < start:
            at += len(pieces[kept])
            kept += 1
        if not kept and first and at + REACH >= start:  # the border before may be in reach: go back over whole leaves
            while first and at + REACH >= start:
                first -= 1
                at -= self.chars[self.size + first]
            pieces = self.leaves[first]
            while kept < len(pieces) and at + len(pieces[kept]) + REACH < start:
                at += len(pieces[kept])
                kept += 1
        last, gap = first, 64
        while True:
            # old pre-tokens from the border on, up to and with leaf ``last``, and their text after the edit
            until = at + sum(map(len, pieces[kept:])) + sum(self.chars[self.size + i] for i in range(first + 1, last + 1))
            whole = last == len(self.leaves) - 1
            if until >= end + REACH + 1 or whole:
                old = pieces[kept:] + [p for i in range(first + 1, last + 1) for p in self.leaves[i]]
                joined = "".join(old)
                new = joined[: start - at] + text + joined[end - at :]
                shift = len(text) - (end - start)
                borders, position = {}, at
                for i, p in enumerate(old):
                    if position >= end:
                        borders[position + shift - at] = i
                    position += len(p)
                fresh, sync = [], None
                settled = len(new) if whole else len(new) - REACH
                for m in self.count.pattern.finditer(new):
                    if m.start() >= start - at + len(text) and m.start() in borders:
                        sync = borders[m.start()]
                        break
                    if not whole and m.end() >= settled:
                        break
                    fresh.append(m[0])
                else:
                    sync = len(old)
                if sync is not None:
                    break
            last = min(len(self.leaves) - 1, max(last + 1, last + gap // 64))
            gap *= 2
        self.encoded += len(fresh)
        # the leaves first..last now hold: kept pre-tokens, the fresh ones, and the old ones from the common border on
        rest = old[sync:]
        merged = pieces[:kept] + fresh + rest
        if len(merged) > 4 * LEAF * (last - first + 1):
            self._build([p for leaf in self.leaves[:first] for p in leaf] + merged + [p for leaf in self.leaves[last + 1 :] for p in leaf])
            return
        share = -(-len(merged) // (last - first + 1))
        for n, i in enumerate(range(first, last + 1)):
            self.leaves[i] = merged[n * share : (n + 1) * share]
            self._update(i)


def count_edits(docs: DataFrame, edits: F.Column, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Per document: key, n_tokens, n_edits, n_tokens_after, n_encoded_again; ``edits`` is array<struct<start: int, length: int, text: string>>."""
    path = path or public_tokenizers.path(VOCABULARY)
    slim = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("text"), edits.alias("edits"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(path, pattern)
        rows = []
        for value, changes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            tree = Tree(value or "", count)
            before = tree.total
            for c in changes or []:
                tree.edit(c["start"], c["length"], c["text"] or "")
            rows.append((before, len(changes or []), tree.total, tree.encoded))
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=[key, "n_tokens", "n_edits", "n_tokens_after", "n_encoded_again"])

    return per_batch(slim, step, f"`{key}` {slim.schema[0].dataType.simpleString()}, n_tokens long, n_edits long, n_tokens_after long, n_encoded_again long")


def sample_edits(key: str = "doc_id", text: str = "text", n: int = 3) -> F.Column:
    """Edits that replace up to 11 characters by up to 15 from elsewhere in the text, at places that a hash of the key gives."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    size = F.greatest(F.length(t), F.lit(1))

    def place(i: int, part: int) -> F.Column:
        return F.xxhash64(F.col(f"`{key}`"), F.lit(i), F.lit(part))

    one = [
        F.struct(
            F.pmod(place(i, 0), size).cast("int").alias("start"),
            F.pmod(place(i, 1), F.lit(12)).cast("int").alias("length"),
            F.substring(t, F.pmod(place(i, 2), size).cast("int") + 1, F.pmod(place(i, 3), F.lit(16)).cast("int")).alias("text"),
        )
        for i in range(n)
    ]
    return F.array(*one)
