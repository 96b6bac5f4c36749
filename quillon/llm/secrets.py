"""Secret scans: base patterns, and formats inferred as probabilistic automata.

Labelled credentials are of two kinds: the base matches in a bounded sample of
documents, drawn by a hash of the text over the whole table, for each label on
its own; and examples of published credential formats, written by a seeded
generator, a label per format (``labelled`` replaces them).  Other tokens of the
sampled documents, with numbers, dates, names and paths by a generator, are the
background; row identifiers of the form 8-4-4-4-12 are never added.  For each label a prefix tree counts how often each continuation was
seen; a character that a place holds far more often than its class would (the
``ghp_`` of a key) is a symbol of its own, others count as their class.  States
whose continuations agree within a Hoeffding bound are merged: of the children
of kept states the one with most strings is folded into the kept state that fits
it best, or kept itself, until no child is left, which gives a deterministic
probabilistic automaton of the format.

Every maximal run of credential characters in every text, from the length of the
shortest string that can be learned on, is then scored: the log-likelihood of
its characters under the best format, less a price for lengths that the format
was not seen with, less the log-likelihood under the background's automaton.
Two upper bounds of that score, which depend on the run's character classes only
and are remembered, settle most runs.  Runs above the threshold that overlap no
base match are added as spans of kind ``format``; base spans always stay.

Spans count code points, end exclusive.  Defined results: a null text is empty
and has no spans; repeated rows are scanned alike; texts and runs of any length
are scanned whole; spans of several kinds may overlap, and are all returned, in
order of start, then kind; an empty table gives an empty table; in ``report``
other columns are not looked at, in ``redact`` they are passed on (n_chars, if
there, is set to the new length).
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ROWS, cut, keyed_text, per_batch

#: Documents with a base match of a label that the automata learn from, at most.
SAMPLE_ROWS = 400
#: Longer texts are scanned like any others, but not learned from.
SAMPLE_CHARS = 100_000
#: Strings of a label, at most, that its automaton learns from.
STRINGS = 300
#: Examples of each published format.
EXAMPLES = 60
#: Verdicts on runs of at most so many characters are kept, for so many kinds of run at a time.
KEPT_CHARS, KEPT = 64, 1 << 16
#: Nats by which a run must fit a format better than the background, in all and per character.
MARGIN, MARGIN_CHAR = 10.0, 0.45
ALPHA = 0.05
#: Probability, under the background, that a token goes on as none was seen to.
RARE = 0.02
#: Nats for each character that a run is shorter or longer than any string of the format.
SHORTER, LONGER = 1.0, 0.5
#: A character is a symbol of its own from so many strings on, if it is so many times as frequent as its class would have it.
LITERAL, OFTENER = 8, 4

# The base patterns.
_ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: The same for Spark, by label: a text that holds a base match holds the pattern.
_HOLDS = {"assign": _ASSIGN.pattern.removesuffix("+)") + "{6,})", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}

# No string that a label can learn is shorter.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{6,}")
_KINDS = ("assign", "access", "hex", "format")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, sorted."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class _Covered:
    """Whether a stretch of text overlaps any of the spans, in time that grows with the logarithm of their number."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, _, end in spans:
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlaps(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end


# Published formats; {n letter} stands for n characters of the set.
_SETS = {"h": "0123456789abcdef", "d": "0123456789", "u": string.ascii_uppercase + string.digits, "w": string.ascii_letters + string.digits, "s": string.ascii_letters + string.digits + "_-", "b": string.ascii_letters + string.digits + "+/"}
PUBLISHED = """AKIA{16u} ASIA{16u} {32h} {40h} {64h} {32w} {40b} ghp_{36w} gho_{36w} ghs_{36w} github_pat_{22w}_{59w} glpat-{20s} npm_{36w} sk-{48w} sk-proj-{48s}
sk_live_{24w} pk_live_{24w} xoxb-{12d}-{12d}-{24w} xoxp-{12d}-{12d}-{12d}-{32h} AIza{35s} SG.{22s}.{43s} ya29.{68s} eyJ{33s}.eyJ{60s}.{43s}""".split()
#: Identifiers of rows are random too, but no secrets.
_IDENTIFIER = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")


def examples(formats: list[str] = PUBLISHED, n: int = EXAMPLES, seed: int = 3) -> dict[str, list[str]]:
    """Strings of each format."""
    rng = random.Random(seed)
    fill = lambda m: "".join(rng.choices(_SETS[m[2]], k=int(m[1])))
    return {f: [re.sub(r"\{(\d+)(\w)\}", fill, f) for _ in range(n)] for f in formats}


def ordinary(n: int = 400, seed: int = 4) -> list[str]:
    """Tokens that are no secrets: numbers, dates, versions, names in several cases, hosts, paths, identifiers of rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    digits = lambda lo, hi: "".join(rng.choices("0123456789", k=rng.randint(lo, hi)))
    kinds = (
        lambda: digits(4, 14), lambda: f"{digits(4, 4)}-{digits(2, 2)}-{digits(2, 2)}", lambda: f"{digits(1, 2)}.{digits(1, 2)}.{digits(1, 3)}", lambda: f"{word()}_{word()}_{word()}", lambda: word() + word().title() + word().title(),
        lambda: f"www.{word()}.com/{word()}/{digits(1, 4)}", lambda: f"{word()}/{word()}.{word()}", lambda: f"{word()}-{word()}-{word()}", lambda: (word() + word()).upper(), lambda: f"{word()}{digits(1, 3)}", lambda: word() + "=" * rng.randint(4, 40), lambda: "-" * rng.randint(4, 60), lambda: "." * rng.randint(4, 60),
        lambda: word().upper() + word(), lambda: word().title() + word().upper(),
    )
    return [rng.choice(kinds)() for _ in range(n)]


_SIZE = {"9": 10, "f": 6, "z": 20, "Z": 26}


def _symbol(c: str) -> str:
    if "0" <= c <= "9":
        return "9"
    if "a" <= c <= "f":
        return "f"
    if "g" <= c <= "z":
        return "z"
    if "A" <= c <= "Z":
        return "Z"
    return c


_CLASS = {chr(c): _symbol(chr(c)) for c in range(33, 127)}
_CLASSES = str.maketrans(_CLASS)
#: Coarser: all small letters are one class.
_COARSE = str.maketrans({c: "a" if "a" <= c <= "z" else s for c, s in _CLASS.items()})


class Automaton:
    """A prefix tree of strings, merged to a deterministic probabilistic automaton.

    Symbols are character classes and, with ``literals``, ``=c`` for a character of its own.
    ``rare``, if any, is the probability of all continuations that a state wasn't seen with.
    """

    def __init__(self, strings: list[str], literals: bool = True, alpha: float = ALPHA, rare: float = 0.0):
        self.rare = rare
        self.next: list[dict[str, int]] = []
        self.count: list[dict[str, int]] = []
        self.through: list[int] = []
        self.shortest, self.longest = min(map(len, strings), default=0), max(map(len, strings), default=0)
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._grow(strings, literals)
        self.kept = self._infer()
        self._price()

    def _new(self) -> int:
        self.next.append({})
        self.count.append({})
        self.through.append(0)
        return len(self.next) - 1

    def _grow(self, strings: list[str], literals: bool) -> None:
        todo = [(self._new(), 0, strings)]
        while todo:
            state, depth, here = todo.pop()
            self.through[state] = len(here)
            going = [s for s in here if len(s) > depth]
            chars = Counter(s[depth] for s in going)
            classes = Counter()
            for c, n in chars.items():
                classes[_CLASS.get(c, "?")] += n
            own = {c for c, n in chars.items() if literals and n >= LITERAL and n * _SIZE.get(_CLASS.get(c, "?"), 1) >= OFTENER * classes[_CLASS.get(c, "?")]}
            parts: dict[str, list[str]] = {}
            for s in going:
                parts.setdefault("=" + s[depth] if s[depth] in own else _CLASS.get(s[depth], "?"), []).append(s)
            if len(going) < len(here):
                self.count[state][""] = len(here) - len(going)
            for symbol, some in parts.items():
                self.count[state][symbol] = len(some)
                self.next[state][symbol] = child = self._new()
                todo.append((child, depth + 1, some))

    def _alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.through[a], self.through[b]
            if not n or not m:
                continue
            limit = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for s in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(s, 0) / n - self.count[b].get(s, 0) / m) > limit:
                    return False
            todo += [(self.next[a][s], self.next[b][s]) for s in self.next[a].keys() & self.next[b].keys() if self.next[a][s] != self.next[b][s]]
        return True

    def _fit(self, a: int, b: int) -> float:
        """Log-likelihood of what follows b under the state a."""
        total = self.through[a] + 1.0
        return sum(n * math.log((self.count[a].get(s, 0) + 0.05) / total) for s, n in self.count[b].items())

    def _fold(self, into: int, tree: int) -> None:
        """Add a tree of states to another state and what follows that; what the other lacks is hung on as it is."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            for s, n in self.count[b].items():
                self.count[a][s] = self.count[a].get(s, 0) + n
            self.through[a] += self.through[b]
            for s, child in self.next[b].items():
                if s in self.next[a]:
                    todo.append((self.next[a][s], child))
                else:
                    self.next[a][s] = child

    def _infer(self) -> list[int]:
        kept, known = [0], {0}
        while True:
            # a fold may have hung new children on any kept state, so all of them are looked at again
            open_ = [(-self.through[child], parent, s) for parent in kept for s, child in self.next[parent].items() if child not in known]
            if not open_:
                return kept
            _, parent, s = min(open_)
            state = self.next[parent][s]
            alike = [r for r in kept if self._alike(r, state)]
            if alike:
                into = max(alike, key=lambda r: (self._fit(r, state), r))
                self.next[parent][s] = into
                self._fold(into, state)
            else:
                kept.append(state)
                known.add(state)

    def _price(self) -> None:
        """Per kept state: log-probability and next state by character, of any other character, and the best and worst by class."""
        self.steps: dict[int, dict[str, tuple[float, int]]] = {}
        self.other: dict[int, tuple[float, int]] = {}
        self.by_class: dict[int, dict[str, list[tuple[float, int]]]] = {}
        for q in self.kept:
            total = self.through[q] + 1.0
            moves = {s: n for s, n in self.count[q].items() if s}
            usual = self.next[q][max(sorted(moves), key=lambda s: moves[s])] if moves else 0
            self.other[q] = (math.log(self.rare / 26 if self.rare else 0.05 / total / 26), usual)
            steps: dict[str, tuple[float, int]] = {}
            for c, cls in _CLASS.items():
                if cls not in moves and cls in self.next[0]:  # as if a string began here
                    steps[c] = (self.other[q][0], self.next[0][cls])
                if cls in moves:
                    steps[c] = (math.log((moves[cls] + 0.05) / total / _SIZE.get(cls, 1)), self.next[q][cls])
            for s, n in moves.items():
                if len(s) == 2:
                    steps[s[1]] = (math.log((n + 0.05) / total), self.next[q][s])
            self.steps[q] = steps
            table: dict[str, set[tuple[float, int]]] = {}
            for c, cls in _CLASS.items():
                step = steps.get(c, self.other[q])
                for name in {cls, "a" if "a" <= c <= "z" else cls}:
                    table.setdefault(name, set()).add(step)
            self.by_class[q] = {name: sorted(some) for name, some in table.items()}

    def length(self, n: int) -> float:
        return -SHORTER * max(0, self.shortest - n) - LONGER * max(0, n - self.longest)

    def score(self, run: str) -> float:
        """Log-likelihood of the characters."""
        total, q = 0.0, 0
        for c in run:
            p, q = self.steps[q].get(c) or self.other[q]
            total += p
        return total

    def reach(self, classes: str, best) -> float:
        """The best (``max``) or worst (``min``) log-likelihood of any run with these classes."""
        ends = {0: 0.0}
        for c in classes:
            onward: dict[int, float] = {}
            for q, total in ends.items():
                for p, to in self.by_class[q].get(c) or [self.other[q]]:
                    onward[to] = total + p if to not in onward else best(onward[to], total + p)
            ends = onward
        return best(ends.values())


def _drawn(strings: list[str]) -> list[str]:
    """At most ``STRINGS`` of the strings, drawn by hash."""
    return sorted(set(strings), key=lambda s: hashlib.sha256(s.encode("utf-8", "replace")).digest())[:STRINGS]


class Formats:
    def __init__(self, texts: list[str], labelled: dict[str, list[str]] | None = None):
        found: dict[str, list[str]] = {"assign": [], "access": [], "hex": []}
        background: list[str] = []
        for text in texts:
            spans = base_spans(text)
            covered = _Covered(spans)
            for start, kind, end in spans:
                secret = text[start:end]
                if kind == 0:
                    secret = _ASSIGN.match(secret)[2]
                found[_KINDS[kind]].append(secret)
            background += [m[0] for m in re.finditer(r"[A-Za-z0-9+/_.=-]{4,}", text) if not covered.overlaps(m.start(), m.end())]
        found |= examples() if labelled is None else labelled
        self.automata = {k: Automaton(_drawn(v)) for k, v in found.items() if v}
        n = min(len(background), 4 * STRINGS)
        self.background = Automaton([background[i * len(background) // n] for i in range(n)] + ordinary(), literals=False, rare=RARE)
        self.bounds: dict[str, bool] = {}

    def _may(self, classes: str) -> bool:
        """Whether any run with these classes could be a secret."""
        found = self.bounds.get(classes)
        if found is None:
            n = len(classes)
            need = max(MARGIN, MARGIN_CHAR * n) + self.background.reach(classes, min)
            found = any(a.reach(classes, max) + a.length(n) >= need for a in self.automata.values())
            if n <= KEPT_CHARS:
                if len(self.bounds) >= KEPT:
                    self.bounds.clear()
                self.bounds[classes] = found
        return found

    def gain(self, run: str) -> float:
        """How much better the best format fits the run than the background, in nats."""
        best = max((a.score(run) + a.length(len(run)) for a in self.automata.values()), default=-math.inf)
        return best - self.background.score(run)

    def is_secret(self, run: str) -> bool:
        """Whether a format fits the run so much better than the background."""
        return self._may(run.translate(_COARSE)) and self._may(run.translate(_CLASSES)) and self.gain(run) >= max(MARGIN, MARGIN_CHAR * len(run)) and not _IDENTIFIER.fullmatch(run)

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(base spans, all spans), each sorted by start, then kind."""
        base = base_spans(text)
        covered = _Covered(base)
        more = [(m.start(), 3, m.end()) for m in _RUN.finditer(text) if self.is_secret(m[0]) and not covered.overlaps(m.start(), m.end())]
        return base, sorted(base + more) if more else base


def learn(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Formats:
    """Formats from at most ``sample_rows`` distinct texts a label that hold a base match, of at most ``SAMPLE_CHARS`` characters, drawn by hash."""
    t = F.col(f"`{text}`").cast("string")
    short = docs.where(F.length(t) <= SAMPLE_CHARS).select(t.alias("t"), F.xxhash64(t).alias("h"))
    # hashes first, so that texts are fetched for the drawn ones only
    holds = cut(short.select("h", *[F.col("t").rlike(p).alias(k) for k, p in _HOLDS.items()]).where(" or ".join(_HOLDS)).distinct())
    drawn = {r.h for k in _HOLDS for r in holds.where(k).select("h").orderBy("h").limit(sample_rows).collect()}
    if not drawn:
        return Formats([])
    rows = short.where(F.col("h").isin(sorted(drawn))).groupBy("h").agg(F.min("t").alias("t")).collect()
    return Formats(sorted(r.t for r in rows))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{_KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", formats: Formats | None = None) -> DataFrame:
    """Per document: key, base (string), spans (string): all matches as kind:start:end."""
    known = docs.sparkSession.sparkContext.broadcast(formats or learn(docs, text))
    slim = keyed_text(docs, key, text)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [known.value.spans(t or "") for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([_joined(b) for b, _ in found], pa.string()), pa.array([_joined(a) for _, a in found], pa.string())], names=[key, "base", "spans"])

    return per_batch(slim, step, f"`{key}` {slim.schema[0].dataType.simpleString()}, base string, spans string")


def report(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Per document: key, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda kind: F.regexp_count("base", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}")
    return scan(docs, key, **options).select(F.col(f"`{key}`"), count("assign"), count("access"), count("hex"), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", formats: Formats | None = None) -> DataFrame:
    """The rows with every span of the text, overlapping ones as one, replaced by ``mark``."""
    known = docs.sparkSession.sparkContext.broadcast(formats or learn(docs, text))
    at = docs.columns.index(text)
    length = next((i for i, f in enumerate(docs.schema) if f.name == "n_chars" and f.dataType.simpleString() in ("int", "bigint")), None)

    def clean(value: str | None) -> str | None:
        if not value:
            return value
        out, done = [], 0
        for start, _, end in known.value.spans(value)[1]:
            if start >= done:
                out += [value[done:start], mark]
            done = max(done, end)
        return "".join([*out, value[done:]]) if done else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                texts = [clean(t) for t in batch.column(at).to_pylist()]
                columns = list(batch.columns)
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                if length is not None:
                    old = batch.column(length).to_pylist()
                    columns[length] = pa.array([n if n is None or t is None else len(t) for n, t in zip(old, texts)], batch.schema.field(length).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def sha256_of(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(_joined(spans).encode()).hexdigest()
