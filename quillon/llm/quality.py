"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A text's words are split once; counts that rules need are computed from them
where a rule asks for them.  On a sample of about ``SAMPLE_ROWS`` rows, every row
of the table as likely as any other, the operator finds for every rule which
texts it rejects and its mean work: the characters, words, lines and matches that
its counts go through on these texts, by what one of each costs; counts that the
result needs anyway cost nothing.  Rules are then put in order greedily by texts
newly rejected per unit of work among those that earlier rules let through.  The
cascade is one CASE expression in that order, so a document stops at the first
rule that rejects it.  The order changes the cost only: the verdict is that of
all rules together.

Words are ``[^\\x20\\x09-\\x0D]+``.  Repeated three-word windows are found by
sorting 64-bit window hashes, in n log n for a text of any length.

Defined results: a null text has no words, fails the base rules and is not kept;
repeated rows are judged alike; of rules with equal rejection per work the
cheaper, then the one listed first comes first; an empty table gives an empty
table and the rules as listed; columns of the input keep their values.  ``apply``
adds ``kept`` (with underscores behind it where the input has such a column) or,
with ``drop=True``, returns the kept rows with the input's columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh

SAMPLE_ROWS = 2000
MIN_WORDS = 50
REPEAT_PERCENT = 50
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[^#*$%&|<>]++"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _left(text: Column, pattern: str) -> Column:
    """Characters outside the runs of a pattern; no match becomes a value of its own."""
    return F.length(F.regexp_replace(text, pattern, ""))


def n_dup_lines(ls: Column) -> Column:
    return F.size(ls) - F.size(F.array_distinct(ls))


def n_repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more; ``w`` must be a column or lambda variable."""

    def covered(starts: Column) -> Column:
        # window starts in order: each covers three words, or as many as lie before the next start
        gaps = F.transform(starts, lambda p, i: F.when(i + 1 < F.size(starts), F.least(F.lit(3), F.get(starts, i + 1) - p)).otherwise(3))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def repeated(windows: Column) -> Column:
        by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(s, F.greatest(i - 1, F.lit(0)))["h"])))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        found = _let(by_hash, starts)
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_let(found, covered))

    windows = _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.slice(h, 1, F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))))
    return F.when(F.size(w) < 4, 0).otherwise(_let(windows, repeated))


@dataclass(frozen=True)
class Text:
    """Counts of a text that is not null, each an expression over the text and its words, or a column that holds it already."""

    text: Column
    words: Column
    known: dict[str, Column] = field(default_factory=dict)

    def count(self, name: str) -> Column:
        return self.known[name] if name in self.known else _COUNTS[name](self)

    def price(self, name: str) -> Column:
        """Work of the count on this text, in what one character of a scan costs."""
        return F.lit(0.0) if name in self.known else _PRICES[name](self).cast("double")


_COUNTS: dict[str, Callable[[Text], Column]] = {
    "n_words": lambda x: F.size(x.words),
    "word_chars": lambda x: F.length(F.array_join(x.words, "")),
    "n_symbols": lambda x: _left(x.text, _SYMBOLS),
    "exclamations": lambda x: F.length(x.text) - F.length(F.replace(x.text, F.lit("!"), F.lit(""))),
    "capitals": lambda x: _left(x.text, r"\P{Lu}++"),
    "letters": lambda x: F.length(x.text) - _left(x.text, r"\p{L}++"),
    "n_lines": lambda x: F.size(lines(x.text)),
    "n_dup_lines": lambda x: _let(lines(x.text), n_dup_lines),
    "n_repeat_words": lambda x: n_repeat_words(x.words),
}
_CHARS = lambda x: F.length(x.text)
#: What counts go through: characters once each, and matches, words or lines by what handling one costs beside.
_PRICES: dict[str, Callable[[Text], Column]] = {
    "n_words": lambda x: F.lit(1),
    "word_chars": lambda x: 2 * x.count("n_words"),
    "n_symbols": lambda x: _CHARS(x) + 8 * x.count("n_symbols"),
    "exclamations": lambda x: 0.3 * _CHARS(x) + 2 * x.count("exclamations"),
    "capitals": lambda x: _CHARS(x) + 8 * x.count("capitals"),
    "letters": lambda x: _CHARS(x) + 8 * x.count("n_words"),
    "n_lines": lambda x: 0.2 * _CHARS(x) + 20 * x.count("n_lines"),
    "n_dup_lines": lambda x: 0.2 * _CHARS(x) + 40 * x.count("n_lines"),
    "n_repeat_words": lambda x: x.count("n_words") * (20 + F.log2(x.count("n_words") + F.lit(1))),
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a text to drop; its work is that of the counts it ``needs``, or ``work``."""

    name: str
    rejects: Callable[[Text], Column]
    needs: tuple[str, ...] = ()
    work: Callable[[Text], Column] | None = None

    def price(self, x: Text) -> Column:
        if self.work is not None:
            return self.work(x).cast("double")
        return sum((x.price(n) for n in self.needs), F.lit(1.0))


BASE = (
    Rule("few_words", lambda x: x.count("n_words") < MIN_WORDS, ("n_words",)),
    Rule("repeats", lambda x: 100 * x.count("n_repeat_words") > REPEAT_PERCENT * x.count("n_words"), ("n_repeat_words",)),
)
RULES = (
    Rule("symbols", lambda x: 5 * x.count("n_symbols") > x.count("n_words"), ("n_symbols",)),
    Rule("exclamations", lambda x: 5 * x.count("exclamations") > x.count("n_words"), ("exclamations",)),
    Rule("capitals", lambda x: 2 * x.count("capitals") > x.count("word_chars"), ("capitals", "word_chars")),
    Rule("letters", lambda x: 2 * x.count("letters") < x.count("word_chars"), ("letters", "word_chars")),
    Rule("word_length", lambda x: (x.count("word_chars") > 15 * x.count("n_words")) | (x.count("word_chars") < 2 * x.count("n_words")), ("word_chars",)),
    Rule("same_lines", lambda x: (x.count("n_lines") >= 4) & (2 * x.count("n_dup_lines") > x.count("n_lines")), ("n_lines", "n_dup_lines")),
)


def _over(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the text, empty for null, and its words, split once."""
    return _let(F.coalesce(text, F.lit("")), lambda t: _let(words(t), lambda w: body(t, w)))


def _drawn(docs: DataFrame, text: str, sample_rows: int) -> DataFrame:
    t = docs.select(F.col(f"`{text}`").cast("string").alias("t"))
    n = docs.count()
    return t if n <= sample_rows else t.sample(False, sample_rows / n, seed=11)


def order(docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS, known: Sequence[str] = ()) -> list[Rule]:
    """The rules by texts newly rejected per unit of work on about ``sample_rows`` rows (a number and a truth value per rule and row come back).

    ``known`` counts are those that are computed in any case.
    """

    def seen(t: Column, w: Column) -> Column:
        plain = Text(t, w)
        x = Text(t, w, {name: plain.count(name) for name in known})
        return F.struct(F.array(*[F.coalesce(r.rejects(x), F.lit(True)) for r in rules]).alias("rejects"), F.array(*[r.price(x) for r in rules]).alias("work"))

    rows = _drawn(docs, text, sample_rows).select(_over(F.col("t"), seen).alias("x")).select("x.rejects", "x.work").collect() if rules else []
    if not rows:
        return list(rules)
    work = [max(1e-9, sum(row.work[i] for row in rows) / len(rows)) for i in range(len(rules))]
    left, todo, out = rows, list(range(len(rules))), []
    while todo:
        gain = {i: sum(row.rejects[i] for row in left) / work[i] for i in todo}
        best = max(todo, key=lambda i: (gain[i], -work[i], -i))
        out.append(rules[best])
        todo.remove(best)
        left = [row for row in left if not row.rejects[best]]
    return out


def passes(x: Text, ordered: Sequence[Rule]) -> Column:
    """True if no rule rejects the text; rules after the first that rejects it are not evaluated."""
    passed: Column = F.lit(True)
    for rule in reversed(ordered):
        passed = F.when(F.coalesce(rule.rejects(x), F.lit(True)), False).otherwise(passed)
    return passed


def cascade(text: Column, ordered: Sequence[Rule]) -> Column:
    return _over(text, lambda t, w: passes(Text(t, w), ordered))


def apply(docs: DataFrame, rules: Sequence[Rule] = BASE + RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, drop: bool = False) -> DataFrame:
    """The rows with ``kept`` added, or only the kept rows."""
    verdict = cascade(F.col(f"`{text}`").cast("string"), order(docs, rules, text, sample_rows))
    if drop:
        return docs.where(verdict)
    return docs.select("*", verdict.alias(fresh("kept", docs.columns)))


#: Counts that the report holds, whatever the verdict.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: the base counts, base_failed, and kept, the cascade's verdict; the base rules, whose counts are known, are part of it."""
    ordered = order(docs, (*BASE, *rules), text, sample_rows, known=REPORTED)

    def judged(t: Column, w: Column) -> Column:
        x = Text(t, w)
        counts = F.struct(*[x.count(name).cast("long").alias(name) for name in REPORTED])

        def verdict(c: Column) -> Column:
            y = Text(t, w, {name: c[name] for name in REPORTED})
            failed = BASE[0].rejects(y) | BASE[1].rejects(y)
            return F.struct(*[c[name].alias(name) for name in REPORTED], failed.alias("base_failed"), passes(y, ordered).alias("kept"))

        return _let(counts, verdict)

    return docs.select(F.col(f"`{key}`").alias(key), _over(F.col(f"`{text}`").cast("string"), judged).alias("x")).select(F.col(f"`{key}`"), *[f"x.{name}" for name in (*REPORTED, "base_failed", "kept")])


#: DuckDB's view of ``report``; kept is the conjunction of all rules.
REPORT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d
), windows AS (
  SELECT doc_id, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), starts AS (
  SELECT doc_id, i, z IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, x, y, z) > 1 AS again FROM windows
), cover AS (
  SELECT doc_id, again OR coalesce(lag(again, 1) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS hit FROM starts WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), rep AS (SELECT doc_id, count(*) FILTER (WHERE hit) AS n FROM cover GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, t, ls, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         5 * n_symbols > n_words OR 5 * (length(t) - length(replace(t, '!', ''))) > n_words
         OR 2 * len(regexp_extract_all(t, '\p{Lu}')) > word_chars OR 2 * len(regexp_extract_all(t, '\p{L}')) < word_chars
         OR word_chars > 15 * n_words OR word_chars < 2 * n_words OR (len(ls) >= 4 AND 2 * n_dup_lines > len(ls)) AS rejected
  FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM judged
"""
