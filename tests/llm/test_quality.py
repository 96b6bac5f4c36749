"""The cascade: what the sample decides, and rows that are awkward."""

import pytest

pytest.importorskip("quillon.llm")

from pyspark.sql import functions as F  # noqa: E402

from quillon.llm import quality  # noqa: E402

SCHEMA = "doc_id long, text string"


def names(rules):
    return [r.name for r in rules]


def test_orders_by_rejection_per_work(spark):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(20)], SCHEMA)
    short = lambda x: F.length(x.text) < 5
    cheap, dear, never = quality.Rule("cheap", short, work=lambda x: F.lit(1)), quality.Rule("dear", short, work=lambda x: F.lit(50)), quality.Rule("never", lambda x: F.lit(False), work=lambda x: F.lit(1))
    assert names(quality.order(docs, [never, dear, cheap])) == ["cheap", "never", "dear"]


def test_the_sample_alone_reverses_the_order(spark):
    """Two rules that reject every text: which one is cheaper lies in the lines and symbols of the sample."""
    both = [quality.Rule("lines", lambda x: x.count("n_lines") > 0, ("n_lines",)), quality.Rule("symbols", lambda x: x.count("n_symbols") >= 0, ("n_symbols",))]
    long_lines = spark.createDataFrame([(i, "word " * 200) for i in range(10)], SCHEMA)
    many_lines = spark.createDataFrame([(i, "a\n" * 500) for i in range(10)], SCHEMA)
    for rules in (both, both[::-1]):
        assert names(quality.order(long_lines, rules)) == ["lines", "symbols"]
        assert names(quality.order(many_lines, rules)) == ["symbols", "lines"]
    # and a selective rule goes ahead of a cheaper one that rejects little
    shouting = spark.createDataFrame([(i, "word! " * 60) for i in range(9)] + [(9, "few words")], SCHEMA)
    assert names(quality.order(shouting, quality.BASE + quality.RULES, known=("n_words",)))[0] in ("exclamations", "few_words")


def test_known_counts_cost_nothing(spark):
    docs = spark.createDataFrame([(i, "some word " * 30) for i in range(10)], SCHEMA)
    rules = quality.BASE[::-1] + quality.RULES
    assert names(quality.order(docs, rules, known=quality.REPORTED)).index("repeats") < names(quality.order(docs, rules)).index("repeats") or names(quality.order(docs, rules, known=quality.REPORTED))[0] == "repeats"


def test_the_sample_covers_the_table(spark):
    """What only the end of the table holds is seen too."""
    docs = spark.createDataFrame([(i, "plain text") for i in range(4000)] + [(i, "hash ##### ") for i in range(4000)], SCHEMA).coalesce(1)
    rules = [quality.Rule("plain", lambda x: x.text == "never", work=lambda x: F.lit(1)), quality.Rule("hash", lambda x: x.text.contains("#"), work=lambda x: F.lit(50))]
    assert names(quality.order(docs, rules, sample_rows=200)) == ["hash", "plain"]


def test_awkward_rows(spark):
    long = "every word is another one " * 40_000
    rows = [(1, long, True, "c"), (2, None, True, "c"), (2, None, True, "c"), (3, "", False, "c"), (4, "\x00 \x0b \r\n\t", True, "c"), (5, "é" * 100_000, True, "c")]
    docs = spark.createDataFrame(rows, SCHEMA + ", kept boolean, t string")
    got = quality.apply(docs)
    assert got.columns == [*docs.columns, "kept_"]
    assert sorted((r.doc_id, r.kept, r.kept_) for r in got.collect()) == [(1, True, False), (2, True, False), (2, True, False), (3, False, False), (4, True, False), (5, True, False)]
    counts = {r.doc_id: r for r in quality.report(docs.withColumnRenamed("kept", "x").withColumnRenamed("t", "w")).collect()}
    assert (counts[1].n_words, counts[1].n_repeat_words, counts[4].n_words, counts[4].word_chars, counts[5].word_chars) == (200_000, 200_000, 1, 1, 100_000)


def test_native(spark):
    docs = spark.createDataFrame([(1, "a b")], SCHEMA)
    for df in (quality.report(docs), quality.apply(docs, drop=True)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
