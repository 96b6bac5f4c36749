"""Long texts, repeated rows, ties and clashing columns, operator by operator and stage by stage."""

import hashlib
import random
import re

import numpy as np
import pytest

pytest.importorskip("quillon.llm")

import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402

from quillon.llm import bpe, langid, neardup, tokencount  # noqa: E402

EXTRA = ["id", "t", "key", "row", "label", "n", "spans", "ids", "decoded", "edits", "held_out", "score", "slot", "shard", "component", "d1", "kept", "_row", "_gone", "item"]


def clash(df):
    return df.selectExpr("*", *[f"'x' AS `{name}`" for name in EXTRA if name not in df.columns])


@pytest.fixture(scope="module")
def library():
    e = bpe.encoder(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=e.ranks, special_tokens={})


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    long = " ".join(rng.choice(["the", "reed", "éta", "tion", "x1"]) + str(rng.randint(0, 99)) for _ in range(60_000))
    return [(1, long, "en"), (2, "short text here", "en"), (2, "short text here", "en"), (3, None, None), (4, "", "de"), (5, "y" * 100_000, "de"), (6, "ein Haus und noch ein Haus", "de")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return clash(spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long"))


def test_bpe(docs, rows, library):
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.digests(docs).collect())
    want = [(i, library.encode_ordinary(t or "")) for i, t, _ in rows]
    assert got == sorted((i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in want)


def test_token_counts(docs, rows, library):
    """Counts before and after the table's own edits are those of the edited texts."""
    edits = tokencount.sample_edits()
    given = {r.doc_id: r.changes for r in docs.select("doc_id", edits.alias("changes")).collect()}
    got = tokencount.count_edits(docs, edits).collect()
    assert len(got) == len(rows)
    for r in got:
        s = next(t for i, t, _ in rows if i == r.doc_id) or ""
        assert r.n_tokens == len(library.encode_ordinary(s))
        for c in given[r.doc_id]:
            at = min(c["start"], len(s))
            s = s[:at] + c["text"] + s[min(len(s), at + c["length"]) :]
        assert r.n_tokens_after == len(library.encode_ordinary(s))


def test_languages(docs):
    got = langid.predict(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.lang_pred, r.score))
    assert len(got) == 7 and all(len(v) == 1 for v in by.values())
    assert {by[i].pop()[0] for i in (3, 4)} == {"und"}


def test_language_ties():
    """Two languages with the same training texts: the first by name."""
    texts = ["one and the same text", "another of the texts"]
    model = langid.Model(texts * 2, ["zz", "zz", "aa", "aa"])
    assert set(model.predict(texts)[0]) == {"aa"} and np.allclose(model.predict(texts)[1], 1)


def test_near_duplicates(docs, spark):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.join(docs, 3, 90, 100).collect())
    assert [(i, c) for i, _, c in got] == [(1, 1), (2, 2), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6)]
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 2, 3, 4, 5, 6]
    with pytest.raises(TypeError):
        neardup.join(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# ---- stages of the pipeline

pipeline = pytest.importorskip("corpus_pipeline")
NO_ROWS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    passage = " ".join(f"item{i}" for i in range(14))
    spark.createDataFrame([("a", passage), ("a", passage), (None, None), ("b", "")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, passage


@pytest.mark.parametrize("number", range(5))
def test_stage_on_awkward_rows(spark, sf, number):
    """Each stage alone: what it drops or changes is what its operator is for, and columns stay as they are."""
    folder, passage = sf
    rng = random.Random(3)
    prose = lambda n: ". ".join(" ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(8)) for _ in range(n // 8))
    clean, long = prose(120), prose(40_000)
    near = re.sub(r"^\w+", "changed", clean)
    texts = [clean, near, clean, long, f"{prose(80)} {passage} {prose(40)}", f"{prose(80)} password=hunter22x {prose(40)}", None, "", "!!! ### !!!", "few words"]
    rows = [(i, t, "en", None, len(t or "")) for i, t in enumerate(texts)] + [(0, clean, "en", None, len(clean))]
    docs = clash(spark.createDataFrame(rows, NO_ROWS)).drop("ids")
    name, stage = pipeline.STAGES[number]
    out = stage(spark, docs, folder)
    got = sorted((r.doc_id for r in out.collect()))
    everything = sorted(i for i, *_ in rows)
    gone = {"quality_rules": {6, 7, 8, 9}, "near_duplicates": {1, 2}, "decontamination": {4}, "secret_scan": set(), "tokens": set()}[name]
    assert got == [i for i in everything if i not in gone]
    if number < 4:
        assert out.columns == docs.columns
    if name == "secret_scan":
        changed = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
        assert "hunter22x" not in changed[5][0] and changed[5][1] == len(changed[5][0])
        assert all(changed[i][0] == texts[i] for i in range(10) if i != 5)


@pytest.mark.parametrize("number", range(5))
def test_stage_on_no_rows(spark, sf, number):
    name, stage = pipeline.STAGES[number]
    assert stage(spark, clash(spark.createDataFrame([], NO_ROWS)).drop("ids"), sf[0]).count() == 0


def test_pipeline_against_plain_code(spark, library, tmp_path):
    """All stages over a fixture against a straightforward version without Spark."""
    import public_tokenizers  # noqa: F401

    from quillon.llm import secrets

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    bench = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def good(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = list(zip(w, w[1:], w[2:]))
        twice = {g for g in grams if grams.count(g) > 1} if len(set(grams)) < len(grams) else set()
        covered = {i + j for i, g in enumerate(grams) if g in twice for j in range(3)}
        chars = sum(map(len, w))
        letters, upper = sum(c.isalpha() for c in t or ""), sum(c.isupper() for c in t or "")
        return not (
            len(w) < 50 or 100 * len(covered) > 50 * len(w) or 5 * len(re.findall(r"[#*$%&|<>]", t)) > len(w) or 5 * t.count("!") > len(w) or 2 * upper > chars or 2 * letters < chars
            or chars > 15 * len(w) or chars < 2 * len(w) or len(lines) >= 4 and 2 * (len(lines) - len(set(lines))) > len(lines)
        )

    docs = sorted((r.doc_id, r.text) for r in source if good(r.text))
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    docs = [d for i, d in enumerate(docs) if root(i) == i]
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = set()
    for t in bench:
        w = words((t or "").translate(low))
        m = min(10, len(w))
        windows |= {tuple(w[p : p + m]) for p in range(len(w) - m + 1)} if m else set()
    sizes = {len(x) for x in windows}
    clean = []
    for i, t in docs:
        w = words(t.translate(low))
        if not any(tuple(w[p : p + m]) in windows for m in sizes for p in range(len(w) - m + 1)):
            clean.append((i, t))
    formats = secrets.learn(spark.createDataFrame(clean, "doc_id long, text string"))

    def redacted(t):
        out, done = "", 0
        for start, _, end in formats.spans(t)[1]:
            if start >= done:
                out += t[done:start] + "[SECRET]"
            done = max(done, end)
        return out + t[done:]

    want = {i: library.encode_ordinary(redacted(t)) for i, t in clean}
    got = {r.doc_id: r.ids for r in pipeline.run(spark, "/root/testdata/sf0.001").collect()}
    assert got == want
