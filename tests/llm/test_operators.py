"""The corpus operators on small fixtures, against brute force, round trips and the awkward cases that each docstring defines."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("quillon.llm")

import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402

from quillon.llm import bpe, counttree, decontaminate, html, langid, licenses, neardup, quality, secrets, sharding, tokencount  # noqa: E402
from quillon.llm import queries as q  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def prose(rng, n, words=None):
    words = words or ["the", "of", "and", "reed", "tion", "anble", "éta", "und", "WORD", "x1"]
    return " ".join(rng.choice(words) + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = prose(rng, 200)
    near = []
    for _ in range(40):
        w = base.split()
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = f"q{rng.random():.6f}"
        near.append(" ".join(w))
    plain = [prose(rng, rng.choice([1, 2, 3, 60, 150])) for _ in range(40)]
    odd = [None, "", "   \n\t ", "one", "a b", "\x00nul \x00", "!" * 30, base, base, base.upper(), "long " * 30000, "x" * 20000]
    return odd + near + plain


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(docs):
    """Extra columns whose names operators might use themselves."""
    out = docs
    for name in ("id", "t", "key", "kept", "node", "label", "n", "w", "_bucket2", "spans", "ids"):
        out = out.selectExpr("*", f"'x' AS `{name}`")
    return out


# ---- quality


def repeat_words(words):
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    return len({i + j for i, g in enumerate(zip(words, words[1:], words[2:])) if seen[g] > 1 for j in range(3)})


def test_quality_counts(docs, texts):
    for r in quality.report(clash(docs)).collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        rep = repeat_words(w)
        expect = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expect
        assert not (r.base_failed and r.kept)


def test_quality_order_changes_no_verdict(docs):
    rules = quality.BASE + quality.RULES
    one = {r.doc_id: r.kept for r in docs.withColumn("kept", quality.cascade(docs["text"], rules)).collect()}
    two = {r.doc_id: r.kept for r in quality.apply(docs).collect()}
    assert one == two and any(one.values())
    assert {i for i, k in one.items() if k} == {r.doc_id for r in quality.apply(docs, drop=True).collect()}


# ---- html

PAGE = """<html><head><title>No</title><script>var t="</p>";</script></head><body><header>Head</header><nav><ul><li><a href=1>Menu</a></li></ul></nav>
<div class="ad">Buy</div><article><h1>Title &amp; more</h1><p>One  <b>bold</b>
text.<br>next</p><aside>Side</aside><p>Ok.</p><div class="comments"><p>First!</p></div><form>Send</form></article><footer>&copy; foot</footer>"""


def test_html():
    assert html.extract(PAGE) == "Title & more One bold text. next Ok."
    long = "word " * 40
    assert html.extract(f"<body><ul><li><a href=x>{long}</a></li></ul><div>{long}</div><div>{long}</div><div id=footer>{long}</div>") == " ".join([long.strip()] * 2)
    for bad in (None, "", "<", "<p", "<nav><p>x", "<!-- x", "plain", "<script>x"):
        assert isinstance(html.extract(bad), str)
    assert html.extract("plain") == "plain"


def test_html_unclosed_raw_elements():
    body = "<p>" + "some words of the article " * 5 + "</p>"
    text = html.extract(f"<body>{body}</body>")
    assert len(text) > 100
    for page in (
        f"<html><head><title>No</title><meta a=b><body>{body}", f"<head><title>No</title>{body}", f"<body><svg/>{body}", f'<body><svg width="1"/>{body}<svg><text>no</text></svg>',
        f"<body><svg><path d=1><article>{body}</article>", f"<body><select><option>no<main>{body}</main><select></select>", f"<body>{body}<iframe>", f"<body><svg><svg>no</svg>no</svg>{body}", f"<body><template><article>no</article></template>{body}",
    ):
        assert html.extract(page) == text, page
    assert html.extract(f"<body>{body}<script>var x = '<article>no</article>'") == text


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.extract_pages(df).collect())
    assert got[:2] == [(1, html.extract(PAGE), len(html.extract(PAGE))), (2, "", 0)]


# ---- secrets


def test_secret_base(spark):
    cases = ["password=abcdef12 PASSWD: 'xy' api_key=\"q1w2e3r4\"", "AKIA" + "Q" * 16 + " AKIAQ", "0" * 24 + "g" + "ab" * 11, "toKenſecret = aaaaaa", None, ""]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.report(df).collect()}
    assert [(got[i].n_assign, got[i].n_access, got[i].n_hex) for i in range(6)] == [(2, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0)]
    assert got[4].base_sha256 == hashlib.sha256(b"").hexdigest() and got[4].spans == ""
    assert got[0].base_sha256 == hashlib.sha256(got[0].spans.encode()).hexdigest()


def test_secret_formats():
    rng = random.Random(2)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(120)]
    rest = [f"user{rng.randint(1, 99)}@mail{rng.randint(0, 9)}.example.com said something long-winded" for _ in range(200)]
    known = secrets.Formats([f"{b} token={h}" for b, h in zip(rest, hexes)] + rest)
    assert known.is_secret("9f8e7d6c5b4a39281706")
    assert not known.is_secret("mail7.example.com") and not known.is_secret("something-long-winded")
    base, spans = known.spans("see 9f8e7d6c5b4a39281706 here")
    assert not base and [(s, e) for s, _, e in spans] == [(4, 24)]


def test_secret_sample_is_drawn_over_the_table(spark):
    rng = random.Random(5)
    key = lambda prefix: prefix + "".join(rng.choice("0123456789abcdef") for _ in range(36))
    rows = [f"the password and the token of secret number {i}" for i in range(600)] + [f"row {i} has token={key('A')}" for i in range(500)] + [f"row {i} has token={key('zz')}" for i in range(500)] + ["found AKIA" + "Q7" * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").coalesce(1)
    known = secrets.learn(df)
    assert set(known.automata) == {"assign", "access", "hex", *secrets.PUBLISHED}
    # both prefixes are learned, whichever sorts first
    drawn = secrets._drawn([key("A") for _ in range(400)] + [key("zz") for _ in range(400)])
    assert 90 < sum(s[0] == "z" for s in drawn) < 210
    assert {"=A", "=z"} <= set(known.automata["assign"].count[0])
    assert known.spans("see " + key("zz") + " here")[1]


def test_secret_runs_without_digits_or_short():
    rng = random.Random(3)
    letters = ["".join(rng.choice("QWXZ") + rng.choice("ghkq") for _ in range(10)) for _ in range(100)]
    short = ["".join(rng.choice("QWXZ") + rng.choice("ghkq") for _ in range(5)) for _ in range(100)]
    rest = [f"some words of prose were written by user{rng.randint(1, 99)} again" for _ in range(200)]
    known = secrets.Formats([f"{b} token={s}" for b, s in zip(rest, letters + short)])
    got = known.spans("see ZkWgQhXqWkZgXkQqWhXg and QgWhXkZqWg, not somebodys considerable writing")[1]
    assert [(s, e) for s, _, e in got] == [(4, 24), (29, 39)]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a password=abcdef12 b", 21, "k"), (2, None, None, "k")], "doc_id long, text string, n_chars long, id string")
    got = sorted(tuple(r) for r in secrets.redact(df).collect())
    assert got == [(1, "a [SECRET] b", 12, "k"), (2, None, None, "k")]


# ---- tokens


@pytest.fixture(scope="module")
def library():
    e = bpe.encoder(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=e.ranks, special_tokens={})


def test_bpe_table(docs, texts, library):
    for r in bpe.digests(clash(docs)).collect():
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_bpe_random(library):
    e = bpe.encoder(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(500):
        s = "".join(rng.choice(["a", "b", " ", "é", "漢", "\n", "ing", "'s", "😀", "zz", "<|endoftext|>"]) for _ in range(rng.randint(0, 80)))
        assert e.encode(s) == library.encode_ordinary(s)
        piece = s.encode()[:300]
        if piece:
            assert e._merge_long(piece) == e._merge_short(piece) or piece in e.ranks
    assert e.encode("abab" * 5000) == library.encode_ordinary("abab" * 5000)


def test_bpe_unknown_id(spark):
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")).collect()


def test_edits(library):
    count = tokencount.counter(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "é", "\n", "1", "the", "'s", "'", "!", "ll", "\n\n"]
    for _ in range(150):
        s = "".join(rng.choice(parts) for _ in range(rng.choice([0, 5, 60, 2000])))
        tree = tokencount.Tree(s, count)
        for _ in range(5):
            a, n, x = rng.randint(0, len(s) + 2), rng.choice([0, 1, 3, 200]), "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 600])))
            at = min(a, len(s))
            s = s[:at] + x + s[min(len(s), at + n) :]
            tree.edit(a, n, x)
            assert tree.text == s and tree.total == len(library.encode_ordinary(s))
    tree = tokencount.Tree("word " * 20000, count)
    tree.edit(50000, 4, "other")
    assert tree.encoded < 10


def test_edit_table(docs, texts, library):
    for r in tokencount.count_edits(docs, tokencount.sample_edits()).collect():
        assert r.n_tokens == len(library.encode_ordinary(texts[r.doc_id] or "")) and r.n_edits == 3


# ---- language


def test_languages(spark):
    rng = random.Random(4)
    vocab = {"en": ["the", "and", "with", "thing", "house"], "de": ["der", "und", "nicht", "schön", "haus"], "fr": ["les", "avec", "être", "maison", "où"]}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(30)), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34 !?", "de"), (902, rows[0][1].upper(), None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(df).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert (got[900].lang_pred, got[901].lang_pred, got[902].lang_pred) == ("und", "und", rows[0][2])
    assert all(0 <= r.score <= 1 for r in got.values())
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.predict(none).first().lang_pred == "und"


def test_language_sample_is_drawn_over_the_table(spark, monkeypatch):
    rng = random.Random(6)
    vocab = {"en": ["the", "and", "with", "thing", "house"], "de": ["der", "und", "nicht", "schön", "haus"], "fr": ["les", "avec", "être", "maison", "où"], "es": ["los", "niño", "hoy", "cuando", "llegó"]}
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 200)
    monkeypatch.setattr(langid, "LEAST_ROWS", 20)
    order = ["en"] * 1200 + ["de"] * 800 + ["fr"] * 30 + ["es"] * 6
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(30)), lang) for i, lang in enumerate(order)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    got = {r.doc_id: r.lang_pred for r in langid.predict(df).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    monkeypatch.setattr(langid, "Model", lambda texts, langs: collections.Counter(langs))
    drawn = langid.fit(df)
    assert set(drawn) == set(vocab) and 150 < sum(drawn.values()) < 300 and drawn["en"] > drawn["de"] > drawn["es"]


# ---- shards


def test_shards(docs, texts):
    got = sharding.report(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    by = collections.defaultdict(list)
    for r in got:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 16, zlib.crc32(t), "rows", None)
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {len(by[s]) for s in range(40)} <= {len(texts) // 40, len(texts) // 40 + 1}


def test_communication_matrix():
    rows = np.array([5, 0, 17, 3, 40, 1])
    ends = np.concatenate([[0], np.cumsum(rows)])
    per, capacity = sharding.plan(int(rows.sum()), 7)
    m = np.stack([sharding.matrix_row(ends, p, capacity, 1) for p in range(len(rows))])
    assert (m.sum(axis=1) == rows).all() and (m.sum(axis=0) == capacity).all()


# ---- joins


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(texts, k, num):
    sets = [shingles(t, k) for t in texts]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("k", "num", "chunk"), [(3, 90, 128), (5, 80, 128), (3, 90, 6), (5, 80, 5)])
def test_join(docs, texts, monkeypatch, k, num, chunk):
    """A small chunk sends the near copies through the rounds across chunks."""
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.join(clash(docs), k, num, 100).collect()}
    assert got == dict(enumerate(brute_components(texts, k, num)))


def test_keep_first(docs, texts):
    kept = {r.doc_id for r in neardup.keep_first(docs).collect()}
    assert kept == {i for i, (_, c) in enumerate(brute_components(texts, 5, 80)) if c == i}


def test_tree_bounds_lose_nothing():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400, np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 300, replace=False), rng.integers(0, 1 << 63, int(rng.integers(0, 40)), np.uint64)])) for _ in range(60)]
    sizes = np.array([len(s) for s in sets])
    vectors = counttree.points(sets, counttree.groups_for(sizes))
    tree = counttree.CountTree(vectors, sizes, 60, 100)
    for i, a in enumerate(sets):
        true = {j for j, b in enumerate(sets) if 160 * len(np.intersect1d(a, b)) >= 60 * (len(a) + len(b))}
        assert true <= set(tree.candidates(vectors[i], len(a)).tolist())


# ---- benchmark


@pytest.mark.parametrize("slice_bytes", [1 << 20, 60])
def test_decontamination(spark, slice_bytes):
    rng = random.Random(5)
    items = [prose(rng, n) for n in (25, 10, 12, 4, 1)] + [None, "", "..."]
    texts = [prose(rng, 40) for _ in range(12)]
    texts += [texts[0] + " , " + items[0].upper() + "!", " ".join(items[1].split()[:9]), items[2].replace(" ", "--"), f"x {items[3]} y", items[4], None, "", items[1] + " " + items[1]]
    bench = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(items)], "item_id string, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = collections.defaultdict(set)
    for i, t in enumerate(items):
        w = find((t or "").translate(LOW))
        m = min(10, len(w))
        for p in range(len(w) - m + 1) if m else ():
            windows[tuple(w[p : p + m])].add(f"i{i}")
    got = {r.doc_id: r for r in decontaminate.report(docs, bench, slice_bytes=slice_bytes).collect()}
    clean = {r.doc_id for r in decontaminate.keep_clean(docs, bench, slice_bytes=slice_bytes).collect()}
    for i, t in enumerate(texts):
        w, hit, found = find((t or "").translate(LOW)), set(), set()
        for key, owners in windows.items():
            for p in range(len(w) - len(key) + 1):
                if tuple(w[p : p + len(key)]) == key:
                    hit.update(range(p, p + len(key)))
                    found |= owners
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (i in clean) == (not hit)


# ---- all of them


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        quality.report(empty), quality.apply(empty, drop=True), html.extract_pages(pages), secrets.report(empty), secrets.redact(empty), tokencount.count_edits(empty, tokencount.sample_edits()),
        licenses.scan(empty), langid.predict(empty), sharding.report(empty), neardup.join(empty), neardup.keep_first(empty), decontaminate.report(empty, bench), decontaminate.keep_clean(empty, bench), bpe.digests(empty),
    ):
        assert df.count() == 0


def test_repeated_rows(docs, texts):
    twice = docs.union(docs)
    assert neardup.join(twice).count() == 2 * len(texts)
    assert sharding.report(twice).count() == 2 * len(texts)
    assert quality.report(twice).count() == 2 * len(texts)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    sf, duck = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    df = q.queries()[name](spark, sf)
    result = duck.execute(q.oracle_sql()[name])
    assert [c[0] for c in result.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(result.fetchall())


def test_registered_queries():
    names = list(q.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
