"""Secret scans against a matcher without regular expressions, and planted formats."""

import hashlib
import random
import string

import pytest

pytest.importorskip("quillon.llm")

from quillon.llm import secrets  # noqa: E402

VALUE = set(string.ascii_letters + string.digits + "+/_.=-")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")


def run_of(text, at, allowed):
    end = at
    while end < len(text) and text[end] in allowed:
        end += 1
    return end


def brute(text):
    """Base spans by walking through the text."""
    out = []
    at = 0
    while at < len(text):
        end = None
        for word in WORDS:
            if all(at + i < len(text) and text[at + i] in (c, c.upper() if c.isalpha() else c) for i, c in enumerate(word)):
                i = at + len(word)
                i += text[i : i + 1] in ("'", '"') and i < len(text)
                while text[i : i + 1] == " ":
                    i += 1
                if text[i : i + 1] in (":", "=") and i < len(text):
                    i += 1
                    while text[i : i + 1] == " ":
                        i += 1
                    i += text[i : i + 1] in ("'", '"') and i < len(text)
                    stop = run_of(text, i, VALUE)
                    # a value may take back signs that the separator could have been
                    if stop > i:
                        end = (stop, stop - i >= 6)
                        break
        if end:
            if end[1]:
                out.append((at, 0, end[0]))
            at = end[0]
        else:
            at += 1
    for kind, head, allowed, least in ((1, "AKIA", set(string.ascii_uppercase + string.digits), 20), (2, "", set("0123456789abcdef"), 24)):
        at = 0
        while at < len(text):
            stop = run_of(text, at + len(head), allowed) if text.startswith(head, at) else at
            if stop > at + len(head):
                if stop - at >= least:
                    out.append((at, kind, stop))
                at = stop
            else:
                at += 1
    return sorted(out)


def test_base_spans_against_a_walk():
    rng = random.Random(8)
    parts = ["password", "PassWd", "api_key", "APIKEY", "token", "secret", "'", '"', " ", "  ", ":", "=", "AKIA", "Q7" * 8, "ab12" * 6, "ab1", "deadbeef" * 3, "\n", "é", "x", "word", "+/", "ſ", "Z", "abcdef"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert secrets.base_spans(text) == brute(text), text


@pytest.fixture(scope="module")
def known():
    rng = random.Random(1)
    prose = [" ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(40)) for _ in range(200)]
    return secrets.Formats([f"{p} token={s}" for p, s in zip(prose, secrets.examples(["{40h}"], n=200)["{40h}"])]), prose


def test_planted_formats(known):
    """Strings that no automaton has seen: nine of ten of every published format, and of keys with a prefix that was never learned."""
    formats, prose = known
    unseen = {"hf_{34w}": 300, "ASIA{16u}": 300, "sk-{40w}": 300, "{20h}": 300}
    for name, strings in (secrets.examples(seed=99, n=300) | secrets.examples([*unseen], n=300, seed=98)).items():
        assert sum(map(formats.is_secret, strings)) >= 0.9 * len(strings), name
    assert not any(formats.is_secret(t) for t in secrets.ordinary(5000, seed=97))
    assert not any(formats.is_secret(t) for v in secrets.examples(["{8h}-{4h}-{4h}-{4h}-{12h}"], n=500, seed=96).values() for t in v)
    assert not any(formats.spans(p)[1] for p in prose)
    key = secrets.examples(["ghp_{36w}"], n=1, seed=95)["ghp_{36w}"][0]
    assert formats.spans(f"é see {key}, here")[1] == [(6, 3, 46)]


def test_automata(known):
    """States keep prefixes apart, every counted way leads to a kept state, and few labels are enough."""
    for n in (20, 130):
        for name, states in (("AKIA{16u}", 5), ("ghp_{36w}", 5), ("sk-{48w}", 4)):
            a = secrets.Automaton(secrets.examples([name], n=n)[name])
            assert len(a.kept) >= states
            assert all(to in a.kept for q in a.kept for to in a.next[q].values())
            assert sum(a.count[q][s] for q in a.kept for s in a.count[q]) == sum(len(s) + 1 for s in secrets.examples([name], n=n)[name])


def test_bounds_lose_nothing(known):
    formats, _ = known
    rng = random.Random(4)
    pool = [s for v in secrets.examples(seed=5, n=8).values() for s in v] + secrets.ordinary(300, seed=6) + ["".join(rng.choices(sorted(VALUE), k=rng.randint(6, 50))) for _ in range(300)]
    for run in pool:
        passed = formats.gain(run) >= max(secrets.MARGIN, secrets.MARGIN_CHAR * len(run))
        assert passed == formats.is_secret(run), run


def test_awkward_rows(spark):
    """Very long texts and runs, repeated rows, overlapping kinds, clashing columns, another key."""
    key = "a1" * 20
    texts = ["x" * 300_000, "word " * 60_000 + "password=hunter22", f"token={key}", f"token={key}", "AKIA" + "0" * 24, None]
    df = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in enumerate(texts)], "row long, text string, spans string, base string, key string, doc_id string")
    got = {r["row"]: r for r in secrets.report(df, key="row").collect()}
    assert [got[i].spans for i in range(6)] == ["", "assign:300000:300017", "assign:0:46,hex:6:46", "assign:0:46,hex:6:46", "access:0:28,hex:4:28", ""]
    assert got[3].base_sha256 == hashlib.sha256(got[3].spans.encode()).hexdigest()
    clean = {r["row"]: r for r in secrets.redact(df).collect()}
    assert (clean[1].text[-13:], clean[2].text, clean[4].text, clean[5].text, clean[0].spans) == ("word [SECRET]", "[SECRET]", "[SECRET]", None, "a")
