"""Line-block distribution: marks weigh, windows decide."""

import re

import pytest

pytest.importorskip("quillon.llm")

import pyarrow.parquet as pq  # noqa: E402

from quillon.llm import html  # noqa: E402

PROSE = "some words of the article " * 5


def test_optional_end_tags_and_names():
    assert html.extract("<html><head><title>x</title><body><article><p>Text here</p></article></body></html>") == "Text here"
    for page in ("<main><div class='content with-sidebar'>Some text</div></main>", "<main><div class='share-of-market'>Some text</div></main>", "<main><p class='related-work'>Some text</p></main>"):
        assert html.extract(page) == "Some text"
    for name in ("sidebar", "ad-banner", "comment-list", "box cookie-notice", "ads2"):
        assert html.extract(f"<article><p>One.</p><div class='{name}'><p>{PROSE}</p></div><p>Two.</p></article>") == "One. Two."
    assert html.extract("<main><ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>e<p>f<div>g</div></main>") == "a b c d e f g"


def test_context():
    assert html.extract(f"<nav><ul><li>Menu<article><p>{PROSE}</p></article>") == PROSE.strip()
    assert html.extract(f"<article><p>Yes.</p><section class=comments><article><p>{PROSE}</p></article></section></article>") == "Yes."
    assert html.extract("<article><header><h1>Title</h1></header><p>Yes.</p></article><header>No</header>") == "Title Yes."
    assert html.extract(f"<div><nav>{PROSE}</div><p>{PROSE}</p>") == PROSE.strip()


def test_windows_decide():
    """On a marked page a long unmarked part surges on its own, a short one doesn't; without marks, weak lines at the ends fall away."""
    article = f"<article><p>Short.</p><p>{PROSE}</p></article>"
    assert html.extract(f"<div>Hello there.</div>{article}<div>Bye.</div>") == f"Short. {PROSE.strip()}"
    assert html.extract(f"<div>{PROSE * 8}</div>{article}") == f"{(PROSE * 8).strip()} Short. {PROSE.strip()}"
    assert html.extract(f"<div>Hello there.</div><h1>Head</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p><div>Bye.</div><div>Ta.</div>") == f"Head {PROSE.strip()} Short. {PROSE.strip()}"
    links = "".join(f"<li><a href={i}>A menu entry of some length {i}</a>" for i in range(30))
    assert html.extract(f"<ul>{links}</ul><p>{PROSE}</p><ul>{links}</ul>") == PROSE.strip()


def test_pages_without_the_article_mark():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    for page in pages:
        whole = html.extract(page)
        assert html.extract(re.sub(r"<(/?)article\b", r"<\1div", page)) == whole
        bare = re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1div", page)
        assert html.extract(bare) == whole
        # here the windows leave out what weighs something
        weight = html.weights(html.lines(bare))
        assert len(html.between(weight)) < sum(w > 0 for w in weight)
        assert whole in html.extract(bare.replace(' class="ad"', ""))


def test_long_and_clashing(spark):
    long = f"<article>{''.join(f'<p>{PROSE}{i}</p>' for i in range(20_000))}</article>"
    row = (1, "u", long, "x", "y", "z")
    df = spark.createDataFrame([row, row, (2, None, "<div>" * 50_000 + "deep", "x", "y", "z")], "page_id long, url string, html string, text string, n_chars string, key string")
    got = sorted(tuple(r) for r in html.extract_pages(df).collect())
    want = " ".join(f"{PROSE}{i}" for i in range(20_000))
    assert got == [(1, "u", want, len(want)), (1, "u", want, len(want)), (2, None, "deep", 4)]


def test_hostile_pages_take_linear_time():
    import time

    began = time.process_time()
    for page in ("<a" * 300_000, "<a b='" * 200_000, "<div>" * 100_000 + "</section>" * 100_000, "<p>" + "<div>" * 100_000 + "</p>" * 100_000, "<li><dd>" * 50_000 + "</td>" * 50_000, "<!--" * 200_000, "<" * 500_000, "<svg>" * 100_000):
        assert isinstance(html.extract(page), str)
    assert time.process_time() - began < 30
