"""Extraction against generated pages whose article is known, and hostile pages."""

import html
import random
import time

import pytest
from pyspark.sql import functions as F

from replayframe.llm.html_extract import extract, extract_html

WORDS = "lorem ipsum été straße año dolor & < > sit amet consectetur  x".split(" ")


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).strip() + rng.choice([".", ", and more.", "!"])


def mess(rng, text):
    """HTML of a text: references, inline tags and white space that mean nothing."""
    out = []
    for w in text.split(" "):
        w = html.escape(w)
        out.append(rng.choice([w, w, w, f"<b>{w}</b>", f"<em class='notice-free'>{w}</em>", f"<span>{w}<!-- , --></span>"]))
    return rng.choice([" ", "\n  ", "\t"]).join(out)


def page(rng):
    """A page and the blocks of its article."""
    blocks, body = [], []

    def add(tag, text, attributes=""):
        blocks.append(" ".join(text.split()))
        return f"<{tag}{attributes}>{mess(rng, text)}" + ("" if tag in ("p", "li") and rng.random() < 0.3 else f"</{tag}>")

    title = add("h1", sentence(rng, 4))
    for _ in range(rng.randint(2, 7)):
        kind = rng.random()
        if kind < 0.6:
            body.append(add("p", sentence(rng, rng.randint(8, 60)), rng.choice(["", ' class="search-results-study"', " id='side-by-side'", ' data-x="a>b"'])))
        elif kind < 0.7:
            body.append(add("h2", sentence(rng, 3)))
            body.append(add("p", sentence(rng, 30)))
        elif kind < 0.8:
            body.append("<ul>" + "".join(add("li", sentence(rng, 6)) for _ in range(3)) + "</ul>")
        elif kind < 0.9:
            body.append("<figure><img src=x>" + add("figcaption", sentence(rng, 5)) + "</figure>")
        else:
            body.append("<blockquote>" + add("p", sentence(rng, 20)) + "</blockquote>")
    body.append(add("p", sentence(rng, 90)))
    aside = rng.choice(['<aside>one, two, three. Four.</aside>', '<div class="ad">buy, now, here.</div>', "<script>if (a < b) { x = '</p>' }</script>", '<div class="related-links"><a href=x>other, story</a></div>', ""])
    body.insert(rng.randrange(len(body)), aside)
    inner = "".join(body)
    shape = rng.randrange(4)
    if shape == 0:
        main = f"<article>{title}{inner}</article>"
    elif shape == 1:
        main = f"<main class='with-sidebar'><article><header>{title}</header>{inner}<footer>by, me.</footer></article></main>"
    elif shape == 2:
        main = f"<div id=content class=has-sidebar>{title}<div class=body>{inner}</div></div>"
    else:
        main = f"<form id=aspnet><div class=outer><div class=story>{title}{inner}</div></div><input value=x></form>"
    menu = "<ul>" + "".join(f"<li><a href=/{k}>item, {k}</a>" for k in range(8)) + "</ul>"
    top = rng.choice([f"<nav>{menu}</nav>", f"<header><div class=logo>Site.</div>{menu}</header>", f"<div id='main-menu'>{menu}</div>", f"<div>{menu}</div>"])
    end = rng.choice(["<footer>&copy; me, you.</footer>", "<div class='site-footer'>about, us.</div>", "<div class='comments'>" + "<p>A very long, nice, reader comment. " * 40 + "</div>"])
    notice = rng.choice(["", "<div class='cookie-banner'>We use cookies, always. Yes.</div>", "<noscript>Turn on, scripts.</noscript>", "<div hidden>not, seen.</div>"])
    return f"<!DOCTYPE html><html><head><title>t, t</title><style>p > a {{}}</style></head><body>{notice}{top}{main}{end}</body></html>", "\n\n".join(blocks)


def test_generated_pages_are_exact(spark):
    rng = random.Random(9)
    made = [page(rng) for _ in range(200)]
    rows = [(k, h, "own", "own", "own") for k, (h, _) in enumerate(made)]
    got = extract_html(spark.createDataFrame(rows, "page_id long, html string, text string, __row string, __html string"))
    assert sorted(got.columns) == sorted(["page_id", "html", "__row", "__html", "text"])
    found = {r["page_id"]: r for r in got.collect()}
    for k, (h, want) in enumerate(made):
        assert found[k]["text"] == want, h
        assert (found[k]["html"], found[k]["__row"], found[k]["__html"]) == (h, "own", "own")


@pytest.mark.parametrize("piece", ["<a '", "<a href='", '<a b="', "<div>", "<div></i>", "<p>", "<b>", "<!--", "<", "&amp;", "<table><tr><td>x", "<script>", "<ul><li>x", "<div class='ad x'>"])
def test_long_hostile_pages(piece):
    began = time.perf_counter()
    extract(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 12  # quadratic time would take minutes


def test_small_pages(spark):
    assert extract(None) == extract("") == extract(" \n ") == extract("<nav>x</nav>") == ""
    assert extract("just < text") == "just < text"
    assert extract("<p>&am<b>p; x</b></p>") == "&amp; x"
    assert extract("<p>one<p>two") == "one\n\ntwo"
    assert extract("<p>a<br>b</p><pre>c\n d</pre>") == "a b\n\nc d"
    assert extract("<article><p>First, here.</p><article class='comment'><p>Reader, here, too.</p></article></article>") == "First, here."
    assert extract('<p title="a>b" class=x>hi</p>') == "hi"
    empty = spark.createDataFrame([], "page_id long, html string")
    assert extract_html(empty).count() == 0
    both = spark.createDataFrame([(1, "<p>x</p>"), (1, "<p>x</p>"), (None, None)], "page_id long, html string").select("page_id", F.col("html").alias("text"))
    assert sorted(map(repr, extract_html(both, "text").collect())) == sorted(["Row(page_id=1, text='x')", "Row(page_id=1, text='x')", "Row(page_id=None, text='')"])


ARTICLE = "<h1>Title here.</h1><p>First paragraph, with words, and more words to read. It goes on and on.</p>{}<p>Second paragraph, again with words, enough to be long.</p>"
SHAPES = ["<html><body><article>%s</article></body></html>", "<html><body><div id=content>%s</div><div><a href=x>other</a></div></body></html>"]
WHOLE = "Title here.\n\nFirst paragraph, with words, and more words to read. It goes on and on.\n\nSecond paragraph, again with words, enough to be long."


@pytest.mark.parametrize("shape", SHAPES)
def test_marks_inside_the_article(shape):
    texts = (
        "ad-slot google-ad advert-unit sponsored-content post-comments comment-body gdpr-message subscribe-cta post-footer entry-footer dfp-ad td-ad-wrap "
        "fb-comments commentThread site-notice privacy-notice main-nav-bar taboola-widget js-ad ad-300x250 article-comments newsletter-box cookie-law-info"
    )
    for name in texts.split():
        for inner in ("<p>Buy this now, please, it is very good. Really it is.</p>", "<a href=x>one, two</a> <a href=y>three</a>"):
            assert extract(shape % ARTICLE.format(f"<div class='{name}'>{inner}</div>")) == WHOLE, name
    for name in "post-navigation right-rail related-posts related-articles post-share social-links share-tools more-related-things".split():
        inner = "<ul><li><a href=x>one, two, three</a><li><a href=y>four</a></ul>"
        if name != "more-related-things":
            assert extract(shape % ARTICLE.format(f"<div class='{name}'>{inner}</div>")) == WHOLE, name
    for name in "search-results-study has-sidebar no-ads content-with-sidebar advertising-history market-share side-by-side related-work comment-on-law cookie-free".split():
        assert "Real text" in extract(shape % ARTICLE.format(f"<div class='{name}'><p>Real text of the article, all of it.</p></div>")), name


def test_wrappers_headers_and_steps():
    p = "<p>Some long paragraph, with commas, and text. More of it here.</p>"
    t = "Some long paragraph, with commas, and text. More of it here."
    assert extract(f"<body><form action=x><h2>Head</h2><div>{p * 2}</div></form></body>") == f"Head\n\n{t}\n\n{t}"
    assert extract(f"<body><div class=header><div>Logo</div><h1>The headline</h1></div><div class=content>{p * 2}</div><div class=footer>foot</div></body>") == f"The headline\n\n{t}\n\n{t}"
    assert extract(f"<article><header><p>By Someone</p></header>{p}</article>") == f"By Someone\n\n{t}"
    assert extract(f"<article>{p}<menu><li>Step one, do it.<li>Step two.</menu></article>") == f"{t}\n\nStep one, do it.\n\nStep two."
    assert extract(f"<header><h1><a href=/>Site</a></h1><nav><a>x</a></nav></header><article>{p}</article>") == t
    assert extract(f"<header><h1>Site name</h1></header><article><h1>Real</h1>{p}</article>") == f"Real\n\n{t}"
