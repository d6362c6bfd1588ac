"""Main text of pages in layouts that training pages do not show, with hand-written truth."""

import time

import pytest

from proofline.llm import html_extract as h
from tests.llm.test_archives_and_pages import site  # noqa: F401

W = "The old harbour lay quiet in the morning, and boats came in one by one, with fish for the market. "
P1, P2, P3 = W * 2, "Later that day " + W * 3, "In the end " + W
c = lambda t: " ".join(t.split())
NAV = "<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a><li><a href=/c>Contact</a></ul></nav>"
FOOT = "<footer><p>&copy; 2024 All rights reserved</p></footer>"
page = lambda body: f"<html><head><title>t</title></head><body>{NAV}{body}{FOOT}</body></html>"
join = lambda *t: "\n\n".join(c(x) for x in t)
LAYOUTS = {
    "list": (page(f"<article><h1>A title here</h1><p>{P1}</p><ul><li>first thing to know<li>second thing to know about the boats</ul><p>{P2}</p></article>"), join("A title here",P1,"first thing to know","second thing to know about the boats",P2)),
    "ordered": (page(f"<article><h1>A title here</h1><p>{P1}</p><ol><li>{P3}</li><li>Then leave the harbour.</li></ol></article>"), join("A title here",P1,P3,"Then leave the harbour.")),
    "definitions": (page(f"<article><h1>Words</h1><p>{P1}</p><dl><dt>harbour<dd>a place where boats are safe from the sea</dl><p>{P3}</p></article>"), join("Words",P1,"harbour","a place where boats are safe from the sea",P3)),
    "quote": (page(f"<article><h1>A title</h1><p>{P1}</p><blockquote>{P3}</blockquote><p>{P2}</p></article>"), join("A title",P1,P3,P2)),
    "quote with paragraphs": (page(f"<article><h1>A title</h1><p>{P1}</p><blockquote><p>{P3}</p></blockquote><p>{P2}</p></article>"), join("A title",P1,P3,P2)),
    "pre": (page(f"<article><h1>A title</h1><p>{P1}</p><pre>for boat in harbour:\n    boat.leave()</pre><p>{P2}</p></article>"), join("A title",P1,"for boat in harbour: boat.leave()",P2)),
    "caption": (page(f"<article><h1>A title</h1><p>{P1}</p><figure><img src=x><figcaption>Boats in the morning, seen from the north.</figcaption></figure><p>{P2}</p></article>"), join("A title",P1,"Boats in the morning, seen from the north.",P2)),
    "own header": (page(f"<article><header><h1>A long title about the harbour</h1></header><p>{P1}</p><p>{P2}</p></article>"), join("A long title about the harbour",P1,P2)),
    "class words": (page(f"<main><div class='related-news-body'><h1>A title</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div></main>"), join("A title",P1,P2,P3)),
    "section of notice": (page(f"<article><h1>A title</h1><section class='notice-of-birth'><p>{P2}</p><p>{P1}</p></section></article>"), join("A title",P2,P1)),
    "table": (page(f"<article><h1>A title</h1><p>{P1}</p><table><tr><th>Boat</th><th>Fish landed</th></tr><tr><td>The old one</td><td>forty boxes of herring</td></tr></table><p>{P2}</p></article>"), join("A title",P1,"Boat","Fish landed","The old one","forty boxes of herring",P2)),
    "subheads": (page(f"<article><h1>A title</h1><p>{P1}</p><h2>The second part</h2><p>{P2}</p><h3>And the third</h3><p>{P3}</p></article>"), join("A title",P1,"The second part",P2,"And the third",P3)),
    "comments": (page(f"<article><h1>A title</h1><p>{P1}</p><p>{P2}</p></article><section class=comments><div class=comment><p>I liked this one, thanks.</p></div><div class=comment><p>{P3}</p></div></section>"), join("A title",P1,P2)),
    "plain div": (page(f"<div class=content><h1>A title</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div><div class=sidebar><ul><li><a href=/x>Other news</a></ul></div>"), join("A title",P1,P2,P3)),
    "advert inside": (page(f"<article><h1>A title</h1><p>{P1}</p><div class=ad><p>Buy two, get one</p></div><p>{P2}</p><aside><p>Read more here</p></aside></article>"), join("A title",P1,P2)),
}


@pytest.fixture(scope="module")
def extractor(spark, site):  # noqa: F811
    return h.learn_extractor(site)


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(extractor, name):
    html, want = LAYOUTS[name]
    assert extractor.texts([html]) == [want]


def test_class_words_never_empty_a_page_of_running_text(extractor):
    for words in ("ad", "comment-body", "menu content", "share", "promo story", "notice", "legal text"):
        (got,) = extractor.texts([page(f"<main><div class='{words}'><h1>A title</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div></main>")])
        assert c(P2) in got and c(P3) in got, words


@pytest.mark.parametrize("html", [
    "<div>" * 20_000 + "x", "<p><button>" + "<div>" * 20_000, "<li>" + "<b>" * 20_000 + "</i>" * 20_000,
    "<p>" + "<a href=x>" * 20_000 + "</p>" * 20_000, "<table>" * 10_000 + "<td>" * 10_000,
])
def test_parsing_time_grows_with_the_page(html):
    began = time.process_time()
    h.parse(html)
    assert time.process_time() - began < 1


def test_ties_of_odds_are_kept_and_null_urls_stay(spark, extractor):
    assert h.decode([-1, 0, 0], h.np.array([0.0, 0.0, -0.1]), h.np.ones(3)) == [True, True, False]
    df = spark.createDataFrame([(1, None, "<article><p>" + P1), (1, None, "<article><p>" + P1)], "page_id long, url string, html string")
    assert [r.url for r in h.extract_text(df, extractor).collect()] == [None, None]
