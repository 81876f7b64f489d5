import itertools

import numpy as np

from tidewatch.llm import pages

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Home</a> <a href=/x>About</a></header><div class="cookie-notice">We use cookies here. Accept them all now, please.</div>
<nav><ul><li><a href="/a">alpha</a></li><li><a href="/b">beta</a></li></ul></nav><!-- ad --><div class="ad">Buy this thing today, it is very cheap.</div>
<article><h1>Head &amp;&amp; line</h1><p><b>First   paragraph &lt;here&gt;, with
words.<br><p>Second&nbsp;one.</p><form>Name <input name=q> <button>Send</button> please fill in</form><p>Last.</article>
<div id="comments"><h3>Comments</h3><p>I liked this article very much, thank you for writing it!</p></div>
<aside><p>Related: another long text that goes on and on, about something else.</p></aside><footer>&copy; someone</footer></body></html>"""


def test_article_only():
    assert pages.main_text(PAGE) == "Head && line\nFirst paragraph <here>, with words.\nSecond one.\nLast."


def test_cases():
    assert pages.main_text(None) == "" and pages.main_text("") == "" and pages.main_text("<p></p>") == ""
    assert pages.main_text("plain text only") == "plain text only"
    assert pages.main_text("<p>open <b \"x") == "open <b \"x"
    assert pages.main_text("</p></div><p>stray ends.</p></b>") == "stray ends."
    assert pages.main_text("<script>var a = 1;") == ""
    assert pages.main_text("<div><p>" + "word " * 100_000 + "</p></div>") == ("word " * 100_000).strip()
    assert len(pages.main_text("<div>" * 3000 + "<p>Deep text, here it is.</p>")) == 22
    assert pages.main_text("<p>Twice.</p><p>Twice.</p>") == "Twice.\nTwice."


def test_names_of_wrappers_and_heads():
    html = ('<body class="home has-sidebar nav-fixed"><div id="page" class="search-page"><article class="post"><header class="entry-header">'
            '<h1>Title</h1></header><div class="entry-content"><p>Prose of the article, a sentence.</p></div><footer class="entry-footer">'
            '<p>Filed under something or other.</p></footer></article><div class="sidebar"><p>Other things that one may read, too.</p></div></div></body>')
    assert pages.main_text(html) == "Title\nProse of the article, a sentence."


def test_div_soup_without_article():
    html = ('<div id=top><a href=/>Home</a> <a href=/n>News</a></div><div><p>A long first paragraph of prose, which says something.</p>'
            '<p>Short.</p><p>Another paragraph of prose that says something else, too.</p></div><div class="share">Share this on everything</div>')
    assert pages.main_text(html) == ("A long first paragraph of prose, which says something.\nShort.\n"
                                     "Another paragraph of prose that says something else, too.")


def test_cut_is_minimal():
    rng = np.random.RandomState(0)
    for _ in range(60):
        n = int(rng.randint(1, 8))
        unary = rng.randn(n).round(2) * 2
        edges = [(a, b, float(rng.rand().__round__(2))) for a, b in itertools.combinations(range(n), 2) if rng.rand() < 0.5]
        f = pages.Flow(n + 2)
        for i, u in enumerate(unary):
            f.edge(0, i + 2, float(u)) if u > 0 else f.edge(i + 2, 1, float(-u))
        for a, b, w in edges:
            f.edge(a + 2, b + 2, w, w)

        def cost(keep):
            return (sum(u for u, k in zip(unary, keep) if u > 0 and not k) - sum(u for u, k in zip(unary, keep) if u < 0 and k)
                    + sum(w for a, b, w in edges if keep[a] != keep[b]))

        got = f.run()[2:]
        assert abs(cost(got) - min(map(cost, itertools.product([False, True], repeat=n)))) < 1e-6


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", PAGE, "x", "y"), (1, "u", PAGE, "x", "y"), (2, None, None, "x", "y"), (None, "v", "", "x", "y")]
    got = pages.extract(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] == "" for r in got] == [False, False, True, True]
    assert pages.extract(spark.createDataFrame([], schema)).collect() == []
