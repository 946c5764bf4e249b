"""Main text of pages: layouts that the weights were not fitted on, the given pages, awkward ones."""

from __future__ import annotations

import html
import re
import time

import pytest

from lodestar_market.llm import html_text as H
from tests.llm.awkward import AWKWARD

SCHEMA = "page_id long, url string, html string, text int, n_chars string, extra string"
WEIGHT = H.weights(H.own_counts())

ARTICLE = """<h1>Tides &amp; moons</h1> <p>The moon pulls at the sea, and the sea&nbsp;follows.
 Twice a day it <em>rises</em>, twice it falls.</p><p>Sailors have known <a href="/a">this</a> for a long time; books came later.<br>They still
 do.</p>"""
TEXT = "Tides & moons\n\nThe moon pulls at the sea, and the sea follows. Twice a day it rises, twice it falls.\n\nSailors have known this for a long time; books came later. They still do."

LAYOUTS = [
    "<html><head><title>T</title><style>p{{}}</style><script>if (a<b) x('</p>')</script></head><body><nav><a href=/>Home</a></nav><article>{}</article><footer>Foot of the page</footer></body></html>",
    "<body><div class='site-header'>Daily Tide</div><ul class=menu><li>One<li>Two</ul><div class=content>{}</div><div id=sidebar><p>Many words that stand beside the text and are no part of it at all, not even a little.</p></div></body>",
    "<body><main>{}</main><section id=comments><h3>3 comments</h3><p>I liked this a lot, as I always do when it is about the sea and the moon and the ships.</p></section></body>",
    "<div><a href=1>A</a> <a href=2>B</a> <a href=3>C</a></div><div>{}</div><div><a href=4>D</a></div><div><a href=5>E</a></div>",
    "<body><div class='cookie-notice'>We use cookies to make this site work for you and for all who come here.<button>OK</button></div><div role=navigation>Go here or there</div><article>{}<form><label>Your mail</label><input></form></article><aside>Ad</aside>",
    "<BODY><TABLE><TR><TD><A HREF=x>Index</A><TD><DIV>{}</DIV><TD><A HREF=y>Next</A></TABLE></BODY>",
    "<article class='post'>{}<div class='share-buttons'>Tell your friends</div><ol class='commentlist'><li>Great text, thank you very much for it</ol></article><article class='related'><p>Read next</p></article>",
    "<header><h2>Site</h2></header><article>{}</article><div class='newsletter'>Subscribe to our letter and never miss a tide again</div><!-- <p>old text</p> --><noscript>Turn scripts on</noscript>",
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    assert H.main_text(layout.replace("{}", ARTICLE), WEIGHT) == TEXT


def test_within_the_article():
    """What is no content is left out in the middle too, and does not split the article."""
    body = "<article><header class=entry-header><h1>Head</h1></header><p>{0}</p><div class='ad-slot'>Buy this now</div><p>{0}</p><aside>{0}</aside><p>end<script>x</script>ing</p><figure><svg><text>no</text></svg><figcaption>A ship</figcaption></figure></article>"
    words = "some words of a text that is long enough"
    assert H.main_text(body.format(words), WEIGHT) == f"Head\n\n{words}\n\n{words}\n\nending\n\nA ship"


def test_the_scan_is_linear_and_exact():
    """The region is the best of all contiguous ones."""
    page = H.Page(LAYOUTS[3].replace("{}", ARTICLE))
    score = [WEIGHT[k] * len(w.split()) if k in ("word", "link") else WEIGHT["cut"] if k == "cut" else (WEIGHT.get(w, -1.0) if w == "a" or w not in H._INLINE else 0.0) for k, w, _ in page.events]
    best = max(sum(score[i:j]) for i in range(len(score)) for j in range(i + 1, len(score) + 1))
    begin, end = H.region(page, WEIGHT)
    assert sum(score[begin:end]) == pytest.approx(best, abs=0.1)


def test_weights_come_from_labelled_pages():
    assert all(w > 0 for k, w in WEIGHT.items() if k in ("word", "link"))
    assert all(w < 0 for k, w in WEIGHT.items() if k not in ("word", "link"))
    assert WEIGHT["word"] > WEIGHT["link"] and WEIGHT["a"] < WEIGHT["p"]
    assert sum(H.agreement(H.Page(p), WEIGHT) for p in H.LABELLED) / len(H.LABELLED) > 0.97


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), (" \n\t ", ""), ("just words", "just words"), ("a < b and c > d", "a < b and c > d"), ("<p>one<p>two", "one\n\ntwo"), ("<p>x&#10;y&nbsp;&lt;z&gt; &unknown; &amp;amp;", "x y <z> &unknown; &amp;"),
        ("<script>never", ""), ("<p>seen</p><!-- open", "seen"), ("<p title='>'>q</p>", "q"), ("<p>a<b", "a<b"), ("<br><br>", ""), ("</p></div>x", "x"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"), ("\x00﻿é", "\x00﻿é"),
    ],
)
def test_awkward_pages(source, text):
    assert H.main_text(source, WEIGHT) == text


def test_broken_and_long_pages_take_linear_time():
    for source in ('<a href="' * 30_000, "<a " * 50_000, "<b>" * 50_000 + "x" + "</i>" * 50_000, "<" * 100_000, '<a "<a "' * 20_000, "<li>" * 30_000, "<p>" * 50_000, "<!-- " * 50_000, "<div class=ad>" * 30_000, "<article>x" * 5_000):
        began = time.perf_counter()
        H.main_text(source, WEIGHT)
        assert time.perf_counter() - began < 10, source[:20]
    long = "<div><p>" + "word " * 400_000 + "</p></div>"
    assert len(H.main_text(long, WEIGHT)) == 5 * 400_000 - 1


def given(source):
    """What stands in the one article of a given page."""
    body = re.search(r"<article>(.*?)</article>", source, re.S).group(1)
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:h1|p)>", body))
    return "\n\n".join(b for b in blocks if b)


def test_all_given_pages(spark):
    got = H.op13_main_text(spark, "/root/testdata/sf0.1").collect()
    want = {r["page_id"]: given(r["html"]) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()}
    assert len(got) == len(want)
    assert all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)


def test_repeated_rows_nulls_and_clashing_names(spark):
    rows = [(1, "u", f"<p>{t}" if t is not None else None, 7, "x", "e") for t in AWKWARD] + [(1, None, "<p>again", 7, "x", "e")] * 3 + [(None, None, None, None, None, None)]
    got = H.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert got[0].asDict().keys() == {"page_id", "url", "html", "text", "n_chars", "extra"}
    assert sorted((r["html"] or "", r["text"]) for r in got) == sorted((r[2] or "", H.main_text(r[2], WEIGHT)) for r in rows)
    assert H.extract(spark.createDataFrame([], SCHEMA)).collect() == []
    few = H.extract(spark.createDataFrame([("<p>only",)], "html string"))
    assert [tuple(r) for r in few.collect()] == [("<p>only", "only", 4)]
