"""Main text of web pages as a maximum-scoring subsequence.

A page becomes a sequence of words and tags.  Words score positive and tags
negative, by log-odds of how often each kind stands within and outside the
content of labelled pages; a linear scan finds the contiguous region of the
largest sum.  What is marked as no content (menus, adverts, scripts, comments of
readers and the like) is left out beforehand and only costs its place.

Labelled pages are ``LABELLED`` and, of the input, a bounded sample of the pages
that mark their content with one ``article`` element.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_slices, table

#: Weights are fitted on at most about so many pages of the input.
MAX_LABELLED = 2000
#: Pages that are Python objects at a time, and their bytes.
PAGES, BYTES = 200, 1 << 23
LEAST_WORD, LEAST_TAG = 0.1, 0.01

_NAMES = "[a-zA-Z][^\\s/><]*"
#: Runs within a tag are bounded, so that a page of broken tags takes linear time.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<name>" + _NAMES + r")(?P<attributes>(?:[^\"'<>]{1,4096}+|\"[^\"]{0,4096}+\"|'[^']{0,4096}+'){0,400}+)>"
    r"|<(?P<end2>/?)(?P<name2>" + _NAMES + r")[^<>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Never content, whatever their attributes say.
OUTSIDE = frozenset("head nav aside footer form button select datalist menu dialog noscript template svg canvas object audio video map script style title textarea iframe noembed noframes search fieldset legend".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
#: Words that name what is no content in a class or an id.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot banner sponsor sponsored promo promoted promotion sidebar sidebars sidenav aside rail widget widgets"
    " nav navbar navigation navi menu menus breadcrumb breadcrumbs pagination pager header masthead topbar footer colophon copyright comment comments commentary respond disqus replies discussion"
    " cookie cookies consent gdpr notice notices notification notifications alert alerts modal popup popover overlay toast newsletter subscribe subscription signup login signin register paywall"
    " share sharing sharebar social follow related recommended recommendations trending popular search toolbar hidden skip skiplink".split()
)
#: The same as the beginning or the end of a longer word.
MARK_BEGINS = ("comment", "sidebar", "cookie", "advert", "newsletter", "breadcrumb", "pagination")
MARK_ENDS = ("menu", "navbar", "sidebar", "banner", "footer", "comments", "advert")
#: Before such a word it only says what the page has elsewhere or is about.
ABOUT = frozenset("has with no without show is not tag tags category type topic".split())
#: A header of these is the article's own.
OWN = frozenset("article post entry story content page".split())
#: A start tag of the first ends an open element of the second.
_ENDED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
_INLINE = frozenset("a b i em strong span small u s sub sup code q cite mark font label abbr time tt big del ins kbd samp var bdi bdo data".split())

#: Pages with their content marked by ``data-content``.
LABELLED = (
    """<html><body><div id=top><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a> <a href=/w>Weather</a></div><div><div data-content><h1>Bridge opens after two years</h1><p>The new bridge
    over the river was opened on Monday, two years after work began. <b>Traffic</b> moved slowly in the first hours.</p><p>Engineers said that the <a href=/x>old bridge</a> will be taken down next spring.</p><p>A second
    lane follows later.</p></div><div><h3>More</h3><ul><li><a href=/1>Rain expected</a><li><a href=/2>Shop closes</a><li><a href=/3>Team wins again</a></ul></div></div><div>All rights reserved. <a href=/i>Imprint</a></div></body></html>""",
    """<table width=100%><tr><td><a href=a>Index</a><br><a href=b>Archive</a><br><a href=c>Links</a></td><td data-content><h2>On keeping bees</h2><p>Bees need water close by, shade at noon and a keeper who is patient.</p>
    <blockquote>Nothing is won by haste.</blockquote><ul><li>Look into the hive once a week.</li><li>Feed them when it is cold.</li></ul><p>In autumn the colony grows smaller, which is no cause for worry.</p></td>
    <td><a href=d>Visitors</a><br><a href=e>Guest book</a></td></tr><tr><td colspan=3><a href=f>Mail</a> Last changed in May</td></tr></table>""",
    """<body><nav><ul><li><a href=/>Start</a><li><a href=/t>Topics</a></ul></nav><main><article data-content><h1>How glaciers move</h1><p>Ice flows under its own weight. Near the ground it slides on a film of water.</p>
    <div class=ad>Buy boots now</div><p>Measured from above, some glaciers move a metre a day.</p><figure><img src=g.jpg><figcaption>A glacier in summer</figcaption></figure><h2>Why it matters</h2><p>Sea levels depend on it.</p>
    <table><tr><th>Year</th><th>Metres</th></tr><tr><td>1990</td><td>12</td></tr></table></article></main><aside><a href=/r>Read this too</a></aside><footer>Contact Press</footer></body>""",
    """<div><span>Menu</span><a href=1>One</a><a href=2>Two</a><a href=3>Three</a></div><div><p><a href=/l>Log in</a></p></div><div data-content><div>Stir the flour into the milk until it is smooth, then let it rest for half an hour.</div><div>Heat
    the pan. Pour in a thin layer and turn it once the edges are brown.</div><div>Serve at once.</div></div><div><div><a href=4>Soups</a></div><div><a href=5>Cakes</a></div><div><a href=6>Bread</a></div><div>Site map</div></div>""",
    """<body><header><a href=/>Logo</a></header><section><div><p>This site stores settings in your browser.</p><a href=#>Fine</a></div></section><section data-content><h1>Council votes on trees</h1><p>The council has voted to
    plant four hundred trees. The <a href=/v>vote</a> was close, and two members left before it.</p><ol><li>Oak and lime come first.</li><li>Streets follow in <a href=/y>the next year</a>.</li></ol><p>Costs are met by the county.</p>
    <pre>oak 200 lime 200</pre></section><section><h4>Latest</h4><div><a href=/7>Fire in mill</a></div><div><a href=/8>Road closed</a></div></section><footer><ul><li>Terms<li>Jobs</ul></footer></body>""",
)


def _marked(name: str, attributes: str) -> bool:
    """Whether a start tag says that what follows is no content."""
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            for one in value.split():
                parts = [p.lower() for p in _PART.findall(one)]
                for n, part in enumerate(parts):
                    if (part in MARKS or part.startswith(MARK_BEGINS) or part.endswith(MARK_ENDS)) and not (n and parts[n - 1] in ABOUT) and not (part == "header" and (OWN & set(parts) or name in ("h1", "h2", "h3"))):
                        return True
        elif key == "role":
            if value.lower() in ROLES:
                return True
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
    return False


class Page:
    """A page as events: ("word", text, article), ("tag", name, article) and ("cut", name, article).

    ``article`` is the number of the innermost open ``article`` element, or 0;
    ``labelled`` tells which events lie in an element with ``data-content``.
    """

    def __init__(self, source: str):
        self.events: list[tuple[str, str, int]] = []
        self.labelled: list[bool] = []
        self.outside: Counter = Counter()  # kinds of what was left out
        self.articles = 0
        self._stack: list[tuple[str, bool, bool, int]] = []  # name, left out, labelled, article
        self._open: Counter = Counter()
        self._read(source)

    def _state(self) -> tuple[bool, bool, int]:
        return self._stack[-1][1:] if self._stack else (False, False, 0)

    def _pop_to(self, name: str) -> None:
        while self._stack:
            last = self._stack.pop()[0]
            self._open[last] -= 1
            if last == name:
                return

    def _implied_ends(self, name: str) -> None:
        if name in BLOCKS and self._open["p"] and name not in _ENDED:
            # A block ends an open paragraph, but not one outside of what it lies in.
            for depth in range(len(self._stack) - 1, -1, -1):
                if self._stack[depth][0] == "p":
                    self._pop_to("p")
                    break
                if self._stack[depth][0] not in _INLINE:
                    break
        ended, scope = _ENDED.get(name), _SCOPE.get(name, ())
        if ended and any(self._open[e] for e in ended):
            for depth in range(len(self._stack) - 1, -1, -1):
                here = self._stack[depth][0]
                if here in scope:
                    break
                if here in ended:
                    self._pop_to(here)
                    if here == "tr" or name != "tr":
                        break

    def _text(self, text: str) -> None:
        out, labelled, article = self._state()
        if out:
            self.outside["link" if self._open["a"] else "word"] += len(text.split())
        else:
            self.events.append(("link" if self._open["a"] else "word", html.unescape(text) if "&" in text else text, article))
            self.labelled.append(labelled)

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            found = _TOKEN.search(source, at)
            if not found:
                self._text(source[at:])
                return
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            name = found["name"] or found["name2"]
            if not name:
                continue
            name = name.lower()
            if found["end"] or found["end2"]:
                self._event(name)
                if self._open[name] > 0:
                    self._pop_to(name)
                continue
            self._implied_ends(name)
            attributes = found["attributes"] or ""
            out, labelled, article = self._state()
            leaves = not out and (name in OUTSIDE or (name == "header" and not article and not self._open["main"]) or _marked(name, attributes))
            if leaves and name not in VOID:
                self.events.append(("cut", name, article))
                self.labelled.append(labelled)
            if name == "article" and not out and not leaves:
                self._event(name)
                self.articles += 1
                article = self.articles
            elif not leaves:
                self._event(name)
            if name in RAW:
                end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(source, at)
                at = n if not end else end.start()
                if not end:
                    return
            if name in VOID:
                continue
            self._stack.append((name, out or leaves, labelled or "data-content" in attributes, article))
            self._open[name] += 1

    def _event(self, name: str) -> None:
        out, labelled, article = self._state()
        if out:
            self.outside[name] += 1
        else:
            self.events.append(("tag", name, article))
            self.labelled.append(labelled)


def kinds(page: Page, inside: list[bool]) -> tuple[Counter, Counter]:
    """How often each kind stands within and outside of the content."""
    within, without = Counter(), Counter(page.outside)
    for (kind, what, _), into in zip(page.events, inside, strict=True):
        count = within if into else without
        if kind in ("word", "link"):
            count[kind] += len(what.split())
        else:
            count[kind if kind == "cut" else what] += 1
    return within, without


def weights(*labelled: tuple[Counter, Counter]) -> dict[str, float]:
    """Log-odds of each kind, from the mean of the shares in each set of labelled pages."""
    every = sorted(set().union(*[set(c) for pair in labelled for c in pair]) | {"word", "link", "cut"})

    def share(side: int, kind: str) -> float:
        return sum((pair[side][kind] + 0.5) / (pair[side].total() + 0.5 * len(every)) for pair in labelled) / len(labelled)

    out = {}
    for kind in every:
        odds = math.log(share(0, kind) / share(1, kind))
        out[kind] = max(odds, LEAST_WORD) if kind in ("word", "link") else min(odds, -LEAST_TAG)
    # Words of a page come in crowds, so their odds say too much: the factor that suits the labelled pages best.
    pages = [Page(p) for p in LABELLED]
    factor = max((1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3), key=lambda f: (sum(agreement(p, out | {"word": f * out["word"]}) for p in pages), f))
    return out | {"word": max(factor * out["word"], LEAST_WORD)}


def agreement(page: Page, weight: dict[str, float]) -> float:
    """Words of the region that are labelled, as F1."""
    begin, end = region(page, weight)
    sizes = [len(what.split()) if kind in ("word", "link") else 0 for kind, what, _ in page.events]
    both = sum(n for n, into in zip(sizes[begin:end], page.labelled[begin:end], strict=True) if into)
    return 2 * both / max(1, sum(sizes[begin:end]) + sum(n for n, into in zip(sizes, page.labelled, strict=True) if into))


def own_counts() -> tuple[Counter, Counter]:
    """The counts of ``LABELLED``."""
    pairs = [kinds(p, p.labelled) for p in map(Page, LABELLED)]
    return sum((a for a, _ in pairs), Counter()), sum((b for _, b in pairs), Counter())


def region(page: Page, weight: dict[str, float]) -> tuple[int, int]:
    """The contiguous events of the largest sum of scores (of equal ones the first), widened to whole blocks."""
    unknown = min((w for k, w in weight.items() if k in BLOCKS), default=-1.0)
    best, begin, end, total, start = 0.0, 0, 0, 0.0, 0
    for n, (kind, what, _) in enumerate(page.events):
        if kind in ("word", "link"):
            total += weight[kind] * len(what.split())
        elif kind == "cut":
            total += weight["cut"]
        elif what == "a" or what not in _INLINE:
            total += weight.get(what, unknown if what in BLOCKS else -LEAST_TAG)
        if total <= 0:
            total, start = 0.0, n + 1
        elif total > best:
            best, begin, end = total, start, n + 1
    if best <= 0:
        return 0, 0
    ends_block = [kind == "tag" and what in BLOCKS for kind, what, _ in page.events]
    while begin and not ends_block[begin - 1]:
        begin -= 1
    while end < len(page.events) and not ends_block[end]:
        end += 1
    return begin, end


def main_text(source: str | None, weight: dict[str, float]) -> str:
    """The content of a page: its blocks, joined by two line feeds."""
    page = Page(source or "")
    begin, end = region(page, weight)
    held = {article for kind, what, article in page.events[begin:end] if kind in ("word", "link") and what.strip()}
    if len(held) == 1 and (only := held.pop()):
        # The region lies in one article element: its other blocks belong to it.
        places = [n for n, e in enumerate(page.events) if e[2] == only]
        begin, end = min(begin, places[0]), max(end, places[-1] + 1)
        page.events = [e if e[2] == only or e[0] == "tag" else ("cut", "", e[2]) for e in page.events[:end]]
    blocks, parts = [], []
    for kind, what, _ in page.events[begin:end]:
        if kind in ("word", "link"):
            parts.append(what)
        elif kind == "tag" and what == "br":
            parts.append(" ")
        elif what in BLOCKS:
            blocks.append(" ".join("".join(parts).split()))
            parts = []
    blocks.append(" ".join("".join(parts).split()))
    return "\n\n".join(b for b in blocks if b)


def _pages(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for part in bounded_slices(batch, column, PAGES, BYTES):
            yield part, part.column(column).to_pylist()


def fit(pages: DataFrame, most: int = MAX_LABELLED) -> dict[str, float]:
    """Weights from ``LABELLED`` and from a bounded sample of pages with one article element."""
    some = pages.where(F.col("html").rlike("(?i)<article[\\s>]"))
    share = int(min(1.0, most / max(1, some.count())) * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Counter()
        for _, sources in _pages(batches, "html"):
            for page in map(Page, sources):
                if page.articles == 1:
                    for inside, counted in zip((True, False), kinds(page, [bool(e[2]) for e in page.events]), strict=True):
                        sums.update({(kind, inside): n for kind, n in counted.items()})
        if sums:
            # Kinds that HTML doesn't know, of which there may be any number, are of no use.
            rows = [(k, i, n) for (k, i), n in sums.items() if k in BLOCKS or k in _INLINE or k in VOID or k in ("word", "link", "cut")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names=["kind", "inside", "n"])

    drawn = some.where(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < share).select("html")
    sums = drawn.mapInArrow(count, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()
    sides = tuple(Counter({r["kind"]: r["n"] for r in sums if r["inside"] is inside}) for inside in (True, False))
    return weights(own_counts(), sides) if sides[0] and sides[1] else weights(own_counts())


def extract(pages: DataFrame, weight: dict[str, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The rows of ``pages``, or their columns ``keep``, with text and n_chars (its code points).

    A null or empty page, or one without words of content, has an empty text.
    Character references are decoded, white space within a block is one space,
    blocks are joined by two line feeds.  Rows that repeat come back each; other
    columns stay, and one with a name of the two is replaced.  Weights are fitted
    on the pages unless given.
    """
    weight = weight or fit(pages)
    kept = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sources in _pages(batches, "_source"):
            texts = [main_text(s, weight) for s in sources]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"])

    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("none")]).alias("row"), F.col("html").alias("_source"))
    schema = rows.select("row", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return rows.mapInArrow(read, schema).select(*[F.col(f"row.`{c}`") for c in kept], "text", "n_chars")


def op13_main_text(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 13 over the whole of ``pages``."""
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
