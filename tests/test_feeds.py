"""Feeds, URLs, many terms: small and awkward inputs."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestar_market.operators import monitoring as M
from lodestar_market.operators.terms import term_hits, term_numbers, term_sum
from lodestar_market.operators.urls import canonical_url
from lodestar_market.sources.feeds import feed_time, parse_feed


@pytest.mark.parametrize(
    ("text", "utc"),
    [
        ("Mon, 05 Jan 2026 10:00:00 +0700", "2026-01-05 03:00:00"), ("5 Jan 26 10:00 GMT", "2026-01-05 10:00:00"), ("Thu, 31 dec 1998 23:59:59 EST", "1999-01-01 04:59:59"),
        ("Tue, 06 Jan 2026 10:00:00 -07:30", "2026-01-06 17:30:00"), ("2026-01-05T10:00:00+07:00", "2026-01-05 03:00:00"), ("2026-01-05T10:00:00+0700", "2026-01-05 03:00:00"), ("2026-01-05T10:00:00Z", "2026-01-05 10:00:00"),
        ("2026-01-05 10:00:00.250", "2026-01-05 10:00:00.250"), ("2026-01-05", "2026-01-05 00:00:00"), (" 7 Feb 2024 1:02 ", "2024-02-07 01:02:00"), ("31 Feb 2024 10:00 GMT", None), ("5 Xyz 2026 10:00 GMT", None),
        ("5 ebm 2026 10:00 GMT", None), ("yesterday", None), ("", None), (None, None), ("12", None), ("2026", None),
    ],
)
def test_feed_dates(spark, text, utc):
    got = spark.createDataFrame([(text,)], "t string").select(feed_time(F.col("t")).alias("t")).first()["t"]
    assert got == (dt.datetime.fromisoformat(utc) if utc else None)


def test_shapes_of_feeds(spark):
    payloads = [
        (1, "<rss><channel><item><title>a &amp; b</title><link>l1</link><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate><description>d</description></item><item><title>two</title><guid>g2</guid></item></channel></rss>"),
        (2, '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">x</title><link rel="edit" href="e"/><link href="alt"/><published>2026-01-05T10:00:00Z</published><content type="text">body</content></entry></feed>'),
        (3, '<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><channel><title>c</title></channel><item><title>r</title><link>l3</link><dc:date>2026-01-05T10:00:00+01:00</dc:date></item></rdf:RDF>'),
        (4, "<rss><channel><item><title>cut"), (5, "no xml at all"), (6, ""), (7, None), (8, "<rss><channel/></rss>"), (9, "<feed><entry><id>only</id></entry></feed>"),
    ]
    rows = parse_feed(spark.createDataFrame(payloads, "n int, xml string"), "xml", "n").collect()
    got = sorted(((r["n"], r["kind"], r["title"], r["link"], r["published_at"], r["status"]) for r in rows), key=repr)
    at = dt.datetime(2026, 1, 5, 10)
    want = [
        (1, "rss", "a & b", "l1", at, "ok"), (1, "rss", "two", "g2", None, "undated"), (2, "atom", "x", "alt", at, "ok"), (3, "rss", "r", "l3", at - dt.timedelta(hours=1), "ok"),
        (4, None, None, None, None, "corrupt"), (5, None, None, None, None, "corrupt"), (6, None, None, None, None, "corrupt"), (7, None, None, None, None, "empty"), (8, None, None, None, None, "empty"), (9, "atom", None, "only", None, "undated"),
    ]
    assert got == sorted(want, key=repr)
    assert {r["description"] for r in rows if r["n"] in (1, 2)} == {"d", None, "body"}


@pytest.mark.parametrize(
    ("url", "one"),
    [
        ("HTTP://User:pw@Example.COM:80/a/b/?b=2&a=1&utm_source=x#top", "http://example.com/a/b?a=1&b=2"), ("https://example.com:8443/", "https://example.com:8443"), ("https://example.com./x?ref=y", "https://example.com/x"),
        ("https://example.com/?reference=y&REF=z&&", "https://example.com?reference=y"), ("  /only/a/path#x ", "/only/a/path#x"), ("", ""), (None, None), ("mailto:a@b", "mailto:a@b"), ("https://e.com/a?q=http://x/?y#z", "https://e.com/a?q=http://x/?y"),
        ("https://e.com/Ünï?b&a", "https://e.com/Ünï?a&b"),
    ],
)
def test_canonical_urls(spark, url, one):
    assert spark.createDataFrame([(url,)], "u string").select(canonical_url(F.col("u")).alias("u")).first()["u"] == one


def test_thousands_of_terms_in_one_pass(spark):
    """The automaton finds what single tests find; five thousand terms cost little more than fifty."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(2, 6))) for _ in range(8000)]
    terms = rng.sample(words, 5000) + ["", "a", "a"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 300))) for _ in range(400)] + ["", None]
    df = spark.createDataFrame(enumerate(texts), "n int, t string")
    got = {r["n"]: (r["hits"], r["sum"]) for r in df.select("n", term_hits(F.col("t"), terms).alias("hits"), term_sum(F.col("t"), [(t, 0.5) for t in terms]).alias("sum")).collect()}
    for n, text in enumerate(texts):
        want = None if text is None else [t for t in terms if t in text]
        assert got[n] == (want, None if text is None else len(want) / 2)
    many = df.crossJoin(spark.range(20)).select("t").repartition(8).cache()
    many.count()

    def seconds(some):
        began = time.perf_counter()
        many.select(F.size(term_numbers(F.col("t"), some)).alias("n")).agg(F.sum("n")).collect()
        return time.perf_counter() - began

    seconds(terms[:50])
    assert seconds(terms) < 6 * seconds(terms[:50]) + 2
    assert [r[0] for r in df.select(term_numbers(F.col("t"), []).alias("x")).limit(2).collect()] == [[], []]


def test_preferences_of_any_shape(spark):
    bodies = ['{"alerts":{"symbols":["AAA","BBB"],"kinds":[]},"limits":{"above":"12.5"},"quiet":"true"}', '{"alerts":{"symbols":"AAA"}}', "[]", "7", "{", "", None, '{"alerts":{"symbols":[]},"limits":{"above":"much"}}']
    rows = M.preferences(spark.createDataFrame(list(enumerate(bodies)), "n int, body string"), "body").orderBy("n").collect()
    assert [(r["status"], r["symbol"], r["above"], r["quiet"], r["kinds"]) for r in rows] == [
        ("ok", "AAA", 12.5, True, 0), ("mistyped", None, None, None, None), ("mistyped", None, None, None, None), ("mistyped", None, None, None, None), ("broken", None, None, None, None), ("broken", None, None, None, None),
        ("broken", None, None, None, None), ("ok", None, None, None, None),
    ]


def test_sketches_keep_their_ranks(spark):
    """Percentiles from hourly sketches lie within one percent of the exact ranks; merging in any order gives as much."""
    log = spark.range(200_000).select(F.lit("p").alias("path"), (F.timestamp_seconds(1_700_000_000 + F.col("id"))).alias("ts"), (F.pow(F.rand(5), 3) * 1000).alias("value")).cache()
    row = M.rolled_up(M.latency_sketches(log, ["path"], "value", "ts"), ["path"]).first()
    assert row["requests"] == 200_000
    for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        rank = log.where(F.col("value") <= row[name]).count() / 200_000
        assert abs(rank - q) < 0.01


def test_long_lists_give_what_short_ones_do(spark, monkeypatch):
    """Hits, counts, adjusted sentiment and spam by one automaton equal those by single tests."""
    from lodestar_market.operators import text as T

    rng = random.Random(9)
    words = ["".join(rng.choices("abcdé", k=rng.randint(2, 4))) for _ in range(400)]
    positive, negative, slang = words[:60], words[40:110], [(w, "", rng.choice([-0.3, 0.0, 0.2])) for w in words[100:180]]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))).upper() for _ in range(200)] + ["", None]
    df = spark.createDataFrame([(n, t, rng.choice(["positive", "negative", "neutral"]), 50.0) for n, t in enumerate(texts)], "n int, t string, label string, sure double")

    def results():
        out = T.adjust_sentiment(df, "t", "label", "sure", positive, negative, slang)
        low = F.lower("t")
        return out.select("n", "adjustment", "sentiment", "confidence", T.hits(low, words[:150]).alias("h"), T.count_hits(low, words[:150]).alias("c"), T.spam_keyword(F.col("t"), F.lit(None), words[200:320]).alias("s")).orderBy("n").collect()

    many = results()
    monkeypatch.setattr(T, "MANY", 10_000)
    assert many == results()
    assert len({r["adjustment"] for r in many}) > 10 and {r["s"] for r in many} == {True, False}
