"""Queries on feeds, URLs and message bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import urls
from ..sources import feeds
from .tables import TEXTS, read, texts

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


#: What a text is sent as: by its number.
FEED_SQL = f"""
WITH {TEXTS}, shaped AS (
  SELECT doc_id, doc_id % 5 AS shape, nullif(trim(title, ' ' || chr(9) || chr(10) || chr(13)), '') AS title, published_at AS seen FROM texts
)
SELECT doc_id, 'rss' AS kind, title, 'https://feeds.example/a?id=' || doc_id || '&x=1' AS link, seen AS published_at, 'ok' AS status FROM shaped WHERE shape = 0
UNION ALL SELECT doc_id, 'atom', title, 'https://feeds.example/b/' || doc_id, seen, 'ok' FROM shaped WHERE shape = 1
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, 'corrupt' FROM shaped WHERE shape = 2
UNION ALL SELECT doc_id, 'rss', title, 'https://feeds.example/d/' || doc_id, date_trunc('minute', seen), 'ok' FROM shaped WHERE shape = 3
UNION ALL SELECT doc_id, 'rss', 'second', 'urn:' || doc_id, NULL, 'undated' FROM shaped WHERE shape = 3
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, 'empty' FROM shaped WHERE shape = 4
"""


@query("io3_parse_feed", FEED_SQL)
def io3(spark, d):
    """Titles and times are put into RSS, Atom, broken and empty payloads, and parsed again."""
    rows = texts(spark, d).select("doc_id", "title", "published_at")
    title = F.col("title")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        title = F.regexp_replace(title, mark, name)
    there = F.from_utc_timestamp("published_at", "Asia/Ho_Chi_Minh")  # written as the clock there shows
    number = F.col("doc_id").cast("string")
    rss = F.format_string(
        '<?xml version="1.0"?><rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom"><channel><title>c</title><atom:link href="https://feeds.example/self"/>'
        "<item><title>%s</title><link>https://feeds.example/a?id=%s&amp;x=1</link><description>d</description><pubDate>%s +0700</pubDate></item></channel></rss>",
        title, number, F.date_format(there, "EEE, dd MMM yyyy HH:mm:ss"),
    )
    atom = F.format_string(
        '<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title type="text">%s</title><link rel="self" href="https://feeds.example/no"/>'
        '<link rel="alternate" href="https://feeds.example/b/%s"/><id>i</id><updated>%s+07:00</updated><summary>s</summary></entry></feed>',
        title, number, F.date_format(there, "yyyy-MM-dd'T'HH:mm:ss"),
    )
    two = F.format_string(
        "<rss><channel><item><title>%s</title><link>https://feeds.example/d/%s</link><pubDate>%s GMT</pubDate></item>"
        "<item><title>second</title><guid>urn:%s</guid><pubDate>some day</pubDate></item></channel></rss>",
        title, number, F.date_format("published_at", "d MMM yy HH:mm"), number,
    )
    shape = F.col("doc_id") % 5
    payload = F.when(shape == 0, rss).when(shape == 1, atom).when(shape == 2, F.substring(rss, 1, 150)).when(shape == 3, two).otherwise("<rss><channel><title>none</title></channel></rss>")
    items = feeds.parse_feed(rows.select("doc_id", payload.alias("xml")), "xml", "doc_id")
    return items.select("doc_id", "kind", F.nullif("title", F.lit("")).alias("title"), "link", "published_at", "status")


_TRACKED = "|".join(t.replace("*", "[^=]*") for t in urls.TRACKING)
URL_SQL = f"""
WITH part AS (
  SELECT page_id, url, lower(regexp_extract(url, '^([a-z]+)://', 1, 'i')) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1, 'i')) AS host,
         regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1, 'i') AS path, split_part(regexp_extract(url, '\\?([^#]*)', 1), '#', 1) AS query FROM pages
), made AS (
  SELECT page_id, scheme || '://' || host || regexp_replace(path, '/+$', '')
    || coalesce('?' || nullif(array_to_string(list_sort([p FOR p IN string_split(query, '&') IF p <> '' AND NOT regexp_matches(p, '^({_TRACKED})(=|$)', 'i')]), '&'), ''), '') AS url FROM part
)
SELECT url, min(page_id) AS page_id, count(*) AS copies FROM made GROUP BY url
"""


@query("u4_dedup_by_url", URL_SQL)
def u4_by_url(spark, d):
    """Pages of one canonical URL are one: the first stays."""
    found = read(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("url"))
    return found.groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


