"""Feed payloads: RSS and Atom, with the dates that feeds use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Zone names of RFC 822 dates.
ZONES = {
    "UT": "+00:00", "GMT": "+00:00", "UTC": "+00:00", "Z": "+00:00", "EST": "-05:00", "EDT": "-04:00",
    "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
}
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_RFC = r"(?i)^\s*(?:[a-z]{3,9}\s*,\s*)?(\d{1,2})\s+([a-z]{3})[a-z]*\s+(\d{4}|\d{2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([a-z]{1,3}|[+-]\d{2}:?\d{2})?\s*$"

_TEXT = "struct<_VALUE: string, _type: string>"
_LINKS = "array<struct<_href: string, _rel: string, _VALUE: string>>"
_RSS_ITEM = f"struct<title: string, link: {_LINKS}, guid: string, description: string, pubDate: string, date: string>"
_ENTRY = f"struct<title: {_TEXT}, link: {_LINKS}, id: string, summary: {_TEXT}, content: {_TEXT}, published: string, updated: string>"
#: Children of the root element: of rss, of an RDF feed, and of an Atom feed.
PAYLOAD = f"channel struct<item: array<{_RSS_ITEM}>>, item array<{_RSS_ITEM}>, entry array<{_ENTRY}>, _corrupt string"
ITEM = "struct<kind: string, title: string, link: string, description: string, date: string>"


def feed_time(text: Column) -> Column:
    """A timestamp of an RFC 822 date (``Mon, 05 Jan 2026 10:00:00 +0700``, ``5 Jan 26 10:00 GMT``) or an ISO 8601 one; null if neither."""
    part = lambda n: F.regexp_extract(text, _RFC, n)
    month = F.instr(F.lit(MONTHS), F.lower(part(2)))
    # As RFC 2822 has it: years of two digits below 50 are of this century.
    year = F.when(F.length(part(3)) == 4, part(3)).otherwise(F.concat(F.when(part(3) < "50", "20").otherwise("19"), part(3)))
    zone = F.upper(part(7))
    offset = F.when(zone == "", "+00:00").when(zone.rlike(r"^[+-]"), F.regexp_replace(zone, r"^([+-]\d{2}):?(\d{2})$", "$1:$2"))
    for name, value in ZONES.items():
        offset = offset.when(zone == name, value)
    clock = F.concat(F.lpad(part(4), 2, "0"), F.lit(":"), part(5), F.lit(":"), F.when(part(6) == "", "00").otherwise(part(6)))
    rfc = F.concat(year, F.lit("-"), F.lpad(((month + 2) / 3).cast("int").cast("string"), 2, "0"), F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("T"), clock, offset)
    iso = F.regexp_replace(F.trim(text), r"([+-]\d{2})(\d{2})$", "$1:$2")
    iso = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"), iso)
    return F.when(text.rlike(_RFC) & (month % 3 == 1), rfc.try_cast("timestamp")).otherwise(iso.try_cast("timestamp"))


def parse_feed(df: DataFrame, xml: str, *keys: str) -> DataFrame:
    """The keys, kind, title, link, description, published_at and status of each item of each payload.

    ``kind`` is rss (RDF feeds too) or atom.  A payload without items gives one
    row: its status is ``corrupt`` where it isn't well-formed XML, else
    ``empty``.  Items have the status ``ok``, or ``undated`` where their date is
    missing or none that feeds use.  Of several links of an Atom entry the
    alternate one counts, else the first.  A null payload is an empty one.
    """
    first_text = lambda links: F.coalesce(F.get(links, F.lit(0))["_VALUE"], F.get(links, F.lit(0))["_href"])
    rss = lambda i: F.struct(F.lit("rss").alias("kind"), i["title"].alias("title"), F.coalesce(first_text(i["link"]), i["guid"]).alias("link"), i["description"].alias("description"), F.coalesce(i["pubDate"], i["date"]).alias("date"))

    def atom(e: Column) -> Column:
        alternate = F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        link = F.coalesce(F.get(alternate, F.lit(0))["_href"], F.get(e["link"], F.lit(0))["_href"], e["id"])
        body = F.coalesce(e["summary"]["_VALUE"], e["content"]["_VALUE"])
        return F.struct(F.lit("atom").alias("kind"), e["title"]["_VALUE"].alias("title"), link.alias("link"), body.alias("description"), F.coalesce(e["published"], e["updated"]).alias("date"))

    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreNamespace": "true"}
    read = df.select(*keys, F.from_xml(F.col(xml), PAYLOAD, options).alias("p"))
    lists = [F.coalesce(x, F.array().cast(f"array<{ITEM}>")) for x in (F.transform("p.channel.item", rss), F.transform("p.item", rss), F.transform("p.entry", atom))]
    items = read.select(*keys, F.col("p._corrupt").alias("_corrupt"), F.explode_outer(F.concat(*lists)).alias("i"))
    published = feed_time(F.col("i.date"))
    status = F.when(F.col("_corrupt").isNotNull(), "corrupt").when(F.col("i").isNull(), "empty").when(published.isNull(), "undated").otherwise("ok")
    return items.select(*keys, "i.kind", "i.title", "i.link", "i.description", published.alias("published_at"), status.alias("status"))
