"""Queries on topics and on streams with keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitoring as M
from ..sources import topics
from ..streaming import jobs as J
from ..streaming import stateful as S
from .daily import CLOSED, ERRORS_SQL, KINDS, MESSAGES, _new_folder, _stream
from .tables import read, symbol_of, symbol_sql

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


TOPIC_OF = {"error": "alerts", "purchase": "technical-requests", "view": "sentiment-requests"}
_TOPIC_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TOPIC_OF.items())


@query(
    "io8_topics",
    f"SELECT CASE event_type {_TOPIC_SQL} ELSE 'analysis-requests' END AS topic, CAST(event_id AS VARCHAR) AS request_id, {symbol_sql('user_id % 50')} AS symbol, ts AS sent_at, value AS amount FROM events WHERE event_type <> 'click'",
)
def io8(spark, d):
    """Events are published to four topics by one stream; a second reads three kinds of bodies back from them."""
    at, own = _new_folder(spark), S.state_session(spark)
    topic = F.lit("analysis-requests")
    for kind, name in TOPIC_OF.items():
        topic = F.when(F.col("event_type") == kind, name).otherwise(topic)
    symbols = F.array(symbol_of(F.col("user_id") % 50))
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("request_id"), symbols.alias("symbols"), F.col("ts").alias("timestamp"), F.struct(F.col("value").alias("amount")).alias("options")), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    topics.publish(_stream(own, d).select(topic.alias("topic"), body.alias("value"), "event_type").where("event_type <> 'click'"), f"{at}/log", f"{at}/published")
    read_back = topics.read_topics(own, f"{at}/log", *TOPIC_OF.values(), "analysis-requests")
    kind = "request_id string, symbols array<string>, timestamp timestamp, options struct<amount: double>"
    parsed = read_back.select("topic", F.from_json("value", kind).alias("m"))
    out = parsed.select("topic", "m.request_id", F.explode("m.symbols").alias("symbol"), F.col("m.timestamp").alias("sent_at"), "m.options.amount")
    return J.run_available(out, at)


FAILING_MINUTES = 12 * 60
FAILING_SQL = f"""
WITH e AS (
  SELECT user_id, ts, event_type = 'error' AS bad, lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events
), run AS (
  SELECT user_id, ts AS since FROM e WHERE bad AND NOT coalesce(before, FALSE)
), alarm AS (
  SELECT r.user_id, r.since FROM run r LEFT JOIN e ON e.user_id = r.user_id AND NOT e.bad AND e.ts > r.since GROUP BY ALL
  HAVING coalesce(min(e.ts) > r.since + INTERVAL {FAILING_MINUTES} MINUTE, TRUE)
)
SELECT CAST(a.user_id AS VARCHAR) AS source, a.since AS failing_since, count(*) AS failures, a.since + INTERVAL {FAILING_MINUTES} MINUTE AS alerted_at
FROM alarm a JOIN e ON e.user_id = a.user_id AND e.bad AND e.ts >= a.since AND e.ts <= a.since + INTERVAL {FAILING_MINUTES} MINUTE
WHERE a.since + INTERVAL {FAILING_MINUTES} MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL
"""


@query("st4_failing_sources", FAILING_SQL)
def st4_failing(spark, d):
    """Sources report about twice a day here, so half a day stands for the usual half an hour."""
    own = S.state_session(spark)
    log = _stream(own, d).select(F.col("user_id").alias("source"), "ts", F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))
    return J.run_available(S.failing_sources(log, FAILING_MINUTES), _new_folder(spark), again=True)


#: Requests a day, for events that are few.
LIMITS = {"anonymous": 1, "registered": 2, "premium": 4}
_SEGMENTS = {"BUILDING": "premium", "MACHINERY": "registered", "AUTOMOBILE": "registered"}
_TIER_SQL = " ".join(f"WHEN '{k}' THEN {LIMITS[v]}" for k, v in _SEGMENTS.items())
WINDOWS_SQL = f"""
WITH RECURSIVE w AS (
  SELECT user_id, min(ts) AS opened FROM events GROUP BY user_id
  UNION ALL
  SELECT w.user_id, min(e.ts) FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.opened + INTERVAL 1 DAY GROUP BY w.user_id
), c AS (
  SELECT w.user_id, w.opened, count(*) AS requests FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.opened AND e.ts < w.opened + INTERVAL 1 DAY GROUP BY ALL
), l AS (
  SELECT c.*, CASE c_mktsegment {_TIER_SQL} ELSE {LIMITS["anonymous"]} END AS most FROM c LEFT JOIN customer ON c_custkey = user_id
)
SELECT CAST(user_id AS VARCHAR) AS client, opened AS window_start, requests, least(requests, most) AS allowed, requests - least(requests, most) AS denied
FROM l WHERE opened + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE
"""


@query("st6_request_windows", WINDOWS_SQL)
def st6_windows(spark, d):
    """Windows that open at a client's first request, against the limit of the client's tier (by segment)."""
    own = S.state_session(spark)
    tier = F.lit("anonymous")
    for segment, name in _SEGMENTS.items():
        tier = F.when(F.col("c_mktsegment") == segment, name).otherwise(tier)
    tiers = read(own, d, "customer").select(F.col("c_custkey").alias("client"), tier.alias("tier"))
    log = _stream(own, d).select(F.col("user_id").alias("client"), "ts")
    return J.run_available(S.request_windows(log, tiers, LIMITS, 24 * 3600), _new_folder(spark), again=True)


HOT_SQL = f"""
WITH c AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, {symbol_sql("user_id % 100")} AS symbol, count(*) AS mentions FROM events GROUP BY ALL
)
SELECT * FROM (
  SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, symbol, mentions, CAST(row_number() OVER (PARTITION BY window_start ORDER BY mentions DESC, symbol) AS INTEGER) AS rank FROM c
) WHERE rank <= 10 AND {CLOSED.format("1 HOUR")}
"""


@query("st5_hot_list", HOT_SQL)
def st5_hot(spark, d):
    """The ten most mentioned symbols of each hour."""
    posts = _stream(spark, d).select("ts", symbol_of(F.col("user_id") % 100).alias("symbol"))
    return S.run_hot_list(J.mentions_per_window(posts), _new_folder(spark))


FIRST_SQL = """
WITH RECURSIVE e AS (SELECT event_type || ':' || user_id AS hash, ts FROM events), w AS (
  SELECT hash, min(ts) AS let FROM e GROUP BY hash
  UNION ALL
  SELECT w.hash, min(e.ts) FROM w JOIN e ON e.hash = w.hash AND e.ts >= w.let + INTERVAL 7 DAY GROUP BY w.hash
)
SELECT hash, let AS published_at FROM w WHERE let <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
"""


@query("st1_dedup_articles", FIRST_SQL)
def st1(spark, d):
    """A hash is let through once in seven days."""
    own = S.state_session(spark)
    articles = _stream(own, d).select(F.concat_ws(":", "event_type", "user_id").alias("hash"), F.col("ts").alias("published_at"))
    return J.run_available(S.first_of_days(articles), _new_folder(spark), again=True)


RATE_SQL = f"""
WITH w AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(i) AS window_start, event_type, user_id % 20 AS source FROM events, range(0, 6) AS r(i)
), c AS (
  SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, source, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) AS total FROM w GROUP BY ALL
)
SELECT *, round(failed::DOUBLE / total, 6) AS error_rate, 'warning' AS severity FROM c WHERE failed::DOUBLE / total > 0.05 AND {CLOSED.format("10 MINUTE")}
"""


@query("st3_error_rate", RATE_SQL)
def st3_errors(spark, d):
    """Windows of six hours, as sources report seldom here, in which more than a twentieth of a source's requests failed."""
    log = _stream(spark, d).select("ts", (F.col("user_id") % 20).alias("source"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))
    return J.run_available(J.error_rate(log, length="6 hours", slide="1 hour"), _new_folder(spark), again=True)


_SEVERITY = "CASE kind " + " ".join(f"WHEN '{kind}' THEN '{severity}'" for _, kind, severity, _ in M.ERROR_RULES) + " ELSE 'medium' END"
_ROUTES = "CASE severity " + " ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in M.CHANNELS.items()) + " END"


@query(
    "st9_routes_by_severity",
    f"WITH {ERRORS_SQL}, k AS (SELECT event_id, {KINDS} AS kind FROM err), s AS (SELECT *, {_SEVERITY} AS severity FROM k) SELECT event_id, kind AS error_type, severity, unnest({_ROUTES}) AS channel FROM s",
)
def st9_routes(spark, d):
    """Errors as they come, each to the channels of its severity."""
    k = F.get_json_object("props", "$.k").cast("int") % 7
    log = _stream(spark, d).where("event_type = 'error'").select("event_id", F.get(F.array(*map(F.lit, MESSAGES)), k).alias("message"))
    routed = M.route_by_severity(log.withColumn("e", M.classify_error(F.col("message"))).select("event_id", "e.error_type", "e.severity"))
    return J.run_available(routed, _new_folder(spark), again=True)
