"""Queries on results over time, models, preferences and many terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import model as L
from ..operators import monitoring as M
from ..operators import store
from ..operators import terms as A
from ..operators.asof import as_of_join
from .daily import _new_folder
from .news import _KEYWORDS, NEGATIVE, POSITIVE, SLANG
from .tables import BARS, TEXTS, bars, events, read, symbol_of, symbol_sql, texts

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


ASOF_SQL = f"""
WITH {BARS}, known AS (
  SELECT symbol, trade_date, close, avg(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING) AS mean FROM bars
), asked AS (SELECT o_orderkey AS request_id, {symbol_sql("o_custkey % 120")} AS symbol, CAST(o_orderdate AS DATE) AS trade_date FROM orders)
SELECT request_id, a.symbol, a.trade_date, round(k.close, 9) AS close, round(k.mean, 9) AS mean
FROM asked a ASOF LEFT JOIN known k ON a.symbol = k.symbol AND a.trade_date >= k.trade_date
"""


@query("j9_as_of_requests", ASOF_SQL)
def j9_requests(spark, d):
    """Each order asks for what was known of a symbol on its day."""
    mean = F.avg("close").over(I.series().rowsBetween(-19, 0))
    known = bars(spark, d).select("symbol", "trade_date", "close", mean.alias("mean"))
    asked = read(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), symbol_of(F.col("o_custkey") % 120).alias("symbol"), F.to_date("o_orderdate").alias("trade_date"))
    found = as_of_join(asked, known, "symbol", "trade_date", ["close", "mean"])
    return found.select("request_id", "symbol", "trade_date", F.round("close", 9).alias("close"), F.round("mean", 9).alias("mean"))


@query("a12_latency_sketches")
def a12_sketches(spark, d):
    """Percentiles of each path from sketches of its hours, which are written and read again; tests hold their ranks against the exact ones."""
    at = _new_folder(spark)
    log = events(spark, d).select(F.col("event_type").alias("path"), "ts", "value")
    M.latency_sketches(log, ["path"], "value", "ts").write.parquet(at)
    return M.rolled_up(spark.read.parquet(at), ["path"])


STEMS = (*POSITIVE, *NEGATIVE, "ing", "ver", "que", "los", "and", "the")
_COUNTS = ", ".join(f"CAST(len([w FOR w IN words IF contains(w, '{s}')]) AS DOUBLE)" for s in STEMS)
MODEL_SQL = f"""
WITH part AS (SELECT doc_id, string_split(lower(coalesce(text, '')), ' ')[1:{L.MOST_WORDS}] AS words FROM documents
), counted AS (SELECT doc_id, [{_COUNTS}] AS x FROM part
), seen AS (SELECT quality, x FROM counted JOIN labels USING (doc_id)
), class AS (SELECT quality, count(*) AS n, [{", ".join(f"sum(x[{i + 1}])" for i in range(len(STEMS)))}] AS s FROM seen GROUP BY quality
), model AS (SELECT quality, ln(n + 1) - ln((SELECT sum(n) FROM class) + 2) AS bias, [ln(v + 1) - ln(list_sum(s) + {len(STEMS)}) FOR v IN s] AS w FROM class
), score AS (
  SELECT c.doc_id, max(CASE WHEN quality = 1 THEN bias + list_dot_product(x, w) END) - max(CASE WHEN quality = 0 THEN bias + list_dot_product(x, w) END) AS z
  FROM counted c, model GROUP BY c.doc_id
)
SELECT doc_id, CASE WHEN z >= 0 THEN 'positive' ELSE 'negative' END AS sentiment, round(100 / (1 + exp(-abs(z))), 6) AS confidence FROM score
"""


@query("t8_model_sentiment", MODEL_SQL)
def t8(spark, d):
    """A model fitted on the labels of quality scores all texts in batches of sixteen, cut at 256 words."""
    rows = texts(spark, d).select("doc_id", "text")
    labelled = rows.join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    fitted = L.fit(labelled, "text", "quality", STEMS)
    return L.model_sentiment(rows, "text", fitted, STEMS).select("doc_id", "sentiment", F.round("confidence", 6).alias("confidence"))


MERGED_SQL = f"""
WITH {BARS}, told AS (
  SELECT symbol, trade_date, volume, 0 AS version FROM bars
  UNION ALL SELECT symbol, trade_date, volume + 1, 1 FROM bars WHERE month(trade_date) = 3 AND volume % 2 = 0
  UNION ALL SELECT symbol, trade_date, volume + 2, 2 FROM bars WHERE month(trade_date) IN (3, 4) AND volume % 3 = 0
  UNION ALL SELECT symbol, trade_date, volume + 9, 0 FROM bars WHERE month(trade_date) = 4 AND volume % 5 = 0
)
SELECT symbol, trade_date, max_by(volume, [version, volume]) AS volume, max(version) AS version FROM told GROUP BY ALL
"""


@query("io9_merge_months", MERGED_SQL)
def io9_months(spark, d):
    """A store of months takes three merges, each of which rewrites the months it has rows of."""
    at, base = _new_folder(spark), bars(spark, d).select("symbol", "trade_date", "volume", F.lit(0).alias("version"))
    store.create(base, at)
    month = F.month("trade_date")
    for version, change, some in ((1, 1, (month == 3) & (F.col("volume") % 2 == 0)), (2, 2, month.isin(3, 4) & (F.col("volume") % 3 == 0)), (0, 9, (month == 4) & (F.col("volume") % 5 == 0))):
        fresh = base.where(some).select("symbol", "trade_date", (F.col("volume") + change).alias("volume"), F.lit(version).alias("version"))
        store.merge(fresh, at, ["symbol", "trade_date"], "version")
    return store.read(spark, at, base.schema)


#: Bodies of preferences by customer: whole, with a number as text, without limits, broken, of another shape.
PREFERENCES_SQL = f"""
WITH c AS (SELECT c_custkey AS user_id, c_custkey % 5 AS shape, {symbol_sql("c_custkey % 10")} AS symbol, c_acctbal AS level FROM customer)
SELECT user_id, CASE shape WHEN 3 THEN 'broken' WHEN 4 THEN 'mistyped' ELSE 'ok' END AS status, CASE WHEN shape < 3 THEN symbol END AS symbol,
       CASE WHEN shape < 2 THEN level END AS above, CASE WHEN shape < 3 THEN shape = 0 END AS quiet, CASE WHEN shape < 3 THEN CAST(2 AS INTEGER) END AS kinds
FROM c
"""


@query("t15_preferences", PREFERENCES_SQL)
def t15_preferences(spark, d):
    """Bodies of several shapes are read as variants; what doesn't fit stays, with a status."""
    shape, symbol, level = F.col("c_custkey") % 5, symbol_of(F.col("c_custkey") % 10), F.col("c_acctbal").cast("string")
    whole = F.format_string('{"alerts":{"symbols":["%s"],"kinds":["HIGH_RISK","RUMOR"]},"limits":{"above":%s},"quiet":true,"theme":{"dark":1}}', symbol, level)
    text = F.format_string('{"alerts":{"symbols":["%s"],"kinds":["HIGH_RISK","RUMOR"]},"limits":{"above":"%s"},"quiet":"false"}', symbol, level)
    bare = F.format_string('{"alerts":{"symbols":["%s"],"kinds":["HIGH_RISK","RUMOR"]},"quiet":false}', symbol)
    body = F.when(shape == 0, whole).when(shape == 1, text).when(shape == 2, bare).when(shape == 3, F.substring(whole, 1, 40)).otherwise('{"alerts":"all"}')
    return M.preferences(read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), body.alias("body")), "body").drop("body")


@query("t5_many_terms", f"WITH {TEXTS} SELECT doc_id, array_to_string(list_filter([{_KEYWORDS}], lambda k: contains(lower(text), k)), ',') AS keywords FROM texts")
def t5_terms(spark, d):
    """As t5_keyword_hits, by one automaton over all terms."""
    listed = (*POSITIVE, *NEGATIVE, *[s[0] for s in SLANG])
    return texts(spark, d).select("doc_id", F.array_join(A.term_hits(F.lower("text"), listed), ",").alias("keywords"))
