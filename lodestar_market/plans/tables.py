"""The given tables as market inputs, in Spark and as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import bars_from_trades, order_key

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol_of(key: str | Column) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    letter = lambda n: F.char(F.lit(65) + F.pmod(n, F.lit(26)))
    return F.concat(letter(F.floor(k / 676)), letter(F.floor(k / 26)), letter(k))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = read(spark, sf_dir, "lineitem").select(
        symbol_of("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("trade_date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"), order_key("l_orderkey", ("l_linenumber", 3), ("l_partkey", 12)).alias("place"),
    )
    return bars_from_trades(trades, ["place"], ["symbol", "trade_date"])


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The security master; exchange by region, industry by nation."""
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    exchange = F.get(F.array(*map(F.lit, ("HSX", "HNX", "UPCOM"))), F.col("n_regionkey") % 3)
    joined = s.join(n, s.s_nationkey == n.n_nationkey)
    return joined.select(symbol_of("s_suppkey").alias("symbol"), F.col("s_name").alias("name"), exchange.alias("exchange"), F.col("n_name").alias("industry"), (F.col("s_acctbal") > 0).alias("is_active"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.substring("source", 4, 9).cast("int")
    return read(spark, sf_dir, "documents").select(
        "doc_id", "source", F.when(number < 10, "official").otherwise("social").alias("source_type"), F.substring("text", 1, 80).alias("title"), "text",
        F.timestamp_add("MINUTE", F.col("doc_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("published_at"),
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' subscriptions to symbols: by customer key and segment."""
    n = 10
    kinds = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("HIGH_RISK"))).when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("STRONG_SIGNAL"))).otherwise(F.array(F.lit("HIGH_RISK"), F.lit("STRONG_SIGNAL"), F.lit("RUMOR")))
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), symbol_of(F.col("c_custkey") % n).alias("symbol"), kinds.alias("alert_types"), (F.col("c_acctbal") > 0).alias("is_active"), (F.col("c_acctbal") / 1000).alias("threshold"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")


def _letter(n: str) -> str:
    return f"chr(CAST(65 + ({n}) % 26 AS INTEGER))"


def symbol_sql(k: str) -> str:
    return f"({_letter(f'({k}) // 676')} || {_letter(f'({k}) // 26')} || {_letter(k)})"


BARS = f"""bars AS (
  SELECT {symbol_sql("l_suppkey")} AS symbol, CAST(l_shipdate AS DATE) AS trade_date,
         first(l_extendedprice / l_quantity ORDER BY {", ".join(ORDER)}) AS open, max(l_extendedprice / l_quantity) AS high,
         min(l_extendedprice / l_quantity) AS low, last(l_extendedprice / l_quantity ORDER BY {", ".join(ORDER)}) AS close,
         CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM lineitem GROUP BY 1, 2)"""

FRAMES = (
    BARS
    + """, f0 AS (
  SELECT *, row_number() OVER s AS rn, lag(close) OVER s AS pc, close - lag(close) OVER s AS change,
         high - lag(high) OVER s AS up, lag(low) OVER s - low AS down, (high + low + close) / 3 AS typical,
         avg(close) OVER w20 AS a20, avg(close) OVER w50 AS a50, stddev_pop(close) OVER w20 AS sd, min(low) OVER w14 AS l14, max(high) OVER w14 AS h14,
         volume / nullif(lag(volume) OVER s, 0) AS volume_ratio_prev, volume / nullif(avg(volume) OVER w20, 0) AS vr,
         max(high) OVER w20 AS recent_high, min(low) OVER w20 AS recent_low,
         avg(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS 11 PRECEDING) AS a12, avg(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS 25 PRECEDING) AS a26
  FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY trade_date), w14 AS (PARTITION BY symbol ORDER BY trade_date ROWS 13 PRECEDING),
       w20 AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING), w50 AS (PARTITION BY symbol ORDER BY trade_date ROWS 49 PRECEDING)
), f1 AS (
  SELECT *, change / nullif(pc, 0) * 100 AS change_percent, coalesce(greatest(high - low, abs(high - pc), abs(low - pc)), high - low) AS true_range,
         CASE WHEN up > down AND up > 0 THEN up WHEN up IS NOT NULL THEN 0 END AS plus_dm, CASE WHEN down > up AND down > 0 THEN down WHEN up IS NOT NULL THEN 0 END AS minus_dm,
         CASE WHEN rn >= 20 THEN a20 END AS sma_20, CASE WHEN rn >= 50 THEN a50 END AS sma_50, CASE WHEN rn >= 20 THEN a20 END AS bb_middle,
         CASE WHEN rn >= 20 THEN a20 + 2 * sd END AS bb_upper, CASE WHEN rn >= 20 THEN a20 - 2 * sd END AS bb_lower,
         CASE WHEN rn >= 20 THEN CASE WHEN a20 = 0 THEN 0 ELSE 4 * sd / a20 END END AS bb_width,
         CASE WHEN h14 = l14 THEN 50 ELSE (close - l14) / nullif(h14 - l14, 0) * 100 END AS raw_k, CASE WHEN rn >= 20 THEN vr END AS volume_ratio,
         greatest(change, 0) AS gain, greatest(-change, 0) AS loss
  FROM f0
), f2 AS (
  SELECT *, CASE WHEN rn >= 14 THEN raw_k END AS stoch_k,
         CASE WHEN rn >= 16 THEN avg(raw_k) OVER (PARTITION BY symbol ORDER BY trade_date ROWS 2 PRECEDING) END AS stoch_d,
         sum(typical * volume) OVER s / nullif(sum(volume) OVER s, 0) AS vwap,
         CASE WHEN rn >= 14 THEN sum(typical * volume) OVER w14 / nullif(sum(volume) OVER w14, 0) END AS vwap_14,
         sum(gain) OVER w14 AS g14, sum(loss) OVER w14 AS o14, sum(true_range) OVER w14 AS t14, sum(plus_dm) OVER w14 AS p14, sum(minus_dm) OVER w14 AS m14
  FROM f1 WINDOW s AS (PARTITION BY symbol ORDER BY trade_date), w14 AS (PARTITION BY symbol ORDER BY trade_date ROWS 13 PRECEDING)
), frames AS (
  SELECT *, CASE WHEN rn < 15 THEN 50 WHEN o14 = 0 THEN 100 ELSE 100 * g14 / nullif(g14 + o14, 0) END AS rsi_simple,
         CASE WHEN rn >= 14 THEN t14 / 14 END AS atr_simple, CASE WHEN rn >= 15 THEN p14 / nullif(t14, 0) * 100 END AS plus_di_simple,
         CASE WHEN rn >= 15 THEN m14 / nullif(t14, 0) * 100 END AS minus_di_simple,
         CASE WHEN rn >= 15 THEN CASE WHEN p14 + m14 = 0 THEN 0 ELSE 100 * abs(p14 - m14) / nullif(p14 + m14, 0) END END AS adx_simple
  FROM f2)"""
)

#: One recursion over row numbers carries all states; seeds come from the frames.
TECHNICAL = (
    "RECURSIVE "
    + FRAMES
    + """, base AS MATERIALIZED (
  SELECT *, CASE WHEN rn = 14 THEN t14 / 14 END AS atr_seed, g14 / 14 AS g_seed, o14 / 14 AS o_seed FROM frames
), r AS (
  SELECT symbol, rn, CAST(NULL AS DOUBLE) AS e12, CAST(NULL AS DOUBLE) AS e26, CAST(0 AS DOUBLE) AS lsum, CAST(NULL AS DOUBLE) AS sig, CAST(NULL AS DOUBLE) AS ag, CAST(NULL AS DOUBLE) AS al,
         CAST(NULL AS DOUBLE) AS atr, CAST(NULL AS DOUBLE) AS st, CAST(NULL AS DOUBLE) AS sp, CAST(NULL AS DOUBLE) AS sm, CAST(NULL AS DOUBLE) AS sx
  FROM base WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, e12, e26, CASE WHEN e26 IS NULL THEN lsum ELSE lsum + e12 - e26 END,
         CASE WHEN rn < 34 THEN NULL WHEN rn = 34 THEN (lsum + e12 - e26) / 9 ELSE sig + (e12 - e26 - sig) * 0.2 END, ag, al, atr, st, sp, sm,
         CASE WHEN rn < 15 THEN NULL ELSE CASE WHEN rn = 15 THEN 0 ELSE sx - sx / 14 END
           + CASE WHEN st = 0 OR sp + sm = 0 THEN 0 ELSE abs(sp - sm) / nullif(sp + sm, 0) * 100 END END
  FROM (SELECT b.symbol, b.rn, r.lsum, r.sig, r.sx,
               CASE WHEN b.rn = 12 THEN b.a12 ELSE r.e12 + (b.close - r.e12) * 2 / 13 END AS e12,
               CASE WHEN b.rn = 26 THEN b.a26 ELSE r.e26 + (b.close - r.e26) * 2 / 27 END AS e26,
               CASE WHEN b.rn = 15 THEN b.g_seed ELSE (r.ag * 13 + b.gain) / 14 END AS ag, CASE WHEN b.rn = 15 THEN b.o_seed ELSE (r.al * 13 + b.loss) / 14 END AS al,
               CASE WHEN b.rn = 14 THEN b.atr_seed ELSE (r.atr * 13 + b.true_range) / 14 END AS atr,
               CASE WHEN b.rn = 15 THEN b.t14 ELSE r.st - r.st / 14 + b.true_range END AS st, CASE WHEN b.rn = 15 THEN b.p14 ELSE r.sp - r.sp / 14 + b.plus_dm END AS sp,
               CASE WHEN b.rn = 15 THEN b.m14 ELSE r.sm - r.sm / 14 + b.minus_dm END AS sm
        FROM r JOIN base b ON b.symbol = r.symbol AND b.rn = r.rn + 1)
), t0 AS (
  SELECT b.*, r.e12 AS ema_12, r.e26 AS ema_26, r.e12 - r.e26 AS macd_line, CASE WHEN b.rn >= 35 THEN r.sig END AS macd_signal,
         CASE WHEN r.al = 0 THEN 100 ELSE 100 - 100 / (1 + r.ag / nullif(r.al, 0)) END AS rsi_14, CASE WHEN b.rn >= 15 THEN r.atr END AS atr_14,
         CASE WHEN b.rn >= 28 THEN CASE WHEN r.st = 0 THEN 0 ELSE r.sp / r.st * 100 END END AS plus_di, CASE WHEN b.rn >= 28 THEN CASE WHEN r.st = 0 THEN 0 ELSE r.sm / r.st * 100 END END AS minus_di,
         CASE WHEN b.rn >= 28 THEN r.sx END AS adx_sum, CASE WHEN b.rn >= 28 THEN r.sx / 14 END AS adx
  FROM base b JOIN r ON b.symbol = r.symbol AND b.rn = r.rn
), technical AS (
  SELECT *, macd_line - macd_signal AS macd_histogram, lag(macd_line) OVER s AS prev_macd_line, lag(macd_signal) OVER s AS prev_macd_signal,
         lag(sma_20) OVER s AS prev_sma_20, lag(sma_50) OVER s AS prev_sma_50
  FROM t0 WINDOW s AS (PARTITION BY symbol ORDER BY trade_date)
), snap AS (SELECT * FROM technical QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1)"""
)

TEXTS = """texts AS (
  SELECT doc_id, source, CASE WHEN CAST(substr(source, 4) AS INTEGER) < 10 THEN 'official' ELSE 'social' END AS source_type, substr(text, 1, 80) AS title, text,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) AS published_at FROM documents)"""

STOCKS = f"""stocks AS (
  SELECT {symbol_sql("s_suppkey")} AS symbol, s_name AS name, ['HSX', 'HNX', 'UPCOM'][n_regionkey % 3 + 1] AS exchange, n_name AS industry, s_acctbal > 0 AS is_active
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

SUBSCRIPTIONS = f"""subs AS (
  SELECT c_custkey AS user_id, {symbol_sql("c_custkey % 10")} AS symbol, c_acctbal > 0 AS is_active, c_acctbal / 1000 AS threshold,
         CASE c_mktsegment WHEN 'BUILDING' THEN ['HIGH_RISK'] WHEN 'MACHINERY' THEN ['STRONG_SIGNAL'] ELSE ['HIGH_RISK', 'STRONG_SIGNAL', 'RUMOR'] END AS alert_types FROM customer)"""
