"""Queries on bars: sources, gates, indicators, signals, levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import indicators as I
from ..operators import report as R
from ..operators import signals as S
from ..sources.files import technical_rows
from .tables import BARS, FRAMES, STOCKS, TECHNICAL, bars, events, read, stocks, symbol_of, symbol_sql

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def rounded(df: DataFrame, names: list[str], *keys: str, digits: int = 9) -> DataFrame:
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in names])


def rsql(names: list[str], digits: int = 9) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in names)


AS_OF = "1998-06-30"
KEY = ("symbol", "trade_date")
OHLCV = ["open", "high", "low", "close"]


@query("w21_bars_from_trades", f"WITH {BARS} SELECT symbol, trade_date, {rsql(OHLCV)}, volume FROM bars")
def w21(spark, d):
    return rounded(bars(spark, d), OHLCV, *KEY, "volume")


TICKS = "SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts) AS bar_start, round(first(value ORDER BY ts, event_id), 9) AS open, round(max(value), 9) AS high, round(min(value), 9) AS low, round(last(value ORDER BY ts, event_id), 9) AS close, count(*) AS volume FROM events GROUP BY 1, 2"


@query("w21_hourly_bars_from_ticks", TICKS)
def w21_hourly(spark, d):
    ticks = events(spark, d).select(F.col("event_type").alias("symbol"), F.window("ts", "1 hour")["start"].alias("bar_start"), "ts", "event_id", F.col("value").alias("price"), F.lit(1).alias("quantity"))
    ticks = ticks.withColumn("place", B.order_key(F.unix_micros(F.col("ts").cast("timestamp")), ("event_id", 19)))
    return rounded(B.bars_from_trades(ticks, ["place"], ["symbol", "bar_start"]), OHLCV, "symbol", "bar_start", "volume")


@query("io4_conform", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def io4(spark, d):
    raw = read(spark, d, "supplier").select(F.col("s_suppkey").alias("S_SUPPKEY"), F.col("s_name").alias("S_Name"), F.col("s_acctbal").alias("S_ACCTBAL"))
    return B.conform(raw, ("s_suppkey", "s_name"))


@query("io5_security_master", f"WITH {STOCKS} SELECT * FROM stocks")
def io5(spark, d):
    return stocks(spark, d)


@query("f1_symbol_check", "SELECT p_brand AS symbol, regexp_full_match(substr(p_brand, 1, 3), '[A-Z]{3}') AS is_valid, count(*) AS parts FROM part GROUP BY 1, 2")
def f1(spark, d):
    return read(spark, d, "part").groupBy(F.col("p_brand").alias("symbol"), B.is_symbol(F.substring("p_brand", 1, 3)).alias("is_valid")).agg(F.count("*").alias("parts"))


@query("f2_lookback", f"WITH {BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS n FROM bars WHERE trade_date <= DATE '{AS_OF}' AND trade_date >= DATE '{AS_OF}' - 415) SELECT symbol, trade_date, volume FROM k WHERE n <= 60")
def f2(spark, d):
    return B.lookback(bars(spark, d), 400, F.lit(AS_OF).cast("date"), rows=60, warm_up=50).select(*KEY, "volume")


@query("f3_minimum_history", f"WITH {BARS} SELECT symbol, trade_date, volume FROM bars QUALIFY count(*) OVER (PARTITION BY symbol) >= 525")
def f3(spark, d):
    return B.minimum_history(bars(spark, d), 525).select(*KEY, "volume")


@query("f4_bar_quality", f"WITH {BARS}, b AS (SELECT symbol, trade_date, CASE WHEN volume % 7 = 0 THEN NULL ELSE close END AS close FROM bars) SELECT symbol, count(*) AS bars, count(close) AS complete FROM b GROUP BY 1")
def f4(spark, d):
    holed = bars(spark, d).withColumn("close", F.when(F.col("volume") % 7 != 0, F.col("close")))
    return B.complete_bars(holed, flag=True).groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if("is_complete").alias("complete"))


SESSION = """SELECT session, is_open, count(*) AS events FROM (
  SELECT isodow(l) <= 5 AND (m BETWEEN 540 AND 690 OR m BETWEEN 780 AND 900) AS is_open,
         CASE WHEN isodow(l) > 5 THEN 'closed' WHEN m < 540 THEN 'pre' WHEN m < 690 THEN 'morning' WHEN m < 780 THEN 'lunch' WHEN m < 870 THEN 'afternoon' WHEN m < 885 THEN 'atc' WHEN m < 900 THEN 'post' ELSE 'closed' END AS session
  FROM (SELECT l, hour(l) * 60 + minute(l) AS m FROM (SELECT ts + INTERVAL 7 HOUR AS l FROM events))) GROUP BY 1, 2"""


@query("f9_market_session", SESSION)
def f9(spark, d):
    return events(spark, d).groupBy(B.session_label(F.col("ts")).alias("session"), B.market_open(F.col("ts")).alias("is_open")).agg(F.count("*").alias("events"))


FRAME_QUERIES = {
    "w1_sma": ["sma_20", "sma_50"],
    "w3b_rsi_simple": ["rsi_simple"],
    "w5_bollinger": ["bb_upper", "bb_middle", "bb_lower", "bb_width"],
    "w6_stochastic": ["stoch_k", "stoch_d"],
    "w7_true_range": ["true_range"],
    "w8b_atr_simple": ["atr_simple"],
    "w9_directional_movement": ["plus_dm", "minus_dm"],
    "w10b_adx_simple": ["adx_simple", "plus_di_simple", "minus_di_simple"],
    "w11_vwap": ["vwap"],
    "w11b_vwap_rolling": ["vwap_14"],
    "w12_change_percent": ["change_percent"],
    "w13_volume_ratio": ["volume_ratio", "volume_ratio_prev"],
    "a8_recent_extremes": ["recent_high", "recent_low"],
}
KERNEL_QUERIES = {
    "w2_ema": ["ema_12", "ema_26"],
    "w3_rsi": ["rsi_14"],
    "w4_macd": ["macd_line", "macd_signal", "macd_histogram"],
    "w8_atr": ["atr_14"],
    "w10_adx": ["adx", "adx_sum", "plus_di", "minus_di"],
}


def _series(names: list[str], kernel: bool):
    make = I.technical if kernel else I.frame_indicators
    return lambda spark, d: rounded(make(bars(spark, d)), names, *KEY)


for _name, _columns in FRAME_QUERIES.items():
    query(_name, f"WITH {FRAMES} SELECT symbol, trade_date, {rsql(_columns)} FROM frames")(_series(_columns, False))
for _name, _columns in KERNEL_QUERIES.items():
    query(_name, f"WITH {TECHNICAL} SELECT symbol, trade_date, {rsql(_columns)} FROM technical")(_series(_columns, True))


@query("w2_ema_blocked", f"WITH {TECHNICAL} SELECT symbol, trade_date, {rsql(['ema_12'])} FROM technical WHERE ema_12 IS NOT NULL")
def w2_blocked(spark, d):
    return I.blocked_ema(bars(spark, d), 12, block=100).select(*KEY, F.round("ema", 9).alias("ema_12"))


CROSS = "CASE WHEN prev_macd_line <= prev_macd_signal AND macd_line > macd_signal THEN 'bullish' WHEN prev_macd_line >= prev_macd_signal AND macd_line < macd_signal THEN 'bearish' END"


@query("w14_macd_cross", f"WITH {TECHNICAL} SELECT symbol, trade_date, {CROSS} AS event FROM technical WHERE {CROSS} IS NOT NULL")
def w14(spark, d):
    return I.technical(bars(spark, d)).withColumn("event", I.macd_cross()).where("event is not null").select(*KEY, "event")


@query("w15_ma_cross", f"WITH {TECHNICAL} SELECT symbol, trade_date, CASE WHEN sma_20 > sma_50 AND prev_sma_20 <= prev_sma_50 THEN 'golden' WHEN sma_20 < sma_50 AND prev_sma_20 >= prev_sma_50 THEN 'death' END AS event, sma_20 > sma_50 AS above FROM technical WHERE sma_50 IS NOT NULL")
def w15(spark, d):
    above, event = I.ma_cross("sma_20", "sma_50")
    return I.frame_indicators(bars(spark, d)).withColumns({"above": above, "event": event}).where("sma_50 is not null").select(*KEY, "event", "above")


EXTREMA = """ext AS (SELECT *,
  coalesce({h} > max({h}) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AND {h} > max({h}) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), false) AS is_max,
  coalesce({l} < min({l}) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AND {l} < min({l}) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), false) AS is_min
  FROM {t})"""
RECENT = "recent AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) <= 50)"


def _levels(column: str, flag: str, ascending: bool, name: str, i: int) -> str:
    return f"round(list_sort(list({column}) FILTER (WHERE {flag}), '{'ASC' if ascending else 'DESC'}')[{i}], 9) AS {name}_{i}"


def _level_sql(h: str, low: str, source: str, ascending: bool) -> str:
    parts = [_levels(h, "is_max", False, "resistance", i) for i in (1, 2, 3)] + [_levels(low, "is_min", ascending, "support", i) for i in (1, 2, 3)]
    return f"WITH {BARS}, {RECENT}, {EXTREMA.format(h=h, l=low, t=source)} SELECT symbol, {', '.join(parts)} FROM ext GROUP BY symbol"


def _flat_levels(df: DataFrame) -> DataFrame:
    return df.select("symbol", *[F.round(F.get(n, F.lit(i)), 9).alias(f"{n}_{i + 1}") for n in ("resistance", "support") for i in range(3)])


@query("w16_local_extrema", f"WITH {BARS}, {EXTREMA.format(h='high', l='low', t='bars')} SELECT symbol, trade_date, is_max, is_min FROM ext WHERE is_max OR is_min")
def w16(spark, d):
    return I.local_extrema(bars(spark, d)).where("is_max or is_min").select(*KEY, "is_max", "is_min")


@query("w17_support_resistance", _level_sql("high", "low", "recent", False))
def w17(spark, d):
    return _flat_levels(I.support_resistance(bars(spark, d)))


@query("w17b_levels_of_closes", _level_sql("close", "close", "bars", True))
def w17b(spark, d):
    return _flat_levels(I.support_resistance(bars(spark, d), close_based=True))


@query("w17c_support_bands", f"WITH {BARS}, c AS (SELECT symbol, arg_max(close, trade_date) AS c, max(close) AS hi, min(close) AS lo FROM bars GROUP BY 1) SELECT symbol, round(c * 0.97, 9) AS support_3, round(c * 0.95, 9) AS support_5, round(c * 1.03, 9) AS resistance_3, round(c * 1.05, 9) AS resistance_5, round(hi, 9) AS highest, round(lo, 9) AS lowest FROM c")
def w17c(spark, d):
    names = ["support_3", "support_5", "resistance_3", "resistance_5", "highest", "lowest"]
    return rounded(I.support_bands(bars(spark, d)), names, "symbol")


FIBS = ", ".join(f"round(recent_low + {r} * (recent_high - recent_low), 9) AS fib_{round(r * 1000)}" for r in I.FIBONACCI)
FIBS_DOWN = ", ".join(f"round(hi - {r} * (hi - lo), 9) AS fib_{round(r * 1000)}" for r in (0.0, *I.FIBONACCI, 1.0))


@query("w18_fibonacci", f"WITH {FRAMES} SELECT symbol, {FIBS} FROM frames QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1")
def w18(spark, d):
    levels = I.fibonacci(F.col("recent_high"), F.col("recent_low"))
    return I.latest(I.frame_indicators(bars(spark, d)).select(*KEY, "recent_high", "recent_low")).select("symbol", *[F.round(v, 9).alias(k) for k, v in levels.items()])


@query("w18b_fibonacci_down", f"WITH {BARS}, x AS (SELECT symbol, max(high) AS hi, min(low) AS lo FROM bars GROUP BY 1) SELECT symbol, {FIBS_DOWN} FROM x")
def w18b(spark, d):
    levels = I.fibonacci(F.col("hi"), F.col("lo"), down=True)
    return bars(spark, d).groupBy("symbol").agg(F.max("high").alias("hi"), F.min("low").alias("lo")).select("symbol", *[F.round(v, 9).alias(k) for k, v in levels.items()])


ALL = sorted({c for cs in [*FRAME_QUERIES.values(), *KERNEL_QUERIES.values()] for c in cs})


@query("w19_latest_snapshot", f"WITH {TECHNICAL} SELECT symbol, trade_date, {rsql(ALL)} FROM snap")
def w19(spark, d):
    return rounded(snapshot(spark, d), ALL, *KEY)


@query("w20_full_series", f"WITH {TECHNICAL} SELECT symbol, trade_date, {rsql(ALL)} FROM technical")
def w20(spark, d):
    return rounded(I.technical(bars(spark, d)), ALL, *KEY)


def snapshot(spark, d) -> DataFrame:
    """The last row of each symbol, with the averages of the row before."""
    frames = I.frame_indicators(bars(spark, d)).withColumns({f"prev_{c}": F.lag(c).over(I.series()) for c in ("sma_20", "sma_50")})
    return I.latest(I.recursive_indicators(frames))


def score_sql(service: bool) -> str:
    scored = "rsi_14 > 0" if service else "rsi_14 IS NOT NULL"
    ratio = "volume_ratio_prev" if service else "volume_ratio"
    up, down = ("macd_line > macd_signal", "macd_line < macd_signal") if service else (CROSS.split(" THEN ")[0].removeprefix("CASE WHEN "), CROSS.split("WHEN ")[2].split(" THEN ")[0])
    placed = "macd_signal IS NOT NULL" if service else "macd_signal IS NOT NULL AND prev_macd_signal IS NOT NULL"
    return f"""CAST(CASE WHEN {scored} THEN CASE WHEN rsi_14 < 30 THEN 2 WHEN rsi_14 < 40 THEN 1 WHEN rsi_14 > 70 THEN -2 WHEN rsi_14 > 60 THEN -1 ELSE 0 END ELSE 0 END
      + CASE WHEN {up} THEN 2 WHEN {down} THEN -2 ELSE 0 END + CASE WHEN {placed} THEN CASE WHEN macd_line > 0 THEN 0.5 ELSE -0.5 END ELSE 0 END
      + CASE WHEN close > sma_20 THEN 1 WHEN close <= sma_20 THEN -1 ELSE 0 END + CASE WHEN sma_20 > sma_50 THEN 1 WHEN sma_20 <= sma_50 THEN -1 ELSE 0 END
      + CASE WHEN close < bb_lower THEN 1.5 WHEN close > bb_upper THEN -1.5 ELSE 0 END + CASE WHEN stoch_k < 20 AND stoch_d < 20 THEN 1 WHEN stoch_k > 80 AND stoch_d > 80 THEN -1 ELSE 0 END
      + CASE WHEN {ratio} > 1.5 THEN 0.5 WHEN {ratio} < 0.5 THEN -0.5 ELSE 0 END AS DOUBLE)"""


LABEL = "CASE WHEN score >= 4 THEN 'STRONG_BUY' WHEN score >= 2 THEN 'BUY' WHEN score >= -2 THEN 'HOLD' WHEN score >= -4 THEN 'SELL' ELSE 'STRONG_SELL' END"
SURE = "CAST(CASE WHEN score >= 4 THEN least(95, 70 + (score - 4) * 5) WHEN score >= 2 THEN least(85, 60 + (score - 2) * 5) WHEN score >= -2 THEN 50 + abs(score) * 5 WHEN score >= -4 THEN least(85, 60 + abs(score + 2) * 5) ELSE least(95, 70 + abs(score + 4) * 5) END AS DOUBLE)"
SCORED = f"scored AS (SELECT *, {score_sql(False)} AS score FROM snap), recommended AS (SELECT *, {LABEL} AS recommendation, {SURE} AS confidence FROM scored)"


def recommended(spark, d) -> DataFrame:
    return S.recommend(snapshot(spark, d))


@query("c1_additive_score", f"WITH {TECHNICAL}, {SCORED} SELECT symbol, trade_date, score FROM scored")
def c1(spark, d):
    return recommended(spark, d).select(*KEY, "score")


@query("c1_additive_score_service", f"WITH {TECHNICAL} SELECT symbol, trade_date, {score_sql(True)} AS score FROM snap")
def c1_service(spark, d):
    return S.additive_score(snapshot(spark, d), parity="service", macd_rule="state").select(*KEY, "score")


CODES = f"""list_filter([CASE WHEN rsi_14 < 30 THEN 'RSI_OVERSOLD' END, CASE WHEN rsi_14 >= 30 AND rsi_14 < 40 THEN 'RSI_LOW' END, CASE WHEN rsi_14 > 70 THEN 'RSI_OVERBOUGHT' END, CASE WHEN rsi_14 > 60 AND rsi_14 <= 70 THEN 'RSI_HIGH' END,
  CASE {CROSS} WHEN 'bullish' THEN 'MACD_BULLISH_CROSS' WHEN 'bearish' THEN 'MACD_BEARISH_CROSS' END, CASE WHEN close > sma_20 THEN 'PRICE_ABOVE_SMA20' WHEN close <= sma_20 THEN 'PRICE_BELOW_SMA20' END,
  CASE WHEN sma_20 > sma_50 THEN 'GOLDEN_CROSS' WHEN sma_20 <= sma_50 THEN 'DEATH_CROSS' END, CASE WHEN close < bb_lower THEN 'PRICE_BELOW_BB_LOWER' WHEN close > bb_upper THEN 'PRICE_ABOVE_BB_UPPER' END,
  CASE WHEN stoch_k < 20 AND stoch_d < 20 THEN 'STOCH_OVERSOLD' WHEN stoch_k > 80 AND stoch_d > 80 THEN 'STOCH_OVERBOUGHT' END], lambda x: x IS NOT NULL)"""


@query("c2_signal_codes", f"WITH {TECHNICAL} SELECT symbol, array_to_string({CODES}, ',') AS signals FROM snap")
def c2(spark, d):
    return recommended(spark, d).select("symbol", F.array_join("signals", ",").alias("signals"))


@query("c3_recommendation", f"WITH {TECHNICAL}, {SCORED} SELECT symbol, trade_date, score, recommendation, confidence FROM recommended")
def c3(spark, d):
    return recommended(spark, d).select(*KEY, "score", "recommendation", "confidence")


def _weighted_sql(simple: bool) -> str:
    macd = "CASE WHEN macd_line > macd_signal THEN CASE WHEN prev_macd_line <= prev_macd_signal THEN 1.0 ELSE 0.5 END ELSE CASE WHEN prev_macd_line >= prev_macd_signal THEN -1.0 ELSE -0.5 END END"
    average = "CASE WHEN sma_20 > sma_50 THEN CASE WHEN prev_sma_20 <= prev_sma_50 THEN 1.0 WHEN close > sma_20 THEN 0.5 ELSE 0.3 END ELSE CASE WHEN prev_sma_20 >= prev_sma_50 THEN -1.0 WHEN close < sma_20 THEN -0.5 ELSE -0.3 END END"
    adx = "CASE WHEN adx > 25 THEN CASE WHEN plus_di > minus_di THEN 0.8 ELSE -0.8 END ELSE 0.0 END"
    volume = f"CASE WHEN volume_ratio > 1.5 THEN CASE WHEN {macd} > 0 THEN 0.5 ELSE -0.5 END ELSE 0.0 END"
    if simple:
        macd, average = "CASE WHEN macd_line > macd_signal THEN 0.8 ELSE -0.5 END", "CASE WHEN sma_20 > sma_50 THEN 0.7 ELSE -0.5 END"
        adx, volume = "CASE WHEN adx > 25 THEN 0.5 ELSE 0.0 END", "CASE WHEN volume_ratio > 1.5 THEN 0.3 ELSE 0.0 END"
    return f"""weighed AS (SELECT symbol, 0.15::DOUBLE * (CASE WHEN rsi_14 < 30 THEN 1.0 WHEN rsi_14 > 70 THEN -1.0 ELSE (50 - rsi_14) / 50 END)::DOUBLE + 0.2::DOUBLE * ({macd})::DOUBLE
      + 0.15::DOUBLE * (CASE WHEN close < bb_lower THEN 1.0 WHEN close > bb_upper THEN -1.0 WHEN bb_upper = bb_middle THEN 0.0 ELSE (bb_middle - close) / nullif(bb_upper - bb_middle, 0) END)::DOUBLE
      + 0.2::DOUBLE * ({average})::DOUBLE + 0.1::DOUBLE * ({volume})::DOUBLE + 0.1::DOUBLE * ({adx})::DOUBLE + 0.1::DOUBLE * (CASE WHEN stoch_k < 20 THEN 1.0 WHEN stoch_k > 80 THEN -1.0 ELSE (50 - stoch_k) / 50 END)::DOUBLE AS w FROM snap)
      SELECT symbol, round(w, 6) AS weighted, CASE WHEN w > 0.6 THEN 'STRONG_BUY' WHEN w > 0.2 THEN 'BUY' WHEN w > -0.2 THEN 'HOLD' WHEN w > -0.6 THEN 'SELL' ELSE 'STRONG_SELL' END AS label, round(least(abs(w) + 0.3::DOUBLE, 1.0::DOUBLE), 6) AS confidence FROM weighed"""


def _weighted(simple: bool):
    def run(spark, d):
        out = S.weighted_score(snapshot(spark, d), simple)
        return out.select("symbol", F.round("weighted", 6).alias("weighted"), F.col("weighted_label").alias("label"), F.round("weighted_confidence", 6).alias("confidence"))

    return run


query("c4_weighted_score", f"WITH {TECHNICAL}, {_weighted_sql(False)}")(_weighted(False))
query("c4b_weighted_simple", f"WITH {TECHNICAL}, {_weighted_sql(True)}")(_weighted(True))


@query("c5_price_targets", f"WITH {TECHNICAL} SELECT symbol, {rsql(['bb_upper', 'bb_lower', 'recent_high', 'sma_20'])}, {FIBS} FROM snap")
def c5(spark, d):
    levels = I.fibonacci(F.col("recent_high"), F.col("recent_low"))
    return rounded(snapshot(spark, d).withColumns(levels), ["bb_upper", "bb_lower", "recent_high", "sma_20", *levels], "symbol")


@query("c5b_targets_by_label", f"WITH {TECHNICAL}, {SCORED} SELECT symbol, round(CASE WHEN recommendation LIKE '%BUY' THEN close * 1.05 WHEN recommendation LIKE '%SELL' THEN close * 0.95 ELSE close END, 9) AS target, round(CASE WHEN recommendation LIKE '%BUY' THEN close * 0.95 WHEN recommendation LIKE '%SELL' THEN close * 1.05 ELSE close * 0.97 END, 9) AS stop FROM recommended")
def c5b(spark, d):
    target, stop = S.targets_by_label(F.col("recommendation"), F.col("close"))
    return recommended(spark, d).select("symbol", F.round(target, 9).alias("target"), F.round(stop, 9).alias("stop"))


@query("c6_basic_signal", f"WITH {TECHNICAL} SELECT symbol, CASE WHEN rsi_14 < 30 THEN 'BUY' WHEN rsi_14 > 70 THEN 'SELL' ELSE 'HOLD' END AS basic, round(CAST(0.5 + CASE WHEN rsi_14 < 30 OR rsi_14 > 70 THEN 0.2 ELSE 0 END + CASE WHEN close > sma_20 THEN 0.1 ELSE -0.1 END + CASE WHEN macd_line > macd_signal THEN 0.15 ELSE 0 END AS DOUBLE), 6) AS confidence FROM snap")
def c6(spark, d):
    return S.basic_signal(snapshot(spark, d)).select("symbol", "basic", F.round("basic_confidence", 6).alias("confidence"))


VOTES = """votes AS (SELECT symbol, CASE WHEN rsi_14 < 30 THEN 1 ELSE 0 END + CASE WHEN macd_line > macd_signal THEN 1 ELSE 0 END + CASE WHEN close < bb_lower THEN 1 ELSE 0 END AS b,
  CASE WHEN rsi_14 > 70 THEN 1 ELSE 0 END + CASE WHEN macd_line < macd_signal THEN 1 ELSE 0 END + CASE WHEN close > bb_upper THEN 1 ELSE 0 END AS s,
  CASE WHEN rsi_14 < 30 THEN (30 - rsi_14) / 30 * 100 WHEN rsi_14 > 70 THEN (rsi_14 - 70) / 30 * 100 ELSE 0 END + CASE WHEN macd_line <> macd_signal THEN 70 ELSE 0 END + CASE WHEN close < bb_lower OR close > bb_upper THEN 60 ELSE 0 END AS c FROM snap)"""


@query("c6b_vote_signal", f"WITH {TECHNICAL}, {VOTES} SELECT symbol, CASE WHEN b > s THEN 'BUY' WHEN s > b THEN 'SELL' ELSE 'HOLD' END AS vote, round(CAST(CASE WHEN b = s THEN 50 ELSE c / nullif(b + s, 0) END AS DOUBLE), 9) AS confidence FROM votes")
def c6b(spark, d):
    return S.vote_signal(snapshot(spark, d)).select("symbol", "vote", F.round("vote_confidence", 9).alias("confidence"))


@query("c10_expected_return", f"WITH {TECHNICAL} SELECT symbol, round((coalesce(bb_upper, close * 1.05) - close) / close * 100, 9) AS expected_return FROM snap")
def c10(spark, d):
    return snapshot(spark, d).select("symbol", F.round(S.expected_return(F.col("close"), F.col("bb_upper")), 9).alias("expected_return"))


@query("c13_volatility", f"WITH {TECHNICAL} SELECT symbol, round(atr_14 / close * 100, 9) AS volatility FROM snap")
def c13(spark, d):
    return snapshot(spark, d).select("symbol", F.round(S.volatility(F.col("atr_14"), F.col("close")), 9).alias("volatility"))


@query("j8_enrich", f"WITH {TECHNICAL}, {SCORED}, {STOCKS} SELECT symbol, exchange, industry, recommendation FROM recommended JOIN stocks USING (symbol) WHERE is_active")
def j8(spark, d):
    return recommended(spark, d).join(stocks(spark, d).where("is_active"), "symbol").select("symbol", "exchange", "industry", "recommendation")


@query("j9_latest_as_of", f"WITH {BARS} SELECT symbol, trade_date, round(close, 9) AS close FROM bars WHERE trade_date <= DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1")
def j9(spark, d):
    known = bars(spark, d).where(F.col("trade_date") <= F.lit(AS_OF).cast("date")).select(*KEY, "close")
    return rounded(I.latest(known), ["close"], *KEY)


@query("a4_report_counters", f"WITH {TECHNICAL}, {SCORED} SELECT count(*) AS total, count(*) FILTER (WHERE recommendation LIKE '%BUY') AS buy, count(*) FILTER (WHERE recommendation LIKE '%SELL') AS sell, count(*) FILTER (WHERE recommendation = 'HOLD') AS hold FROM recommended")
def a4(spark, d):
    r = F.col("recommendation")
    return recommended(spark, d).agg(F.count("*").alias("total"), F.count_if(r.endswith("BUY")).alias("buy"), F.count_if(r.endswith("SELL")).alias("sell"), F.count_if(r == "HOLD").alias("hold"))


@query("a11_batch_summary", f"WITH {BARS}, asked AS (SELECT {symbol_sql('p_partkey % 200')} AS symbol FROM part GROUP BY 1), done AS (SELECT symbol FROM bars GROUP BY 1 HAVING count(*) >= 26) SELECT asked.symbol, done.symbol IS NOT NULL AS analysed FROM asked LEFT JOIN done USING (symbol)")
def a11(spark, d):
    asked = read(spark, d, "part").select(symbol_of(F.col("p_partkey") % 200).alias("symbol")).distinct()
    done = B.minimum_history(bars(spark, d)).select("symbol", F.lit(True).alias("analysed")).distinct()
    return asked.join(done, "symbol", "left").select("symbol", F.coalesce("analysed", F.lit(False)).alias("analysed"))


WEEKS = f"WITH {BARS}, m AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS c FROM bars) SELECT date_trunc('week', trade_date)::DATE AS week, count(*) FILTER (WHERE c > 0) AS rising, count(*) FILTER (WHERE c < 0) AS falling, count(DISTINCT trade_date) AS days FROM m GROUP BY 1"


@query("a13_weekly_rollup", WEEKS)
def a13(spark, d):
    c = F.col("close") - F.lag("close").over(I.series())
    return bars(spark, d).withColumn("c", c).groupBy(F.to_date(F.date_trunc("week", "trade_date")).alias("week")).agg(F.count_if(F.col("c") > 0).alias("rising"), F.count_if(F.col("c") < 0).alias("falling"), F.count_distinct("trade_date").alias("days"))


OVERVIEW = """daily0 AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS b FROM bars), daily AS (
  SELECT trade_date, CAST(sum(volume) AS BIGINT) AS total_volume, sum(close * volume) / nullif(sum(volume), 0) AS market_index, count(*) FILTER (WHERE close > b) AS advancing, count(*) FILTER (WHERE close < b) AS declining FROM daily0 GROUP BY 1
), overview AS (SELECT *, (market_index - lag(market_index) OVER (ORDER BY trade_date)) / nullif(lag(market_index) OVER (ORDER BY trade_date), 0) * 100 AS index_change,
  total_volume / nullif(avg(total_volume) OVER (ORDER BY trade_date ROWS 19 PRECEDING), 0) AS market_volume_ratio FROM daily)"""


@query("a9_market_overview", f"WITH {BARS}, {OVERVIEW} SELECT trade_date, total_volume, advancing, declining, {rsql(['market_index', 'index_change'])} FROM overview")
def a9(spark, d):
    return rounded(R.market_overview(bars(spark, d)), ["market_index", "index_change"], "trade_date", "total_volume", "advancing", "declining")


@query("a10_market_volume_ratio", f"WITH {BARS}, {OVERVIEW} SELECT trade_date, {rsql(['market_volume_ratio'])} FROM overview")
def a10(spark, d):
    return rounded(R.market_overview(bars(spark, d)), ["market_volume_ratio"], "trade_date")


@query("io6_technical_rows", f"WITH {FRAMES} SELECT symbol, trade_date, CAST(CAST(sma_20 AS DECIMAL(15,2)) AS DOUBLE) AS sma_20, CAST(CAST(vwap AS DECIMAL(15,2)) AS DOUBLE) AS vwap, volume FROM frames")
def io6(spark, d):
    rows = technical_rows(I.frame_indicators(bars(spark, d)).select(*KEY, "sma_20", "vwap", "volume"))
    return rows.select(*KEY, F.col("sma_20").cast("double").alias("sma_20"), F.col("vwap").cast("double").alias("vwap"), "volume")


@query("io9_merge_latest", f"WITH {BARS}, u AS (SELECT symbol, trade_date, volume, 0 AS v FROM bars UNION ALL SELECT symbol, trade_date, volume + 1, 1 FROM bars WHERE volume % 2 = 0) SELECT symbol, trade_date, volume, v FROM u QUALIFY row_number() OVER (PARTITION BY symbol, trade_date ORDER BY v DESC) = 1")
def io9(spark, d):
    base = bars(spark, d).select(*KEY, "volume", F.lit(0).alias("v"))
    updates = base.where("volume % 2 = 0").select(*KEY, (F.col("volume") + 1).alias("volume"), F.lit(1).alias("v"))
    return R.merge_latest(base, updates, list(KEY), "v")


@query("io9_insert_only", f"WITH {STOCKS}, base AS (SELECT * FROM stocks WHERE exchange = 'HSX') SELECT symbol, exchange FROM base UNION ALL SELECT symbol, 'NEW' FROM stocks WHERE symbol NOT IN (SELECT symbol FROM base)")
def io9_insert(spark, d):
    known = stocks(spark, d).select("symbol", "exchange")
    return R.insert_only(known.where("exchange = 'HSX'"), known.select("symbol", F.lit("NEW").alias("exchange")), ["symbol"])


@query("io10_retention", f"WITH {BARS} SELECT trade_date, CASE WHEN DATE '{AS_OF}' - trade_date <= 365 THEN 'keep' ELSE 'archive' END AS disposal, count(*) AS bars FROM bars GROUP BY 1, 2")
def io10(spark, d):
    kept, gone = R.apply_retention(bars(spark, d), "processed", AS_OF)
    return kept.withColumn("disposal", F.lit("keep")).unionByName(gone).groupBy("trade_date", "disposal").agg(F.count("*").alias("bars"))


@query("t17_math_helpers", f"WITH {BARS} SELECT symbol, trade_date, round(abs(close - open), 9) AS move, round(greatest(0, least(1000, close)), 9) AS clamped, round(sqrt(volume), 9) AS root FROM bars")
def t17(spark, d):
    return bars(spark, d).select(*KEY, F.round(F.abs(F.col("close") - F.col("open")), 9).alias("move"), F.round(S.clamp(F.col("close"), 0.0, 1000.0), 9).alias("clamped"), F.round(F.sqrt("volume"), 9).alias("root"))
