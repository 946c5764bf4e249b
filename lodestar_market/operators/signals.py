"""Scores, recommendations, forecasts, risk and alerts: expressions over one snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(name: str) -> Column:
    return F.col(name)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def _rules(parity: str, macd_rule: str) -> list[tuple[Column, float, str | None, str | None, str | None]]:
    """(condition, points, code, reason format, its column), in the order of the rules."""
    rsi, line, signal, price = _c("rsi_14"), _c("macd_line"), _c("macd_signal"), _c("close")
    scored = rsi > 0 if parity == "service" else rsi.isNotNull()
    ratio = _c("volume_ratio_prev") if parity == "service" else _c("volume_ratio")
    ratio_name = "volume_ratio_prev" if parity == "service" else "volume_ratio"
    if macd_rule == "state":
        rises, falls = line > signal, line < signal
        placed = signal.isNotNull()
    else:
        was, was_signal = _c("prev_macd_line"), _c("prev_macd_signal")
        rises, falls = (was <= was_signal) & (line > signal), (was >= was_signal) & (line < signal)
        placed = signal.isNotNull() & was_signal.isNotNull()
    k, d = _c("stoch_k"), _c("stoch_d")
    return [
        (scored & (rsi < 30), 2.0, "RSI_OVERSOLD", "RSI oversold (%.1f < 30)", "rsi_14"),
        (scored & (rsi >= 30) & (rsi < 40), 1.0, "RSI_LOW", "RSI low (%.1f)", "rsi_14"),
        (scored & (rsi > 70), -2.0, "RSI_OVERBOUGHT", "RSI overbought (%.1f > 70)", "rsi_14"),
        (scored & (rsi > 60) & (rsi <= 70), -1.0, "RSI_HIGH", "RSI high (%.1f)", "rsi_14"),
        (rises, 2.0, "MACD_BULLISH_CROSS", "MACD above its signal (%.2f)", "macd_line"),
        (falls, -2.0, "MACD_BEARISH_CROSS", "MACD below its signal (%.2f)", "macd_line"),
        (placed & (line > 0), 0.5, None, None, None),
        (placed & (line <= 0), -0.5, None, None, None),
        (price > _c("sma_20"), 1.0, "PRICE_ABOVE_SMA20", "Price above SMA20 (%.1f)", "sma_20"),
        (price <= _c("sma_20"), -1.0, "PRICE_BELOW_SMA20", "Price below SMA20 (%.1f)", "sma_20"),
        (_c("sma_20") > _c("sma_50"), 1.0, "GOLDEN_CROSS", "SMA20 above SMA50 (%.1f)", "sma_50"),
        (_c("sma_20") <= _c("sma_50"), -1.0, "DEATH_CROSS", "SMA20 not above SMA50 (%.1f)", "sma_50"),
        (price < _c("bb_lower"), 1.5, "PRICE_BELOW_BB_LOWER", "Price below the lower band (%.1f)", "bb_lower"),
        (price > _c("bb_upper"), -1.5, "PRICE_ABOVE_BB_UPPER", "Price above the upper band (%.1f)", "bb_upper"),
        ((k < 20) & (d < 20), 1.0, "STOCH_OVERSOLD", "Stochastic oversold (%.1f)", "stoch_k"),
        ((k > 80) & (d > 80), -1.0, "STOCH_OVERBOUGHT", "Stochastic overbought (%.1f)", "stoch_k"),
        (_c("adx") > 25, 0.0, None, "ADX = %.1f, strong trend", "adx"),
        (_c("adx") <= 25, 0.0, None, "ADX = %.1f, sideways", "adx"),
        (ratio > 1.5, 0.5, None, "Volume %.1f times the usual", ratio_name),
        (ratio < 0.5, -0.5, None, "Volume only %.1f times the usual", ratio_name),
    ]


def additive_score(df: DataFrame, parity: str = "agent", macd_rule: str = "event") -> DataFrame:
    """Adds score, signals (codes) and reasons; parts with a missing input are skipped."""
    rules = _rules(parity, macd_rule)
    score = sum((F.when(when, points).otherwise(0.0) for when, points, *_ in rules), F.lit(0.0))
    codes = F.array_compact(F.array(*[F.when(when, code) for when, _, code, *_ in rules if code]))
    reasons = F.array_compact(F.array(*[F.when(when, F.format_string(text, _c(column))) for when, _, _, text, column in rules if text]))
    return df.withColumns({"score": score, "signals": codes, "reasons": reasons})


def recommendation(score: Column) -> Column:
    return F.when(score >= 4, "STRONG_BUY").when(score >= 2, "BUY").when(score >= -2, "HOLD").when(score >= -4, "SELL").when(score.isNotNull(), "STRONG_SELL")


def confidence(score: Column) -> Column:
    """0 to 100."""
    return (
        F.when(score >= 4, F.least(F.lit(95.0), 70 + (score - 4) * 5)).when(score >= 2, F.least(F.lit(85.0), 60 + (score - 2) * 5))
        .when(score >= -2, 50 + F.abs(score) * 5).when(score >= -4, F.least(F.lit(85.0), 60 + F.abs(score + 2) * 5))
        .when(score.isNotNull(), F.least(F.lit(95.0), 70 + F.abs(score + 4) * 5))
    )


#: What ``recommend`` reads of a row.
SCORED = ("close", "rsi_14", "macd_line", "macd_signal", "prev_macd_line", "prev_macd_signal", "bb_upper", "bb_lower", "sma_20", "sma_50", "stoch_k", "stoch_d", "adx", "volume_ratio", "volume_ratio_prev")


def recommend(df: DataFrame, **options) -> DataFrame:
    scored = additive_score(df, **options)
    return scored.withColumns({"recommendation": recommendation(_c("score")), "confidence": confidence(_c("score"))})


# Weights of the component scores.
WEIGHTS = {"rsi": 0.15, "macd": 0.20, "bollinger": 0.15, "moving_average": 0.20, "volume": 0.10, "adx": 0.10, "stochastic": 0.10}


def weighted_score(df: DataFrame, simple: bool = False) -> DataFrame:
    """Component scores in [-1, 1], their weighted sum, label and confidence (0 to 1).

    Needs prev_sma_20 and prev_sma_50.  With a missing component the label is null.
    """
    rsi, k, price, line, signal = _c("rsi_14"), _c("stoch_k"), _c("close"), _c("macd_line"), _c("macd_signal")
    s20, s50, was20, was50 = _c("sma_20"), _c("sma_50"), _c("prev_sma_20"), _c("prev_sma_50")
    known = lambda test, value: F.when(test.isNotNull(), value)
    macd = F.when(line > signal, F.when(_c("prev_macd_line") <= _c("prev_macd_signal"), 1.0).otherwise(0.5)).otherwise(F.when(_c("prev_macd_line") >= _c("prev_macd_signal"), -1.0).otherwise(-0.5))
    average = F.when(s20 > s50, F.when(was20 <= was50, 1.0).when(price > s20, 0.5).otherwise(0.3)).otherwise(F.when(was20 >= was50, -1.0).when(price < s20, -0.5).otherwise(-0.3))
    adx = F.when(_c("adx") > 25, F.when(_c("plus_di") > _c("minus_di"), 0.8).otherwise(-0.8)).otherwise(0.0)
    volume = F.when(_c("volume_ratio") > 1.5, F.when(macd > 0, 0.5).otherwise(-0.5)).otherwise(0.0)
    if simple:
        macd, average = F.when(line > signal, 0.8).otherwise(-0.5), F.when(s20 > s50, 0.7).otherwise(-0.5)
        adx, volume = F.when(_c("adx") > 25, 0.5).otherwise(0.0), F.when(_c("volume_ratio") > 1.5, 0.3).otherwise(0.0)
    band = _c("bb_upper") - _c("bb_middle")
    parts = {
        "rsi": known(rsi, F.when(rsi < 30, 1.0).when(rsi > 70, -1.0).otherwise((50 - rsi) / 50)),
        "macd": known(signal, macd),
        "bollinger": known(_c("bb_upper"), F.when(price < _c("bb_lower"), 1.0).when(price > _c("bb_upper"), -1.0).when(band == 0, 0.0).otherwise((_c("bb_middle") - price) / F.nullif(band, F.lit(0.0)))),
        "moving_average": known(s50, average),
        "volume": known(_c("volume_ratio"), volume),
        "adx": known(_c("adx"), adx),
        "stochastic": known(k, F.when(k < 20, 1.0).when(k > 80, -1.0).otherwise((50 - k) / 50)),
    }
    out = df.withColumns({f"part_{name}": part for name, part in parts.items()})
    total = sum((_c(f"part_{name}") * w for name, w in WEIGHTS.items()), F.lit(0.0))
    w = _c("weighted")
    label = F.when(w > 0.6, "STRONG_BUY").when(w > 0.2, "BUY").when(w > -0.2, "HOLD").when(w > -0.6, "SELL").when(w.isNotNull(), "STRONG_SELL")
    return out.withColumn("weighted", total).withColumns({"weighted_label": label, "weighted_confidence": F.least(F.abs(w) + 0.3, F.lit(1.0))})


def basic_signal(df: DataFrame) -> DataFrame:
    rsi = _c("rsi_14")
    sure = F.lit(0.5) + F.when((rsi < 30) | (rsi > 70), 0.2).otherwise(0.0) + F.when(_c("close") > _c("sma_20"), 0.1).otherwise(-0.1) + F.when(_c("macd_line") > _c("macd_signal"), 0.15).otherwise(0.0)
    return df.withColumns({"basic": F.when(rsi < 30, "BUY").when(rsi > 70, "SELL").otherwise("HOLD"), "basic_confidence": sure})


def vote_signal(df: DataFrame) -> DataFrame:
    """RSI, MACD and Bollinger vote; the majority wins, a tie or no vote is HOLD at 50."""
    rsi, price = _c("rsi_14"), _c("close")
    votes = [
        (rsi < 30, rsi > 70, F.when(rsi < 30, (30 - rsi) / 30 * 100).otherwise((rsi - 70) / 30 * 100)),
        (_c("macd_line") > _c("macd_signal"), _c("macd_line") < _c("macd_signal"), F.lit(70.0)),
        (price < _c("bb_lower"), price > _c("bb_upper"), F.lit(60.0)),
    ]
    one = lambda test: F.when(test, 1).otherwise(0)
    buy, sell = sum((one(b) for b, _, _ in votes), F.lit(0)), sum((one(s) for _, s, _ in votes), F.lit(0))
    sure = sum((F.when(b | s, v).otherwise(0.0) for b, s, v in votes), F.lit(0.0))
    return df.withColumns({"vote": F.when(buy > sell, "BUY").when(sell > buy, "SELL").otherwise("HOLD"), "vote_confidence": F.when(buy == sell, 50.0).otherwise(F.try_divide(sure, buy + sell))})


def targets_by_label(label: Column, price: Column) -> tuple[Column, Column]:
    """Target and stop: 5 % either way, or the price and 3 % below for HOLD."""
    buy, sell = label.isin("BUY", "STRONG_BUY"), label.isin("SELL", "STRONG_SELL")
    return F.when(buy, price * 1.05).when(sell, price * 0.95).otherwise(price), F.when(buy, price * 0.95).when(sell, price * 1.05).otherwise(price * 0.97)


def volatility(atr: Column, price: Column) -> Column:
    return F.try_divide(atr, price) * 100


def technical_component(label: Column, sure: Column) -> Column:
    """0 to 1 from label and confidence (0 to 1); STRONG labels count like plain ones."""
    return clamp(0.5 + F.when(label.isin("BUY", "STRONG_BUY"), sure * 0.5).when(label.isin("SELL", "STRONG_SELL"), -sure * 0.5).otherwise(0.0))


def sentiment_component(overall: Column) -> Column:
    return F.coalesce((overall + 1) / 2, F.lit(0.5))


def market_component(index_change: Column, volume_ratio: Column, foreign_net: Column) -> Column:
    index = F.coalesce(index_change, F.lit(0.0))
    score = 0.5 + F.when(index > 0, 0.2).when(index < -1, -0.2).otherwise(0.0) + F.when(volume_ratio > 1.2, 0.1).otherwise(0.0) + F.when(foreign_net > 0, 0.15).otherwise(0.0)
    return clamp(score)


#: Why an action is taken; a warning follows where there are rumours.
ACTION_REASONS = {
    "STRONG_BUY": ("Technical signals are positive", "Market sentiment is optimistic"),
    "BUY": ("Short-term trend is up",),
    "HOLD": ("Market moves sideways, wait for a clearer signal",),
    "SELL": ("Selling pressure grows",),
    "STRONG_SELL": ("Technical signals are strongly negative",),
}
RUMOUR_WARNING = "WARNING: unconfirmed rumours found"


def forecast_reasons(action: Column, rumours: Column) -> Column:
    """The reasons of an action, and the warning where ``rumours`` is true."""
    reasons = F.array().cast("array<string>")
    for name, texts in ACTION_REASONS.items():
        reasons = F.when(action == name, F.array(*map(F.lit, texts))).otherwise(reasons)
    return F.when(rumours, F.array_append(reasons, F.lit(RUMOUR_WARNING))).otherwise(reasons)


def forecast(df: DataFrame, scale: str = "unit") -> DataFrame:
    """Adds final_score, action, action_confidence from tech_score, sent_score, market_score.

    ``scale="signed"`` reads the bands on -1 to 1.  Where ``rumour_mentions`` is
    at hand, action_reasons is added too.
    """
    final = F.col("tech_score") * 0.4 + F.col("sent_score") * 0.3 + F.col("market_score") * 0.3
    f = _c("final_score")
    bands = (0.7, 0.55, 0.45, 0.3) if scale == "unit" else (0.6, 0.2, -0.2, -0.6)
    action = F.when(f >= bands[0], "STRONG_BUY").when(f >= bands[1], "BUY").when(f >= bands[2], "HOLD").when(f >= bands[3], "SELL").when(f.isNotNull(), "STRONG_SELL")
    sure = F.when(f >= bands[1], f).when(f >= bands[2], 0.6).otherwise(1 - f)
    # Nine digits: a band must not hang on the order in which parts are added.
    out = df.withColumn("final_score", F.round(final if scale == "unit" else 2 * final - 1, 9)).withColumns({"action": action, "action_confidence": sure})
    return out.withColumn("action_reasons", forecast_reasons(_c("action"), _c("rumour_mentions") > 0)) if "rumour_mentions" in df.columns else out


def risk_level(volatility_: Column, negative_ratio: Column, has_rumours: Column) -> Column:
    points = F.when(volatility_ > 3, 2).otherwise(0) + F.when(negative_ratio > 0.5, 2).otherwise(0) + F.when(has_rumours, 3).otherwise(0)
    return F.when(points >= 5, "HIGH").when(points >= 3, "MEDIUM").otherwise("LOW")


def risk_by_thresholds(atr_share: Column, negative_ratio: Column, has_rumours: Column) -> Column:
    high = (atr_share > 0.05) | (negative_ratio > 0.5) | has_rumours
    return F.when(high, "HIGH").when((atr_share > 0.03) | (negative_ratio > 0.3), "MEDIUM").otherwise("LOW")


def expected_return(price: Column, upper: Column) -> Column:
    return (F.coalesce(upper, price * 1.05) - price) / F.nullif(price, F.lit(0.0)) * 100


def alerts(df: DataFrame, min_mentions: int = 5) -> DataFrame:
    """Zero or more rows per symbol: symbol, alert_type, message."""
    found = F.array_compact(
        F.array(
            F.when(_c("risk") == "HIGH", F.struct(F.lit("HIGH_RISK").alias("alert_type"), F.concat(_c("symbol"), F.lit(": high risk")).alias("message"))),
            F.when(_c("action").isin("STRONG_BUY", "STRONG_SELL"), F.struct(F.lit("STRONG_SIGNAL").alias("alert_type"), F.concat_ws(": ", "symbol", F.replace("action", F.lit("_"), F.lit(" "))).alias("message"))),
            F.when(_c("rumour_mentions") > min_mentions, F.struct(F.lit("RUMOR").alias("alert_type"), F.concat(_c("symbol"), F.lit(": unconfirmed rumour")).alias("message"))),
        )
    )
    return df.withColumn("_alert", F.explode(found)).select(*[c for c in df.columns if c not in ("alert_type", "message")], "_alert.*")


def insights(df: DataFrame) -> DataFrame:
    found = F.array(
        F.when(F.array_contains("signals", "RSI_OVERSOLD"), "RSI is oversold"),
        F.when(_c("rumour_mentions") > 0, "Rumours on social media"),
        F.when(_c("action_confidence") > 0.8, F.format_string("High confidence (%.1f%%)", F.round(_c("action_confidence") * 100, 6))),
    )
    return df.withColumn("insights", F.array_compact(found))
