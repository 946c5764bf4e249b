"""Vectors worked out by hand, and properties."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar_market.operators import indicators as I
from lodestar_market.operators import monitoring as M
from lodestar_market.operators import signals as S
from lodestar_market.operators import text as T
from lodestar_market.plans import daily
from lodestar_market.sources import files
from lodestar_market.streaming import jobs as J

BAR = files.BAR


def mock_bars(n=100):
    out, base = [], 50_000.0
    day = datetime.date(2024, 1, 1)
    for i in range(n):
        o = base + (i % 10 - 5) * 100
        c = o + (i % 5 - 2) * 50
        out.append(("AAA", day + datetime.timedelta(i), o, max(o, c) + (i % 3) * 30, min(o, c) - (i % 3) * 30, c, 1_000_000 + (i % 10) * 100_000))
        base = c
    return out


def snapshot(spark):
    frames = I.frame_indicators(spark.createDataFrame(mock_bars(), BAR)).withColumns({f"prev_{c}": F.lag(c).over(I.series()) for c in ("sma_20", "sma_50")})
    return I.latest(I.recursive_indicators(frames))


GOLDEN = {
    "change_percent": 1.1235955056179776, "sma_20": 44550.0, "sma_50": 45300.0, "ema_12": 44459.60204755419, "ema_26": 44743.21011124002, "rsi_14": 53.380019852965006, "rsi_simple": 57.89473684210526,
    "macd_line": -283.60806368583144, "macd_signal": -355.2510674599241, "macd_histogram": 71.64300377409268, "prev_macd_line": -361.31904575700173, "prev_macd_signal": -373.1618184034473,
    "bb_upper": 45454.4335243676, "bb_lower": 43645.5664756324, "bb_width": 0.04060307629035246, "stoch_k": 67.44186046511628, "stoch_d": 41.27906976744186, "adx_sum": 275.58719406797513,
    "plus_di": 40.924279905642024, "minus_di": 35.69688710240534, "adx": 19.684799576283939, "atr_14": 320.78578303933057, "atr_simple": 326.42857142857144, "vwap": 46551.14942528735,
    "volume_ratio_prev": 1.0555555555555556, "volume_ratio": 1.3103448275862069, "recent_high": 45560, "recent_low": 43840,
}


def test_golden_series(spark):
    row = snapshot(spark).first()
    for name, value in GOLDEN.items():
        assert row[name] == pytest.approx(value, rel=1e-9), name
    one = S.recommend(snapshot(spark)).first()
    assert (one["score"], one["recommendation"], one["confidence"]) == (-0.5, "HOLD", 52.5)
    other = S.recommend(snapshot(spark), parity="service", macd_rule="state").first()
    assert (other["score"], other["recommendation"], other["confidence"]) == (1.5, "HOLD", 57.5)
    levels = I.support_resistance(spark.createDataFrame(mock_bars(), BAR)).first()
    assert levels["resistance"] == [47060, 46500, 46030] and levels["support"] == [45870, 45340, 44840]


def test_extremes_of_rsi_and_flat_series():
    up, flat = np.arange(10.0, 60), np.full(50, 7.0)
    zero = np.zeros(50)
    assert I.recurrences(up, zero, zero, zero)["rsi_14"][-1] == 100
    assert I.recurrences(up[::-1].copy(), zero, zero, zero)["rsi_14"][-1] == 0
    got = I.recurrences(flat, zero, zero, zero)
    assert got["rsi_14"][-1] == 100 and got["adx"][-1] == 0 and got["macd_line"][-1] == 0
    assert I.recurrences(up, zero, zero, zero)["macd_line"][-1] > 0


def test_blocked_scan_equals_one_pass(spark):
    bars = spark.createDataFrame(mock_bars(), BAR)
    blocked = {r["trade_date"]: r["ema"] for r in I.blocked_ema(bars, 12, block=7).collect()}
    whole = {r["trade_date"]: r["ema_12"] for r in I.technical(bars).where("ema_12 is not null").collect()}
    assert blocked.keys() == whole.keys() and all(blocked[k] == pytest.approx(whole[k]) for k in whole)


def test_one_shuffle_for_all_indicators(spark):
    plan = I.technical(spark.createDataFrame(mock_bars(), BAR))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_local_extrema_plateau_and_borders(spark):
    rows = [("A", datetime.date(2024, 1, i + 1), v, v, v, v, 1) for i, v in enumerate(map(float, (1, 3, 2, 5, 4, 4, 6, 1)))]
    got = I.local_extrema(spark.createDataFrame(rows, BAR), order=2).orderBy("trade_date").collect()
    assert [i for i, r in enumerate(got) if r["is_max"]] == [3, 6] and not any(r["is_min"] for r in got)


TEXTS = [
    ("VNM công bố lợi nhuận tăng 20%", "positive", 80.0, "positive", 90.0, ["tăng", "lợi nhuận"]),
    ("HPG bị bán tháo, nhà đầu tư cắt lỗ vì FOMO", "positive", 70.0, "neutral", 15.0, ["bán tháo", "cắt lỗ", "bán tháo", "fomo"]),
    ("Cá mập gom hàng FPT, giá trần tím", "negative", 60.0, "neutral", 100.0, ["cá mập", "gom hàng", "trần", "tím"]),
    ("Thị trường đi ngang", "neutral", 55.5, "neutral", 55.5, []),
]


def test_sentiment_vectors(spark):
    df = spark.createDataFrame([t[:3] for t in TEXTS], "text string, label string, sure double")
    out = T.adjust_sentiment(df, "text", "label", "sure").withColumn("k", T.keywords(F.col("text"))).collect()
    for row, want in zip(out, TEXTS, strict=True):
        assert (row["sentiment"], row["confidence"]) == want[3:5]
        assert sorted(row["k"]) == sorted(want[5])


def test_symbols_and_spam(spark):
    df = spark.createDataFrame([("VNM tang, ĐVNM HPG-FPT ABCD",)], "text string").select(T.symbols(F.col("text")).alias("s"), T.symbols(F.lit("vnm abc"), "upper").alias("u")).first()
    assert df["s"] == ["VNM", "HPG", "FPT"] and df["u"] == ["VNM"]
    spam = spark.createDataFrame([("Đăng ký ngay group VIP",), ("lợi nhuận 50%",), ("tăng 5x trong",), ("zalo: 0901234567",), ("tin thường",)], "t string")
    got = [r[0] for r in spam.select(T.spam_keyword(F.col("t"), F.lit(None).cast("string")) | T.spam_pattern(F.col("t"))).collect()]
    assert got == [True, True, True, True, False]


def test_forecast_vectors(spark):
    rows = [("BUY", 0.8, 0.2, 0.5, 1.3, 1.0), ("SELL", 0.7, -0.4, -1.5, 1.0, 0.0), ("HOLD", 0.5, None, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "label string, sure double, overall double, change double, ratio double, net double")
    scored = df.select(S.technical_component(F.col("label"), F.col("sure")).alias("tech_score"), S.sentiment_component(F.col("overall")).alias("sent_score"), S.market_component(F.col("change"), F.col("ratio"), F.col("net")).alias("market_score"))
    got = [(r["action"], round(r["final_score"], 3), round(r["action_confidence"], 3)) for r in S.forecast(scored).collect()]
    assert got == [("STRONG_BUY", 0.825, 0.825), ("STRONG_SELL", 0.24, 0.76), ("HOLD", 0.5, 0.6)]
    risk = spark.range(1).select(S.risk_level(F.lit(3.5), F.lit(0.6), F.lit(False)), S.risk_level(F.lit(3.5), F.lit(0.6), F.lit(True)), S.risk_level(F.lit(1.0), F.lit(0.1), F.lit(False))).first()
    assert tuple(risk) == ("MEDIUM", "HIGH", "LOW")


def test_model_sees_whole_texts(spark):
    """Pieces of 256 words are scored each and their logits averaged."""
    text = " ".join(["calm"] * 300 + ["rise"] * 212)
    load = lambda: lambda batch: [(0.0, float(t.count("calm")), float(t.count("rise"))) for t in batch]
    rows = T.model_sentiment(spark.createDataFrame([(text,), ("rise",), (None,), ("",)], "t string"), "t", load).collect()
    assert [r["model_sentiment"] for r in rows] == ["neutral", "positive", "negative", "negative"]
    assert abs(rows[1]["model_confidence"] - 100 * 2.718281828459045 / (2 + 2.718281828459045)) < 1e-6


def test_forecast_reasons(spark):
    df = spark.createDataFrame([(0.9, 0.9, 0.9, 1), (0.5, 0.5, 0.5, 0)], "tech_score double, sent_score double, market_score double, rumour_mentions int")
    got = [r["action_reasons"] for r in S.forecast(df).collect()]
    assert got == [[*S.ACTION_REASONS["STRONG_BUY"], S.RUMOUR_WARNING], [*S.ACTION_REASONS["HOLD"]]]


def test_error_rules(spark):
    messages = ["connection timeout", "HTTP 429", "ECONNREFUSED", "bad JSON", "401", "503", "etc"]
    got = [r["e"]["error_type"] for r in spark.createDataFrame([(m,) for m in messages], "m string").select(M.classify_error(F.col("m")).alias("e")).collect()]
    assert got == ["TIMEOUT", "RATE_LIMIT", "CONNECTION", "PARSE_ERROR", "AUTH_ERROR", "SERVER_ERROR", "UNKNOWN"]


def test_sources_and_sinks(spark, tmp_path):
    bars = spark.createDataFrame(mock_bars(30), BAR)
    files.write_technical(bars, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 30
    bars.drop("symbol").coalesce(1).write.json(str(tmp_path / "VNM_bars"))
    bars.write.parquet(str(tmp_path / "p"))
    assert files.read_bars(spark, str(tmp_path / "p")).count() == 30
    files.write_report(bars.withColumn("body", F.lit("# x")), str(tmp_path / "r"), "text")
    assert spark.read.text(str(tmp_path / "r")).count() == 30
    assert [files.load_dim(spark, n).count() for n in ("slang", "keywords", "stocks", "valid_symbols", "spam_patterns")] == [29, 44, 15, 40, 4]


def test_carried_state_and_silence(spark, tmp_path):
    bars = spark.createDataFrame(mock_bars(40), BAR)
    for i in range(2):
        bars.where(F.dayofyear("trade_date") <= 20 if i == 0 else F.dayofyear("trade_date") > 20).coalesce(1).write.mode("append").parquet(str(tmp_path / "bars"))
    stream = J.read_stream(spark, str(tmp_path / "bars"), bars.schema, per_trigger=1)
    got = {r["trade_date"]: r["ema"] for r in J.run_available(J.carried_ema(stream), str(tmp_path / "s")).collect()}
    want = {r["trade_date"]: r["ema_12"] for r in I.technical(bars).collect()}
    assert got.keys() == want.keys()
    assert all((got[d] is None) == (want[d] is None) and (want[d] is None or abs(got[d] - want[d]) < 1e-9) for d in want)
    stream = J.read_stream(spark, str(tmp_path / "bars"), bars.schema, per_trigger=1)
    carried = {r["trade_date"]: (r["ema"], r["rsi"], r["atr"]) for r in J.run_available(J.carried_indicators(stream), str(tmp_path / "c")).collect()}
    whole = {r["trade_date"]: (r["ema_12"], r["rsi_14"], r["atr_14"]) for r in I.technical(bars).collect()}
    assert carried.keys() == whole.keys()
    for day, row in whole.items():
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(carried[day], row, strict=True)), day
    rows = [("a", datetime.datetime(2024, 1, 1, h)) for h in (0, 1, 6)] + [("b", datetime.datetime(2024, 1, 1, h)) for h in (0, 1, 2, 3, 4, 5, 6)]
    spark.createDataFrame(rows, "source string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "e"))
    events = J.read_stream(spark, str(tmp_path / "e"), "source string, ts timestamp")
    quiet = J.run_available(J.silence(events), str(tmp_path / "q")).collect()
    assert [(r["source"], r["silent_since"].hour) for r in quiet] == [("a", 1)]


def test_insights_count_oversold_months(spark):
    d = "/root/testdata/sf0.001"
    oversold = daily.judged(spark, d).where("rsi_simple < 30").count()
    n = [daily.QUERIES[q](spark, d).agg(F.sum("n")).first()[0] for q in ("c12_insights", "c12b_insights_of_all_rules")]
    assert oversold > 0
    assert n[1] - n[0] == oversold
