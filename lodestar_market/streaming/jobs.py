"""Structured Streaming jobs: each takes a streaming (or batch) DataFrame and returns one."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.bars import order_key
from ..operators.text import rule_sentiment

REQUEST = "request_id string, correlation_id string, texts array<struct<id: string, content: string, source: string, published_at: string>>"


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def run_available(df: DataFrame, folder: str, mode: str = "append", again: bool = False) -> DataFrame:
    """Run a stream over what is there, to Parquet in ``folder``, and read the result.

    With ``again`` the folder is this stream's own: state and results go on from where they were.
    """
    at = folder if again else f"{folder}/stream-{uuid.uuid4().hex}"
    schema = df.schema
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return df.sparkSession.read.schema(schema).parquet(f"{at}/out")


def new_articles(articles: DataFrame) -> DataFrame:
    """Articles whose hash wasn't seen in the last seven days."""
    return articles.withWatermark("published_at", "7 days").dropDuplicatesWithinWatermark(["hash"])


def score_requests(requests: DataFrame, body: str = "value", **terms) -> DataFrame:
    """One scored row per text of each request, with its ids; ``terms`` are the positive and negative ones, if not the usual."""
    r = requests.select(F.from_json(F.col(body), REQUEST).alias("r")).select("r.request_id", "r.correlation_id", F.explode("r.texts").alias("t"))
    return rule_sentiment(r.select("request_id", "correlation_id", F.col("t.id").alias("id"), F.col("t.content").alias("content")), "content", **terms)


def regroup_requests(scored: DataFrame) -> DataFrame:
    """Results of one batch put together again, for a foreachBatch sink."""
    return scored.groupBy("request_id", "correlation_id").agg(F.array_sort(F.collect_list(F.struct("id", "base_sentiment", "base_confidence"))).alias("results"))


def run_regrouped(scored: DataFrame, folder: str) -> DataFrame:
    """Run a stream of scored texts and put each micro-batch's requests together again.

    A batch that is run again overwrites what it wrote before.
    """
    at = f"{folder}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        regroup_requests(batch).write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    scored.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    results = "results array<struct<id: string, base_sentiment: string, base_confidence: double>>"
    return scored.sparkSession.read.schema(f"request_id string, correlation_id string, {results}").parquet(f"{at}/out")


def run_counted(rows: DataFrame, folder: str, by: list[str]) -> DataFrame:
    """Run a stream into ``n``, the number of its rows by ``by``, and read the result.

    Only counts are written, those of each micro-batch.  A batch that is run
    again overwrites what it wrote before.
    """
    at = f"{folder}/stream-{uuid.uuid4().hex}"
    counted = lambda df: df.groupBy(*by).agg(F.count("*").alias("n"))
    schema = StructType([*rows.select(*by).schema, StructField("n", LongType())])

    def write(batch: DataFrame, number: int) -> None:
        counted(batch).write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(schema).parquet(f"{at}/out").groupBy(*by).agg(F.sum("n").alias("n"))


def success_rate(log: DataFrame, length: str = "10 minutes", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Sliding windows with their success rate and whether it alerts (below 80 %)."""
    ok = F.count_if(F.col("status") == "ok")
    out = log.withWatermark("ts", delay).groupBy(F.window("ts", length, slide)).agg(ok.alias("ok"), F.count("*").alias("total"))
    rate = F.col("ok") / F.col("total")
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "ok", "total", F.round(rate, 6).alias("success_rate"), (rate < 0.8).alias("alert"))


def error_rate(log: DataFrame, limit: float = 0.05, length: str = "10 minutes", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Sliding windows of a source in which more than ``limit`` of the requests failed."""
    failed = F.count_if(F.col("status") != "ok")
    out = log.withWatermark("ts", delay).groupBy(F.window("ts", length, slide), "source").agg(failed.alias("failed"), F.count("*").alias("total"))
    rate = F.col("failed") / F.col("total")
    return out.where(rate > limit).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "source", "failed", "total", F.round(rate, 6).alias("error_rate"), F.lit("warning").alias("severity"))


def mentions_per_window(posts: DataFrame, length: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    out = posts.withWatermark("ts", delay).groupBy(F.window("ts", length), "symbol").agg(F.count("*").alias("mentions"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "symbol", "mentions")


def request_audit(log: DataFrame, limit: int, length: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """Clients over the limit in a window."""
    out = log.withWatermark("ts", delay).groupBy(F.window("ts", length), "client").agg(F.count("*").alias("requests"))
    return out.where(F.col("requests") > limit).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "client", "requests")


def bars_of_ticks(ticks: DataFrame, length: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    order = order_key(F.unix_micros("ts"), ("tick_id", 19))
    out = ticks.withWatermark("ts", delay).groupBy(F.window("ts", length), "symbol").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("quantity").alias("volume")
    )
    return out.select("symbol", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "open", "high", "low", "close", "volume")


def silence(events: DataFrame, minutes: int = 120, delay: str = "10 minutes") -> DataFrame:
    """A row for each key after which nothing came for ``minutes`` of event time."""

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            (last,) = state.get
            out.append((key[0], pd.Timestamp(last, unit="us")))
            state.remove()
        else:
            last = state.get[0] if state.exists else None
            for ts in sorted(t for pdf in batches for t in pdf["ts"]):
                now = ts.value // 1000
                if last is not None and now - last > minutes * 60_000_000:
                    out.append((key[0], pd.Timestamp(last, unit="us")))
                last = now if last is None else max(last, now)
            if last is not None:
                state.update((last,))
                due = last // 1000 + minutes * 60_000
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["source", "silent_since"])

    held = events.withWatermark("ts", delay).groupBy("source")
    return held.applyInPandasWithState(watch, "source string, silent_since timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def carried_ema(bars: DataFrame, n: int = 12) -> DataFrame:
    """EMA of each new bar from state: sum and count until the seed, then the value."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, value = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values("trade_date")
        out = []
        for day, close in zip(rows["trade_date"], rows["close"], strict=True):
            count += 1
            if count < n:
                value += close
            elif count == n:
                value = (value + close) / n
            else:
                value += (close - value) * 2 / (n + 1)
            out.append((key[0], day, value if count >= n else None))
        state.update((count, float(value)))
        yield pd.DataFrame(out, columns=["symbol", "trade_date", "ema"])

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, trade_date date, ema double", "count long, value double", "append", GroupStateTimeout.NoTimeout)


def carried_indicators(bars: DataFrame, ema: int = 12, n: int = 14) -> DataFrame:
    """EMA, RSI and ATR of each new bar from state, with an alert where the RSI leaves 30 to 70.

    The state of a symbol is the number of bars, the last close and four
    averages, which are sums until their first value is due.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last, mean, gain, loss, atr = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values("trade_date")
        out = []
        for day, high, low, close in zip(rows["trade_date"], rows["high"], rows["low"], rows["close"], strict=True):
            count += 1
            reach = high - low if count == 1 else max(high - low, abs(high - last), abs(low - last))
            up, down = (0.0, 0.0) if count == 1 else (max(close - last, 0.0), max(last - close, 0.0))
            mean = mean + close if count < ema else (mean + close) / ema if count == ema else mean + (close - mean) * 2 / (ema + 1)
            atr = atr + reach if count < n else (atr + reach) / n if count == n else (atr * (n - 1) + reach) / n
            if count <= n + 1:  # the first change is the second bar's
                gain, loss = gain + up, loss + down
                if count == n + 1:
                    gain, loss = gain / n, loss / n
            else:
                gain, loss = (gain * (n - 1) + up) / n, (loss * (n - 1) + down) / n
            last = close
            known = count > n
            rsi = None if not known else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
            alert = None if rsi is None else "RSI_OVERSOLD" if rsi < 30 else "RSI_OVERBOUGHT" if rsi > 70 else None
            out.append((key[0], day, mean if count >= ema else None, rsi, atr if known else None, alert))
        state.update((count, float(last), float(mean), float(gain), float(loss), float(atr)))
        yield pd.DataFrame(out, columns=["symbol", "trade_date", "ema", "rsi", "atr", "alert"])

    held = "count long, last double, mean double, gain double, loss double, atr double"
    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, trade_date date, ema double, rsi double, atr double, alert string", held, "append", GroupStateTimeout.NoTimeout)


def route_alerts(alerts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Stream of alerts joined with the static table of subscriptions."""
    active = subscriptions.where("is_active").select("user_id", "symbol", "alert_types")
    return alerts.join(active, "symbol").where(F.expr("array_contains(alert_types, alert_type)")).drop("alert_types")
