"""Operators with keyed state, timers and event time, on the RocksDB state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import IntegerType, StructField, StructType

MINUTE = 60_000_000  # microseconds


def state_session(spark: SparkSession) -> SparkSession:
    """A session of its own on the same cluster, with the settings of ``spark``, whose streams keep state in RocksDB."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


class InEventTime(StatefulProcessor):
    """Rows of a key in the order of their times, each once the watermark has passed it.

    Rows wait in a list state; a timer wakes the key when the next is due.
    ``step`` takes the rows that are due and the watermark, and returns results
    and the time (microseconds) by which it wants to be asked again, or None.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, number long")
        self.held = handle.getValueState("held", self.layout)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.waiting.appendList(list(zip(pdf["at"].tolist(), pdf["number"].tolist(), strict=True)))
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues)

    def _advance(self, key, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((int(r[0]), int(r[1])) for r in self.waiting.get())
        due = [r for r in rows if r[0] <= mark]
        rest = rows[len(due) :]
        if due:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        held = tuple(self.held.get()) if self.held.exists() else None
        out, held, wake = self.step(held, due, mark)
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)
        if rest:
            wake = rest[0][0] if wake is None else min(wake, rest[0][0])
        if wake is not None:
            self.handle.registerTimer(max(-(-wake // 1000), mark // 1000 + 1))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", *self.columns])

    def close(self) -> None:
        pass


class Failing(InEventTime):
    """Sources that fail without a success in between for ``minutes``: number is 1 for a failure, else 0."""

    layout = "since long, failures long, told boolean"
    columns = ["since", "failures"]

    def __init__(self, minutes: int):
        self.length = minutes * MINUTE

    def step(self, held, due, mark):
        out = []
        for at, failed in due:
            if held and not held[2] and at > held[0] + self.length:
                out.append((held[0], held[1]))
                held = (held[0], held[1], True)
            if not failed:
                held = None
            elif held is None:
                held = (at, 1, False)
            elif not held[2]:
                held = (held[0], held[1] + 1, False)
        if held and not held[2] and held[0] + self.length <= mark:
            out.append((held[0], held[1]))
            held = (held[0], held[1], True)
        return out, held, held[0] + self.length if held and not held[2] else None


class RequestWindows(InEventTime):
    """Windows that open at a client's first request and end ``seconds`` later; number is the client's limit."""

    layout = "opened long, requests long, most long"
    columns = ["opened", "requests", "most"]

    def __init__(self, seconds: int):
        self.length = seconds * 1_000_000

    def step(self, held, due, mark):
        out = []
        for at, most in due:
            if held and at >= held[0] + self.length:
                out.append(held)
                held = None
            held = (held[0], held[1] + 1, held[2]) if held else (at, 1, most)
        # A window is whole once the watermark has reached its end.
        if held and held[0] + self.length <= mark:
            out.append(held)
            held = None
        return out, held, held[0] + self.length if held else None


class FirstOfDays(InEventTime):
    """Rows of a key that come ``days`` or more after the last that was let through."""

    layout = "let long"
    columns = ["at"]

    def __init__(self, days: int):
        self.length = days * 24 * 60 * MINUTE

    def step(self, held, due, mark):
        out = []
        for at, _ in due:
            if held is None or at >= held[0] + self.length:
                out.append((at,))
                held = (at,)
        # Nothing at or before the watermark is to come: then the key can be forgotten.
        over = held is not None and held[0] + self.length <= mark
        return out, None if over else held, held[0] + self.length if held and not over else None


def first_of_days(articles: DataFrame, days: int = 7, delay: str = "10 minutes") -> DataFrame:
    """hash and published_at of articles whose hash wasn't let through in the ``days`` before; also over restarts."""
    kept = articles.where("hash is not null and published_at is not null").withColumnRenamed("published_at", "ts")
    found = _keyed(kept, "hash", F.lit(0), delay).groupBy("key").transformWithStateInPandas(FirstOfDays(days), "key string, at long", "Append", "EventTime")
    return found.select(F.col("key").alias("hash"), F.timestamp_micros("at").alias("published_at"))


def _keyed(rows: DataFrame, key: str, number, delay: str) -> DataFrame:
    at = F.unix_micros("ts")
    return rows.withWatermark("ts", delay).select(F.col(key).cast("string").alias("key"), "ts", at.alias("at"), number.cast("long").alias("number"))


def failing_sources(log: DataFrame, minutes: int = 30, delay: str = "10 minutes") -> DataFrame:
    """source, failing_since, failures and alerted_at of each run of failures that lasts ``minutes``; once a run.

    ``log`` has source, ts and status (``ok`` or another).  ``failures`` are
    those of the first ``minutes``.
    """
    kept = _keyed(log.where("source is not null and ts is not null"), "source", F.when(F.col("status") == "ok", 0).otherwise(1), delay)
    found = kept.groupBy("key").transformWithStateInPandas(Failing(minutes), "key string, since long, failures long", "Append", "EventTime")
    since = F.timestamp_micros("since")
    return found.select(F.col("key").alias("source"), since.alias("failing_since"), "failures", F.timestamp_micros(F.col("since") + minutes * MINUTE).alias("alerted_at"))


# Requests an hour.
TIERS = {"anonymous": 100, "registered": 1000, "premium": 10000}


def request_windows(log: DataFrame, tiers: DataFrame, limits: dict[str, int] | None = None, seconds: int = 3600, delay: str = "1 minute") -> DataFrame:
    """client, window_start, requests, allowed and denied of each window; a window opens at the first request after the one before.

    ``log`` is a stream of client and ts; ``tiers`` a table of client and tier.
    Who isn't in it is anonymous; a tier without a limit has that of anonymous.
    A window has the limit of its first request.
    """
    limits = limits or TIERS
    joined = log.where("client is not null and ts is not null").join(tiers.select("client", "tier"), "client", "left")
    limit = F.lit(limits["anonymous"])
    for name, most in limits.items():
        limit = F.when(F.col("tier") == name, most).otherwise(limit)
    found = _keyed(joined.select("client", "ts", limit.alias("most")), "client", F.col("most"), delay).groupBy("key")
    out = found.transformWithStateInPandas(RequestWindows(seconds), "key string, opened long, requests long, most long", "Append", "EventTime")
    allowed = F.least("requests", "most")
    return out.select(F.col("key").alias("client"), F.timestamp_micros("opened").alias("window_start"), "requests", allowed.alias("allowed"), (F.col("requests") - allowed).alias("denied"))


def run_hot_list(mentions: DataFrame, folder: str, k: int = 10) -> DataFrame:
    """Run counts of windows (``mentions_per_window``) into a list of the k most mentioned symbols of each.

    A window closes with all its symbols in one batch; its rows replace those
    of an earlier run of that batch.  Ties go to the smaller symbol.
    """
    from ..operators.report import top_per

    schema = mentions.schema

    def write(batch: DataFrame, number: int) -> None:
        ranked = top_per(batch, ["window_start"], [F.desc("mentions"), "symbol"], k)
        hour = F.date_format("window_start", "yyyyMMddHHmm")
        ranked.withColumn("hour", hour).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour").parquet(f"{folder}/out")

    query = mentions.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    query.start().awaitTermination()
    ranked = StructType([*schema.fields, StructField("rank", IntegerType())])
    return mentions.sparkSession.read.schema(ranked).parquet(f"{folder}/out").drop("hour")
