"""Watching the ingestion: counters, health, errors, request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Part of the message, type, severity, minutes until a retry (none: no retry).
ERROR_RULES = (
    (("ETIMEDOUT", "timeout"), "TIMEOUT", "warning", 5),
    (("429", "rate limit"), "RATE_LIMIT", "warning", 60),
    (("ECONNREFUSED", "connection"), "CONNECTION", "high", 10),
    (("JSON", "parse"), "PARSE_ERROR", "medium", None),
    (("401", "403"), "AUTH_ERROR", "critical", None),
    (("500", "502", "503"), "SERVER_ERROR", "high", 10),
)


def classify_error(message: Column) -> Column:
    """A struct of error_type, severity, retryable, delay_minutes; the first rule that matches."""
    out, first = None, True
    for parts, kind, severity, delay in ERROR_RULES:
        test = F.lit(False)
        for part in parts:
            test = test | F.contains(message, F.lit(part))
        value = F.struct(F.lit(kind).alias("error_type"), F.lit(severity).alias("severity"), F.lit(delay is not None).alias("retryable"), F.lit(delay).cast("int").alias("delay_minutes"))
        out = F.when(test, value) if first else out.when(test, value)
        first = False
    rest = F.struct(F.lit("UNKNOWN").alias("error_type"), F.lit("medium").alias("severity"), F.lit(False).alias("retryable"), F.lit(None).cast("int").alias("delay_minutes"))
    return out.otherwise(rest)


def route_errors(errors: DataFrame) -> DataFrame:
    """Adds route (retry queue or dead letter) and retry_at."""
    wait = F.make_dt_interval(mins=F.col("delay_minutes"))
    return errors.withColumn("route", F.when(F.col("retryable"), "retry").otherwise("dead_letter")).withColumn("retry_at", F.when(F.col("retryable"), F.col("ts") + wait))


def source_health(counts: DataFrame) -> DataFrame:
    """Adds success_rate, health and alert from ok and failed."""
    rate = F.col("ok") / (F.col("ok") + F.col("failed") + 1)
    return counts.withColumn("success_rate", F.round(rate, 6)).withColumns({"health": F.when(rate > 0.8, "healthy").otherwise("degraded"), "alert": F.col("failed") > 10})


def quality(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Accuracy, precision and recall of a filter against labels."""
    p, t = F.col(predicted), F.col(truth)
    tp, fp, fn, tn = (F.count_if(x) for x in (p & t, p & ~t, ~p & t, ~p & ~t))
    return df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn")).withColumns(
        {
            "accuracy": F.round(F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 6),
            "precision": F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 6),
            "recall": F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 6),
        }
    )


def latencies(log: DataFrame, by: list[str], value: str, error: Column, exact: bool = False) -> DataFrame:
    """p50, p95, p99 and error rate; exact percentiles only for comparison."""
    points = [0.5, 0.95, 0.99]
    p = F.percentile(value, points) if exact else F.percentile_approx(value, points, 10_000)
    out = log.groupBy(*by).agg(p.alias("_p"), F.round(F.avg(error.cast("double")), 6).alias("error_rate"), F.count("*").alias("requests"))
    return out.select(*by, *[F.round(F.get("_p", F.lit(i)), 6).alias(f"p{round(q * 100)}") for i, q in enumerate(points)], "error_rate", "requests")


def gaps(df: DataFrame, by: list[str], hours: float) -> DataFrame:
    """Stretches without a row longer than ``hours``; times count as whole seconds, to which they are rounded (halves to the even one)."""
    from pyspark.sql import Window

    after = F.lead("ts").over(Window.partitionBy(*by).orderBy("ts"))
    spaced = df.select(*by, F.col("ts").alias("gap_start"), after.alias("gap_end"))
    second = lambda c: F.rint(F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000)
    return spaced.where(second("gap_end") - second("gap_start") > int(hours * 3600))


#: Of a KLL sketch: ranks are within about one in k of the exact ones, mostly.
SKETCH_K = 1000


def latency_sketches(log: DataFrame, by: list[str], value: str, ts: str, k: int = SKETCH_K) -> DataFrame:
    """A mergeable sketch of the values, and their number, of each hour; bounded, whatever the number of requests."""
    return log.where(F.col(value).isNotNull()).groupBy(*by, F.date_trunc("hour", F.col(ts)).alias("hour")).agg(F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"), F.count("*").alias("requests"))


def rolled_up(sketches: DataFrame, by: list[str], k: int = SKETCH_K) -> DataFrame:
    """p50, p95, p99 and requests of coarser groups, from sketches alone."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("_s"), F.sum("requests").alias("requests"))
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return merged.select(*by, *[F.kll_sketch_get_quantile_double("_s", F.lit(q)).alias(n) for n, q in points.items()], "requests")


def preferences(df: DataFrame, body: str) -> DataFrame:
    """Adds status, symbol (the first), above, quiet and kinds (their number) of bodies with any keys.

    Numbers and truth values may come as text.  A body that isn't JSON has the
    status ``broken``, one whose alerts aren't an object with a list of symbols
    ``mistyped``; both keep nulls.  A limit that is missing or no number is null.
    """
    v = F.try_parse_json(body)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    symbols = get("$.alerts.symbols", "array<string>")
    status = F.when(v.isNull(), "broken").when(symbols.isNull(), "mistyped").otherwise("ok")
    kinds = get("$.alerts.kinds", "array<string>")
    found = {"symbol": F.get(symbols, F.lit(0)), "above": get("$.limits.above", "double"), "quiet": get("$.quiet", "boolean"), "kinds": F.when(kinds.isNotNull(), F.size(kinds))}
    return df.withColumn("status", status).withColumns({name: F.when(F.col("status") == "ok", value) for name, value in found.items()})


# Where an alert of each severity goes.
CHANNELS = {"critical": ("telegram", "email"), "high": ("telegram",), "warning": ("telegram",), "medium": ("log",)}


def route_by_severity(alerts: DataFrame, severity: str = "severity", channels: dict[str, tuple[str, ...]] = CHANNELS) -> DataFrame:
    """A row for each channel of each alert; a severity without channels goes to the log, so that nothing is lost."""
    where = F.array(F.lit("log"))
    for name, listed in channels.items():
        where = F.when(F.col(severity) == name, F.array(*map(F.lit, listed))).otherwise(where)
    return alerts.withColumn("channel", F.explode(where))


def crawl_counters(log: DataFrame, by: list[str], key: str, ts: str, days: int = 7) -> DataFrame:
    """articles and duplicates: rows whose key stood within the days before."""
    from pyspark.sql import Window

    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts))
    again = F.coalesce(F.col(ts) - before <= F.make_dt_interval(days=F.lit(days)), F.lit(False))
    return log.withColumn("_again", again).groupBy(*by).agg(F.count("*").alias("articles"), F.count_if("_again").alias("duplicates"))
