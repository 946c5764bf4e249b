"""Market context, synthesis and the daily report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DISCLAIMER = "For reference only; this is not investment advice."


def market_overview(bars: DataFrame) -> DataFrame:
    """One row per date: volume, turnover-weighted index, its change, advancing and declining.

    Symbols are compared with their own bar before; the window over dates sees
    one row per date.
    """
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("trade_date"))
    moved = bars.withColumn("_before", before)
    daily = moved.groupBy("trade_date").agg(
        F.sum("volume").alias("total_volume"),
        (F.sum(F.col("close") * F.col("volume")) / F.nullif(F.sum("volume"), F.lit(0))).alias("market_index"),
        F.count_if(F.col("close") > F.col("_before")).alias("advancing"), F.count_if(F.col("close") < F.col("_before")).alias("declining"),
    )
    by_date = Window.orderBy("trade_date")
    was = F.lag("market_index").over(by_date)
    usual = F.avg("total_volume").over(by_date.rowsBetween(-19, 0))
    return daily.withColumns({"index_change": (F.col("market_index") - was) / F.nullif(was, F.lit(0.0)) * 100, "market_volume_ratio": F.col("total_volume") / F.nullif(usual, F.lit(0.0))})


def top_per(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def merge_latest(base: DataFrame, updates: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Union, and the row with the latest ``ts`` of each key; updates win ties."""
    both = base.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts), F.desc("_new")))
    return both.withColumn("_n", n).where(F.col("_n") == 1).drop("_n", "_new")


def insert_only(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(updates.join(base.select(*keys), keys, "left_anti"), allowMissingColumns=True)


# Days for which a class of data is kept, and what happens then.
RETENTION = {"raw": (90, "delete"), "processed": (365, "archive"), "report": (730, "archive")}


def apply_retention(df: DataFrame, data_class: str, as_of, date: str = "trade_date") -> tuple[DataFrame, DataFrame]:
    """(kept, expired); expired rows carry ``disposal``."""
    days, action = RETENTION[data_class]
    age = F.date_diff(F.lit(as_of).cast("date"), F.col(date))
    return df.where(age <= days), df.where(age > days).withColumn("disposal", F.lit(action))


def assemble(overview: DataFrame, ranked: DataFrame, alerts: DataFrame, hot: DataFrame) -> DataFrame:
    """One row per date; only top-k rows are collected into lists."""
    listed = lambda df, name, *cols: df.groupBy("trade_date").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    out = overview
    for df, name, cols in ((ranked, "recommendations", ("rank", "symbol", "recommendation", "confidence")), (hot, "hot", ("rank", "symbol", "mentions")), (alerts, "alerts", ("symbol", "alert_type", "message"))):
        out = out.join(listed(df, name, *cols), "trade_date", "left")
    return out


def markdown(title: Column, lines: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit(f"\n\n{DISCLAIMER}"))


def html(title: Column, lines: Column) -> Column:
    return F.concat(F.lit("<h1>"), title, F.lit("</h1><ul>"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), ""), F.lit(f"</ul><p>{DISCLAIMER}</p>"))


#: Characters that a message may have.
MESSAGE_LIMIT = 4096


def short_message(title: Column, index: Column, change: Column, picks: Column, most: int = 3) -> Column:
    """The market in a few lines: index and its change, the first picks (structs of symbol, recommendation, confidence), the disclaimer.

    Signs of the mark-up are escaped in what comes from data; what would be too
    long loses picks, never the disclaimer.
    """
    escape = lambda c: F.regexp_replace(c, r"([_*`\[])", r"\\$1")
    line = lambda p: F.format_string("• %s - %s (%d%%)", escape(p["symbol"]), escape(p["recommendation"]), F.round(p["confidence"] * 100).cast("int"))
    head = F.concat(F.lit("*"), escape(title), F.lit("*\n\n"), F.when(change.isNotNull(), F.format_string("Index: %.2f (%+.2f%%)\n", index, change)).when(index.isNotNull(), F.format_string("Index: %.2f\n", index)).otherwise(""))
    listed = F.transform(F.slice(F.coalesce(picks, F.array().cast("array<struct<symbol:string,recommendation:string,confidence:double>>")), 1, most), line)
    text = lambda lines: F.concat(head, F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(""), F.lit(f"\n_{DISCLAIMER}_"))
    return F.when(F.length(text(listed)) <= MESSAGE_LIMIT, text(listed)).otherwise(text(F.slice(listed, 1, 0)))
