"""Bars: conforming, gates, look-back, sessions, bars from trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAR_COLUMNS = ("symbol", "trade_date", "open", "high", "low", "close", "volume")


def conform(df: DataFrame, required: tuple[str, ...] = BAR_COLUMNS) -> DataFrame:
    """Lower-case the column names; raise if a required one is missing."""
    out = df.toDF(*[c.lower() for c in df.columns])
    if missing := [c for c in required if c not in out.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return out


def is_symbol(symbol: Column) -> Column:
    return F.coalesce(symbol.rlike("^[A-Z]{3}$"), F.lit(False))


def lookback(bars: DataFrame, days: int, as_of, rows: int | None = None, warm_up: int = 0) -> DataFrame:
    """Bars of the last ``days`` (30 to 365) calendar days, then the last ``rows`` per symbol."""
    clamped = F.greatest(F.lit(30), F.least(F.lit(365), F.lit(days))) + warm_up
    kept = bars.where((F.col("trade_date") <= F.lit(as_of)) & (F.col("trade_date") >= F.date_sub(F.lit(as_of), clamped)))
    if rows is None:
        return kept
    order = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    return kept.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rows).drop("_n")


def minimum_history(bars: DataFrame, rows: int = 26) -> DataFrame:
    """Symbols with fewer rows are dropped, the others go on."""
    return bars.withColumn("_n", F.count("*").over(Window.partitionBy("symbol"))).where(F.col("_n") >= rows).drop("_n")


def complete_bars(bars: DataFrame, flag: bool = False) -> DataFrame:
    """Drop bars that lack a value, or flag them in ``is_complete``."""
    values = list(BAR_COLUMNS[2:])
    if not flag:
        return bars.na.drop(subset=values)
    whole = F.lit(True)
    for c in values:
        whole = whole & F.col(c).isNotNull()
    return bars.withColumn("is_complete", whole)


def order_key(first: str | Column, *rest: tuple[str | Column, int]) -> Column:
    """Whole numbers as one of up to 38 digits that sorts as they do; each but the first with how many digits it has at most."""
    column = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")
    key = column(first)
    for c, digits in rest:
        key = (key * F.lit(str(10**digits)).cast("decimal(38,0)") + column(c)).cast("decimal(38,0)")
    return key


def bars_from_trades(trades: DataFrame, order: list[str], keys: list[str | Column]) -> DataFrame:
    """Open, high, low, close and volume per group of trades, which ``order`` puts in a row.

    One partial aggregation.  If the order is a single number or time (see
    ``order_key``), it is one by hash and nothing is sorted; a struct of several
    columns has no fixed width, so Spark sorts for it.
    """
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return trades.groupBy(*keys).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("quantity").cast("long").alias("volume"),
    )


def market_minute(ts: Column, zone: str = "Asia/Ho_Chi_Minh") -> Column:
    local = F.from_utc_timestamp(ts, zone)
    return F.hour(local) * 60 + F.minute(local)


def market_open(ts: Column, zone: str = "Asia/Ho_Chi_Minh") -> Column:
    """Weekdays, 09:00 to 11:30 or 13:00 to 15:00 market time, borders included."""
    minute = market_minute(ts, zone)
    weekday = F.dayofweek(F.from_utc_timestamp(ts, zone)).between(2, 6)
    return weekday & (minute.between(540, 690) | minute.between(780, 900))


def session_label(ts: Column, zone: str = "Asia/Ho_Chi_Minh") -> Column:
    minute = market_minute(ts, zone)
    weekday = F.dayofweek(F.from_utc_timestamp(ts, zone)).between(2, 6)
    label = (
        F.when(~weekday, "closed").when(minute < 540, "pre").when(minute < 690, "morning").when(minute < 780, "lunch")
        .when(minute < 870, "afternoon").when(minute < 885, "atc").when(minute < 900, "post")
    )
    return label.otherwise("closed")
