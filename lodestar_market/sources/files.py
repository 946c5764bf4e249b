"""Sources and sinks: bars, texts, dimensions, results, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wordlists as words
from ..operators.bars import BAR_COLUMNS, conform

BAR = "symbol string, trade_date date, open double, high double, low double, close double, volume bigint"
TEXT = "id string, source string, source_type string, title string, body string, link string, published_at timestamp"


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bars in a declared schema; where rows name no symbol, the file name does."""
    reader = spark.read.schema(BAR).option("multiLine", True).option("header", True)
    rows = reader.format(fmt).load(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([A-Z]{3})", 1)
    return conform(rows.withColumn("symbol", F.coalesce("symbol", F.nullif(name, F.lit("")))))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Date-partitioned JSON of news and posts."""
    return spark.read.schema(TEXT).json(path)


def load_dim(spark: SparkSession, name: str) -> DataFrame:
    """stocks, slang, keywords, slang_tokens, spam_keywords, spam_patterns or valid_symbols: fixed, small tables."""
    tables = {
        "stocks": ([(*row, True) for row in words.STOCKS], "symbol string, name string, exchange string, industry string, is_active boolean"),
        "slang": ([(i, *row) for i, row in enumerate(words.SLANG)], "ord int, slang string, meaning string, sentiment_modifier double"),
        "keywords": ([(i, k, p) for p, ks in (("positive", words.POSITIVE), ("negative", words.NEGATIVE)) for i, k in enumerate(ks)], "ord int, keyword string, polarity string"),
        "slang_tokens": ([(i, *row) for i, row in enumerate(words.SLANG_TOKENS)], "ord int, slang string, token string"),
        "spam_keywords": ([(k,) for k in words.SPAM_KEYWORDS], "keyword string"),
        "spam_patterns": ([(p,) for p in words.SPAM_PATTERNS], "pattern string"),
        "valid_symbols": ([(s,) for s in words.VALID_SYMBOLS], "symbol string"),
    }
    rows, schema = tables[name]
    return spark.createDataFrame(rows, schema)


#: Declared decimals of the results table; adx is wide enough for a Wilder sum.
DECIMALS = {
    "open": (15, 2), "high": (15, 2), "low": (15, 2), "close": (15, 2), "sma_20": (15, 2), "sma_50": (15, 2), "ema_12": (15, 2), "ema_26": (15, 2), "rsi_14": (5, 2),
    "macd_line": (12, 4), "macd_signal": (12, 4), "macd_histogram": (12, 4), "bb_upper": (15, 2), "bb_middle": (15, 2), "bb_lower": (15, 2), "bb_width": (12, 4),
    "stoch_k": (5, 2), "stoch_d": (5, 2), "adx": (9, 2), "plus_di": (7, 2), "minus_di": (7, 2), "atr_14": (12, 4), "vwap": (15, 2), "confidence": (5, 2), "score": (5, 2),
}


def technical_rows(df: DataFrame) -> DataFrame:
    """One row per (symbol, trade_date), rounded to the declared decimals."""
    casts = [F.col(c).cast(f"decimal{DECIMALS[c]}").alias(c) if c in DECIMALS else F.col(c) for c in df.columns]
    return df.dropDuplicates(["symbol", "trade_date"]).select(*casts)


def write_technical(df: DataFrame, path: str) -> None:
    """Overwrite the dates at hand, and only those."""
    rows = technical_rows(df).repartition("trade_date")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date").parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "json", column: str = "body") -> None:
    """JSON rows, or the text column, under one folder per trade_date."""
    out = df if fmt == "json" else df.select("trade_date", F.col(column).alias("value"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date").format("json" if fmt == "json" else "text").save(path)


__all__ = ["BAR", "BAR_COLUMNS", "TEXT", "load_dim", "read_bars", "read_texts", "technical_rows", "write_report", "write_technical"]
