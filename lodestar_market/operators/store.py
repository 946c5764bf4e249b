"""A store of results by month: merging rewrites only the months that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .report import merge_latest


def _by_month(df: DataFrame, date: str) -> DataFrame:
    return df.withColumn("month", F.date_format(date, "yyyyMM"))


def create(df: DataFrame, path: str, date: str = "trade_date") -> None:
    rows = _by_month(df, date)
    rows.repartition("month").sortWithinPartitions("month", *df.columns[:1]).write.mode("overwrite").partitionBy("month").parquet(path)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path).drop("month")


def merge(updates: DataFrame, path: str, keys: list[str], ts: str, date: str = "trade_date") -> None:
    """Keep the row with the latest ``ts`` of each key; an update wins a tie.

    Only months with updates are read (partitions are pruned by a join with
    their names) and written again; files of all others stay as they are.
    ``keys`` must hold ``date`` or determine it.
    """
    spark, fresh = updates.sparkSession, _by_month(updates, date)
    months = fresh.select("month").distinct()
    base = spark.read.schema(fresh.schema).parquet(path).join(months, "month", "left_semi")
    merged = merge_latest(base.select(fresh.columns), fresh, keys, ts)
    out = merged.repartition("month").sortWithinPartitions("month", *updates.columns[:1])
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
