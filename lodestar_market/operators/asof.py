"""As-of joins: for each request the latest row at or before its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(requests: DataFrame, history: DataFrame, key: str, at: str, columns: list[str], bucket: Column | None = None) -> DataFrame:
    """``requests`` with ``columns`` of the latest row of ``history`` of the same key with ``at`` not after theirs.

    Both tables have ``key`` and ``at``.  They are put together, sorted once
    within (key, bucket), and the last row of history is carried on; so one key
    with any number of rows is spread over as many tasks as it has buckets.  What
    a bucket leaves to later ones is one row of history for each (key, bucket),
    found without the rows themselves.  ``bucket`` must grow with ``at`` and
    be a function of it; by default it is the month.  Of rows of history with
    equal times the largest in ``columns`` counts; requests without an earlier
    row keep nulls; requests whose key or time is null stay, with nulls.
    """
    bucket = F.date_trunc("month", F.col(at)) if bucket is None else bucket
    value = F.struct(F.col(at).alias("_at"), *columns)
    kept = requests.columns
    known = history.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, bucket.alias("_bucket"), value.alias("_value"), F.lit(0).alias("_role"), F.lit(None).cast(_struct(requests)).alias("_row"))
    asked = requests.select(key, at, bucket.alias("_bucket"), F.lit(None).cast(known.schema["_value"].dataType).alias("_value"), F.lit(1).alias("_role"), F.struct(*kept).alias("_row"))
    both = known.unionByName(asked)
    # History before requests of the same time, so that "at or before" holds.
    order = Window.partitionBy(key, "_bucket").orderBy(at, "_role", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = both.withColumn("_found", F.last("_value", ignorenulls=True).over(order)).where("_role = 1")
    # The last row of each bucket, and for each bucket that of the nearest one before it.
    last = known.groupBy(key, "_bucket").agg(F.max("_value").alias("_last")).unionByName(asked.groupBy(key, "_bucket").agg(F.lit(None).cast(known.schema["_value"].dataType).alias("_last")))
    ends = last.groupBy(key, "_bucket").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).where("_carried is not null").select(key, "_bucket", "_carried")
    found = within.join(carried, [key, "_bucket"], "left").withColumn("_found", F.coalesce("_found", "_carried"))
    return found.select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in columns])


def _struct(df: DataFrame):
    return df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType
