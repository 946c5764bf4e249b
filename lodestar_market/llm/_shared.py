"""Helpers that the corpus operators have in common."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a folder is made.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    context.setCheckpointDir(made := tempfile.mkdtemp(prefix="checkpoints-"))
    return made


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as its result is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def batches_bounded(spark: SparkSession, most: int | None) -> Iterator[None]:
    """Arrow batches of what runs inside have at most so many bytes, or one row."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    if most:
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        if most:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.checkpoint(eager=True)


class Scratch:
    """Tables in a folder of their own below the shared one, which cut lineage and can be dropped.

    With ``batch_bytes`` Python tasks that fill them get Arrow batches of so many bytes.
    """

    def __init__(self, spark: SparkSession, batch_bytes: int | None = None):
        self.spark, self.folder, self.batch_bytes = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", batch_bytes

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        with shuffles_freed(self.spark), batches_bounded(self.spark, self.batch_bytes):
            df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop_all_but(self, *names: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for item in store.listStatus(path) if store.exists(path) else []:
            if item.getPath().getName() not in names:
                store.delete(item.getPath(), True)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.folder}/{name}")


#: A key with more than one in so many rows is a hot one: there are fewer hot keys than this.
HOT_SHARE = 1000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a table that has each key once and, as ``n``, how many rows of ``left`` have it.

    Hot keys, of which there are less than ``HOT_SHARE``, are sent to the rows;
    only rows of the other keys are shuffled, so no task gets more than its part.
    Those are shuffled at any size, so what a small table costs tells what a large
    one will.  Both tables are read twice and should be written ones.
    """
    total = right.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(right.where(F.col("n") * HOT_SHARE > total).drop("n"))
    cold = right.where(F.col("n") * HOT_SHARE <= total).drop("n")
    return left.join(hot, keys).unionByName(left.join(F.broadcast(right.where(F.col("n") * HOT_SHARE > total).select(keys)), keys, "left_anti").join(cold.hint("merge"), keys))


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def rounded_parts(df: DataFrame, least: int = 8) -> int:
    """Shuffle partitions of the session, for repartition() with a key."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bounded_slices(batch: pa.RecordBatch, column: str, rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows and, but for a single longer text, bytes of a column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = held = 0
    for n, size in enumerate(sizes):
        if n > at and (n - at == rows or held + size > most):
            yield batch.slice(at, n - at)
            at, held = n, 0
        held += size
    if at < len(sizes):
        yield batch.slice(at)


def whole_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup key-sorted Arrow batches so that no run of equal keys is split.

    Memory is bounded by one batch plus the longest run, which callers bound.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = _last_run_start(batch, keys)
        if last == 0:
            if held and not _same_key(held[-1], batch, keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _last_run_start(batch: pa.RecordBatch, keys: list[str]) -> int:
    n = batch.num_rows
    changed = np.zeros(n, dtype=bool)
    for key in keys:
        column = batch.column(key).to_numpy(zero_copy_only=False)
        changed[1:] |= column[1:] != column[:-1]
    found = np.flatnonzero(changed)
    return int(found[-1]) if len(found) else 0


def _same_key(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    return all(a.column(k)[a.num_rows - 1].as_py() == b.column(k)[0].as_py() for k in keys)


def run_starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys begin, and the number of rows at the end."""
    n = len(columns[0])
    changed = np.ones(n, dtype=bool)
    if n:
        changed[1:] = False
        for column in columns:
            changed[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(changed), n)
