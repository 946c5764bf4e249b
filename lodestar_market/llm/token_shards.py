"""Training-order materialisation of token ids.

Texts are dealt out in the order of doc_id and text, encoded once and cut into
sequences of a fixed stride, so that a sequence's number depends on the data
alone, not on files or tasks.  A keyed Feistel permutation with cycle walking
maps numbers to global slots, one to one.  Ranges of slots become shards: flat
binary files in which slot s stands at ``s % shard_sequences * 2 * stride``, so
a reader can take up at any slot.  An index in Parquet says what each slot holds.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ._shared import remove, rounded_parts, shared_folder, shuffles_freed, table
from .byte_pairs import LibraryCodec

#: Tokens of a sequence; ids are stored as little-endian 16-bit numbers.
STRIDE = 512
#: Ends each text and fills its last sequence; the rank files leave this id free.
END = 50_256
#: Sequences of a shard: files of 16 MB.
SHARD_SEQUENCES = 16_384
#: Shards are written in so many rounds, each of which shuffles its share of the tokens only.
WAVES = 3
#: Beyond so many shards in a wave, a task writes several of them.
MAX_TASKS = 20_000
ROUNDS = 6
KEY = 0x5EED
#: Rows of the table of ranges that may be sent to every task.
MAX_RANGES = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(number: np.ndarray, size: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The slot of each number in [0, size), or, inverted, the number of each slot.

    A balanced Feistel network permutes the next even power of two; values
    beyond ``size`` walk on along their cycle until they fall inside.
    """
    half = max(1, -(-max(1, (size - 1).bit_length()) // 2))
    h, mask = np.uint64(half), np.uint64((1 << half) - 1)
    with np.errstate(over="ignore"):
        keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))

        def once(x: np.ndarray) -> np.ndarray:
            left, right = x >> h, x & mask
            for k in keys[::-1] if inverse else keys:
                if inverse:
                    left, right = right ^ (_mix(left + k) & mask), left
                else:
                    left, right = right, left ^ (_mix(right + k) & mask)
            return (left << h) | right

        out = once(np.asarray(number).astype(np.uint64))
        while len(beyond := np.flatnonzero(out >= size)):
            out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def in_data_order(docs: DataFrame) -> DataFrame:
    """doc_id and text in ranges by doc_id and text, so that one doc_id (or none) can fill many ranges."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = slim.withColumn("digest", F.xxhash64("text"))
    return keyed.repartitionByRange(rounded_parts(docs, 32), "doc_id", "digest").sortWithinPartitions("doc_id", "digest", "text")


def sequences(docs: DataFrame, path: str, pattern: str, stride: int = STRIDE) -> DataFrame:
    """range, row, doc_id, part, n_tokens and tokens (2 * n_tokens bytes) of each sequence.

    A text's ids and one END are cut into parts of ``stride`` ids; the last may
    be shorter.  A null or empty text is one sequence with END alone.  Range and
    row give the place in the data's order.  Ids that don't fit into 16 bits, or
    are END, raise.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = LibraryCodec.of(path, pattern)
        if max(coder.ranks.values(), default=0) >= END:
            raise ValueError(f"ranks must stay below {END}, which ends texts")
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                piece = batch.slice(at, 200)
                docs_, parts, counts, rows = [], [], [], []
                for doc, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    ids = np.append(coder.ids(text), END).astype("<u2")
                    for part, start in enumerate(range(0, len(ids), stride)):
                        cut = ids[start : start + stride]
                        docs_.append(doc)
                        parts.append(part)
                        counts.append(len(cut))
                        rows.append(cut.tobytes())
                n = len(rows)
                columns = [pa.array(np.full(n, task, np.int32)), pa.array(np.arange(row, row + n)), pa.array(docs_, pa.int64()), pa.array(parts, pa.int64()), pa.array(counts, pa.int32()), pa.array(rows, pa.binary())]
                row += n
                yield pa.RecordBatch.from_arrays(columns, names=["range", "row", "doc_id", "part", "n_tokens", "tokens"])

    return in_data_order(docs).select("doc_id", "text").mapInArrow(encode, "range int, row long, doc_id long, part long, n_tokens int, tokens binary")


def numbered(rows: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """The rows, written to a folder and read again, with ``number`` from 0, and their count."""
    spark = rows.sparkSession
    with shuffles_freed(spark):
        rows.write.option("compression", "zstd").parquet(folder)
    kept = spark.read.schema(rows.schema).parquet(folder)
    ranges = kept.groupBy("range").agg(F.count("*").alias("n"))  # one row per task that has encoded
    before = F.sum("n").over(W.Window.orderBy("range").rowsBetween(W.Window.unboundedPreceding, -1))
    firsts = ranges.select("range", "n", F.coalesce(before, F.lit(0)).alias("first"))
    n_ranges, total = firsts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    placed = firsts.select("range", "first")
    joined = kept.join(F.broadcast(placed) if n_ranges <= MAX_RANGES else placed, "range")
    return joined.withColumn("number", F.col("first") + F.col("row")).drop("range", "row", "first"), total


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _shard_file(base: str, shard: int) -> str:
    return f"{base}/shard-{shard:012d}.bin"


def _filled(tokens: pa.Array, counts: np.ndarray, stride: int) -> np.ndarray:
    """Rows of one length, the rest of each filled with END."""
    out = np.full((len(tokens), stride), END, "<u2")
    out[np.arange(stride) < counts[:, None]] = np.frombuffer(b"".join(tokens.to_pylist()), "<u2")
    return out


class _Shard:
    """One shard's file: written under a name of its own, moved when whole, and read back for the index."""

    def __init__(self, store: fs.FileSystem, base: str, shard: int, size: int, stride: int, shard_sequences: int):
        self.store, self.base, self.shard, self.size, self.width = store, base, shard, size, 2 * stride
        self.next = self.first = shard * shard_sequences
        self.draft = f"{_shard_file(base, shard)}.{uuid.uuid4().hex}"
        self.out = store.open_output_stream(self.draft, compression=None)
        self.about: list[pa.RecordBatch] = []

    def add(self, slots: np.ndarray, raw: np.ndarray, about: pa.RecordBatch) -> None:
        if not np.array_equal(slots, np.arange(self.next, self.next + len(slots))):
            raise ValueError(f"shard {self.shard}: slots must follow each other from {self.next}")
        self.out.write(raw.tobytes())
        self.next += len(slots)
        self.about.append(about)

    def close(self) -> Iterator[pa.RecordBatch]:
        self.out.close()
        if self.next - self.first != self.size:
            raise ValueError(f"shard {self.shard}: {self.next - self.first} of {self.size} sequences came")
        name = _shard_file(self.base, self.shard)
        self.store.move(self.draft, name)  # a task that runs again replaces the file by the same bytes
        with self.store.open_input_stream(name, compression=None) as file:
            for about in self.about:
                raw = file.read(about.num_rows * self.width)
                digests = [hashlib.sha256(raw[i : i + self.width]).hexdigest() for i in range(0, len(raw), self.width)]
                slots = about.column("slot").to_numpy()
                n = len(slots)
                columns = [about.column("slot"), pa.array(np.full(n, self.shard)), pa.array((slots - self.first) * self.width), about.column("doc_id"), about.column("part"), about.column("n_tokens"), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["slot", "shard", "byte_offset", "doc_id", "part", "n_tokens", "tokens_sha256"])


INDEX = "slot long, shard long, byte_offset long, doc_id long, part long, n_tokens int, tokens_sha256 string"


def write_shards(docs: DataFrame, path: str, pattern: str, folder: str, stride: int = STRIDE, shard_sequences: int = SHARD_SEQUENCES, key: int = KEY, waves: int = WAVES) -> DataFrame:
    """Write the shards of ``docs`` and their index below ``folder``, and return the index.

    slot, shard, byte_offset, doc_id, part, n_tokens, tokens_sha256: slots run
    from 0 to the number of sequences without gaps, byte_offset is the place in
    the shard's file, and the digest is that of the bytes which were read back
    from there.  A shard is a range of ``shard_sequences`` slots; its task
    streams them in order and holds one batch of tokens.  The same rows give
    the same files, however they are partitioned.  Null and empty texts give one
    sequence; repeated rows are materialised each; an empty table gives an empty
    index.  Other columns are left out.  ``folder`` must be one that executors
    can write to by pyarrow (a shared path, HDFS, an object store).
    """
    spark = docs.sparkSession
    rows, total = numbered(sequences(docs, path, pattern, stride), f"{folder}/sequences")
    shards = -(-total // shard_sequences)

    @F.pandas_udf("long")
    def slot_of(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), max(1, total), key))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        open_: _Shard | None = None
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            edges = np.flatnonzero(np.diff(slots // shard_sequences)) + 1
            for a, b in zip([0, *edges], [*edges, len(slots)], strict=True):
                if a == b:
                    continue
                shard = int(slots[a]) // shard_sequences
                if open_ is None or open_.shard != shard:
                    if open_ is not None:
                        yield from open_.close()
                    open_ = _Shard(store, base, shard, min(shard_sequences, total - shard * shard_sequences), stride, shard_sequences)
                piece = batch.slice(a, b - a)
                open_.add(slots[a:b], _filled(piece.column("tokens"), piece.column("n_tokens").to_numpy(), stride), piece.select(["slot", "doc_id", "part", "n_tokens"]))
        if open_ is not None:
            yield from open_.close()

    placed = rows.withColumn("slot", slot_of("number")).select("slot", "doc_id", "part", "n_tokens", "tokens")
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    per_wave = max(1, -(-shards // waves))
    for first in range(0, shards, per_wave):
        last = min(shards, first + per_wave)
        per_task = -(-(last - first) // MAX_TASKS)
        tasks = -(-(last - first) // per_task)
        task = F.expr(f"cast((slot div {shard_sequences} - {first}) div {per_task} as int)")
        mine = placed.where(F.col("slot").between(first * shard_sequences, last * shard_sequences - 1))
        with shuffles_freed(spark):
            mine.repartitionById(tasks, task).sortWithinPartitions("slot").mapInArrow(write, INDEX).write.mode("append").parquet(f"{folder}/index")
    if not shards:
        spark.createDataFrame([], INDEX).write.parquet(f"{folder}/index")
    remove(spark, f"{folder}/sequences")
    layout = spark.createDataFrame([(total, stride, shard_sequences)], "total long, stride int, shard_sequences long")
    layout.coalesce(1).write.parquet(f"{folder}/layout")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_from(spark: SparkSession, folder: str, slot: int = 0, count: int | None = None, block: int = 4096) -> DataFrame:
    """slot and tokens from a slot on: a task per shard reads its bytes in order, ``block`` sequences at a time."""
    total, stride, shard_sequences = spark.read.parquet(f"{folder}/layout").first()
    end = total if count is None else min(total, slot + count)
    width = 2 * stride
    if slot >= end:
        return spark.createDataFrame([], "slot long, tokens binary")
    shards = spark.range(slot // shard_sequences, (end - 1) // shard_sequences + 1)
    n = (end - 1) // shard_sequences + 1 - slot // shard_sequences

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                at, last = max(slot, shard * shard_sequences), min(end, (shard + 1) * shard_sequences)
                with store.open_input_file(_shard_file(base, shard)) as file:
                    file.seek((at - shard * shard_sequences) * width)
                    while at < last:
                        n_ = min(block, last - at)
                        raw = file.read(n_ * width)
                        tokens = pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n_)), tokens], names=["slot", "tokens"])
                        at += n_

    return shards.repartition(min(n, MAX_TASKS)).mapInArrow(read, "slot long, tokens binary")


def op5_token_shards(spark, sf_dir: str) -> DataFrame:
    """Place and digest of every sequence of the whole of ``documents``, as its shards hold it."""
    import public_tokenizers

    folder = f"{shared_folder(spark)}/token-shards-{uuid.uuid4().hex}"
    return write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, folder)
