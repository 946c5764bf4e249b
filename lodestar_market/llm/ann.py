"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives every vector a long string of hash bits, and keeps the vectors
sorted by it.  A query descends to its longest-prefix matches and then
ascends, all trees at once, until the prefixes hold enough candidates.  How
many vectors a prefix holds is read from a directory of fixed size.  The sorted
arrays are kept in blocks of bounded size; a query goes to the blocks its
prefix covers, finds its range by bisection and scores what is in it.

Inner products are searched: vectors are lifted by one coordinate so that all
have the same length, which makes the largest inner product the least angle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ._shared import cut, run_starts, table

TREES = 16
BITS = 24
#: Leading bits that the directory counts, and those that make a block.
DIRECTORY_BITS = 10
BLOCK_BITS = 4
#: Candidates to look for, over all trees, as a share of the index.
SHARE = 1.0
LEAST = 2000
BLOCK_ROWS = 8192
K = 20
SEED = 11


def _planes(dims: int, trees: int, bits: int) -> np.ndarray:
    """Hash planes: in each tree as orthogonal to each other as they can be."""
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(trees):
        drawn = [np.linalg.qr(rng.standard_normal((dims, dims)))[0].T for _ in range(-(-bits // dims))]
        out.append(np.concatenate(drawn)[:bits])
    return np.stack(out)


def _labels(lifted: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The hash strings, as numbers, of each vector in each tree."""
    weights = 1 << np.arange(planes.shape[1] - 1, -1, -1, dtype=np.int64)
    return np.stack([(lifted @ tree.T > 0) @ weights for tree in planes], axis=1)


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    x = x / longest
    return np.concatenate([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1, keepdims=True)))], axis=1)


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(flat), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (doubles) of rows whose vector is a finite, non-zero one."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return v.where("vec_id is not null and v is not null and size(v) > 0").where(~bad & F.exists("v", lambda x: x != 0))


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores and a few more, so that ties can be settled."""
    spare = k + 4
    if len(scores) <= spare:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - spare)[len(scores) - spare]
    found = np.flatnonzero(scores >= least)
    return found if len(found) <= 4 * spare else found[np.lexsort((ids[found], -scores[found]))[: 4 * spare]]


def nearest(vectors: DataFrame, every: int = 20, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, share: float = SHARE, least: int = LEAST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query.

    Queries are the rows whose id is divisible by ``every``; all other rows are
    candidates.  Equal vectors are indexed once, with the k + 1 smallest of
    their ids, which are all that can be among the k nearest of a query.  The
    score is the inner product in double precision; ties go to the smaller id.
    Rows whose vector is null, empty, zero or not finite, or whose id is null,
    take no part.  Vectors of different lengths have no inner product: each
    length is searched for itself, with an index of its own.
    Rows of one id count once: the least of their vectors.  With k or fewer candidates all are returned.
    """
    clean = usable(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    lengths = [r["d"] for r in clean.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    if not lengths:
        return vectors.sparkSession.range(0).selectExpr("id AS query_id", "cast(0 as int) AS rank", "id AS vec_id", "0.0D AS score")
    return reduce(DataFrame.unionByName, [_nearest_of(clean.where(F.size("v") == dims), dims, every, k, trees, share, least, block_rows) for dims in lengths])


def _nearest_of(clean: DataFrame, dims: int, every: int, k: int, trees: int, share: float, least: int, block_rows: int) -> DataFrame:
    """``nearest`` among vectors of one length."""
    # Before the shuffle each task keeps the k + 1 smallest ids of a vector.
    order = W.Window.partitionBy("v").orderBy("vec_id")
    few = clean.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    classes = cut(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("cid", F.get("ids", F.lit(0))))
    total, longest = classes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    asking = clean.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").join(classes.select("v", "cid"), "v").select("query_id", "cid")
    planes = _planes(dims + 1, trees, BITS)
    wanted = max(least, int(share * total))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = _labels(_lift(_matrix(batch.column("v")), longest), planes)
            n = len(labels)
            for tree in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, tree, np.int32)), pa.array(labels[:, tree]), batch.column("cid"), batch.column("v")], names=["tree", "label", "cid", "v"])

    index = classes.select("cid", "v").mapInArrow(label, "tree int, label long, cid long, v array<double>")
    prefix = F.shiftright("label", BITS - DIRECTORY_BITS)
    # At most trees * 2 ** DIRECTORY_BITS counts, whatever the number of vectors.
    counted = index.groupBy("tree", prefix.alias("prefix")).agg(F.count("*").alias("n")).collect()
    directory = [np.zeros((trees, 1 << DIRECTORY_BITS), np.int64)]
    for row in counted:
        directory[0][row["tree"], row["prefix"]] = row["n"]
    while directory[-1].shape[1] > 1:
        directory.append(directory[-1].reshape(trees, -1, 2).sum(axis=2))
    directory.reverse()  # directory[level][tree, prefix of that many bits]
    parts = np.maximum(1, -(-directory[BLOCK_BITS] // block_rows))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ascend from the longest prefixes until all trees together hold enough."""
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"))
            lifted = np.concatenate([v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros((len(v), 1))], axis=1)
            labels = _labels(lifted, planes)
            level = np.zeros(len(v), np.int64)
            for bits in range(DIRECTORY_BITS, -1, -1):
                held = sum(directory[bits][t, labels[:, t] >> (BITS - bits)] for t in range(trees))
                level = np.where((level == 0) & (held >= wanted), bits, level)
            for tree in range(trees):
                shift = BITS - level
                low = (labels[:, tree] >> shift) << shift
                high = low + (np.int64(1) << shift)
                first, last = low >> (BITS - BLOCK_BITS), (high - 1) >> (BITS - BLOCK_BITS)
                row = np.repeat(np.arange(len(v)), last - first + 1)
                block = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
                again = parts[tree, block]
                which = np.repeat(np.arange(len(row)), again)
                part = np.arange(len(which)) - np.repeat(np.cumsum(again) - again, again)
                row, block = row[which], block[which]
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), tree, np.int32)), pa.array(block.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.ones(len(row), np.int32)), pa.array(low[row]), pa.array(high[row]), batch.column("cid").take(pa.array(row)), batch.column("v").take(pa.array(row))],
                        names=["tree", "block", "part", "role", "label", "high", "cid", "v"],
                    )

    layout = "tree int, block int, part int, role int, label long, high long, cid long, v array<double>"
    queries = asking.select("cid").distinct().join(classes.select("cid", "v"), "cid").mapInArrow(route, layout)
    block = F.shiftright("label", BITS - BLOCK_BITS).cast("int")
    part_count = F.get(F.array(*[F.lit(int(n)) for n in parts.ravel()]), F.col("tree") * (1 << BLOCK_BITS) + block)
    items = index.select("tree", block.alias("block"), F.pmod(F.xxhash64("cid"), part_count).cast("int").alias("part"), F.lit(0).alias("role"), "label", F.lit(0).cast("long").alias("high"), "cid", "v")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come with their sorted items first, then their queries."""
        key, held = None, []  # the block that is open and its items so far
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("tree", "block", "part", "role")]
            starts = run_starts(cols)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                now = tuple(int(c[a]) for c in cols[:3])
                if now != key:
                    key, held = now, []
                piece = batch.slice(a, b - a)
                if cols[3][a] == 0:
                    held.append((piece.column("label").to_numpy(), piece.column("cid").to_numpy(), _matrix(piece.column("v"))))
                elif held:
                    if len(held) > 1:
                        held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
                    yield from _score_block(*held[0], piece, k + 1)

    both = items.unionByName(queries).repartition("tree", "block", "part").sortWithinPartitions("tree", "block", "part", "role", "label", "high", "cid")
    scored = both.mapInArrow(score, "qid long, cid long, score double")
    best = W.Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    near = scored.groupBy("qid", "cid").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    members = near.join(classes.select("cid", "ids"), "cid").select(F.col("qid").alias("cid"), "score", "ids")
    each = asking.join(members, "cid").select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    final = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _score_block(labels: np.ndarray, cids: np.ndarray, items: np.ndarray, queries: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    low, high = queries.column("label").to_numpy(), queries.column("high").to_numpy()
    qid, q = queries.column("cid").to_numpy(), _matrix(queries.column("v"))
    groups = run_starts([low, high])
    out_q, out_c, out_s = [], [], []
    for a, b in zip(groups[:-1], groups[1:], strict=True):
        i, j = np.searchsorted(labels, low[a], "left"), np.searchsorted(labels, high[a], "left")
        if i == j:
            continue
        for at in range(a, b, 256):
            rough = q[at : min(b, at + 256)] @ items[i:j].T
            for n, row in enumerate(rough):
                found = _top(row, cids[i:j], k)
                # Settled in extended precision, so that a score doesn't depend on its block.
                exact = (items[i:j][found] * q[at + n]).astype(np.longdouble).sum(axis=1).astype(np.float64)
                found = found[order := np.lexsort((cids[i:j][found], -exact))[:k]]
                out_q.append(np.full(len(found), qid[at + n]))
                out_c.append(cids[i:j][found])
                out_s.append(exact[order])
    if out_q:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_c, out_s)], names=["qid", "cid", "score"])


def recall(found: pd.DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int = K) -> float:
    """Share of the true k nearest that were found, by brute force (for tests)."""
    place = {int(i): n for n, i in enumerate(ids)}
    got = total = 0
    for query, rows in found.groupby("query_id"):
        scores = vectors @ vectors[place[int(query)]]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != query][:k]
        got += len({int(ids[i]) for i in order} & set(rows["vec_id"]))
        total += len(order)
    return got / max(1, total)


def op4_hash_prefix_forest(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 4 over the whole of ``embeddings``."""
    return nearest(table(spark, sf_dir, "embeddings"))
