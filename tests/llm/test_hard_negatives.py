"""Hard negatives against brute force in whole numbers."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar_market.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, cell string, low double"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, every=100, positives=5, negatives=5, percent=80):
    clean = {}
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(256 * x) for x in v):
            continue
        if vec_id not in clean or (label, v) < clean[vec_id]:
            clean[vec_id] = (label, v)
    q = {i: ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, (label, v) in clean.items()}
    out = []
    for a, (label, x) in q.items():
        if a % every:
            continue
        scores = sorted((-sum(s * t for s, t in zip(x, y, strict=True)), i, k == label) for i, (k, y) in q.items() if i != a and len(y) == len(x))
        for minus, p, same in [s for s in scores if s[2]][:positives]:
            fit = [(-s, i) for s, i, k in scores if not k and percent * -minus <= 100 * -s <= 100 * -minus]
            out += [(a, p, n, i, -minus, s) for n, (s, i) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "c", 0.5) for i, v, label in rows], SCHEMA).repartition(3)


def clustered(seed, n, dims, spread, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    return [(i, [float(x) for x in scale * (centres[i % 6] + spread * rng.standard_normal(dims))], int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize(("seed", "dims", "spread", "piece_rows", "every"), [(1, 8, 0.1, 1 << 16, 10), (2, 8, 1.0, 40, 10), (3, 24, 0.3, 100, 20), (4, 1, 1.0, 64, 25), (5, 2, 3.0, 64, 10)])
def test_against_brute_force(spark, seed, dims, spread, piece_rows, every):
    rows = clustered(seed, 400, dims, spread)
    assert found(H.hard_negatives(frame(spark, rows), every=every, piece_rows=piece_rows)) == plain(rows, every)


def test_awkward_rows(spark):
    """Nulls, what isn't finite, ties, repeated rows and ids, zero and empty vectors, several lengths, negative scores."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)], int(rng.integers(0, 3))) for i in range(300)]
    rows += [(i, [float(x) for x in rng.integers(-2, 3, 5)], i % 3) for i in range(300, 420)]
    rows += [(i, [], i % 2) for i in range(500, 512)] + [(i, [0.0, 0.0, 0.0], i % 2) for i in range(600, 604)]
    rows += [(700, None, 1), (701, [1.0, None, 1.0], 1), (702, [1.0, float("nan"), 1.0], 1), (703, [1.0, float("inf"), 0.0], 1), (704, [1.7e308, 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1), (705, [1.0, 1.0, 1.0], None)]
    rows += [(20, [2.0, 2.0, 2.0], 0), (20, [2.0, 2.0, 2.0], 0), (40, [1.0, 1.0, 1.0], 2), *rows[100:140]]
    rows += [(800 + i, [-5.0 - i, 0.25, 0.0], 1) for i in range(5)] + [(900 + i, [1.0, 2.0, 1.0], i % 3) for i in range(60)]
    assert found(H.hard_negatives(frame(spark, rows), every=10, piece_rows=50)) == plain(rows, 10)


def test_whole_numbers_beyond_doubles(spark):
    """Products above 2**53 are still compared exactly."""
    rng = np.random.default_rng(10)
    rows = [(i, [float(x) for x in np.round(1e6 * rng.standard_normal(3) + 3e6, 3)], int(rng.integers(0, 3))) for i in range(60)]
    assert max(r[-1] for r in plain(rows, 10)) > 1 << 53
    assert found(H.hard_negatives(frame(spark, rows), every=10)) == plain(rows, 10)


def test_nothing_to_mine(spark):
    assert found(H.hard_negatives(frame(spark, []))) == []
    assert found(H.hard_negatives(frame(spark, [(0, [1.0], 1), (1, [1.0], 2)]))) == []


def test_bounds_leave_cells_out(spark):
    """Where vectors lie in clusters, an anchor doesn't go to cells that its bounds rule out."""
    rows = clustered(6, 600, 16, 0.05)
    clean = H.usable(frame(spark, rows), 7, 10)
    placed = H.placed(clean, H.fit_directions(clean)).cache()
    ranges = [f(F.get("angles", F.lit(i))).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(H.DIRECTIONS)]
    cells = placed.groupBy("dims", "cell").agg(*ranges, F.min("norm").alias("norm_least"), F.max("norm").alias("norm_most"))
    directory = cells.select("dims", "cell", F.array(*[f"lo{i}" for i in range(H.DIRECTIONS)]).alias("least"), F.array(*[f"hi{i}" for i in range(H.DIRECTIONS)]).alias("most"), "norm_least", "norm_most")
    one = placed.where("vec_id = 100").withColumn("low", 0.9 * F.col("norm") * F.col("norm")).withColumn("high", F.lit(float("inf")))
    reached = {r["cell"] for r in H.reached(one, directory, 1).collect()}
    vectors = {r["vec_id"]: (np.array(r["q"]), r["cell"], r["norm"]) for r in placed.collect()}
    a, _, norm = vectors[100]
    needed = {cell for q, cell, _ in vectors.values() if q @ a >= 0.9 * norm * norm}
    assert needed <= reached
    assert len(reached) < directory.count()


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_sql_gives_the_same_rows(spark, size):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{size}/embeddings.parquet'")
    out = con.execute(H.NEGATIVES_SQL)
    names = [c[0] for c in out.description]
    want = sorted(tuple(r[names.index(c)] for c in COLUMNS) for r in out.fetchall())
    assert found(H.op12_hard_negatives(spark, f"/root/testdata/{size}")) == want
