"""Hard-negative mining with angular triangle filtering.

Every vector keeps its angles to a few reference directions.  By the triangle
inequality on the sphere the angle between an anchor and a row lies between the
difference and the sum of their angles to each direction; the cosines of both,
multiplied by the norms, are bounds of their inner product.  They are widened by
more than their rounding errors, so nothing that counts falls outside.

1. Rows go to the cell of their nearest direction, cells into pieces of bounded
   size.  A directory has the ranges of angles and norms of each cell.
2. Anchors look into one piece of their own cell first: the scores found there
   say how large a score must be to matter.
3. Anchors go to the pieces of the cells whose bounds reach that far.  Within a
   piece, sorted by angle, each searches only the window that its bound allows;
   what lies in it gets integer scores.
4. The same once more for negatives, with the window of scores that the
   positives leave.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ._shared import Scratch, run_starts, table

#: Reference directions, and so cells.
DIRECTIONS = 16
#: The directions are fitted on at most about so many vectors.
SAMPLE = 2048
#: Rows of a piece, at most about: even where all rows are in one cell.
PIECE_ROWS = 1 << 16
#: Rows of the directory up to which it is sent to all tasks.
MAX_SENT = 20_000
POSITIVES = NEGATIVES = 5
#: More than the rounding error of an angle, and of a product of norms.
ANGLE_SLACK = 1e-6
SCORE_SLACK = 1e-9
#: Doubles hold all sums of products, times a hundred, exactly below this product of norms.
EXACT = 2.0**46
SEED = 23
_LONG = (1 << 63) - 1


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def directions_of(dims: int, fitted: dict[int, np.ndarray]) -> np.ndarray:
    """Unit vectors: those fitted for this length, else drawn ones."""
    if dims in fitted:
        return fitted[dims]
    drawn = np.random.default_rng([SEED, dims]).standard_normal((DIRECTIONS, dims))
    return drawn / np.maximum(np.linalg.norm(drawn, axis=1, keepdims=True), 1e-300)


def fit_directions(clean: DataFrame, most: int = SAMPLE, rounds: int = 6) -> dict[int, np.ndarray]:
    """Centres of a bounded sample of the commonest length; results do not depend on them."""
    total = clean.count()
    share = int(min(1.0, most / max(1, total)) * 1_000_000)
    drawn = clean.where((F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share) & (F.size("v") > 0)).select("v").limit(2 * most).toArrow()
    v = drawn.column("v").combine_chunks()
    lengths = np.diff(v.offsets.to_numpy()) if len(v) else np.empty(0, np.int64)
    if not len(lengths):
        return {}
    dims = int(np.bincount(lengths).argmax())
    x = matrix(v.filter(pa.array(lengths == dims)), dims)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    x = x[np.lexsort(x.T)]
    centres = x[np.linspace(0, len(x) - 1, DIRECTIONS).astype(int)]
    for _ in range(rounds):
        of = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[of == c].sum(axis=0) for c in range(DIRECTIONS)])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return {dims: np.where(np.isfinite(centres), centres, 0.0)}


def usable(vectors: DataFrame, relabel_every: int, labels: int) -> DataFrame:
    """vec_id, label and v of the rows that take part; each id once."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(256 * x) == float("inf")))
    clean = v.where("vec_id is not null and label is not null and v is not null").where(~bad)
    moved = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return clean.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v").withColumn("label", moved)


def placed(clean: DataFrame, fitted: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, label, dims, q (integers as doubles), norm, angles to the directions and cell (the nearest)."""
    kind = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dims", pa.int32()), ("q", pa.list_(pa.float64())), ("norm", pa.float64()), ("angles", pa.list_(pa.float64())), ("cell", pa.int32())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("dims").to_numpy()
            for dims in np.unique(size):
                part = batch.filter(pa.array(size == dims))
                q = np.floor(256.0 * matrix(part.column("v"), dims))
                # Scaled first, so that squares of huge components stay finite.
                largest = np.abs(q).max(axis=1, initial=0.0)
                unit = q / np.where(largest > 0, largest, 1.0)[:, None]
                length = np.linalg.norm(unit, axis=1)
                cosine = unit / np.where(length > 0, length, 1.0)[:, None] @ directions_of(int(dims), fitted).T
                angles = np.arccos(np.clip(cosine, -1.0, 1.0))
                n = len(part)
                with np.errstate(over="ignore"):
                    norm = length * largest
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), part.column("dims"), _lists(q), pa.array(norm), _lists(angles), pa.array(angles.argmin(axis=1).astype(np.int32) if n else np.empty(0, np.int32))],
                    schema=kind,
                )

    return clean.withColumn("dims", F.size("v")).mapInArrow(place, "vec_id long, label long, dims int, q array<double>, norm double, angles array<double>, cell int")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def _bound(norms: Column, angle: Column) -> Column:
    return norms * F.cos(angle)


def reached(asking: DataFrame, directory: DataFrame, pieces: int) -> DataFrame:
    """``asking`` once for each piece of each cell whose bounds meet ``low`` to ``high``, with cell, piece and angle."""
    r = F.sequence(F.lit(0), F.lit(DIRECTIONS - 1))
    met = asking.drop("cell").join(directory, "dims")
    a, lo, hi = (lambda i, c=c: F.get(c, i) for c in ("angles", "least", "most"))
    gap = F.array_max(F.transform(r, lambda i: F.greatest(F.lit(0.0), a(i) - hi(i), lo(i) - a(i)))) - ANGLE_SLACK
    # The largest possible angle: a sum, or what is left of a full turn, whichever is less.
    reach = F.array_min(F.transform(r, lambda i: F.greatest(F.least(a(i) + hi(i), F.lit(math.pi)), F.least(F.lit(2 * math.pi) - a(i) - lo(i), F.lit(math.pi)))))
    reach = F.array_min(F.array(reach, F.lit(math.pi))) + ANGLE_SLACK
    near, far = F.cos(F.greatest(gap, F.lit(0.0))), F.cos(F.least(reach, F.lit(math.pi)))
    top = F.col("norm") * F.when(near >= 0, F.col("norm_most")).otherwise(F.col("norm_least")) * near
    bottom = F.col("norm") * F.when(far >= 0, F.col("norm_least")).otherwise(F.col("norm_most")) * far
    slack = F.col("norm") * F.col("norm_most") * SCORE_SLACK + 1
    # Written so that bounds that aren't numbers (of huge norms) rule nothing out.
    out = met.where(~((top + slack < F.col("low")) | (bottom - slack > F.col("high"))) | F.isnan(top) | F.isnan(bottom))
    return out.withColumn("angle", F.get("angles", F.col("cell"))).withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))


ROW = ["dims", "cell", "piece", "role", "angle", "vec_id", "label", "q", "norm"]


def search(rows: DataFrame, asking: DataFrame, kernel, schema: str, extra: dict[str, str]) -> DataFrame:
    """Bring pieces and the anchors that reach them together; ``kernel`` sees the rows of a piece and some anchors."""
    items = rows.select("dims", "cell", "piece", F.lit(0).alias("role"), F.get("angles", F.col("cell")).alias("angle"), "vec_id", "label", "q", "norm", *[F.lit(None).cast(t).alias(c) for c, t in extra.items()])
    queries = asking.select("dims", "cell", "piece", F.lit(1).alias("role"), "angle", "vec_id", "label", "q", "norm", *extra)
    # The sort deals with rows of one piece before its anchors; both by angle.
    both = items.unionByName(queries).repartition("dims", "cell", "piece").sortWithinPartitions("dims", "cell", "piece", "role", "angle", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ROW[:4]]
            starts = run_starts(cols)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                now = tuple(int(c[a]) for c in cols[:3])
                if now != key:
                    key, held = now, []
                part = batch.slice(a, b - a)
                if cols[3][a] == 0:
                    held.append((part.column("angle").to_numpy(), part.column("vec_id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("q"), now[0]), part.column("norm").to_numpy()))
                elif held:
                    if len(held) > 1:
                        held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
                    found = [x for x in scored(held[0], part, now[0], kernel) if len(x[0])]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=names)

    names = [c.split()[0] for c in schema.split(", ")]
    return both.mapInArrow(run, schema)


def scored(rows: tuple, anchors: pa.RecordBatch, dims: int, kernel) -> Iterator[tuple]:
    """``kernel(anchor, ids, labels, scores)`` of each anchor and the window of rows that it must score."""
    angle, ids, labels, q, norms = rows
    low = anchors.column("low").to_numpy()
    norm, at, asked = anchors.column("norm").to_numpy(), anchors.column("angle").to_numpy(), matrix(anchors.column("q"), dims)
    large, small = norms.max(), norms.min()
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        # cos(difference of angles) must be at least low / (both norms).
        need = (low - 1 - np.abs(low) * SCORE_SLACK) / (norm * np.where(low > 0, large, small)) * np.where(low > 0, 1 - SCORE_SLACK, 1 + SCORE_SLACK)
        width = np.where(need > 1, -1.0, np.arccos(np.clip(need, -1.0, 1.0)) + ANGLE_SLACK)
        width = np.where(np.isfinite(need), width, np.where(need == np.inf, -1.0, np.pi + 1))
    begin, end = np.searchsorted(angle, at - width, "left"), np.searchsorted(angle, at + width, "right")
    exact = large * norm.max(initial=0.0) < EXACT
    found = anchors.to_pylist() if "positive_ids" in anchors.schema.names else [{"vec_id": i, "label": n} for i, n in zip(anchors.column("vec_id").to_pylist(), anchors.column("label").to_pylist(), strict=True)]
    for a in range(0, len(at), 64):
        b = min(len(at), a + 64)
        live = np.flatnonzero(end[a:b] > begin[a:b]) + a
        if not len(live):
            continue
        first, last = begin[live].min(), end[live].max()
        if exact:
            # Whole numbers below 2**53 in any order of adding: no rounding.
            block = asked[live] @ q[first:last].T
        else:
            block = np.array([[sum(int(s) * int(t) for s, t in zip(x, y, strict=True)) for y in q[first:last]] for x in asked[live]], object)
        for n, scores in zip(live, block, strict=True):
            i, j = begin[n], end[n]
            yield kernel(found[n], ids[i:j], labels[i:j], scores[i - first : j - first])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > 8 * k and scores.dtype != object:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    order = np.lexsort((ids[near], -scores[near])) if scores.dtype != object else np.array(sorted(range(len(near)), key=lambda n: (-scores[near[n]], ids[near[n]])), np.int64)
    return near[order[:k]]


def _long(scores: np.ndarray) -> np.ndarray:
    """As 64-bit integers; what doesn't fit (components in the billions) is cut to the largest or smallest."""
    return scores.astype(np.int64) if scores.dtype != object else np.array([max(-_LONG - 1, min(_LONG, int(s))) for s in scores], np.int64)


def _positives(k: int):
    def kernel(anchor: dict, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> tuple:
        same = np.flatnonzero((labels == anchor["label"]) & (ids != anchor["vec_id"]))
        best = same[_best(scores[same], ids[same], k)]
        return np.full(len(best), anchor["vec_id"]), ids[best], _long(scores[best])

    return kernel


def _negatives(k: int, percent: int):
    def kernel(anchor: dict, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> tuple:
        least, most = min(anchor["positive_scores"]), max(anchor["positive_scores"])
        other = np.flatnonzero((labels != anchor["label"]) & (100 * scores >= percent * least) & (scores <= most))
        out = []
        for positive, score in zip(anchor["positive_ids"], anchor["positive_scores"], strict=True):
            fit = other[(scores[other] <= score) & (100 * scores[other] >= percent * score)]
            best = fit[_best(scores[fit], ids[fit], k)]
            out.append((np.full(len(best), anchor["vec_id"]), np.full(len(best), positive), np.full(len(best), score), ids[best], _long(scores[best])))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return kernel


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = 80, relabel_every: int = 7, labels: int = 10, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows whose vec_id is divisible by ``relabel_every`` get the label
    (label + 1) % ``labels``.  A component x counts as floor(256 x); scores are
    inner products of these, as integers.  Anchors are the rows whose vec_id is
    divisible by ``every``; their positives the ``positives`` best other rows of
    their label; the negatives of each the ``negatives`` best rows of another
    label whose score is at least ``percent`` percent of the positive's and at
    most all of it.  Ties go to the smaller vec_id.

    Rows whose vec_id, label or vector is null, or whose vector holds a null or
    something not finite (before or after the factor), take no part.  Rows of one
    id count once: the one of least label, then vector.  Vectors of different
    lengths have no inner product, so partners are of the anchor's length; the
    product of empty ones is 0.  A score beyond 64 bits is compared exactly
    and returned as the nearest 64-bit number.  Other columns play no part.
    """
    scratch = Scratch(vectors.sparkSession)
    clean = scratch.keep(usable(vectors, relabel_every, labels), "clean")
    found = placed(clean, fit_directions(clean))
    pieces = max(1, -(-clean.count() // piece_rows))
    rows = scratch.keep(found.withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.lit(pieces)).cast("int")), "rows")
    ranges = [f(F.get("angles", F.lit(i))).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(DIRECTIONS)]
    cells = rows.groupBy("dims", "cell").agg(*ranges, F.min("norm").alias("norm_least"), F.max("norm").alias("norm_most"))
    directory = scratch.keep(cells.select("dims", "cell", F.array(*[f"lo{i}" for i in range(DIRECTIONS)]).alias("least"), F.array(*[f"hi{i}" for i in range(DIRECTIONS)]).alias("most"), "norm_least", "norm_most"), "directory")
    # At most DIRECTIONS rows for each length of vector.
    sent = F.broadcast(directory) if directory.count() <= MAX_SENT else directory
    no_limit = F.lit(float("inf"))
    anchors = rows.where(F.col("vec_id") % every == 0).withColumn("high", no_limit)
    # A sample of the anchor's own cell gives scores that the positives reach at least.
    pair, low = "anchor_id long, vec_id long, score long", {"low": "double"}
    own = anchors.withColumn("low", -no_limit).withColumn("angle", F.get("angles", F.col("cell"))).withColumn("piece", F.lit(0))
    seeds = search(rows.where("piece = 0"), own, _positives(positives), pair, low)
    order = W.Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    known = seeds.withColumn("n", F.row_number().over(order)).where(F.col("n") == positives).select(F.col("anchor_id").alias("vec_id"), F.col("score").cast("double").alias("low"))
    asking = anchors.join(known, "vec_id", "left").withColumn("low", F.coalesce("low", -no_limit))
    near = search(rows, reached(asking, sent, pieces), _positives(positives), pair, low)
    best = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
    lists = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("p"))
    lists = scratch.keep(lists.select(F.col("anchor_id").alias("vec_id"), F.col("p.vec_id").alias("positive_ids"), F.col("p.score").alias("positive_scores")), "positives")
    least, most = F.array_min("positive_scores"), F.array_max("positive_scores")
    # A window of scores; 80 p <= 100 n, widened by what a double may lose of a large number.
    window = anchors.drop("high").join(lists, "vec_id").withColumn("low", least * (percent / 100) - 1 - F.abs(least) * SCORE_SLACK).withColumn("high", most.cast("double") + 1 + F.abs(most) * SCORE_SLACK)
    extra = {"low": "double", "positive_ids": "array<long>", "positive_scores": "array<long>"}
    held = search(rows, reached(window, sent, pieces), _negatives(negatives, percent), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long", extra)
    ranks = W.Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    out = held.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= negatives)
    out = scratch.keep(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "result")
    scratch.drop("clean", "rows", "directory", "positives")
    return out


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 12 over the whole of ``embeddings``."""
    return hard_negatives(table(spark, sf_dir, "embeddings"))


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
