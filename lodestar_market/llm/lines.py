"""Line dedup by winnowing over line hashes.

1. Every window of ``run`` consecutive lines selects its smallest line hash (the
   rightmost of equal ones) as a fingerprint.  Only the selected lines become
   rows, so any repeated run of at least ``run`` lines is sure to share one.
2. Places with the same fingerprint are joined.  Around each the match extends
   to both sides as far as windows hold the selected line: if the whole
   surroundings stand earlier, they go at once.
3. Of each different surroundings of a fingerprint the first place is held
   window by window against the others, which finds where a match extends to
   one side only.
4. Runs that stand earlier are deleted.

Lines are compared by 128 bits of hash.  A line of many words also
counts as a run of its own where that is asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, bounded_slices, join_counted, table

#: Lines of a window: the shortest run that is deleted.
RUN = 2
#: Words that make a line long enough to go alone (``op3_long_lines`` and the pipeline).
LONG_WORDS = 50
#: Texts that are Python objects at a time, and their bytes (a longer text comes alone).
SLICE, SLICE_BYTES = 200, 1 << 22
#: Stands for a doc_id that is null: before all others.
NO_ID = -(1 << 63)


def _key(docs: DataFrame) -> list:
    """doc and twin, which tell texts apart: rows equal in both are one document."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("twin")]


PLACE = pa.schema([("doc", pa.int64()), ("twin", pa.int64()), ("fingerprint", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("windows", pa.list_(pa.int64()))])
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[^ \t\r]+")


def _windows(lines: np.ndarray, run: int) -> np.ndarray:
    """A hash of each ``run`` line hashes in a row."""
    out = np.zeros(len(lines) - run + 1, np.uint64)
    for d in range(run):
        out = (out ^ (out >> np.uint64(29))) * _FACTOR + lines[d : d + len(out)]
    return out


def _selected(h: np.ndarray, run: int, doc_of: np.ndarray) -> np.ndarray:
    """Places of the smallest hash (the rightmost of equal ones) of each window within a text."""
    n = len(h) - run + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, at = h[:n].copy(), np.arange(n)
    for d in range(1, run):
        nearer = h[d : d + n] <= least
        least[nearer] = h[d : d + n][nearer]
        at[nearer] = np.flatnonzero(nearer) + d
    return np.unique(at[doc_of[:n] == doc_of[run - 1 : run - 1 + n]])


def fingerprints(docs: DataFrame, run: int = RUN, long_words: int = 0) -> DataFrame:
    """doc, twin, fingerprint, low, high and windows of every selected line.

    low to high are the lines of all windows that hold the selected line, and
    ``windows`` has the two hashes of each (first all of one kind, then all of
    the other).  With ``long_words`` each line of as many words (split at
    blanks, tabs and carriage returns) is selected for itself too: low and high
    are equal.
    """

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, "text", SLICE, SLICE_BYTES):
                texts = [t.encode().split(b"\n") for t in part.column("text").to_pylist()]
                counts = np.array([len(t) for t in texts])
                lines = [line for t in texts for line in t]
                h, g = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), ">u8").astype(np.uint64).reshape(-1, 2).T
                doc_of = np.repeat(np.arange(len(texts)), counts)
                end = np.cumsum(counts)[doc_of]
                begin = end - counts[doc_of]
                p = _selected(h, run, doc_of)
                low = np.maximum(begin[p], p - run + 1)
                n = np.minimum(p, end[p] - run) - low + 1
                # The windows of each place: n hashes of one kind, then n of the other.
                size = 2 * n
                within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                other = within >= np.repeat(n, size)
                window = np.repeat(low, size) + within - np.where(other, np.repeat(n, size), 0)
                values = np.where(other, _windows(g, run)[window], _windows(h, run)[window]) if len(p) else np.empty(0, np.uint64)
                rows = [(doc_of[p], h[p], low - begin[p], low + n + run - 2 - begin[p], size, values)]
                if long_words:
                    long = np.array([i for i, line in enumerate(lines) if len(line) >= 2 * long_words - 1 and len(_WORD.findall(line)) >= long_words], np.int64)
                    rows.append((doc_of[long], h[long] * _FACTOR ^ g[long], long - begin[long], long - begin[long], np.full(len(long), 2), np.stack([h[long], g[long]], axis=1).ravel()))
                of, print_, low, high, size, values = (np.concatenate(c) for c in zip(*rows, strict=True))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(values.view(np.int64)))
                doc, twin = (part.column(c).take(pa.array(of)) for c in ("doc", "twin"))
                yield pa.RecordBatch.from_arrays([doc, twin, pa.array(print_.view(np.int64)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), lists], schema=PLACE)

    return docs.where("text is not null").select(*_key(docs), "text").mapInArrow(select, "doc long, twin long, fingerprint long, low int, high int, windows array<long>")


def repeated_runs(docs: DataFrame, scratch: Scratch, run: int = RUN, long_words: int = 0) -> DataFrame:
    """doc, twin and gone (numbers of the lines of runs that also stand earlier), a written table.

    The texts are read and hashed once; what follows reads the selected lines,
    which are without their text.
    """
    every = scratch.keep(fingerprints(docs, run, long_words), "selected")
    # Map-side combine leaves one row a task for a fingerprint, however frequent.
    shared = scratch.keep(every.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    places = scratch.keep(join_counted(every, shared, ["fingerprint"]), "places")
    kinds = scratch.keep(places.groupBy("fingerprint", "windows").agg(F.min(F.struct("doc", "twin", "low", "high")).alias("first"), F.count("*").alias("n")), "kinds")
    again = join_counted(places, kinds.where("n > 1"), ["fingerprint", "windows"])
    whole = again.where(F.struct("doc", "twin", "low") > F.struct("first.doc", "first.twin", "first.low")).select("doc", "twin", "low", "high")
    # Fingerprints with several surroundings: one row for each window of each of them.
    several = scratch.keep(kinds.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1"), "several")
    each = F.sequence(F.lit(0), F.expr("size(windows) div 2") - 1)
    held = join_counted(kinds.drop("n"), several, ["fingerprint"]).select("first.doc", "first.twin", "first.low", "windows", F.explode(each).alias("i"))
    held = held.select("doc", "twin", (F.col("low") + F.col("i")).alias("low"), F.get("windows", "i").alias("a"), F.get("windows", F.expr("i + size(windows) div 2")).alias("b"))
    held = scratch.keep(held, "held")
    firsts = scratch.keep(held.groupBy("a", "b").agg(F.min(F.struct("doc", "twin", "low")).alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    partly = join_counted(held, firsts, ["a", "b"]).where(F.struct("doc", "twin", "low") > F.col("first")).select("doc", "twin", "low", (F.col("low") + run - 1).alias("high"))
    # As numbers of lines, each once a text, however its runs overlap.
    lines = whole.unionByName(partly).distinct().groupBy("doc", "twin").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("low", "high")))).alias("gone"))
    found = scratch.keep(lines, "gone")
    scratch.drop("selected", "shared", "places", "kinds", "several", "held", "firsts")
    return found


def without_repeats(docs: DataFrame, run: int = RUN, long_words: int = 0) -> DataFrame:
    """row (all columns of ``docs``), kept_text, n_lines, n_removed and n_runs of each row."""
    gone = repeated_runs(docs, Scratch(docs.sparkSession, SLICE_BYTES), run, long_words)
    # The text travels in its row only, once, at any size; the cut itself is made of built-in functions.
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_key(docs)).join(gone.hint("merge"), ["doc", "twin"], "left")
    text, cut = F.col("row.text"), F.col("gone").isNotNull() & F.col("row.text").isNotNull()
    of = joined.withColumn("lines", F.when(cut, F.split(text, "\n")))
    of = of.withColumn("kept", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"))
    # A run lies wherever two lines that stay, or an end of the text, have others in between.
    marks = F.concat(F.array(F.lit(-1)), F.col("kept"), F.array(F.size("lines")))
    of = of.withColumn("marks", F.when(cut, marks))
    runs = F.size(F.filter(F.sequence(F.lit(1), F.size("marks") - 1), lambda i: F.get("marks", i) - F.get("marks", i - 1) > 1))
    return of.select(
        "row",
        F.when(cut, F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")).otherwise(text).alias("kept_text"),
        F.size(F.split(F.coalesce(text, F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.when(cut, F.size("lines") - F.size("kept")).otherwise(0).cast("long").alias("n_removed"),
        F.when(cut, runs).otherwise(0).cast("long").alias("n_runs"),
    )


def dedup_lines(docs: DataFrame, run: int = RUN, long_words: int = 0) -> DataFrame:
    """The rows of ``docs`` with kept_text, n_lines, n_removed and n_runs.

    A line goes if it lies in a run of at least ``run`` consecutive lines that
    stands earlier too: in a row of smaller doc_id, or further up in the same
    text.  With ``long_words``, a line of as many words goes also alone: if the
    same line stands earlier, whatever its neighbours are and even if it is the
    whole text.  Runs are judged on the input.  Lines end at line feeds; a null
    text counts as one line, takes no part and stays null; an empty one is one
    empty line.  Of rows that repeat a doc_id with different texts one counts
    as the earlier (by a hash of the text); rows equal in doc_id and text are
    one document, so they lose the same lines, and none to each other.  Rows
    without a doc_id come before all others.  Other columns stay; one with a
    name of the four is replaced.
    """
    made = ["kept_text", "n_lines", "n_removed", "n_runs"]
    return without_repeats(docs, run, long_words).select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in made], *made)


def cut_lines(docs: DataFrame, run: int = RUN, long_words: int = 0) -> DataFrame:
    """``docs`` with the repeated lines cut from ``text``; ``n_chars``, if there, follows it."""
    length = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long"))
    new = {"text": F.col("kept_text"), "n_chars": length}
    columns = [F.coalesce(new[c], F.col(f"row.`{c}`")).alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns]
    return without_repeats(docs, run, long_words).select(*columns)


def op3_lines(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs and kept_sha256 of each document."""
    return _digested(dedup_lines(table(spark, sf_dir, "documents")))


def op3_long_lines(spark, sf_dir: str) -> DataFrame:
    """As ``op3_lines``, where a line of at least ``LONG_WORDS`` words also goes alone."""
    return _digested(dedup_lines(table(spark, sf_dir, "documents"), long_words=LONG_WORDS))


def _digested(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


LINES_SQL = """
WITH line AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), win AS (
  SELECT doc_id, i AS place, lines[i + 1] || chr(10) || lines[i + 2] AS body
  FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 1)) AS i FROM line)
), ranked AS (
  SELECT doc_id, place, row_number() OVER (PARTITION BY body ORDER BY doc_id, place) AS k FROM win
), gone AS (
  SELECT DISTINCT doc_id, place + d AS i FROM ranked, (VALUES (0), (1)) AS step(d) WHERE k > 1
), runs AS (
  SELECT g.doc_id, count(*) AS n_removed,
         sum(CASE WHEN p.i IS NULL THEN 1 ELSE 0 END) AS n_runs, list(g.i) AS gone
  FROM gone g LEFT JOIN gone p ON g.doc_id = p.doc_id AND g.i = p.i + 1 GROUP BY g.doc_id
), kept AS (
  SELECT e.doc_id, string_agg(e.body, chr(10) ORDER BY e.i) AS body
  FROM (SELECT doc_id, unnest(lines) AS body, unnest(range(0, len(lines))) AS i FROM line) e
  LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i WHERE g.i IS NULL GROUP BY e.doc_id
)
SELECT l.doc_id, CAST(len(l.lines) AS BIGINT) AS n_lines, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(r.n_runs, 0) AS BIGINT) AS n_runs, sha256(coalesce(k.body, '')) AS kept_sha256
FROM line l LEFT JOIN runs r ON l.doc_id = r.doc_id LEFT JOIN kept k ON l.doc_id = k.doc_id
"""

_GONE = "SELECT DISTINCT doc_id, place + d AS i FROM ranked, (VALUES (0), (1)) AS step(d) WHERE k > 1"

#: The rule of ``op3_long_lines``: LINES_SQL, and later occurrences of a long line.
LONG_LINES_SQL = LINES_SQL.replace(
    _GONE,
    _GONE
    + f""" UNION SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS k
    FROM (SELECT doc_id, unnest(lines) AS body, unnest(range(0, len(lines))) AS i FROM line)
    WHERE len(regexp_extract_all(body, '[^ \\t\\r]+')) >= {LONG_WORDS}) WHERE k > 1""",
)
