"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

The lexicon is part of the classifier: word beginnings that mark toxic texts
are learned, with the trees, from a bounded sample of labelled rows.  Features
of all texts are computed in one pass without a shuffle; the trees and the
calibration are Spark ML models.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ._shared import cut, table

#: The classifier is fitted on at most so many labelled rows.
MAX_LABELLED = 20_000
#: Terms of the learned lexicon: a fixed bound, so it can travel with the tasks.
MAX_TERMS = 400
STEMS = (4, 5, 6)

SECOND_PERSON = ("you", "your", "yours", "you're", "ur", "du", "dich", "dein", "deine", "ihr", "tu", "toi", "vous", "votre", "tú", "usted", "ustedes", "eres")
NEAR = 60  # characters

FEATURES = (
    "lexicon_density", "lexicon_hits", "lexicon_distinct", "second_person_near", "second_person_density",
    "capitals", "exclamations", "punctuation", "digits_in_words", "obfuscated_hits", "repeated_marks", "log_words",
)

_WORD = re.compile(r"[^\W\d_]+")
_LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_DISGUISED = re.compile(r"(?<!\w)(?=\w*[0-9@$!*])[^\W_][\w@$!*.\-]{2,30}|(?<!\w)(?:\w[.\-*_]){3,20}\w(?!\w)")
_UPPER_ASCII = bytes(range(65, 91))
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_DIGIT_INSIDE = re.compile(r"[^\W\d_][0-9]+[^\W\d_]")
_MARKS = re.compile(r"[!?*#$%&]{2,}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(False))


class Matcher:
    """Finds lexicon terms at the start of words, and second-person words."""

    def __init__(self, terms: list[str]):
        self.automaton = ahocorasick.Automaton()
        for term in terms:
            self.automaton.add_word(term, (term, False))
        for word in SECOND_PERSON:
            if word not in terms:
                self.automaton.add_word(word, (word, True))
        if terms or SECOND_PERSON:
            self.automaton.make_automaton()

    def scan(self, lowered: str) -> tuple[list[int], list[int], set[str]]:
        hits, persons, distinct, n = [], [], set(), len(lowered)
        last = -1
        for end, (term, person) in self.automaton.iter(lowered):
            start = end - len(term) + 1
            if start and lowered[start - 1].isalpha():
                continue
            if person:
                if end + 1 == n or not lowered[end + 1].isalpha():
                    persons.append(start)
            else:
                distinct.add(term)
                if start != last:  # a longer stem of the same word isn't another hit
                    hits.append(start)
                    last = start
        return hits, persons, distinct


def dense_features(text: str | None, matcher: Matcher) -> list[float]:
    """The FEATURES of a text; all zero for a null or empty one."""
    text = text or ""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    lowered = text.lower()
    n, words = len(text), max(1, lowered.count(" ") + lowered.count("\n") + 1)
    hits, persons, distinct = matcher.scan(lowered)
    near = 0
    if hits and persons:
        at = np.searchsorted(persons, hits)
        marks = np.array([-(10**9), *persons, 10**9])
        gaps = np.minimum(np.abs(marks[at] - hits), np.abs(marks[at + 1] - hits))
        near = int((gaps <= NEAR).sum())
    disguised = 0
    for found in _DISGUISED.findall(lowered):
        plain = re.sub(r"[\W\d_]", "", found.translate(_LOOKALIKE))
        got, _, _ = matcher.scan(plain)
        if got and got[0] == 0 and not matcher.scan(found)[0]:
            disguised += 1
    letters = max(1, n)
    upper = len(raw) - len(raw.translate(None, _UPPER_ASCII))
    marks_n = len(raw) - len(raw.translate(None, _PUNCTUATION))
    return [
        100.0 * len(hits) / words, float(len(hits)), float(len(distinct)), 100.0 * near / words, 100.0 * len(persons) / words,
        upper / letters, 100.0 * raw.count(b"!") / letters, marks_n / letters, 100.0 * len(_DIGIT_INSIDE.findall(text)) / words, float(disguised),
        100.0 * len(_MARKS.findall(text)) / words, float(np.log1p(words)),
    ]


def with_features(rows: DataFrame, terms: list[str]) -> DataFrame:
    """row (as it is) and features (array of doubles) of rows with ``row``, which holds ``text``; no shuffle."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows_ = part.column("row")
                made = [dense_features(t, matcher) for t in pc.struct_field(rows_, "text").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows_, pa.array(made, pa.list_(pa.float64()))], names=["row", "features"])

    schema = StructType([rows.schema["row"], StructField("features", ArrayType(DoubleType()))])
    return rows.select("row").mapInArrow(compute, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text and toxic of at most about ``most`` rows that aren't held out.

    Rows are chosen by a hash of doc_id; the share follows from the count of labels.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = usable.count()
    share = min(1.0, most / max(1, count))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(share * 1_000_000)).limit(most + most // 4)
    # At most 1.25 * most rows of two numbers: small enough to send to every task.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def learn_lexicon(sample: DataFrame, most: int = MAX_TERMS) -> list[str]:
    """Word beginnings (4 to 6 letters) that mark toxic texts of the sample.

    A stem counts once a text.  Kept are stems that are at least twenty times
    likelier in toxic texts than elsewhere, and in so many of them that, of all
    stems together, chance would hardly give one; strongest first.
    """

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                stem, toxic = [], []
                for text, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    words = set(_WORD.findall((text or "").lower()))
                    found = {w[:k] for w in words for k in STEMS if len(w) >= k}
                    stem += found
                    toxic += [y] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(stem, pa.string()), pa.array(toxic, pa.int32())], names=["stem", "toxic"])

    per_class = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = per_class.get(1, 0), per_class.get(0, 0)
    if not bad or not good:
        return []
    counts = cut(sample.select("text", "toxic").mapInArrow(stems, "stem string, toxic int").groupBy("stem").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")))
    # A stem of k texts is in toxic ones alone by chance with probability share ** k.
    share = bad / (bad + good)
    needed = max(3.0, (math.log(max(1, counts.count())) + 2.0) / -math.log(share))
    ratio = ((F.col("bad") + 0.5) / bad) / ((F.col("good") + 0.5) / good)
    strong = counts.where(F.col("bad") >= needed).withColumn("ratio", ratio).where("ratio >= 20")
    top = strong.orderBy(F.desc(F.col("bad") * F.log("ratio")), "stem").limit(most).collect()
    kept: list[str] = []
    for row in top:  # a stem that another one already covers adds nothing
        if not any(row["stem"].startswith(k) for k in kept):
            kept.append(row["stem"])
    return kept


class Model:
    """A fitted lexicon, ensemble and calibration, or a constant score."""

    def __init__(self, terms: list[str], trees=None, calibration=None, constant: float = 0.0):
        self.terms, self.trees, self.calibration, self.constant = terms, trees, calibration, constant

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id and score (0 to 1) of each row, an empty or null text's too."""
        return self.scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("row.doc_id", "score")

    def scored(self, docs: DataFrame) -> DataFrame:
        """row (all columns of each row) and score."""
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        if self.trees is None:
            return rows.select("row", F.lit(float(self.constant)).alias("score"))
        raw = self.trees.transform(with_features(rows, self.terms).withColumn("features", array_to_vector("features")))
        margin = raw.select("row", vector_to_array("probability")[1].alias("margin"))
        return self.calibration.transform(margin).select("row", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "prediction")).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, rounds: int = 12, depth: int = 3) -> Model:
    """Fit on labelled rows of ``docs`` whose crc32(doc_id) mod 5 isn't 0.

    Of those, a quarter calibrates and the rest trains; where either part lacks
    a label, all rows do both.  Without rows of both labels there is nothing to
    tell apart, and the score is the constant share of toxic rows (0 without
    any).  Rows that repeat a labelled doc_id count each.  Labels, lang, source
    and doc_id are no inputs of a score.
    """
    sample = cut(labelled_sample(docs, labels, most))
    terms = learn_lexicon(sample)
    rows = with_features(sample.select(F.struct("doc_id", "toxic", "text").alias("row")), terms)
    rows = cut(rows.select("row.doc_id", F.col("row.toxic").cast("double").alias("label"), array_to_vector("features").alias("features")))
    calibrates = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(20)) >= 15
    counts = {(r["part"], r["label"]): r["n"] for r in rows.groupBy(calibrates.alias("part"), "label").agg(F.count("*").alias("n")).collect()}
    of = {label: sum(n for (_, y), n in counts.items() if y == label) for label in (0.0, 1.0)}
    if not of[0.0] or not of[1.0]:
        return Model(terms, constant=of[1.0] / max(1, sum(of.values())))
    trains, measures = (rows.where(~calibrates), rows.where(calibrates)) if len(counts) == 4 else (rows, rows)
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, maxBins=32, seed=7, featuresCol="features", labelCol="label").fit(trains.coalesce(4))
    margins = trees.transform(measures).select("label", vector_to_array("probability")[1].alias("margin"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label").fit(margins.coalesce(1))
    return Model(terms, trees, calibration)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 7: doc_id, held_out, score, predicted per document."""
    docs = table(spark, sf_dir, "documents")
    scored = fit(docs, table(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose own score is below the threshold: a filter, without a shuffle."""
    rows = fit(docs, labels).scored(docs)
    return rows.where(F.col("score") < threshold).select("row.*")
