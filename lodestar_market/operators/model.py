"""Sentiment by a fitted model: batches through one function that a worker loads once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

MOST_WORDS, BATCH = 256, 16


def stem_counts(text: Column, stems: Sequence[str], most_words: int = MOST_WORDS) -> Column:
    """How many of the first words contain each stem, as doubles."""
    kept = F.slice(F.split(F.lower(F.coalesce(text, F.lit(""))), " "), 1, most_words)

    def count(stem: str) -> Column:
        return F.size(F.filter(kept, lambda w: F.contains(w, F.lit(stem)))).cast("double")

    return F.array(*[count(stem) for stem in stems])


class LinearModel:
    """Log-odds of each class as a linear function of the counts."""

    def __init__(self, bias: np.ndarray, weights: np.ndarray):
        self.bias, self.weights = bias, weights

    def scorer(self):
        """``make_predict_fn`` for predict_batch_udf: what it returns is called with batches of counts."""
        bias, weights = self.bias, self.weights

        def load():
            def predict(counts: np.ndarray) -> np.ndarray:
                scores = counts @ weights.T + bias
                odds = np.exp(scores - scores.max(axis=1, keepdims=True))
                return odds / odds.sum(axis=1, keepdims=True)

            return predict

        return load


def fit(labelled: DataFrame, text: str, label: str, stems: Sequence[str]) -> LinearModel:
    """Multinomial naive Bayes on all labelled rows: two classes, 0 and 1."""
    rows = labelled.select(array_to_vector(stem_counts(F.col(text), stems)).alias("features"), F.col(label).cast("double").alias("label"))
    model = NaiveBayes(smoothing=1.0).fit(rows)
    return LinearModel(model.pi.toArray(), model.theta.toArray())


def model_sentiment(df: DataFrame, text: str, model: LinearModel, stems: Sequence[str], batch: int = BATCH) -> DataFrame:
    """Adds sentiment (positive where class 1 is likelier) and confidence (its probability, in percent)."""
    score = predict_batch_udf(model.scorer(), return_type=ArrayType(DoubleType()), batch_size=batch, input_tensor_shapes=[[len(stems)]])
    scored = df.withColumn("_p", score(stem_counts(F.col(text), stems)))
    positive = F.get("_p", F.lit(1)) >= F.get("_p", F.lit(0))
    return scored.withColumns({"sentiment": F.when(positive, "positive").otherwise("negative"), "confidence": F.array_max("_p") * 100}).drop("_p")
