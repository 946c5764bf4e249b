"""News and social text: validation, spam, slang, symbols, keywords, sentiment, mentions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wordlists as words
from .terms import term_hits, term_numbers, term_sum

SYMBOL = r"(?<![\p{L}\p{N}_])([A-Z]{3})(?![\p{L}\p{N}_])"


def normalise_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def replace_slang(text: Column, pairs: Sequence[tuple[str, str]] = words.SLANG_TOKENS) -> Column:
    """Lower-case, then replace each term in its order; a token may be hit by later terms."""
    out = F.lower(text)
    for term, token in pairs:
        out = F.replace(out, F.lit(term), F.lit(f" {token} "))
    return normalise_blanks(out)


def remove_special(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}\s]", " ")


def symbols(text: Column, mode: str = "raw", listed: Sequence[str] = words.VALID_SYMBOLS) -> Column:
    """Distinct symbols in order of appearance; modes raw, listed, upper (upper-cased, then listed)."""
    found = F.array_distinct(F.regexp_extract_all(F.upper(text) if mode == "upper" else text, F.lit(SYMBOL), 1))
    return found if mode == "raw" else F.array_intersect(found, F.array(*map(F.lit, listed)))


def symbol_hits(text: Column) -> Column:
    """All occurrences, repeats included."""
    return F.regexp_extract_all(text, F.lit(SYMBOL), 1)


#: More terms than this are looked up by one automaton; a few are quicker as single tests.
MANY = 100


def hits(text: Column, terms: Sequence[str]) -> Column:
    """Terms that the text contains, in list order."""
    if len(terms) > MANY:
        return F.coalesce(term_hits(text, terms), F.array().cast("array<string>"))
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def count_hits(text: Column, terms: Sequence[str]) -> Column:
    """How many terms the text contains: a sum of generated tests, no array."""
    if len(terms) > MANY:
        return F.coalesce(F.size(term_numbers(text, terms)), F.lit(0))
    return sum((F.when(F.contains(text, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))


def keywords(text: Column, positive=words.POSITIVE, negative=words.NEGATIVE, slang=words.SLANG) -> Column:
    return hits(F.lower(text), [*positive, *negative, *[s[0] for s in slang]])


def adjust_sentiment(df: DataFrame, text: str, label: str, sure: str, positive=words.POSITIVE, negative=words.NEGATIVE, slang=words.SLANG) -> DataFrame:
    """Shift a base sentiment by slang and keywords: adds adjustment, sentiment, confidence."""
    low = F.lower(F.col(text))
    weights = [(t, m * 100) for t, _, m in slang if m]
    if len(weights) + len(positive) + len(negative) > MANY:
        every = [*weights, *[(t, 5.0) for t in positive], *[(t, -5.0) for t in negative]]
        shift = F.coalesce(term_sum(low, every), F.lit(0.0))
    else:
        shift = sum((F.when(F.contains(low, F.lit(t)), w).otherwise(0.0) for t, w in weights), F.lit(0.0))
        shift = shift + 5.0 * (count_hits(low, positive) - count_hits(low, negative))
    out = df.withColumn("adjustment", F.round(shift, 6))
    flips = ((F.col("adjustment") < -20) & (F.col(label) == "positive")) | ((F.col("adjustment") > 20) & (F.col(label) == "negative"))
    moved = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(sure) + F.col("adjustment")))
    return out.withColumns({"sentiment": F.when(flips, "neutral").otherwise(F.col(label)), "confidence": F.bround(moved, 2)})


def rule_sentiment(df: DataFrame, text: str, positive=words.RULE_POSITIVE, negative=words.RULE_NEGATIVE) -> DataFrame:
    """Adds pos, neg, base_sentiment, base_confidence (0 to 1) and the three scores."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    p, n = F.col("pos"), F.col("neg")
    out = df.withColumns({"pos": count_hits(low, positive), "neg": count_hits(low, negative)})
    total = (p + n + 1).cast("double")
    return out.withColumns(
        {
            "base_sentiment": F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral"),
            "base_confidence": F.round(F.when(p == n, 0.5).otherwise(F.least(F.greatest(p, n) / total + 0.3, F.lit(0.9))), 4),
            "score_positive": F.round(p / total, 4),
            "score_negative": F.round(n / total, 4),
            "score_neutral": F.round(1 - (p + n) / total, 4),
        }
    )


def model_sentiment(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[tuple[float, float, float]]]], batch: int = 16, most_words: int = 256) -> DataFrame:
    """Adds model_sentiment and model_confidence (0 to 100) by an injected scorer.

    ``load`` runs once a worker and gives a function from texts to negative,
    neutral and positive logits.  It sees a text in pieces of ``most_words``
    words, whose logits are averaged; a text without words is one empty piece.
    """

    @F.pandas_udf("model_sentiment string, model_confidence double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np

        scorer = load()
        for series in batches:
            words_of = [(t or "").split() for t in series]
            counts = np.array([max(1, -(-len(w) // most_words)) for w in words_of], dtype=int)
            pieces = [" ".join(w[i * most_words : (i + 1) * most_words]) for w, n in zip(words_of, counts, strict=True) for i in range(n)]
            rows = [r for i in range(0, len(pieces), batch) for r in scorer(pieces[i : i + batch])]
            logits = np.array(rows, dtype=float).reshape(-1, 3)
            if len(logits):
                logits = np.add.reduceat(logits, np.cumsum(counts) - counts, axis=0) / counts[:, None]
            odds = np.exp(logits - logits.max(axis=1, keepdims=True)) if len(logits) else logits
            odds = odds / odds.sum(axis=1, keepdims=True) if len(logits) else odds
            best = odds.argmax(axis=1) if len(logits) else []
            yield pd.DataFrame({"model_sentiment": [("negative", "neutral", "positive")[i] for i in best], "model_confidence": [float(odds[r, i] * 100) for r, i in enumerate(best)]})

    return df.withColumn("_m", score(text)).select(*df.columns, "_m.*")


def spam_keyword(title: Column, description: Column, terms=words.SPAM_KEYWORDS) -> Column:
    """Whether the text holds a spam keyword; empty text is spam."""
    text = F.lower(F.concat_ws(" ", title, description))
    listed = F.size(term_numbers(text, terms)) > 0 if len(terms) > MANY else F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))
    return (F.trim(text) == "") | listed


def spam_pattern(text: Column, patterns=words.SPAM_PATTERNS) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(f"(?iu){p}")
    return out


def schema_faults(title: Column, link: Column, published: Column, now: Column) -> Column:
    """Reasons for which an article is invalid."""
    return F.array_compact(
        F.array(
            F.when(title.isNull() | (F.trim(title) == ""), "no title"),
            F.when(link.isNull() | (F.trim(link) == ""), "no link"),
            F.when(~F.length(title).between(10, 500), "title length"),
            F.when(published > now, "in the future"),
            F.when(published < now - F.expr("interval 7 days"), "too old"),
        )
    )


def classify_spam(df: DataFrame, now: Column, terms=words.SPAM_KEYWORDS, patterns=words.SPAM_PATTERNS) -> DataFrame:
    """Adds is_spam and stage (schema, keyword, pattern): the first that fails."""
    text = F.concat_ws(" ", "title", "body")
    bad = F.size(schema_faults(F.col("title"), F.col("link"), F.col("published_at"), now)) > 0
    stage = F.when(bad, "schema").when(spam_keyword(F.col("title"), F.col("body"), terms), "keyword").when(spam_pattern(text, patterns), "pattern")
    return df.withColumn("stage", stage).withColumn("is_spam", F.col("stage").isNotNull())


def content_hash(source: Column, title: Column, published: Column) -> Column:
    return F.md5(F.concat_ws(":", source, title, published.cast("string")))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n") == 1).drop("_n")


def mentions(df: DataFrame, by: list[str]) -> DataFrame:
    """mentions (by occurrence) and articles (by document) per group; needs doc_id and text."""
    each = df.select(*[c for c in by if c != "symbol"], "doc_id", F.explode(symbol_hits(F.col("text"))).alias("symbol"))
    per_doc = each.groupBy(*by, "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy(*by).agg(F.sum("n").alias("mentions"), F.count("*").alias("articles"))


def aggregate_sentiment(df: DataFrame, by: list[str]) -> DataFrame:
    share = lambda label: F.round(F.avg(F.when(F.col("base_sentiment") == label, 1.0).otherwise(0.0)), 4)
    return df.groupBy(*by).agg(
        F.count("*").alias("articles_analyzed"),
        share("positive").alias("positive_ratio"), share("negative").alias("negative_ratio"), share("neutral").alias("neutral_ratio"),
        F.round(F.avg(F.col("score_positive") - F.col("score_negative")), 4).alias("overall_score"),
    )


def rumours(per_source: DataFrame, high: int = 10) -> DataFrame:
    """Symbols mentioned in social but never in official text, per group, in one pass.

    Needs symbol, source_type, mentions and the grouping columns.
    """
    by = [c for c in per_source.columns if c not in ("source_type", "mentions", "articles")]
    official = F.sum(F.when(F.col("source_type") == "official", F.col("mentions")).otherwise(0))
    social = F.sum(F.when(F.col("source_type") == "social", F.col("mentions")).otherwise(0))
    both = per_source.groupBy(*by).agg(official.alias("official"), social.alias("mentions"))
    return both.where("official = 0 AND mentions > 0").drop("official").withColumn("risk", F.when(F.col("mentions") >= high, "HIGH").otherwise("MEDIUM"))
