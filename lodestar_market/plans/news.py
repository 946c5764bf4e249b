"""Queries on texts: validation, spam, slang, symbols, sentiment, mentions, rumours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import monitoring as M
from ..operators import report as R
from ..operators import text as T
from .tables import TEXTS, read, texts

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# The given texts are invented words in four languages: some stand for the lists.
LISTED = ("THE", "AND", "DER", "DES", "LES", "QUE", "LOS", "UND", "FOR", "WAS")
POSITIVE = ("tion", "enst", "reau", "heit", "ado")
NEGATIVE = ("ould", "ment", "schaft", "idad", "worthless")
SLANG = (("thea", "", 0.1), ("ouon", "", -0.2), ("einge", "", -0.3), ("quell", "", 0.2))
TOKENS = (("the", "article"), ("and", "conjunction"), ("article article", "pair"))
SPAM = ("password", "worthless", "idiot", "chlla")
PATTERNS = (r"[a-z]+@[a-z]+", r"\d{4,}", "lowei")
NOW = "TIMESTAMP '2024-01-03 00:00:00'"


def _now():
    return F.lit("2024-01-03 00:00:00").cast("timestamp")


def _count(text: str, terms) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({text}, '{t}') THEN 1 ELSE 0 END" for t in terms) + ")"


RULES = f"""{TEXTS}, counted AS (SELECT *, {_count("lower(text)", POSITIVE)} AS p, {_count("lower(text)", NEGATIVE)} AS n FROM texts), ruled AS (
  SELECT *, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS base_sentiment,
         round(CASE WHEN p = n THEN 0.5::DOUBLE ELSE least(greatest(p, n)::DOUBLE / (p + n + 1) + 0.3::DOUBLE, 0.9::DOUBLE) END, 4) AS base_confidence,
         round(p::DOUBLE / (p + n + 1), 4) AS score_positive, round(n::DOUBLE / (p + n + 1), 4) AS score_negative, round(1 - (p + n)::DOUBLE / (p + n + 1), 4) AS score_neutral FROM counted)"""

HITS = "list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z]{3}'))"
MENTIONED = TEXTS + f""", hit AS (SELECT doc_id, CAST(published_at AS DATE) AS day, source_type, unnest({HITS}) AS symbol FROM texts), per_source AS (
  SELECT day, symbol, source_type, CAST(sum(n) AS BIGINT) AS mentions, count(*) AS articles FROM (SELECT day, symbol, source_type, doc_id, count(*) AS n FROM hit GROUP BY ALL) GROUP BY ALL)"""


def dated(spark, d) -> DataFrame:
    return texts(spark, d).withColumn("day", F.to_date("published_at"))


def per_source(spark, d) -> DataFrame:
    return T.mentions(dated(spark, d), ["day", "symbol", "source_type"])


def ruled(spark, d) -> DataFrame:
    return T.rule_sentiment(texts(spark, d), "text", POSITIVE, NEGATIVE)


@query("t1_blanks", f"WITH {TEXTS} SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM texts")
def t1(spark, d):
    return texts(spark, d).select("doc_id", F.md5(T.normalise_blanks(F.col("text"))).alias("digest"))


_SLANG_SQL = "lower(text)"
for _term, _token in TOKENS:
    _SLANG_SQL = f"replace({_SLANG_SQL}, '{_term}', ' {_token} ')"


@query("t2_slang_tokens", f"WITH {TEXTS} SELECT doc_id, md5(trim(regexp_replace({_SLANG_SQL}, '\\s+', ' ', 'g'))) AS digest FROM texts")
def t2(spark, d):
    return texts(spark, d).select("doc_id", F.md5(T.replace_slang(F.col("text"), TOKENS)).alias("digest"))


@query("t3_special_characters", f"WITH {TEXTS} SELECT doc_id, md5(regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g')) AS digest FROM texts")
def t3(spark, d):
    return texts(spark, d).select("doc_id", F.md5(T.remove_special(F.col("text"))).alias("digest"))


def _symbols_sql(text: str, listed: bool) -> str:
    found = HITS.replace("(text,", f"({text},")
    wanted = f"list_filter({found}, lambda x: x IN ({', '.join(map(repr, LISTED))}))" if listed else found
    return f"WITH {TEXTS} SELECT doc_id, array_to_string(list_sort(list_distinct({wanted})), ',') AS symbols FROM texts"


def _symbols(mode: str):
    return lambda spark, d: texts(spark, d).select("doc_id", F.array_join(F.sort_array(T.symbols(F.col("text"), mode, LISTED)), ",").alias("symbols"))


query("t4_symbols_raw", _symbols_sql("text", False))(_symbols("raw"))
query("t4_symbols_listed", _symbols_sql("text", True))(_symbols("listed"))
query("t4_symbols_upper", _symbols_sql("replace(upper(text), 'ß', 'SS')", True))(_symbols("upper"))


@query("u3_distinct_symbols", f"WITH {TEXTS} SELECT doc_id, CAST(len(list_distinct({HITS})) AS INTEGER) AS n FROM texts")
def u3(spark, d):
    return texts(spark, d).select("doc_id", F.size(T.symbols(F.col("text"))).alias("n"))


_KEYWORDS = ", ".join(f"'{t}'" for t in (*POSITIVE, *NEGATIVE, *[s[0] for s in SLANG]))


@query("t5_keyword_hits", f"WITH {TEXTS} SELECT doc_id, array_to_string(list_filter([{_KEYWORDS}], lambda k: contains(lower(text), k)), ',') AS keywords FROM texts")
def t5(spark, d):
    return texts(spark, d).select("doc_id", F.array_join(T.keywords(F.col("text"), POSITIVE, NEGATIVE, SLANG), ",").alias("keywords"))


_SHIFT = " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN {m * 100} ELSE 0 END" for t, _, m in SLANG)
ADJUSTED = f"{RULES}, shifted AS (SELECT *, round(CAST({_SHIFT} + 5 * (p - n) AS DOUBLE), 6) AS adj FROM ruled)"


@query("t6_adjusted_sentiment", f"WITH {ADJUSTED} SELECT doc_id, CASE WHEN (adj < -20 AND base_sentiment = 'positive') OR (adj > 20 AND base_sentiment = 'negative') THEN 'neutral' ELSE base_sentiment END AS sentiment, round(greatest(0::DOUBLE, least(100::DOUBLE, base_confidence * 100 + adj)), 2) AS confidence FROM shifted")
def t6(spark, d):
    base = ruled(spark, d).withColumn("sure", F.col("base_confidence") * 100)
    return T.adjust_sentiment(base, "text", "base_sentiment", "sure", POSITIVE, NEGATIVE, SLANG).select("doc_id", "sentiment", "confidence")


@query("t7_rule_sentiment", f"WITH {RULES} SELECT doc_id, base_sentiment, base_confidence, score_positive, score_negative, score_neutral FROM ruled")
def t7(spark, d):
    return ruled(spark, d).select("doc_id", "base_sentiment", "base_confidence", "score_positive", "score_negative", "score_neutral")


@query("t9_content_hash", f"WITH {TEXTS} SELECT doc_id, md5(source || ':' || title || ':' || strftime(published_at, '%Y-%m-%d %H:%M:%S')) AS hash FROM texts")
def t9(spark, d):
    return texts(spark, d).select("doc_id", T.content_hash(F.col("source"), F.col("title"), F.col("published_at")).alias("hash"))


@query("t10_sentiment_result", f"WITH {ADJUSTED} SELECT doc_id, CASE WHEN (adj < -20 AND base_sentiment = 'positive') OR (adj > 20 AND base_sentiment = 'negative') THEN 'neutral' ELSE base_sentiment END AS sentiment, CAST(len(list_distinct({HITS})) AS INTEGER) AS symbols, CAST(len(list_filter([{_KEYWORDS}], lambda k: contains(lower(text), k))) AS INTEGER) AS keywords FROM shifted")
def t10(spark, d):
    base = ruled(spark, d).withColumn("sure", F.col("base_confidence") * 100)
    out = T.adjust_sentiment(base, "text", "base_sentiment", "sure", POSITIVE, NEGATIVE, SLANG)
    return out.select("doc_id", "sentiment", F.size(T.symbols(F.col("text"))).alias("symbols"), F.size(T.keywords(F.col("text"), POSITIVE, NEGATIVE, SLANG)).alias("keywords"))


FAULTS = f"title IS NULL OR trim(title) = '' OR length(title) NOT BETWEEN 10 AND 500 OR published_at > {NOW} OR published_at < {NOW} - INTERVAL 7 DAY"


@query("f5_article_schema", f"WITH {TEXTS} SELECT doc_id, ({FAULTS}) AS invalid FROM texts")
def f5(spark, d):
    faults = T.schema_faults(F.col("title"), F.lit("x"), F.col("published_at"), _now())
    return texts(spark, d).select("doc_id", (F.size(faults) > 0).alias("invalid"))


@query("f6_spam_keywords", f"WITH {TEXTS} SELECT doc_id, trim(text) = '' OR {_count('lower(text)', SPAM)} > 0 AS spam FROM texts")
def f6(spark, d):
    return texts(spark, d).select("doc_id", T.spam_keyword(F.col("text"), F.lit(None).cast("string"), SPAM).alias("spam"))


_PATTERN_SQL = " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in PATTERNS)


@query("f7_spam_patterns", f"WITH {TEXTS} SELECT doc_id, ({_PATTERN_SQL}) AS spam FROM texts")
def f7(spark, d):
    return texts(spark, d).select("doc_id", T.spam_pattern(F.col("text"), PATTERNS).alias("spam"))


STAGED = f"{TEXTS}, staged AS (SELECT doc_id, CASE WHEN {FAULTS} THEN 'schema' WHEN {_count('lower(text)', SPAM)} > 0 THEN 'keyword' WHEN {_PATTERN_SQL} THEN 'pattern' END AS stage FROM texts)"


def staged(spark, d) -> DataFrame:
    articles = texts(spark, d).select("doc_id", "title", F.col("text").alias("body"), F.lit("x").alias("link"), "published_at")
    return T.classify_spam(articles, _now(), SPAM, PATTERNS)


@query("f8_spam_stages", f"WITH {STAGED} SELECT doc_id, stage, stage IS NOT NULL AS is_spam FROM staged")
def f8(spark, d):
    return staged(spark, d).select("doc_id", "stage", "is_spam")


@query("a14_filter_quality", f"WITH {STAGED}, j AS (SELECT stage IN ('keyword', 'pattern') AND stage IS NOT NULL AS p, toxic = 1 OR quality = 0 AS t FROM staged JOIN labels USING (doc_id)), c AS (SELECT count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE NOT p AND t) AS fn, count(*) FILTER (WHERE NOT p AND NOT t) AS tn FROM j) SELECT *, round((tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 6) AS accuracy, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall FROM c")
def a14(spark, d):
    labels = read(spark, d, "labels").select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("t"))
    judged = staged(spark, d).join(labels, "doc_id").withColumn("p", F.coalesce(F.col("stage").isin("keyword", "pattern"), F.lit(False)))
    return M.quality(judged, "p", "t")


@query("u1_union_of_news_and_posts", f"WITH {TEXTS} SELECT kind, count(*) AS items FROM (SELECT source_type AS kind FROM texts UNION ALL SELECT 'chat' FROM conversations WHERE role = 'user') GROUP BY 1")
def u1(spark, d):
    chat = read(spark, d, "conversations").where("role = 'user'").select(F.lit("chat").alias("kind"), "text")
    both = texts(spark, d).select(F.col("source_type").alias("kind"), "text", "title").unionByName(chat, allowMissingColumns=True)
    return both.groupBy("kind").agg(F.count("*").alias("items"))


@query("u4_dedup_by_hash", f"WITH {TEXTS} SELECT md5(source || ':' || title || ':' || strftime(published_at, '%Y-%m-%d')) AS hash, min(doc_id) AS doc_id FROM texts GROUP BY 1")
def u4(spark, d):
    hashed = texts(spark, d).select("doc_id", T.content_hash(F.col("source"), F.col("title"), F.to_date("published_at")).alias("hash"))
    return T.keep_first(hashed, ["hash"], ["doc_id"]).select("hash", "doc_id")


@query("a1_mentions", f"WITH {MENTIONED} SELECT symbol, CAST(sum(mentions) AS BIGINT) AS mentions, CAST(sum(articles) AS BIGINT) AS articles FROM per_source GROUP BY 1")
def a1(spark, d):
    return T.mentions(texts(spark, d), ["symbol"])


@query("a2_mentions_per_article", f"WITH {MENTIONED} SELECT doc_id, symbol, count(*) AS n FROM hit GROUP BY ALL")
def a2(spark, d):
    return texts(spark, d).select("doc_id", F.explode(T.symbol_hits(F.col("text"))).alias("symbol")).groupBy("doc_id", "symbol").agg(F.count("*").alias("n"))


RATIOS = "count(*) AS articles_analyzed, round(avg(CASE WHEN base_sentiment = 'positive' THEN 1 ELSE 0 END), 4) AS positive_ratio, round(avg(CASE WHEN base_sentiment = 'negative' THEN 1 ELSE 0 END), 4) AS negative_ratio, round(avg(CASE WHEN base_sentiment = 'neutral' THEN 1 ELSE 0 END), 4) AS neutral_ratio, round(avg(score_positive - score_negative), 4) AS overall_score"


@query("a3_sentiment_aggregate", f"WITH {RULES}, hit AS (SELECT *, unnest(list_distinct({HITS})) AS symbol FROM ruled) SELECT symbol, {RATIOS} FROM hit GROUP BY 1")
def a3(spark, d):
    hits = ruled(spark, d).withColumn("symbol", F.explode(T.symbols(F.col("text"))))
    return T.aggregate_sentiment(hits, ["symbol"])


@query("a5_verified_symbols", f"WITH {MENTIONED} SELECT day, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS verified FROM hit WHERE source_type = 'official' GROUP BY 1")
def a5(spark, d):
    official = per_source(spark, d).where("source_type = 'official'")
    return official.groupBy("day").agg(F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("verified"))


@query("j1_listed_mentions", f"WITH {MENTIONED}, listed(symbol) AS (VALUES {', '.join(f'({s!r})' for s in LISTED)}) SELECT day, symbol, source_type, mentions FROM per_source SEMI JOIN listed USING (symbol)")
def j1(spark, d):
    listed = spark.createDataFrame([(s,) for s in LISTED], "symbol string")
    return per_source(spark, d).join(F.broadcast(listed), "symbol", "left_semi").select("day", "symbol", "source_type", "mentions")


RUMOURS = "rumour AS (SELECT day, symbol, CAST(sum(mentions) AS BIGINT) AS mentions FROM per_source GROUP BY ALL HAVING count(*) FILTER (WHERE source_type = 'official') = 0)"


@query("j3_rumours", f"WITH {MENTIONED}, {RUMOURS} SELECT day, symbol, mentions, CASE WHEN mentions >= 10 THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM rumour")
def j3(spark, d):
    return T.rumours(per_source(spark, d))


@query("u2_symbol_difference", f"WITH {MENTIONED} SELECT DISTINCT symbol FROM hit WHERE source_type = 'social' EXCEPT SELECT symbol FROM hit WHERE source_type = 'official'")
def u2(spark, d):
    m = per_source(spark, d)
    return m.where("source_type = 'social'").select("symbol").distinct().join(m.where("source_type = 'official'"), "symbol", "left_anti")


@query("k3_rumours_ranked", f"WITH {MENTIONED}, {RUMOURS} SELECT day, symbol, mentions, row_number() OVER (PARTITION BY day ORDER BY mentions DESC, symbol) AS rank FROM rumour QUALIFY rank <= 5")
def k3(spark, d):
    return R.top_per(T.rumours(per_source(spark, d)), ["day"], [F.desc("mentions"), "symbol"], 5).select("day", "symbol", "mentions", "rank")


HOT = "hot AS (SELECT day, symbol, CAST(sum(mentions) AS BIGINT) AS mentions, row_number() OVER (PARTITION BY day ORDER BY sum(mentions) DESC, symbol) AS rank FROM per_source GROUP BY day, symbol QUALIFY rank <= 10)"


def hot(spark, d) -> DataFrame:
    return R.top_per(T.mentions(dated(spark, d), ["day", "symbol"]), ["day"], [F.desc("mentions"), "symbol"], 10)


@query("k1_hot_symbols", f"WITH {MENTIONED}, {HOT} SELECT day, rank, symbol, mentions FROM hot")
def k1(spark, d):
    return hot(spark, d).select("day", "rank", "symbol", "mentions")


@query("j5_articles_of_symbols", f"WITH {TEXTS}, hit AS (SELECT doc_id, unnest(list_distinct({HITS})) AS symbol FROM texts), asked AS (SELECT DISTINCT upper(substr(c_mktsegment, 1, 3)) AS symbol FROM customer UNION VALUES ('THE'), ('AND')) SELECT symbol, doc_id FROM hit JOIN asked USING (symbol)")
def j5(spark, d):
    asked = read(spark, d, "customer").select(F.upper(F.substring("c_mktsegment", 1, 3)).alias("symbol")).union(spark.createDataFrame([("THE",), ("AND",)], "symbol string")).distinct()
    hits = texts(spark, d).select("doc_id", F.explode(T.symbols(F.col("text"))).alias("symbol"))
    return hits.join(F.broadcast(asked), "symbol").select("symbol", "doc_id")


def _ranked_articles(spark, d) -> DataFrame:
    hits = ruled(spark, d).select("doc_id", "base_sentiment", "score_positive", "score_negative", F.explode(T.symbols(F.col("text"))).alias("symbol"))
    return hits.withColumn("score", F.round(F.col("score_positive") - F.col("score_negative"), 4))


RANKED = f"{RULES}, hit AS (SELECT doc_id, base_sentiment, round(score_positive - score_negative, 4) AS score, unnest(list_distinct({HITS})) AS symbol FROM ruled)"


@query("k5_top_articles", f"WITH {RANKED} SELECT symbol, base_sentiment, doc_id, row_number() OVER (PARTITION BY symbol, base_sentiment ORDER BY abs(score) DESC, doc_id) AS rank FROM hit WHERE base_sentiment <> 'neutral' QUALIFY rank <= 3")
def k5(spark, d):
    some = _ranked_articles(spark, d).where("base_sentiment <> 'neutral'")
    return R.top_per(some, ["symbol", "base_sentiment"], [F.desc(F.abs("score")), "doc_id"], 3).select("symbol", "base_sentiment", "doc_id", "rank")


@query("k6_first_results", f"WITH {RANKED} SELECT symbol, doc_id, base_sentiment, row_number() OVER (PARTITION BY symbol ORDER BY doc_id) AS rank FROM hit QUALIFY rank <= 10")
def k6(spark, d):
    return R.top_per(_ranked_articles(spark, d), ["symbol"], ["doc_id"], 10).select("symbol", "doc_id", "base_sentiment", "rank")


