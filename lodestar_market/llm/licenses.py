"""License scans by diagonal voting, in DataFrame functions alone.

All rolling word k-grams of all texts are joined by hash to the positions they
have in license templates.  A hit of text position p and template position t
votes for the diagonal p - t.  Votes are counted per diagonal, diagonals that
are a few words apart are merged (inserted or missing words shift the offset),
and a span counts as verified if enough of the template's k-grams, compared
word by word, stand in it.  Short phrases are templates too: a phrase stands
at a place if and only if all of its k-grams vote for one diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ._shared import ASCII_LOWER, ASCII_UPPER, ascii_lower, table

GRAM = 3
#: Words by which neighbouring diagonals may differ and still be one span.
SLACK = 6
#: Share of a template's k-grams that a span must hold.
COVERAGE = 0.6
#: Template positions that one mask holds; longer templates have several.
MASK = 62
#: Copies of a row that are written from one array.
COPIES = 65_536
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Passages of public license notices, with the labels they stand for.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to "
        "the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
        "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability "
        "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
)


TEMPLATE = (("gram", "string"), ("template", "int"), ("label", "string"), ("base", "boolean"), ("at", "int"), ("grams", "int"))


def word_array(text: Column) -> Column:
    """The words of a text, in order; a null text has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), lambda w: w != "")


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES, k: int = GRAM) -> DataFrame:
    """gram, template, label, base, at, grams: one row per k-gram position.

    The table grows with the list of licenses only, never with the documents.
    A row with an empty gram stands for each document itself.
    """
    rows = [("", -1, None, False, 0, 0)]
    for number, (label, text, base) in enumerate([(label, text, True) for text, label in phrases] + [(label, text, False) for label, text in notices]):
        words = text.split()
        if len(words) < k:
            raise ValueError(f"a template needs {k} words: {text!r}")
        grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        rows += [(gram, number, label, base, i, len(grams)) for i, gram in enumerate(grams)]
    values = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, TEMPLATE, strict=True)]) for row in rows])
    return spark.range(1, numPartitions=1).select(F.inline(values))


def grams_of(docs: DataFrame, k: int = GRAM) -> DataFrame:
    """doc_id, twin, n_words, position, hash and gram: every rolling k-gram and, per row, an empty one.

    Explode and all after it up to the first counts is one generated loop; a
    gram's string is only built where its hash has met a template's.
    """
    # The row's own empty gram comes first: a gram's position is its index less one.
    words = docs.select("doc_id", F.xxhash64("text").alias("twin"), F.concat(F.array(F.lit("")), word_array(F.col("text"))).alias("w"))
    each = words.select("doc_id", "twin", "w", F.posexplode_outer("w").alias("index", "word"))
    gram = [F.col("word"), *[F.get("w", F.col("index") + d) for d in range(1, k)]]
    whole = (F.col("index") == 0) | (F.col("index") + k <= F.size("w"))
    return each.where(whole).select(
        "doc_id", "twin", (F.size("w") - 1).cast("long").alias("n_words"), (F.col("index") - 1).alias("position"),
        F.when(F.col("index") == 0, F.xxhash64(F.lit(""))).otherwise(F.xxhash64(*gram)).alias("hash"),
        F.when(F.col("index") == 0, F.lit("")).otherwise(F.concat_ws(" ", *gram)).alias("gram"),
    )


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, k: int = GRAM, slack: int = SLACK, coverage: float = COVERAGE) -> DataFrame:
    """One row per verified span: doc_id, twin, n_words, copies, label, base, first_word, last_word, share.

    Each document has one more row with label null, whose ``copies`` is the
    number of rows equal in doc_id and text; elsewhere it is null.  ``twin`` is
    a hash of the text.
    """
    spark = docs.sparkSession
    words = F.split("gram", " ")
    hashed = F.when(F.col("gram") == "", F.xxhash64(F.lit(""))).otherwise(F.xxhash64(*[F.get(words, F.lit(d)) for d in range(k)]))
    known = F.broadcast(templates(spark, phrases, notices, k).select(hashed.alias("template_hash"), F.col("gram").alias("template_gram"), "template", "label", "base", "at", "grams"))
    grams = grams_of(docs, k)
    # The hash finds template positions; equal grams verify them word by word.
    hits = grams.join(known, (F.col("hash") == F.col("template_hash")) & F.col("gram").eqNullSafe(F.col("template_gram")))
    diagonal = F.col("position") - F.col("at")
    votes = hits.groupBy("doc_id", "twin", "n_words", "template", "label", "base", "grams", diagonal.alias("diagonal"), F.expr(f"at div {MASK}").alias("part")).agg(
        # Each template position votes once: one bit of a mask, so repeated rows don't count twice.
        F.expr(f"bit_or(shiftleft(1L, at % {MASK}))").alias("mask"), F.min("position").alias("low"), F.max("position").alias("high"), F.count("*").alias("n")
    )
    per_row = ["doc_id", "twin", "n_words"]
    # Neighbouring diagonals of one template are merged: a new span begins where
    # the offset jumps.  Each place of a base phrase is a span of its own.
    along = W.Window.partitionBy("doc_id", "twin", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > F.when(F.col("base"), 0).otherwise(slack)
    spanned = votes.withColumn("span", F.sum(F.coalesce(apart.cast("int"), F.lit(1))).over(along))
    of_span = [*per_row, "template", "label", "base", "grams", "span"]
    parts = spanned.groupBy(*of_span, "part").agg(F.bit_count(F.bit_or("mask")).alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("n").alias("n"))
    spans = parts.groupBy(*of_span).agg(F.sum("votes").alias("votes"), F.min("low").alias("first_word"), (F.max("high") + k - 1).alias("last_word"), F.max("n").alias("n"))
    share = F.when(F.col("template") < 0, F.lit(0.0)).otherwise(F.col("votes") / F.greatest("grams", F.lit(1)))
    holds = (F.col("template") < 0) | F.when(F.col("base"), F.col("votes") == F.col("grams")).otherwise(F.col("share") >= coverage)
    return spans.withColumn("share", share).where(holds).select(*per_row, F.when(F.col("template") < 0, F.col("n")).alias("copies"), "label", "base", "first_word", "last_word", "share")


def licenses(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases, first_word and last_word are the
    smallest and largest start of one (null without any), score is the largest
    share of a template found (0 for none).  A null or empty text has no words
    and no labels.  Rows equal in doc_id and text are scanned together and come
    back as many times; a null doc_id is a value like others.  Extra columns
    are left out.
    """
    found = scan(docs, **options)
    base = F.col("base")
    each = (
        found.groupBy("doc_id", "twin")
        .agg(
            F.max("copies").alias("copies"),
            F.max("n_words").alias("n_words"),
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
            F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
            F.max("share").alias("score"),
        )
        .withColumn("block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
        .withColumn("copy", F.explode(F.expr(f"sequence(1L, least({COPIES}L, copies - block * {COPIES}))")))
    )
    return each.drop("twin", "copies", "block", "copy")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 1 over the whole of ``documents``."""
    return licenses(table(spark, sf_dir, "documents"))


def _template_values() -> str:
    rows = []
    for number, (label, text, base) in enumerate([(label, text, True) for text, label in PHRASES] + [(label, text, False) for label, text in NOTICES]):
        words = text.split()
        grams = [" ".join(words[i : i + GRAM]) for i in range(len(words) - GRAM + 1)]
        rows += [f"('{gram}', {number}, '{label}', {str(base).lower()}, {i}, {len(grams)})" for i, gram in enumerate(grams)]
    return ", ".join(rows)


LICENSE_SQL = rf"""
WITH template(gram, template, label, base, place, grams) AS (VALUES {_template_values()}),
word AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), gram AS (
  SELECT doc_id, i AS position, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS gram
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS i FROM word)
), vote AS (
  SELECT doc_id, template, label, base, grams, position - place AS diagonal, list(DISTINCT place) AS places, count(*) AS votes, min(position) AS low
  FROM gram JOIN template USING (gram) GROUP BY ALL
), base AS (
  SELECT doc_id, count(*) AS n_base, min(low) AS first_word, max(low) AS last_word,
         array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels, list(label) AS found
  FROM vote WHERE base AND votes = grams GROUP BY doc_id
), jump AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {SLACK} THEN 0 ELSE 1 END AS jump
  FROM vote WHERE NOT base
), span AS (
  SELECT *, sum(jump) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM jump
), notice AS (
  SELECT doc_id, label, len(list_distinct(flatten(list(places))))::DOUBLE / grams AS share
  FROM span GROUP BY doc_id, template, label, grams, span
), noticed AS (
  SELECT doc_id, list(label) AS found, max(share) AS share FROM notice WHERE share >= {COVERAGE} GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(b.n_base, 0) AS BIGINT) AS n_base,
       CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word, coalesce(b.base_labels, '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.found, []::VARCHAR[]), coalesce(n.found, []::VARCHAR[])))), ',') AS labels,
       CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(n.share, 0.0::DOUBLE) END AS score
FROM word w LEFT JOIN base b ON w.doc_id = b.doc_id LEFT JOIN noticed n ON w.doc_id = n.doc_id
"""
