"""Phrase collocations against a plain count, on small and awkward inputs."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lodestar_market.llm import collocations as C
from tests.llm.awkward import AWKWARD

SCHEMA = "doc_id long, text string, lang string, rank int, phrase string, key long"


def plain(rows, least, longest, held_percent, first):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            held = any(100 * b >= held_percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items() if len(q) > len(p))
            if not held:
                score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 3))) for _ in range(25)] + ["A", "ÀB", "日本", "x\x00y", " "]
    rows = []
    for _ in range(120):
        body = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\x0b", ",", "\r\n"]) for _ in range(rng.randint(0, 60)))
        rows.append((body, rng.choice(["en", "en", "de", None, "und", ""])))
    return rows + [(t, "en") for t in AWKWARD] + [rows[0]] * 5


@pytest.mark.parametrize(("seed", "least", "longest", "first", "fill"), [(1, 10, 3, 2000, 0.25), (2, 4, 3, 7, 0.25), (3, 5, 4, 50, 0.25), (4, 10, 3, 2000, 0.0), (5, 3, 2, 20, 0.25), (6, 1, 3, 100, 0.0)])
def test_against_a_plain_count(spark, seed, least, longest, first, fill):
    """With fill 0 the candidates are joined instead of sieved."""
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, lang, 1, "p", 2) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    assert found(C.collocations(docs, least=least, longest=longest, first=first, fill=fill)) == plain(rows, least, longest, C.HELD_PERCENT, first)


def test_long_texts_are_cut_without_a_loss(spark):
    """A text of several slices, with and without ends of pieces, counts as one."""
    rng = random.Random(7)
    words = ["the", "quick", "brown", "fox", "jumps", "ß" * 40]
    one_piece = " ".join(rng.choices(words, k=300_000))
    pieces = "".join(w + rng.choice([" ", " ", ". ", "\n"]) for w in rng.choices(words, k=300_000))
    assert min(len(one_piece), len(pieces)) > C.SLICE
    rows = [(one_piece, "en"), (pieces, "en"), ("x" * (C.SLICE + 9) + " the quick", "en")]
    docs = spark.createDataFrame([(i, t, lang, 1, "p", 2) for i, (t, lang) in enumerate(rows)], SCHEMA)
    assert found(C.collocations(docs)) == plain(rows, 10, 3, 50, 2000)


def test_no_rows_and_empty_texts(spark):
    assert found(C.collocations(spark.createDataFrame([], SCHEMA))) == []
    assert found(C.collocations(spark.createDataFrame([(1, None, None, 1, "p", 2), (None, "", "en", 1, "p", 2)], SCHEMA))) == []


def test_scores_pass_64_bits(spark):
    """a * a * 1000000 of three hundred million occurrences doesn't fit into 64 bits; decimals hold it."""
    a = 300_000_000
    row = spark.range(1).selectExpr(f"{a}L AS a", f"{a + 1}L AS l", f"{a + 7}L AS r")
    got = row.selectExpr("(1000000 * cast(a as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) AS s").first()["s"]
    assert got == 1000000 * a * a // ((a + 1) * (a + 7))


def test_shards_are_mined_at_the_lowered_support(spark):
    """What no shard holds often enough is no candidate; what some shard does is one."""
    text = "alpha beta. " * 2
    docs = spark.createDataFrame([(text, "en", s) for s in range(C.SHARDS)] + [("gamma delta. " * 3, "en", 0)], "text string, lang string, shard int")
    keys = {r["key"] for r in C.locally_frequent(docs, range(1, 3), 3, 3).collect()}
    assert len(keys) == 3  # gamma, delta and the pair
    sieve = C.bit_set(docs.sparkSession.createDataFrame([(k,) for k in keys], "key long"))
    counted = {r["phrase"]: r["n"] for r in C.counted_phrases(docs, 3, sieve).groupBy("phrase").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert counted == {"": 22, "gamma": 3, "delta": 3, "gamma delta": 3}


def test_bit_set_misses_no_member(spark):
    keys = np.random.default_rng(3).integers(0, 1 << 62, 5000, dtype=np.int64)
    made = C.bit_set(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert made.has(keys.view(np.uint64)).all()
    others = np.random.default_rng(4).integers(0, 1 << 62, 5000, dtype=np.int64).view(np.uint64)
    assert made.has(others).mean() < 0.01


def test_sql_gives_the_same_rows(spark):
    directory = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{directory}/documents.parquet'")
    out = con.execute(C.COLLOCATIONS_SQL)
    names = [c[0] for c in out.description]
    want = sorted(tuple(r[names.index(c)] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in out.fetchall())
    assert found(C.op11_collocations(spark, directory)) == want


@pytest.mark.parametrize(("bits", "share"), [(1 << 10, 1.5), (1 << 26, 0.001)])
def test_full_sets_and_large_results_take_rounds(spark, monkeypatch, bits, share):
    """More candidates than a set holds, or more strings than the texts allow: several rounds, and phrases that are no candidates aren't written as strings."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    often = [" ".join(rng.choices(words, k=3)) for _ in range(40)]
    rows = [(". ".join([" ".join(rng.choices(words, k=80)), *rng.sample(often, 4)]), "en") for _ in range(200)]
    for name, value in (("SET_BITS", bits), ("LEAST_BITS", min(bits, 1 << 26)), ("TEXT_SHARE", share)):
        monkeypatch.setattr(C, name, value, raising=False)
    written, counted = [], C.counted_phrases
    monkeypatch.setattr(C, "counted_phrases", lambda *a, **b: written.append(counted(*a, **b)) or written[-1])
    docs = spark.createDataFrame([(i, t, lang, 1, "p", 2) for i, (t, lang) in enumerate(rows)], SCHEMA)
    assert found(C.collocations(docs)) == plain(rows, 10, 3, 50, 2000)
    assert len(written) > 1
    once = sum(df.where("size > 1").count() for df in written)
    assert once < 0.2 * sum(len(t.split()) for t, _ in rows)  # all pairs and triples would be twice as many as words
