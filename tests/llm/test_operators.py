"""The corpus operators against brute force, on small and awkward inputs."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from lodestar_market.llm import _shared, ann, byte_pairs, decontamination, licenses, lines, near_duplicates, sharding, suffixes, token_shards, toxicity
from tests.llm.awkward import AWKWARD

DIR = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", None, None) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def corpus(seed: int, n: int = 60) -> list[str]:
    """Texts with copies, near copies and shared passages."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéü", k=rng.randint(1, 8))) for _ in range(300)]
    passage = " ".join(rng.choices(words, k=40))
    texts: list[str] = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.35:
            old = rng.choice(texts).split(" ")
            old[rng.randrange(len(old))] = rng.choice(words)
            texts.append(" ".join(old))
        else:
            body = rng.choices(words, k=rng.randint(0, 150))
            if rng.random() < 0.3:
                body.insert(rng.randrange(len(body) + 1), passage)
            texts.append(re.sub(r" (\w{7,}) ", r"\n\1 ", " ".join(body)))
    return texts


# -- 1 -----------------------------------------------------------------------


def base_places(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = []
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return len(words), sorted(found)


def test_licenses_against_brute_force(spark):
    texts = [*AWKWARD, "mit " + licenses.NOTICES[0][1], "x " + licenses.NOTICES[3][1].replace("and use", "or any use") + " y", "the mit license under the mit license under the mit license"]
    got = {r["doc_id"]: r for r in licenses.licenses(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n, places = base_places(text)
        row = got[i]
        assert (row["n_words"], row["n_base"]) == (n, len(places)), text
        assert row["first_word"] == (places[0][0] if places else None)
        assert row["last_word"] == (places[-1][0] if places else None)
        assert row["base_labels"] == ",".join(sorted({p[1] for p in places}))
        assert 0 <= row["score"] <= 1
    assert got[len(AWKWARD)]["labels"] == "mit"
    assert got[len(AWKWARD) + 1]["labels"] == "bsd"


def test_licenses_of_whole_notices_and_repeated_rows(spark):
    """A notice longer than a mask is scanned whole; rows that repeat come back each."""
    whole = next(text for label, text in licenses.NOTICES if label == "bsd" and len(text.split()) > 200).split()
    most, half = " ".join(whole), " ".join(whole[70:170])
    docs = docs_of(spark, [most, half, "nothing of it", "nothing of it", "nothing of it", most], [1, 2, 3, 3, None, 1])
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["labels"], round(r["score"], 3)) for r in licenses.licenses(docs).collect())
    n = len(whole)
    assert got == [(-1, 3, "", 0.0), (1, n, "bsd", 1.0), (1, n, "bsd", 1.0), (2, 100, "", 0.0), (3, 3, "", 0.0), (3, 3, "", 0.0)]
    share = (n - 60 - 2) / (n - 2)  # the first 60 words are missing, so their 3-grams are too
    only = licenses.licenses(docs_of(spark, ["x " * 7 + " ".join(whole[60:])]), notices=(("whole", most),)).first()
    assert only["labels"] == "whole" and only["score"] == pytest.approx(share)


def test_licenses_by_sql_on_whole_notices(spark):
    """The SQL agrees where masks have several parts."""
    texts = [t for _, t in licenses.NOTICES] + [" ".join(t.split()[5:]) for _, t in licenses.NOTICES] + [t.replace(" the ", " any of the ") for _, t in licenses.NOTICES]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = sorted(map(tuple, con.execute(licenses.LICENSE_SQL).fetchall()), key=repr)
    assert sorted(map(tuple, licenses.licenses(docs_of(spark, texts)).collect()), key=repr) == want


def duck(sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    return sorted(map(tuple, con.execute(sql).fetchall()), key=repr)


@pytest.mark.parametrize(("query", "sql"), [(licenses.op1_licenses, licenses.LICENSE_SQL), (lines.op3_lines, lines.LINES_SQL)])
def test_sql_gives_the_same_rows(spark, query, sql):
    assert sorted(map(tuple, query(spark, DIR).collect()), key=repr) == duck(sql)


# -- 2 -----------------------------------------------------------------------


def plain_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("shard", [near_duplicates.SHARD, 3])
def test_simhash_against_brute_force(spark, shard, monkeypatch):
    texts = AWKWARD + corpus(5, 90)
    prints = [plain_simhash(t) for t in texts]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, plain_components(prints), strict=True))}
    # Links alone, with trees small enough that a block has several.
    rng = random.Random(1)
    core = rng.getrandbits(64)
    values = sorted({core ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    nodes = spark.createDataFrame(signed, "fingerprint long")
    found = {frozenset((r["a"] % 2**64, r["b"] % 2**64)) for r in near_duplicates.links(nodes, shard=shard).collect()}
    assert found == {frozenset((a, b)) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["root"] for r in near_duplicates.components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def _shingles_of(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("batch", [near_duplicates.BATCH_BYTES, 3000])
def test_similar_pairs_group_as_brute_force(spark, monkeypatch, batch):
    """In batches of a few rows too, where heads and their members fall into different ones."""
    monkeypatch.setattr(near_duplicates, "BATCH_BYTES", batch)
    """Single copies and a large group: the pairs found connect what all pairs at 0.8 connect."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    base = [[word() for _ in range(draw.randint(3, 120))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for i in range(200):  # near copies, some just above and some just below 0.8
        b = list(base[i % 40])
        for _ in range(draw.randint(0, max(1, len(b) // 40))):
            b[draw.randrange(len(b))] = word()
        texts.append(" ".join(b))
    core = [word() for _ in range(150)]
    for _ in range(300):
        c = list(core)
        c[draw.randrange(150)] = word()
        texts.append(" ".join(c))
    texts += ["", None, texts[0], "  "]
    sets = [_shingles_of(t) for t in texts]

    def groups(pairs):
        root = list(range(len(texts)))

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = sorted((top(a), top(b)))
            root[b] = a
        return [top(x) for x in range(len(texts))]

    alike = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    docs = docs_of(spark, texts)
    found = [(r["a"], r["b"]) for r in near_duplicates.similar_pairs(docs).collect()]
    assert {(min(p), max(p)) for p in found} <= {(min(p), max(p)) for p in alike}
    assert len(found) < 24 * len(texts)
    same = [(i, texts.index(t)) for i, t in enumerate(texts) if t]
    wanted = groups(alike + same)
    assert groups(found + same) == wanted
    prints = [near_duplicates.simhash(t) for t in texts]  # what stays is one of each group of either kind
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    kept = sorted(r["doc_id"] for r in near_duplicates.keep_one(docs).collect())
    assert kept == sorted(set(groups(alike + same + linked)))


def test_similar_pairs_in_a_crowd(spark):
    """A crowd that shares a passage (0.74 to each other) with pairs at 0.83 in it: every such pair is found."""
    core = [f"core{i}" for i in range(124)]
    texts = [" ".join([*core, *(f"own{t}x{i}" for i in range(21))]) for t in range(2000)]
    planted = []
    for p in range(100):
        common = [f"pair{p}x{i}" for i in range(8)]
        planted.append((len(texts), len(texts) + 1))
        texts += [" ".join([*core, *common, *(f"side{p}{side}x{i}" for i in range(13))]) for side in "ab"]
    a, b, other = (_shingles_of(texts[i]) for i in (2000, 2001, 0))
    assert len(a & b) / len(a | b) > 0.82
    assert 0.73 < len(a & other) / len(a | other) < 0.76
    draw = list(range(len(texts)))
    random.Random(5).shuffle(draw)
    docs = docs_of(spark, texts, draw)
    found = {(r["a"], r["b"]) for r in near_duplicates.similar_pairs(docs).collect()}
    assert found == {tuple(sorted((draw[x], draw[y]))) for x, y in planted}


def test_keep_one_and_nulls(spark):
    docs = docs_of(spark, ["a b c d", "a b c d", None, "", "q r s", "q r s"], [4, 2, 7, None, None, None])
    kept = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in near_duplicates.keep_one(docs).collect())
    # A null text is an empty one; rows equal in doc_id and text are one document.
    assert kept == [(-1, "q r s"), (-1, "q r s"), (2, "a b c d"), (7, None)]


def test_keep_one_with_repeated_ids(spark):
    """Rows are documents by doc_id and text, so no copy is left out for its doc_id."""
    a, b, c = ("a b c d e f", "p q r s t u", "k l m n o p")
    docs = docs_of(spark, [a, a, b, c, c, c], [1, 2, 2, 3, 3, 4])
    kept = sorted((r["doc_id"], r["text"]) for r in near_duplicates.keep_one(docs).collect())
    assert kept == [(1, a), (2, b), (3, c), (3, c)]
    t, u = "one two three four five six seven", "another text with other words in it"
    five = docs_of(spark, [t, u, t, t, t], [1, 1, 2, None, None])
    assert sorted((r["doc_id"], r["text"]) for r in near_duplicates.keep_one(five).collect()) == [(1, u), (1, t)]
    assert sorted(near_duplicates.keep_one(five.withColumnsRenamed({"lang": "doc", "source": "node", "n_chars": "row"})).columns) == sorted(["doc_id", "text", "doc", "node", "row"])


# -- 3 -----------------------------------------------------------------------


def plain_lines(texts, run):
    seen, gone = set(), [set() for _ in texts]
    for d, text in enumerate(texts):
        rows = [] if text is None else text.split("\n")
        for i in range(len(rows) - run + 1):
            key = tuple(rows[i : i + run])
            if key in seen:
                gone[d] |= set(range(i, i + run))
            seen.add(key)
    return gone


@pytest.mark.parametrize("run", [1, 2, 3])
def test_lines_against_brute_force(spark, run):
    rng = random.Random(run)
    texts = [*AWKWARD, *("\n".join(rng.choices("abcd", k=rng.randint(0, 9))) for _ in range(40))]
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs_of(spark, texts), run).collect()}
    assert len(got) == len(texts)
    for d, (text, gone) in enumerate(zip(texts, plain_lines(texts, run), strict=True)):
        rows = (text or "").split("\n")
        kept = "\n".join(line for i, line in enumerate(rows) if i not in gone) if gone else text
        assert (got[d]["kept_text"], got[d]["n_lines"], got[d]["n_removed"]) == (kept, len(rows), len(gone))
        assert got[d]["n_runs"] == len([i for i in gone if i - 1 not in gone])


def test_long_lines_go_alone(spark):
    """A long line goes wherever it stood earlier, between other neighbours or as the only line; a short one stays."""
    long, short = " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49))
    texts = [f"a\n{long}\nb", f"c\n{long}\nd", long, f"{short}\ne", f"f\n{short}", f"g\n{long}\n{long}", f"a\n{long}\nh"]
    want = [texts[0], "c\nd", "", texts[3], texts[4], "g", "h"]
    got = {r["doc_id"]: r["kept_text"] for r in lines.dedup_lines(docs_of(spark, texts), long_words=50).collect()}
    assert [got[i] for i in range(len(texts))] == want
    left = docs_of(spark, [long, f"x\n{long}"])
    assert sorted(r["text"] for r in corpus_pipeline.line_dedup(spark, left, DIR).collect()) == sorted([long, "x"])


def test_lines_of_rows_that_repeat_an_id(spark):
    """Text that stands nowhere else stays, whatever doc_ids repeat or are missing."""
    a, b = "\n".join(f"a{i}" for i in range(6)), "\n".join(f"b{i}" for i in range(6))
    docs = docs_of(spark, [a, a, b, b, a + "\nx", "x\n" + b], [1, 2, 2, None, 3, None])
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["text"], r["kept_text"]) for r in lines.dedup_lines(docs).collect())
    assert [(i, k) for i, t, k in got if t == a] == [(1, a), (2, "")]
    assert [(i, k) for i, t, k in got if t == b and i == 2] == [(2, "")]  # the rows without an id come first
    assert sorted(k for i, t, k in got if i == -1) in (sorted([b, "x"]), sorted(["", "x\n" + b]))
    assert [k for i, t, k in got if i == 3] == ["x"]
    alone = docs_of(spark, [a, b], [7, 7])
    assert sorted(r["kept_text"] for r in lines.dedup_lines(alone).collect()) == [a, b]


def test_fingerprints_are_window_minima(spark):
    """Every window of a text holds a selected line, and fewer lines than there are get selected."""
    text = "\n".join(f"line {i * i % 97}" for i in range(60))
    rows = lines.fingerprints(docs_of(spark, [text]), 4).collect()
    assert len(rows) < 40 and all(len(r["windows"]) == 2 * (r["high"] - r["low"] - 2) for r in rows)
    assert {s for r in rows for s in range(r["low"], r["high"] - 2)} == set(range(57))


def test_line_stage_and_clashing_names(spark):
    from pyspark.sql import functions as F

    docs = docs_of(spark, ["a\nb", "a\nb\nc"]).drop("n_chars").withColumns({c: F.lit(77) for c in ("n_lines", "kept_text", "runs", "row", "doc", "out")})
    got = corpus_pipeline.line_dedup(spark, docs, DIR)
    assert got.columns == docs.columns
    assert sorted((r["text"], r["n_lines"], r["row"]) for r in got.collect()) == [("a\nb", 77, 77), ("c", 77, 77)]


def test_line_joins_shuffle_at_any_size(spark, tmp_path):
    """The texts, and the rows of keys that aren't hot, are joined in one way, however small the other table is."""

    def joins(df):
        return Counter(re.findall(r"SortMergeJoin|BroadcastHashJoin", df._jdf.queryExecution().executedPlan().toString()))

    assert joins(lines.dedup_lines(docs_of(spark, ["a\nb", "a\nb", "c"]))) == {"SortMergeJoin": 1}
    rows = spark.range(3000).selectExpr("id % 2000 as k", "id").union(spark.range(3000, 3100).selectExpr("20L as k", "id"))
    rows.write.parquet(f"{tmp_path}/left")
    left = spark.read.parquet(f"{tmp_path}/left")
    left.groupBy("k").count().where("k > 10").withColumnRenamed("count", "n").write.parquet(f"{tmp_path}/right")
    joined = _shared.join_counted(left, spark.read.parquet(f"{tmp_path}/right"), ["k"])
    assert joins(joined) == {"SortMergeJoin": 1, "BroadcastHashJoin": 2}  # the hot key (20) is sent to the rows
    assert sorted(r["id"] for r in joined.collect()) == [*(i for i in range(3000) if i % 2000 > 10), *range(3000, 3100)]


def test_long_lines_by_sql(spark):
    assert sorted(map(tuple, lines.op3_long_lines(spark, DIR).collect()), key=repr) == duck(lines.LONG_LINES_SQL)


# -- 4 -----------------------------------------------------------------------


def test_ann_recall_and_exclusions(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[100:160] = x[20]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [None] + [1.0] * 15), (9080, [float("inf")] * 16)]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), share=0.7, least=200, block_rows=100).toPandas()
    assert set(found["query_id"]) == set(range(0, 3000, 20))
    assert (found.groupby("query_id")["rank"].apply(list).apply(lambda r: r == list(range(1, 21)))).all()
    assert ann.recall(found, np.arange(3000), x.astype(np.float64)) >= 0.9


def test_ann_takes_the_least_vector_of_an_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [2.0, 5.0]), (1, [2.0, 5.0]), (2, [1.0, 1.0])]
    for parts in (1, 5):
        found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)).collect()
        assert [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 2.0), (2, 1.0)]


def test_ann_ties_go_to_the_smaller_id(spark):
    x = np.random.default_rng(4).standard_normal((400, 16))
    x[20] *= 3  # longer than the others, so its copies are its nearest
    x[100:160] = x[20]
    found = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas()
    assert found[found["query_id"] == 20].sort_values("rank")["vec_id"].tolist() == list(range(100, 120))


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_ann_recall_on_the_given_tables(spark, size):
    """The registered query at its own settings, against brute force over all vectors."""
    table = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    found = ann.op4_hash_prefix_forest(spark, f"/root/testdata/{size}").toPandas()
    ids, vectors = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(np.float64)
    assert set(found["query_id"]) == {int(i) for i in ids if i % 20 == 0}
    place = {int(i): n for n, i in enumerate(ids)}
    exact = np.einsum("ij,ij->i", vectors[[place[i] for i in found["query_id"]]], vectors[[place[i] for i in found["vec_id"]]])
    assert np.allclose(found["score"], exact, rtol=0, atol=1e-12)
    assert ann.recall(found, ids, vectors) >= 0.9


def test_ann_of_nothing_and_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], schema)).toPandas()
    assert few[["query_id", "rank", "vec_id", "score"]].values.tolist() == [[0, 1, 1, 0.5], [0, 2, 2, -1.0]]


def test_ann_searches_every_length(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0, 2.0, 3.0]), (21, [0.0, 1.0, 0.0]), (40, [7.0])]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in found) == [(0, 1, 0.5), (20, 21, 2.0)]


# -- 5 -----------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation_is_one_to_one_and_inverts(size):
    slots = token_shards.permute(np.arange(size), size)
    assert sorted(slots) == list(range(size))
    assert (token_shards.permute(slots, size, inverse=True) == np.arange(size)).all()


def test_token_shards_hold_every_text(spark, tmp_path):
    texts = [*AWKWARD, *corpus(9, 20)]
    folder = f"file://{tmp_path}/shards"
    index = token_shards.write_shards(docs_of(spark, texts), RANKS, public_tokenizers.PATTERN, folder, stride=16, shard_sequences=32)
    rows = sorted(index.collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    files = sorted(p for p in (tmp_path / "shards").iterdir() if p.name.startswith("shard-"))
    assert len(files) == -(-len(rows) // 32) and all(len(f.name) == len(files[0].name) for f in files)
    assert {f.stat().st_size for f in files[:-1]} == {32 * 32}
    enc = reference_encoder()
    found = {}
    for r in rows:
        raw = files[r["shard"]].read_bytes()[r["byte_offset"] : r["byte_offset"] + 32]
        assert r["byte_offset"] == r["slot"] % 32 * 32 and hashlib.sha256(raw).hexdigest() == r["tokens_sha256"]
        ids = np.frombuffer(raw, "<u2").tolist()
        assert set(ids[r["n_tokens"] :]) <= {token_shards.END}
        found.setdefault(r["doc_id"], []).append((r["part"], ids[: r["n_tokens"]]))
    for d, text in enumerate(texts):
        assert [i for _, ids in sorted(found[d]) for i in ids] == [*enc.encode_ordinary(text or ""), token_shards.END]
    later = sorted(token_shards.read_from(spark, folder, 40, 30).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in later] == list(range(40, 70))
    assert all(hashlib.sha256(r["tokens"]).hexdigest() == rows[r["slot"]]["tokens_sha256"] for r in later)
    assert token_shards.read_from(spark, folder).count() == len(rows)
    assert token_shards.read_from(spark, folder, len(rows)).count() == 0


def test_library_codec_equals_the_library():
    enc = reference_encoder()
    rng = random.Random(5)
    coder = byte_pairs.LibraryCodec.of(RANKS, public_tokenizers.PATTERN)
    bits = ["a", "word", " ", " ", "  ", "\n", " \n", "\t", "\u00a0", "\u3000", "1234", ".", ",\n\n", "don't", "\u65e5\u672c", "\x00", "\U0001f600", "e\u0301"]
    texts = [*(t for t in AWKWARD if t), *corpus(12, 20), *("".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(20_000))]
    for text in texts:
        assert coder.ids(text).tolist() == enc.encode_ordinary(text), repr(text)


def test_library_codec_takes_blocks_once(monkeypatch):
    """Every character goes to the library once, in blocks of bounded size, by the quicker pattern unless blanks stand in a row."""

    class Listening:
        def __init__(self, encoding, said):
            self.encoding, self.said = encoding, said

        def encode_ordinary(self, text):
            self.said.append(text)
            return self.encoding.encode_ordinary(text)

    enc = reference_encoder()
    coder = byte_pairs.LibraryCodec(byte_pairs.Codec.load(RANKS, public_tokenizers.PATTERN).ranks, public_tokenizers.PATTERN)
    careful, quick = [], []
    monkeypatch.setattr(coder, "encoding", Listening(coder.encoding, careful))
    monkeypatch.setattr(coder, "plain", Listening(coder.plain, quick))
    monkeypatch.setattr(byte_pairs, "BLOCK", 500)
    text = " ".join(random.Random(3).choices(["one", "two,", "three\nfour", "f\u00efve\u3000", "it's"], k=2000))
    assert coder.ids(text).tolist() == enc.encode_ordinary(text)
    assert "".join(sorted(careful + quick, key=text.index)) == text
    assert max(map(len, careful + quick)) < 530 and all(re.search(r"\s\s", t) for t in careful) and quick == [t for t in quick if not re.search(r"\s\s", t)]
    plain = text.replace("\u3000", "")
    careful.clear()
    quick.clear()
    assert coder.ids(plain).tolist() == enc.encode_ordinary(plain) and not careful and "".join(quick) == plain
    assert coder.ids("").tolist() == []


def test_token_shards_do_not_depend_on_the_partitioning(spark, tmp_path):
    texts = [*AWKWARD, *corpus(10, 20), "same", "same", "other", None]
    ids = [*range(len(texts) - 4), 5, 5, 5, None]
    docs = docs_of(spark, texts, ids)
    written = []
    for n in (1, 3, 7):
        folder = tmp_path / str(n)
        index = token_shards.write_shards(docs.repartition(n), RANKS, public_tokenizers.PATTERN, str(folder), stride=16, shard_sequences=64, waves=n)
        assert not (folder / "sequences").exists()
        written.append((sorted(map(tuple, index.collect())), [f.read_bytes() for f in sorted(folder.glob("shard-*.bin"))]))
    assert written[0] == written[1] == written[2]


def test_token_shards_refuse_ids_that_do_not_fit(spark, tmp_path):
    ranks = tmp_path / "wide.tiktoken"
    lines_ = [base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)]
    ranks.write_bytes(b"\n".join([*lines_, base64.b64encode(b"ab") + b" 70000"]) + b"\n")
    with pytest.raises(Exception, match="ranks must stay below"):
        token_shards.write_shards(docs_of(spark, ["ab"]), str(ranks), public_tokenizers.PATTERN, str(tmp_path / "shards"))


# -- 6 -----------------------------------------------------------------------


def test_sharding_is_even_and_keeps_groups(spark):
    texts = [*AWKWARD, *(f"text {i // 5}" for i in range(400)), *["hot"] * 150]
    got = sharding.assign_shards(docs_of(spark, texts), 8).collect()
    assert len(got) == len(texts)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    for shard in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sizes[shard]))
    shards: dict = {}
    for r in got:
        text = texts[r["doc_id"]]
        shards.setdefault(text, set()).add(r["shard"])
        assert r["size"] == len((text or "").encode()) + 1
    split = [t for t, s in shards.items() if len(s) > 1]
    assert len(split) <= 8
    assert sharding.assign_shards(docs_of(spark, []), 8).count() == 0
    assert sorted(r["slot"] for r in sharding.assign_shards(docs_of(spark, ["a", "a", None]), 8).collect()) == [0, 0, 0]


def sharded_edges(spark, docs, rounds):
    out = sharding.assign_shards(docs, 8, rounds).join(docs.select("doc_id", "text"), "doc_id")
    return sharding.cut_links(out, "text")


def test_propagation_cuts_fewer_links_than_no_rounds(spark):
    texts = [f"text {i % 700}" for i in range(3000)] + ["hot"] * 900 + [f"single {i}" for i in range(600)]
    docs = docs_of(spark, texts)
    none, some = sharded_edges(spark, docs, 0), sharded_edges(spark, docs, sharding.ROUNDS)
    forced = 900 - (4500 + 7) // 8  # rows of the hot group that no shard can hold beside the others
    assert none - forced > 1000 and some - forced < 20
    # On given tables no more groups are split than an even cut of shards in a row must split.
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = sharding.assign_shards(given).join(given.select("doc_id", "text"), "doc_id")
    pieces = out.select("text", "shard").distinct().groupBy("text").count()
    assert pieces.where("count > 1").count() <= 7


def test_quotas_bind(spark):
    """A shard takes what is free and what leaves it, whole groups only, those that move most first."""
    assert sharding.quotas([10, 10, 10], {(0, 1): 4, (1, 0): 4}, 10) == [4, 4, 0]
    assert sharding.quotas([10, 10, 10], {(0, 1): 4, (2, 1): 4}, 12) == [0, 2, 0]
    asking = spark.createDataFrame([(1, 0, 8), (2, 0, 5), (3, 0, 3), (4, 0, 1), (5, 1, 2)], "group long, target int, moves long")
    taken = {r["group"]: r["target"] for r in sharding.granted(asking, [9, 1]).collect()}
    assert taken.get(1) == 0 and 5 not in taken
    assert sum({1: 8, 2: 5, 3: 3, 4: 1}[g] for g in taken) <= 9


# -- 7 -----------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    rows = toxicity.op7_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert len(rows) == docs.count()
    assert rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= 0.5)).all()
    test = rows[rows["held_out"]].merge(labels, on="doc_id")
    assert (test["predicted"] == test["toxic"]).mean() > 0.93


def test_toxicity_of_few_and_repeated_rows(spark):
    """A model is fitted as soon as both labels occur; repeated rows count each and come back each."""
    good, bad = [f"a pleasant day number {i} with friends" for i in range(30)], [f"you horrible zzgrub number {i}" for i in range(6)]
    ids = [i for i in range(1, 200) if toxicity_trains(i)][:36]
    docs = docs_of(spark, [*good, *bad, bad[0], bad[0]], [*ids, ids[30], ids[30]])
    labels = spark.createDataFrame([(i, int(n >= 30)) for n, i in enumerate(ids)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.trees is not None and model.score(docs).count() == 38
    kept = [r["text"] for r in toxicity.keep_clean(docs, labels).collect()]
    assert sorted(kept) == sorted(good)


def toxicity_trains(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 5 != 0


def test_toxicity_of_awkward_texts(spark):
    docs, labels = docs_of(spark, AWKWARD), spark.createDataFrame([(0, 1), (1, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels).score(docs).count() == len(AWKWARD)
    assert toxicity.keep_clean(docs_of(spark, []), labels).count() == 0
    matcher = toxicity.Matcher(["idiot", "lowei"])
    for text in AWKWARD:
        assert len(toxicity.dense_features(text, matcher)) == len(toxicity.FEATURES)
    found = dict(zip(toxicity.FEATURES, toxicity.dense_features("You idiot! an 1d10t, a kidiot, loweisch", matcher), strict=True))
    assert found["lexicon_hits"] == 2 and found["obfuscated_hits"] == 1 and found["second_person_near"] > 0


# -- 8 -----------------------------------------------------------------------


def reference_encoder():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_pairs_against_the_library(spark):
    texts = [*AWKWARD, *corpus(2, 30), *(r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").limit(80).collect())]
    enc = reference_encoder()
    got = {r["doc_id"]: r for r in byte_pairs.encode_documents(docs_of(spark, texts), RANKS, public_tokenizers.PATTERN, keep="ids").collect()}
    for d, text in enumerate(texts):
        ids = enc.encode_ordinary(text or "")
        assert list(got[d]["token_ids"]) == ids, text
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    decoded = byte_pairs.decode_tokens(spark.createDataFrame([(1, [64, 65]), (2, None), (3, [])], "i int, token_ids array<int>"), RANKS, public_tokenizers.PATTERN)
    assert [r["decoded"] for r in decoded.orderBy("i").collect()][1:] == [None, b""]


def test_tree_reduction_equals_plain_merging():
    codec = byte_pairs.Codec.load(RANKS, public_tokenizers.PATTERN)
    codec.leaf = 3
    enc, rng = reference_encoder(), random.Random(4)
    for alphabet in ("ab", "abcdefghij", "aeionrst", "äöüßabc", "a"):
        for _ in range(60):
            word = "".join(rng.choices(alphabet, k=rng.randint(1, 200)))
            assert list(codec.reduce(word.encode())) == codec.merge(word.encode())
            assert codec.encode(word) == enc.encode_ordinary(word)


def test_blanks_of_all_kinds_with_ranks_that_hold_two_blanks():
    ranks = {bytes([i]): i for i in range(256)} | {b"  ": 256, b"   ": 257, b"\t ": 258, b" c": 259, b"\n ": 260}
    enc = tiktoken.Encoding("blanks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coders = [byte_pairs.ChunkedCodec(byte_pairs.Codec(ranks, public_tokenizers.PATTERN))]
    rng = random.Random(6)
    texts = ["a\tb\tc   d", " a", "a ", "  ", "a\u00a0 b", "a \n b", *("".join(rng.choices("ab \t\n\u3000\x1c", k=rng.randint(1, 12))) for _ in range(3000))]
    for coder in coders:
        for text in texts:
            assert coder.ids(text).tolist() == enc.encode_ordinary(text), repr(text)


def test_the_tree_decides_most_pieces():
    codec = byte_pairs.Codec.load(RANKS, public_tokenizers.PATTERN)
    joins = Counter()
    plain = codec.join

    def counted(left, right):
        out = plain(left, right)
        joins["all"] += 1
        joins["seam moved"] += out != left + right
        return out

    codec.join = counted
    text = duckdb.sql(f"SELECT text FROM '{DIR}/documents.parquet' ORDER BY doc_id LIMIT 20").fetchall()
    matches = [m for (t,) in text for m in codec.matches(t or "") if m.encode() not in codec.ranks]
    for m in matches:
        codec.piece(m.encode())
    assert joins["all"] > len(matches) and joins["seam moved"] > len(matches) / 10


# -- 9 -----------------------------------------------------------------------


def plain_similar(text, item, k=5, least=0.8):
    words, item = decontamination.tokens(text), decontamination.tokens(item)
    if not item or not words:
        return False
    k = min(k, len(item))
    want = Counter(tuple(item[i : i + k]) for i in range(len(item) - k + 1))
    for s in range(max(1, len(words) - len(item) + 1)):
        part = words[s : s + len(item)]
        got = Counter(tuple(part[i : i + k]) for i in range(len(part) - k + 1))
        both = sum((want & got).values())
        if both and both / sum((want | got).values()) >= least:
            return True
    return False


def test_decontamination_against_brute_force(spark):
    rng = random.Random(8)
    texts = corpus(8, 60)
    items = [" ".join(rng.choices([w for t in texts for w in t.split()], k=n)) for n in (1, 3, 5, 12, 30, 60)] + ["", None]
    for item in items[2:6]:
        for edits in (0, 1, 2, 4):
            words = item.split()
            for _ in range(edits):
                words[rng.randrange(len(words))] = "zzz"
            texts.append(" ".join([*rng.choices(texts[3].split() or ["q"], k=20), *words, "tail"]))
    texts += AWKWARD + [items[4].upper(), " ".join(items[4].split()[:-1])]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    expected = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if plain_similar(t, item)}
    found = decontamination.contaminated(docs_of(spark, texts), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected
    # In several blocks the findings are the same.
    again = decontamination.contaminated(docs_of(spark, texts), benchmark, block_bytes=200).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))
    assert decontamination.contaminated(docs_of(spark, texts), benchmark.limit(0)).count() == 0


def test_fingerprints_rule_out_windows_and_long_texts_stay_small():
    """The Hamming index returns what is similar and drops most windows that only share a shingle."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    item = rng.choices(words, k=200)
    part = [*rng.choices(words, k=300), *item[40:70], *rng.choices(words, k=300)]  # 30 of 200 words
    whole = [*rng.choices(words, k=300), *item[:90], "changed", *item[91:], *rng.choices(words, k=300)]
    index = decontamination.Index([(1, " ".join(item))], 5, 0.8, decontamination.RADIUS)
    assert index.search(" ".join(part)) == [] and index.met > 200 and index.near_ones < index.met / 10
    (found,) = index.search(" ".join(whole))
    assert found[:2] == (1, 300) and found[3] > 0.9
    import tracemalloc

    long = rng.choices(words, k=20_000)
    index = decontamination.Index([(1, " ".join(long))], 5, 0.8, decontamination.RADIUS)
    text = " ".join(["x", *long, "y"])
    tracemalloc.start()
    (found,) = index.search(text)
    assert found[1] == 1 and found[3] == 1.0
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_clean_rows_stay_whatever_their_id(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = docs_of(spark, [item, "something else", item, "clean"], [1, 1, None, None])
    benchmark = spark.createDataFrame([(1, item), (2, "w " * 50), (3, None)], "item_id long, text string")
    for block in (decontamination.BLOCK_BYTES, 100):
        assert sorted(r["text"] for r in decontamination.keep_uncontaminated(docs, benchmark, block_bytes=block).collect()) == ["clean", "something else"]


def test_rare_shingles_find_all_that_all_shingles_find():
    """Items are filed under a fifth of their shingles, the rarest; boilerplate that all of them share is under none."""
    rng = random.Random(6)
    common = [f"all{i}" for i in range(30)]
    items = [(i, " ".join([*common, *(f"item{i}x{rng.randrange(40)}" for _ in range(60))])) for i in range(40)]
    index = decontamination.Index(items, 5, 0.8, decontamination.RADIUS)
    boilerplate = decontamination.shingle_hashes(decontamination.tokens(" ".join(common)), 5).tolist()
    assert not any((5, h) in index.by_shingle for h in boilerplate)
    assert sum(len(v) for v in index.by_shingle.values()) < 0.3 * sum(len(w) for *_, w in index.items)
    for _ in range(60):
        at, words = rng.randrange(40), None
        words = items[at][1].split()
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = "changed"
        text = " ".join([*common, *words, *common])
        assert {f[0] for f in index.search(text)} == {i for i, item in items if plain_similar(text, item)}
    assert index.search(" ".join(common)) == []


# -- 10 ----------------------------------------------------------------------


def plain_suffixes(texts):
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(raw[i : i + 100])
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(raw) else 0
        kept = bytes(b for b, g in zip(raw, gone[:-1], strict=True) if not g)
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "piece", "slice_"), [(1, 4096, 1 << 20), (2, 5, 1 << 20), (3, 7, 900)])
def test_suffixes_against_brute_force(spark, seed, piece, slice_):
    texts = AWKWARD + corpus(seed, 120) + ["xy" * 800, "q" * 99, "q" * 101, AWKWARD[7]]
    ids = random.Random(seed).sample(range(1000), len(texts))
    order = sorted(range(len(texts)), key=lambda i: ids[i])
    expected = dict(zip((ids[i] for i in order), plain_suffixes([texts[i] for i in order]), strict=True))
    frame = docs_of(spark, texts, ids).repartition(5)
    before = suffixes.PIECE, suffixes.SLICE
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.dedup_bytes(frame).collect()}
    assert got == expected
    # The task functions with small pieces and slices, without Spark's shuffles.
    try:
        suffixes.PIECE, suffixes.SLICE = piece, slice_
        assert local_spans(texts, ids) == {d: e[1] for d, e in expected.items()}
    finally:
        suffixes.PIECE, suffixes.SLICE = before


def local_spans(texts, ids):
    import pyarrow as pa

    def ordered(batches, *keys):
        table = pa.Table.from_batches(list(batches)).sort_by([(k, "ascending") for k in keys])
        return table.to_batches(max_chunksize=11)

    source = pa.record_batch({"doc": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())})
    compared = pa.Table.from_batches(list(suffixes.compare_contexts(ordered(suffixes.find_anchors(iter([source])), "gram", "context", "doc", "off"))))
    rows = compared.to_pylist()
    offs: dict = {}
    for r in rows:
        if r["kind"] == suffixes.CANDIDATE:
            offs.setdefault(r["doc"], set()).add(r["low"])
    by_id = dict(zip(ids, texts, strict=True))
    chosen = pa.record_batch({"doc": pa.array(list(offs), pa.int64()), "text": pa.array([by_id[d] for d in offs], pa.string()), "offs": pa.array([sorted(v) for v in offs.values()], pa.list_(pa.int64()))})
    spans = [r for r in rows if r["kind"] == suffixes.COVERED]
    if offs:
        met = list(suffixes.compare_buckets(iter(ordered(suffixes.cut_suffixes(iter([chosen])), "lead", "context", "doc", "off"))))
        spans += [r for b in suffixes.meet_across(iter(ordered(met, "a", "b", "doc", "low"))) for r in b.to_pylist()] if met else []
    gone = {d: np.zeros(len((t or "").encode()), bool) for d, t in by_id.items()}
    for r in spans:
        gone[r["doc"]][r["low"] : r["high"]] = True
    return {d: int(g.sum()) for d, g in gone.items()}


def test_suffixes_of_rows_that_repeat_an_id(spark):
    """Bytes that stand nowhere else stay, whatever doc_ids repeat or are missing."""
    draw = random.Random(8)
    a, b, c = ("".join(draw.choices("abcdefgh ", k=300)) for _ in range(3))
    docs = docs_of(spark, [a, a, b, c, c + b, b], [1, 2, 2, None, None, 9])
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffixes.dedup_bytes(docs).collect())
    assert got[2:] == [(1, 300, 0), (2, 300, 300), (2, 300, 300), (9, 300, 300)]
    assert [n for _, n, _ in got[:2]] == [300, 600] and sum(r for _, _, r in got[:2]) == 300
    alone = suffixes.dedup_bytes(docs_of(spark, [a, a, b], [1, 2, 2])).collect()
    assert sorted((r["doc_id"], r["n_removed"], bytes(r["kept"]).decode()) for r in alone) == [(1, 0, a), (2, 0, b), (2, 300, "")]


# -- all ---------------------------------------------------------------------


def test_extra_columns_and_empty_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    clash = docs_of(spark, AWKWARD).withColumns({c: F.lit(1) for c in ("fingerprint", "u", "root", "kept_text", "block", "label", "doc", "off", "gram", "group", "features", "score", "lows", "word")})
    labels = spark.createDataFrame([(3, 1)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "ab ab ab ab ab ab")], "item_id long, text string")
    n = len(AWKWARD)
    for docs, rows in ((clash, n), (clash.limit(0), 0)):
        assert licenses.licenses(docs).count() == rows
        assert near_duplicates.near_duplicates(docs).count() == rows
        assert lines.dedup_lines(docs).count() == rows
        assert token_shards.write_shards(docs, RANKS, public_tokenizers.PATTERN, str(tmp_path / str(rows))).select("doc_id").distinct().count() == rows
        assert sharding.assign_shards(docs).count() == rows
        assert toxicity.fit(docs, labels).score(docs).count() == rows
        assert byte_pairs.encode_documents(docs, RANKS, public_tokenizers.PATTERN).count() == rows
        assert decontamination.keep_uncontaminated(docs, items).count() == max(0, rows - 1)
        assert suffixes.dedup_bytes(docs).count() == rows
