"""Each stage of the pipeline on its own input, and the whole of it."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_the_clean(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = docs.count()
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR).cache()
        now = docs.count()
        assert 0 < now <= rows, name
        rows = now
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names, name
    assert corpus_pipeline.run(spark, DIR).count() == rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the stages use themselves.
CLASHING = (
    "_starts", "_out", "row", "out", "runs", "low", "high", "doc", "twin", "windows", "kept_text", "n_lines", "n_removed", "n_runs", "features", "score", "margin", "probability", "prediction",
    "rawPrediction", "fingerprint", "label", "root", "top", "node", "head", "band", "block", "shingles", "item_id", "toxic", "text_a",
)
LONG = "word " * 60
FILTERS = corpus_pipeline.STAGES[:-1]


def awkward(spark):
    """Null ids, repeated rows and ids, null, empty and long texts, ties."""
    texts = [(1, "alpha beta\ngamma delta"), (1, "alpha beta\ngamma delta"), (2, "alpha beta\ngamma delta"), (2, "quite another text"), (None, "a row without an id"), (None, None), (3, None), (4, ""), (5, "\n\n\n"), (6, LONG * 400), (7, LONG), (8, LONG)]
    return spark.createDataFrame([(i, t, None if i == 4 else "en", None, None if t is None else len(t)) for i, t in texts], SCHEMA)


@pytest.mark.parametrize(("name", "stage"), FILTERS, ids=[name for name, _ in FILTERS])
def test_stages_on_awkward_rows(spark, name, stage):
    """No new rows; other columns come back as they were, whatever their names; an empty table stays empty."""
    docs = awkward(spark).withColumns({c: F.lit(77) for c in CLASHING})
    out = stage(spark, docs, DIR)
    assert out.columns == docs.columns
    rows = out.collect()
    assert 0 < len(rows) <= docs.count()
    assert all(r[c] == 77 for r in rows for c in CLASHING)
    kept = {(r["doc_id"], r["lang"], r["source"]) for r in rows}
    assert kept <= {(r["doc_id"], r["lang"], r["source"]) for r in docs.collect()}
    # A text that nothing resembles, and rows without text, stay in every stage.
    assert {(None, "a row without an id"), (2, "quite another text"), (3, None)} <= {(r["doc_id"], r["text"]) for r in rows}
    assert stage(spark, docs.limit(0), DIR).count() == 0
    without = docs.select("text", "doc_id")
    assert stage(spark, without, DIR).columns == ["text", "doc_id"]


def test_line_dedup_and_near_duplicates_on_awkward_rows(spark):
    docs = awkward(spark)
    cut = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in corpus_pipeline.line_dedup(spark, docs, DIR).collect())
    assert len(cut) == docs.count()
    # The row of doc_id 2 loses what stands in 1; rows equal in doc_id and text keep theirs alike.
    assert [t for i, t in cut if i in (1, 2)] == ["alpha beta\ngamma delta"] * 2 + ["", "quite another text"]
    assert [t for i, t in cut if i in (7, 8)] == [LONG, ""]
    ids = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, DIR).collect()]
    # Of the two like texts the smaller doc_id stays; of rows without one the text that stands nowhere else.
    assert ids.count(7) + ids.count(8) <= 1 and ids.count(None) == 1 and ids.count(1) == 2


def test_last_stage_on_awkward_rows(spark):
    _, stage = corpus_pipeline.STAGES[-1]
    docs = awkward(spark).withColumns({c: F.lit(77) for c in ("ids", "token_ids", "n_tokens")})
    assert stage(spark, docs, DIR).count() == docs.count()
    assert stage(spark, docs.limit(0), DIR).count() == 0


def test_all_stages_against_brute_force(spark, tmp_path):
    """The whole pipeline on a small corpus without labels, so that no text is toxic; the other four stages by plain Python."""
    import hashlib
    import random

    import public_tokenizers
    import tiktoken

    from lodestar_market.llm import near_duplicates
    from tests.llm.test_operators import RANKS, _shingles_of, corpus, plain_similar, reference_encoder

    rng = random.Random(21)
    texts = corpus(21, 90)
    long_line = " ".join(f"long{i}" for i in range(55))
    texts += [f"a\n{long_line}\nb", f"c\n{long_line}\nd", "x\ny\nz\nw", "p\nx\ny\nq", None, "", "same text of six words here", "same text of six words here"]
    items = [" ".join(rng.choices([w for t in texts if t for w in t.split()], k=n)) for n in (12, 30)]
    texts += [f"before it {items[0]} and behind", f"other words {items[1]}"]
    rng.shuffle(texts)
    d = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}

    seen, seen_long, cut = set(), set(), {}
    for i, text in enumerate(texts):
        lines = [] if text is None else text.split("\n")
        gone = set()
        for at in range(len(lines)):
            pair = tuple(lines[at : at + 2])
            if len(pair) == 2:
                gone |= {at, at + 1} if pair in seen else set()
                seen.add(pair)
            if len(lines[at].split(" ")) >= 50:
                gone |= {at} if lines[at] in seen_long else set()
                seen_long.add(lines[at])
        cut[i] = None if text is None else "\n".join(line for at, line in enumerate(lines) if at not in gone)
    ids = list(cut)
    prints, sets, root = [near_duplicates.simhash(cut[i]) for i in ids], [_shingles_of(cut[i]) for i in ids], list(ids)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in range(a):
            if (cut[a] or "") == (cut[b] or "") or (prints[a] ^ prints[b]).bit_count() <= 2 or (sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    kept = [i for i in ids if top(i) == i and not any(plain_similar(cut[i], item) for item in items)]
    assert 40 < len(kept) < len(texts) - 10 and set(got) == set(kept)
    library = reference_encoder()
    for i in kept:
        want = library.encode_ordinary(cut[i] or "")
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((cut[i] or "").encode()).hexdigest()
    assert public_tokenizers.PATTERN and tiktoken and RANKS
