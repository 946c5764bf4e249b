"""SimHash near-duplicates: fingerprints, BK-trees within shards, components.

Rows with the same fingerprint are first collapsed to one node.  Two
fingerprints that differ in at most ``radius`` bits agree in at least two of
``radius + 2`` blocks, so each node is filed under every pair of its blocks.
The nodes filed under one pair form shards of bounded size.  Each shard's
BK-tree goes to every query block of its own pair (never to the whole corpus),
and a query follows only the edges that can lead within the radius.
Components come from repeated hooking of nodes to the smallest neighbour, all as joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, cut, rounded_parts, run_starts, table, whole_runs

SEED = 42
WORDS = 3
RADIUS = 2
#: Fingerprints of one tree.
SHARD = 2048
#: What ``keep_one`` calls similar, besides near fingerprints.
SIMILAR_WORDS = 5
SIMILARITY = 0.8
#: Bands of least hashes, and hashes of a band.
BANDS = 24
BAND_ROWS = 4
#: Texts of one side of a task that settles what the heads leave apart.
BLOCK = 256


def simhash(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint of a text, as op2's contract defines it."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z and ASCII blanks only
    if not tokens:
        return 0
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)) if len(tokens) >= words else [b" ".join(tokens)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of each row; null text: 0."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                prints = np.fromiter((simhash(t, words) for t in part.column("text").to_pylist()), dtype=np.uint64, count=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(prints.view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(compute, "doc_id long, fingerprint long")


class BKTree:
    """A BK-tree over 64-bit integers; children are keyed by their distance."""

    def __init__(self, values: list[int]):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        for node in range(1, len(values)):
            at = 0
            while True:
                apart = (values[node] ^ values[at]).bit_count()
                nearer = self.children[at].get(apart)
                if nearer is None:
                    self.children[at][apart] = node
                    break
                at = nearer

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            apart = (value ^ self.values[at]).bit_count()
            if apart <= radius:
                found.append(self.values[at])
            children = self.children[at]
            if len(children) <= 2 * radius + 1:
                todo += [c for k, c in children.items() if apart - radius <= k <= apart + radius]
            else:
                todo += [children[k] for k in range(apart - radius, apart + radius + 1) if k in children]
        return found


def links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints at most ``radius`` bits apart.

    ``nodes`` has distinct non-null fingerprints.  Nothing is capped: a pair of
    blocks with many fingerprints is cut into several trees, each of which is
    sent to all query blocks of that pair.
    """
    blocks = radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned("fingerprint", edges[i]).bitwiseAND((1 << (edges[i + 1] - edges[i])) - 1) for i in range(blocks)]
    keys = [F.xxhash64(F.lit(f"{i},{j}"), part[i], part[j]) for i, j in combinations(range(blocks), 2)]
    filed = nodes.select("fingerprint", F.explode(F.array(*keys)).alias("block"))
    sizes = filed.groupBy("block").agg(F.count("*").alias("size")).where("size > 1")
    trees = F.ceil(F.col("size") / shard).cast("int")
    own = F.pmod(F.xxhash64("fingerprint", F.lit("shard")), F.col("trees")).cast("int")
    dealt = filed.join(sizes, "block").withColumn("trees", trees).withColumn("own", own)
    # (tree, asks): the tree of shard `tree` meets the queries of shard `asks` >= tree.
    as_tree = dealt.select("block", F.col("own").alias("tree"), F.explode(F.sequence("own", F.col("trees") - 1)).alias("asks"), F.lit(0).alias("role"), "fingerprint")
    as_query = dealt.where("own > 0").select("block", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("tree"), F.col("own").alias("asks"), F.lit(1).alias("role"), "fingerprint")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in whole_runs(batches, ["block", "tree", "asks"]):
            block, tree, asks, role, value = (runs.column(c).to_numpy() for c in ("block", "tree", "asks", "role", "fingerprint"))
            starts = run_starts([block, tree, asks])
            found: list[tuple[int, int]] = []
            unsigned = value.view(np.uint64).tolist()
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if b - a == 2 and tree[a] == asks[a]:
                    if (unsigned[a] ^ unsigned[a + 1]).bit_count() <= radius:
                        found.append((unsigned[a], unsigned[a + 1]))
                    continue
                members = [unsigned[i] for i in range(a, b) if role[i] == 0]
                queries = [unsigned[i] for i in range(a, b) if role[i] == 1] if tree[a] != asks[a] else members
                grown = BKTree(members)
                found += [(q, hit) for q in queries for hit in grown.within(q, radius) if hit != q]
            if found:
                pairs = np.array(found, dtype=np.uint64).view(np.int64)
                low, high = pairs.min(axis=1), pairs.max(axis=1)
                once = np.unique(np.stack([low, high], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], names=["a", "b"])

    both = as_tree.unionByName(as_query)
    dealt_out = both.repartition(rounded_parts(nodes), "block", "tree", "asks").sortWithinPartitions("block", "tree", "asks", "role")
    return dealt_out.mapInArrow(search, "a long, b long").distinct()


def components(edges: DataFrame, scratch: Scratch | None = None, name: str = "edges") -> DataFrame:
    """node, root (the smallest node of its component) for all nodes in ``edges``.

    Until all components are stars around their smallest node, each node links
    its larger neighbours, then its smaller ones, to the smallest neighbour.
    Rounds grow with the logarithm of the longest path; nothing but the answer
    to "are all stars" reaches the driver.
    """
    scratch, round_ = scratch or Scratch(edges.sparkSession), 0
    now = scratch.keep(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct(), f"{name}-0")
    while not _all_stars(now):
        both = now.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(now.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root"))
        large = both.join(least, "u").where("v > u").select(F.col("root").alias("low"), F.col("v").alias("high")).where("low < high")
        small_least = large.groupBy("high").agg(F.min("low").alias("root"))
        hooked = large.join(small_least, "high").select(F.col("root").alias("low"), F.col("low").alias("high")).where("low < high")
        now = scratch.keep(hooked.unionByName(small_least.select(F.col("root").alias("low"), "high")).distinct(), f"{name}-{round_ + 1}")
        scratch.drop(f"{name}-{round_}")
        round_ += 1
    heads = now.select(F.col("low").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(heads)


def _all_stars(edges: DataFrame) -> bool:
    """Whether each higher end has one edge and is nowhere the lower end."""
    ends = edges.select(F.col("high").alias("node"), F.lit(1).alias("under")).unionByName(edges.select(F.col("low").alias("node"), F.lit(0).alias("under")))
    return ends.groupBy("node").agg(F.sum("under").alias("under"), F.count("*").alias("n")).where("under > 1 or (under = 1 and n > 1)").isEmpty()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of each row of ``docs``.

    component_id is the smallest doc_id that is reachable over links, the row's
    own included.  A null or empty text has fingerprint zero and is linked like
    any other; a null doc_id keeps its row and takes part, but is never the
    smallest (component_id is null if no row of the component has a doc_id).
    Repeated rows stay.  Extra columns are left out.
    """
    prints = cut(fingerprints(docs, words))
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"))
    grouped = components(links(nodes.select("fingerprint"), radius))
    rooted = nodes.join(grouped, nodes.fingerprint == grouped.node, "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least_id")
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    # Both sides are one row per fingerprint; only the last join meets all rows.
    ids = rooted.join(named, "root").select("fingerprint", "component_id")
    return prints.join(ids, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def _shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes of a text's shingles; none for a text without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)) if len(tokens) >= words else [b" ".join(tokens)]
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), dtype=np.uint64))


#: Bytes of an Arrow batch: rows carry a text or all its shingles, so a batch of so many rows may be very large.
BATCH_BYTES = 1 << 22
#: Stands for a doc_id that is null: behind all others.
NO_ID = (1 << 63) - 1


def _per_text(docs: DataFrame, compute, columns: str) -> DataFrame:
    """doc_id and the named columns that ``compute`` makes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = zip(*map(compute, part.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *map(pa.array, made)], schema=run.schema)

    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    run.schema = pa.schema([("doc_id", pa.int64())] + [(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in columns.split(", ")])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {columns}")


def _band_keys(words: int):
    """A function that gives the size of a text's shingle set and one key for each band of least hashes."""
    draw = np.random.default_rng(SEED)
    factors = draw.integers(1 << 63, size=BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = draw.integers(1 << 63, size=BANDS * BAND_ROWS, dtype=np.uint64)
    room = np.empty((256, BANDS * BAND_ROWS), np.uint64)

    def keys(text: str | None) -> tuple[int, list[int]]:
        hashes, least = _shingle_set(text, words), np.full(BANDS * BAND_ROWS, ~np.uint64(0))
        with np.errstate(over="ignore"):
            for at in range(0, len(hashes), len(room)):
                some = hashes[at : at + len(room), None]
                drawn = np.multiply(some, factors, out=room[: len(some)])
                drawn += offsets
                np.minimum(least, drawn.min(axis=0), out=least)
        bands = least.reshape(BANDS, BAND_ROWS) if len(hashes) else []
        return len(hashes), [xxhash.xxh64_intdigest(row.tobytes(), seed=i) - (1 << 63) for i, row in enumerate(bands)]

    return keys


def _texts(docs: DataFrame, words: int, similar_words: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """One row per different text, and the doc_ids that stand on several texts.

    A text has node (its smallest doc_id), fingerprint, n (distinct shingles)
    and keys (of its bands).  Rows without a doc_id, or whose doc_id names
    several texts, are left out.
    """
    keys_of = _band_keys(similar_words)

    def sketch(text: str | None) -> tuple:
        digest, print_ = np.array([xxhash.xxh64_intdigest((text or "").encode()), simhash(text, words)], np.uint64).view(np.int64).tolist()
        return digest, print_, *keys_of(text)

    sketches = scratch.keep(_per_text(docs.where("doc_id is not null"), sketch, "digest long, fingerprint long, n long, keys array<long>"), "sketches")
    spread = sketches.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc_id")
    spread = scratch.keep(spread, "spread")
    texts = sketches.join(spread, "doc_id", "left_anti").groupBy("digest", "fingerprint", "n", "keys").agg(F.min("doc_id").alias("node"))
    texts = scratch.keep(texts.drop("digest"), "texts")
    scratch.drop("sketches")
    return texts, spread


def _against_heads(filed: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Similar pairs (a, b, label_a, label_b) of a bucket's first text and its other members.

    All buckets have one order, so that a group of copies meets few heads.  A
    head's shingles come once to each task, its members' once for each head;
    a head of many members is dealt to several tasks.
    """
    turn = F.xxhash64("node")
    heads = filed.groupBy("key").agg(F.min_by("node", turn).alias("head"), F.min_by("label", turn).alias("head_label"), F.min_by("n", turn).alias("head_n"), F.floor(F.count("*") / 1000).cast("int").alias("parts"))
    met = filed.join(heads, "key").where("label <> head_label").where(F.least("n", "head_n") >= similarity * F.greatest("n", "head_n") - 1e-9)
    pairs = met.groupBy("head", "head_label", F.col("node").alias("other"), "label").agg(F.max("parts").alias("parts"))
    pairs = scratch.keep(pairs.withColumn("salt", F.pmod(F.xxhash64("other"), F.col("parts") + 1).cast("int")), "pairs")
    group = ["head", "parts", "salt"]
    asked = pairs.select(*group, F.col("head").alias("node"), F.col("head_label").alias("label"), F.lit(0).alias("role")).distinct()
    members = pairs.select(*group, F.col("other").alias("node"), "label", F.lit(1).alias("role"))
    both = asked.unionByName(members).join(sets.select("node", "shingles"), "node").repartition(rounded_parts(filed), *group).sortWithinPartitions(*group, "role")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, ours, label = None, np.empty(0, np.uint64), 0
        for batch in batches:
            found = []
            for h, role, node, its_label, shingles in zip(*(batch.column(c).to_pylist() for c in ("head", "role", "node", "label")), batch.column("shingles"), strict=True):
                theirs = shingles.values.to_numpy().view(np.uint64)
                if role == 0:
                    head, ours, label = h, theirs, its_label
                elif h == head:
                    shared = len(np.intersect1d(ours, theirs, assume_unique=True))
                    if shared >= similarity * (len(ours) + len(theirs) - shared) - 1e-9:
                        found.append((h, node, label, its_label))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b", "label_a", "label_b"])

    return both.mapInArrow(check, "a long, b long, label_a long, label_b long")


def _joined(node, root, sets, keys, band: int, left, right, similarity: float) -> list[tuple[int, int, int, int]]:
    """Pairs, and their roots, of a text of ``left`` and one of ``right`` (positions) that are similar and join two roots.

    Pairs that share an earlier band are left to that band's bucket.  A pair
    whose parity bitmaps differ in more bits than the similarity allows
    shingles to differ can't be similar; all others are checked exactly.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    bits = 1 << min(16, max(10, int(4 * sizes.max()).bit_length()))
    maps = np.stack([np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).view(np.uint64) for s in sets])
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    found = []
    for i in left:
        js = right[right > i] if left is right else right
        js = js[root[js] != root[i]]
        js = js[~(keys[js, :band] == keys[i, :band]).any(axis=1)]
        both = sizes[js] + sizes[i]
        least = (similarity * both - 1e-9) / (1 + similarity)  # shingles to share
        near = np.minimum(sizes[js], sizes[i]) >= least
        js, both, least = js[near], both[near], least[near]
        apart = np.bitwise_count(maps[js] ^ maps[i]).sum(axis=1, dtype=np.int64)
        for j in js[apart <= both - 2 * least + 1e-6]:
            one, other = top(int(root[i])), top(int(root[j]))
            if one == other:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if shared >= similarity * (sizes[i] + sizes[j] - shared) - 1e-9:
                found.append((int(node[i]), int(node[j]), int(root[i]), int(root[j])))
                above[one] = other
    return found


def _settled(filed: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float, block: int, scratch: Scratch) -> DataFrame:
    """Similar pairs (a, b, label_a, label_b: their roots) that share a bucket and have different roots.

    Every pair of texts of different components in a bucket is checked, once.
    In each bucket the component with most members is never held against
    itself: blocks of the other members meet each other and blocks of it.
    """
    rooted = filed.join(roots.withColumnRenamed("node", "label"), "label", "left").withColumn("root", F.coalesce("root", "label")).drop("label")
    per_root = rooted.groupBy("key", "root").agg(F.count("*").alias("n_root"))
    sizes = per_root.groupBy("key").agg(F.max_by("root", F.struct("n_root", "root")).alias("main"), F.max("n_root").alias("n_main"), (F.sum("n_root") - F.max("n_root")).alias("n_rest")).where("n_rest > 0")
    dealt = rooted.join(sizes, "key").withColumns({"of_main": F.ceil(F.col("n_main") / block).cast("int"), "of_rest": F.ceil(F.col("n_rest") / block).cast("int")})
    own = lambda parts: F.pmod(F.xxhash64("node", F.lit("block")), F.col(parts)).cast("int")
    main = F.col("root") == F.col("main")
    dealt = scratch.keep(dealt.withColumn("own", F.when(main, own("of_main") + F.col("of_rest")).otherwise(own("of_rest"))), "dealt")
    slim = ["key", "band", "node", "root"]
    # Blocks of the rest are 0 .. of_rest - 1, those of the main component follow.
    first = F.when(F.col("n_rest") > 1, F.col("own")).otherwise(F.col("own") + 1)  # one text has no partner in its own block
    as_left = dealt.where(~main).select(*slim, F.col("own").alias("low"), F.explode(F.sequence(first, F.col("of_rest") + F.col("of_main") - 1)).alias("high"), F.lit(0).alias("side"))
    last = F.least(F.col("own"), F.col("of_rest")) - 1
    as_right = dealt.where(last >= 0).select(*slim, F.explode(F.sequence(F.lit(0), last)).alias("low"), F.col("own").alias("high"), F.lit(1).alias("side"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in whole_runs(batches, ["key", "low", "high"]):
            key, low, high, side, band, node, root = (runs.column(c).to_numpy() for c in ("key", "low", "high", "side", "band", "node", "root"))
            starts = run_starts([key, low, high])
            found: list[tuple] = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if b - a < 2:
                    continue
                within = low[a] == high[a]
                left = np.flatnonzero(side[a:b] == 0)
                right = left if within else np.flatnonzero(side[a:b] == 1)
                rows = runs.slice(a, b - a)
                hashes = [s.values.to_numpy().view(np.uint64) for s in rows.column("shingles")]
                keys = np.stack([s.values.to_numpy() for s in rows.column("keys")])
                found += _joined(node[a:b], root[a:b], hashes, keys, int(band[a]), left, right, similarity)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b", "label_a", "label_b"])

    tasks = as_left.unionByName(as_right).join(sets.select("node", "keys", "shingles"), "node").repartition(rounded_parts(filed), "key", "low", "high").sortWithinPartitions("key", "low", "high")
    return tasks.mapInArrow(check, "a long, b long, label_a long, label_b long")


def _similar(docs: DataFrame, texts: DataFrame, links_: DataFrame | None, words: int, similarity: float, block: int, scratch: Scratch, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs by heads, roots of the labels that they and ``links_`` connect, and pairs of texts of different roots.

    ``texts`` has a label; texts of one label belong together anyway.
    """
    filed = texts.select("node", "label", "n", F.posexplode("keys").alias("band", "key"))
    mixed = filed.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
    filed = scratch.keep(filed.join(mixed, "key"), "filed")
    used, one = filed.select(F.col("node").alias("doc_id")).distinct(), ["doc_id"]
    if ids is not None:  # of the many rows of a text those of one document
        used, one = used.join(ids, "doc_id"), ["doc_id", "doc"]
    # A doc_id in use names one text, so any of its rows will do.
    rows = docs.select(*one, "text").join(used, one).groupBy("doc_id").agg(F.first("text").alias("text"))
    keys_of = _band_keys(words)
    sets = _per_text(rows, lambda t: (_shingle_set(t, words).view(np.int64), keys_of(t)[1]), "shingles array<long>, keys array<long>")
    sets = scratch.keep(sets.withColumnRenamed("doc_id", "node"), "sets")
    by_heads = scratch.keep(_against_heads(filed, sets, similarity, scratch), "by_heads")
    edges = by_heads.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    roots = components(edges if links_ is None else edges.unionByName(links_), scratch, "by_heads")
    settled = scratch.keep(_settled(filed, sets, roots, similarity, block, scratch), "settled")
    scratch.drop("filed", "sets", "pairs", "dealt")
    return by_heads, roots, settled


def similar_pairs(docs: DataFrame, words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Pairs a < b of doc_ids whose shingle sets have a Jaccard similarity of at least ``similarity``.

    Equal texts are one text, under their smallest doc_id.  Texts that agree in
    a band of least hashes meet in a bucket.  Each is held against the bucket's
    first text, which connects copies with few pairs.  Then all members of a
    bucket that are still in different components are held against each other,
    in blocks of bounded size.  Pairs are checked exactly, on all shingles.
    Pairs connect all that is similar and shares a band but need not list it
    all.  Two texts at 0.8 share no band with a chance of 3 in a million.
    Rows without a doc_id, or whose doc_id names several texts, take no part.
    """
    scratch = Scratch(docs.sparkSession, BATCH_BYTES)
    texts, _ = _texts(docs, WORDS, words, scratch)
    by_heads, _, settled = _similar(docs, texts.withColumn("label", F.col("node")), None, words, similarity, block, scratch)
    return by_heads.unionByName(settled).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def keep_one(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, similar_words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, that of the smallest doc_id.

    Groups join what the fingerprints link and what ``similar_pairs`` would
    list: at a similarity of 0.8 fingerprints are often ten bits apart, too far
    for blocks of bits to find.  Texts of one fingerprint are one node from the
    start, so that only pairs that join fingerprints are checked.

    Texts are told apart by 128 bits of hash, so every row takes part, whether
    its doc_id is missing (those come last), repeats or names several texts
    (then the text of the least hash stays).  Rows equal in doc_id and text are
    one document: all stay or all go.  A null text counts as an empty one.
    """
    scratch = Scratch(docs.sparkSession, BATCH_BYTES)
    node, doc = F.xxhash64(F.coalesce("text", F.lit(""))), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    named = docs.select(node.alias("doc_id"), doc.alias("doc"), "text")
    # Two texts of one hash (64 bits; another 64 tell them apart) are held against nothing.
    texts, spread = _texts(named, words, similar_words, scratch)
    ids = scratch.keep(named.groupBy("doc_id").agg(F.min("doc").alias("doc")), "ids")
    texts = texts.withColumn("label", F.col("fingerprint"))
    near = links(texts.select("fingerprint").distinct(), radius)
    _, roots, settled = _similar(named, texts, near, similar_words, similarity, block, scratch, ids)
    tops = components(settled.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")), scratch, "settled").select(F.col("node").alias("root"), F.col("root").alias("top"))
    placed = texts.select("node", "label").join(roots.withColumnRenamed("node", "label"), "label", "left").withColumn("root", F.coalesce("root", "label"))
    grouped = placed.join(tops, "root", "left").select(F.col("node").alias("doc_id"), F.coalesce("top", "root").alias("top")).join(ids, "doc_id")
    least = grouped.groupBy("top").agg(F.min(F.struct("doc", "doc_id")).alias("least")).select("least.doc_id", "least.doc")
    apart = named.join(spread, "doc_id", "left_semi").select("doc_id", "doc").distinct()
    stays = scratch.keep(least.unionByName(apart), "stays")
    scratch.drop_all_but("stays")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), node.alias("doc_id"), doc.alias("doc"))
    return rows.join(stays, ["doc_id", "doc"], "left_semi").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 2 over the whole of ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
