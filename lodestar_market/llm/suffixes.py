"""Suffix-array dedup of repeated byte strings.

A full suffix array has a row for every byte.  Here only suffixes at anchors
are kept, which lose nothing: of the ``GRAM``-byte strings inside any
``LENGTH``-byte window the one with the smallest hash is an anchor, so equal
windows have equal anchors at equal places.

1. Anchors are dealt by their leading gram and sorted.  An anchor whose whole
   context (all windows that hold it) stands earlier is covered.  The first
   anchor of each context stays a candidate if its gram has other contexts.
2. Candidate suffixes are range-partitioned by their leading bytes at sampled
   splitters and sorted.  Each bucket compares the windows of suffixes with the
   same lead by a multikey sort; what begins or ends a bucket (or a piece of
   it) is compared across the boundaries in one more round.
3. Covered spans are merged per document and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, run_starts, table

LENGTH = 100
GRAM = 32
#: Bytes that are hashed at once, and candidate suffixes that are compared at once.
SLICE = 1 << 20
PIECE = 4096
#: Stands for a doc_id that is null: before all others.
NO_ID = -(1 << 63)

_MIXED = np.random.default_rng(20_240_101)
_BYTE = _MIXED.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_FACTOR = _MIXED.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def _doubled(x: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Hashes of all strings of 1, 2, 4 ... ``most`` bytes."""
    out, size = {1: _BYTE[x]}, 1
    while size < most:
        shorter = out[size]
        out[2 * size] = shorter[:-size] * _FACTOR[size.bit_length()] + shorter[size:]
        size *= 2
    return out


def _gram_hashes(x: np.ndarray) -> np.ndarray:
    h = _BYTE[x]
    size = 1
    while size < GRAM:
        h = h[:-size] * _FACTOR[size.bit_length()] + h[size:]
        size *= 2
    h ^= h >> np.uint64(31)
    h *= _FACTOR[14]
    h ^= h >> np.uint64(29)
    return h


def _window_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of each ``LENGTH``-byte string of x."""
    h = _doubled(x, 64)
    n = len(x) - LENGTH + 1
    out = h[64][:n] * _FACTOR[12] + h[32][64 : 64 + n] * _FACTOR[13] + h[4][96 : 96 + n]
    return out ^ (out >> np.uint64(31))


def _sliding(a: np.ndarray, n: int, f) -> np.ndarray:
    size = 1
    while 2 * size <= n:
        a = f(a[:-size], a[size:])
        size *= 2
    return f(a[: len(a) - (n - size)], a[n - size :]) if size < n else a


def _anchors(x: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors in x and their gram hashes; stops[p]: where p's document ends."""
    reach = LENGTH - GRAM + 1
    h = _gram_hashes(x)
    least = _sliding(h, reach, np.minimum)
    n = len(least)
    least[np.arange(n) + LENGTH > stops[:n]] = 0  # such windows run into the next document
    none = np.zeros(reach - 1, np.uint64)
    highest = _sliding(np.concatenate([none, least, none]), reach, np.maximum)
    at = np.flatnonzero((highest == h) & (h != 0))
    return at, h[at]


ANCHOR = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("doc", pa.int64()), ("off", pa.int64()), ("right", pa.int32())])
SPAN = pa.schema([("kind", pa.int8()), ("doc", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
CANDIDATE, COVERED, ACROSS = 0, 1, 2


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes], list[int], list[int], list[int]]]:
    """ids, bytes, their start in the document, and the core part that anchors may be in.

    Short texts go together; a text longer than SLICE comes in overlapping parts.
    """
    halo = 2 * LENGTH
    ids, parts, bases, lows, highs, size = [], [], [], [], [], 0
    for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
        raw = (text or "").encode()
        if len(raw) < LENGTH:
            continue
        for core in range(0, len(raw), SLICE):
            begin, end = max(0, core - halo), min(len(raw), core + SLICE + halo)
            if size and size + end - begin > SLICE:
                yield ids, parts, bases, lows, highs
                ids, parts, bases, lows, highs, size = [], [], [], [], [], 0
            ids.append(doc)
            parts.append(raw[begin:end])
            bases.append(begin)
            lows.append(core - begin)
            highs.append(min(len(raw), core + SLICE) - begin)
            size += end - begin
    if parts:
        yield ids, parts, bases, lows, highs


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor rows; what repeats within a slice is combined and comes as a span (right < 0)."""
    for batch in batches:
        for ids, parts, bases, lows, highs in _slices(batch):
            data = b"".join(parts)
            lengths = np.array([len(p) for p in parts])
            ends = np.cumsum(lengths)
            begins = ends - lengths
            part_of = np.repeat(np.arange(len(parts)), lengths)
            at, gram = _anchors(np.frombuffer(data, np.uint8), ends[part_of])
            part = part_of[at]
            core = (at - begins[part] >= np.array(lows)[part]) & (at - begins[part] < np.array(highs)[part])
            at, gram, part = at[core], gram[core], part[core]
            if not len(at):
                continue
            low, high = np.maximum(begins[part], at - (LENGTH - GRAM)), np.minimum(ends[part], at + LENGTH)
            context = np.fromiter(map(xxhash.xxh3_64_intdigest, map(data.__getitem__, map(slice, low.tolist(), high.tolist())), ((at - low) * 1000 + high - at).tolist()), np.uint64, len(at))
            doc, off = np.array(ids)[part], at - begins[part] + np.array(bases)[part]
            order = np.lexsort((off, doc, context, gram))
            g, c = gram[order], context[order]
            first = np.ones(len(order), bool)
            first[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
            keep = order[first]
            yield pa.RecordBatch.from_arrays([pa.array(gram[keep].view(np.int64)), pa.array(context[keep].view(np.int64)), pa.array(doc[keep]), pa.array(off[keep]), pa.array((high - at)[keep].astype(np.int32))], schema=ANCHOR)
            head = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
            again = order[~first & ((doc[order] != doc[head]) | (off[order] != off[head]))]
            if len(again):
                d, lo, hi = _merged(doc[again], (off - (at - low))[again], (off + high - at)[again])
                key = (d.view(np.uint64) * _FACTOR[15]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(d), pa.array(d), pa.array(lo), pa.array((lo - hi).astype(np.int32))], schema=ANCHOR)


def _merged(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document with overlapping and touching ones merged."""
    order = np.lexsort((low, doc))
    doc, low, high = doc[order], low[order], high[order]
    edges = run_starts([doc])
    top = np.empty_like(high)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        top[a:b] = np.maximum.accumulate(high[a:b])
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (low[1:] > top[:-1])
    begin = np.flatnonzero(new)
    return doc[begin], low[begin], top[np.append(begin[1:], len(doc)) - 1]


def compare_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of anchors sorted by gram, context, doc, off: covered spans and candidates (low: off)."""
    gram = context = doc = off = None  # the context that is open, and its first place
    waiting: tuple | None = None  # its first anchor, if no other context of its gram came yet
    for batch in batches:
        if not batch.num_rows:
            continue
        g, c, d, o, r = (batch.column(name).to_numpy() for name in ("gram", "context", "doc", "off", "right"))
        spans = r < 0
        out = [(np.full(spans.sum(), COVERED, np.int8), d[spans], o[spans], o[spans] - r[spans])]
        g, c, d, o, r = (v[~spans] for v in (g, c, d, o, r))
        if len(g):
            first = np.ones(len(g), bool)
            first[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
            same = g[0] == gram and c[0] == context
            first[0] = not same
            head = np.flatnonzero(first)
            # The first place of the context that each row belongs to.
            which = np.cumsum(first) - 1
            fd, fo = np.append(d[head], doc or 0), np.append(o[head], off or 0)  # index -1: the open one
            again = ~first & ((d != fd[which]) | (o != fo[which]))
            low = np.maximum(0, o - (LENGTH - GRAM))
            out.append((np.full(again.sum(), COVERED, np.int8), d[again], low[again], (o + r)[again]))
            if len(head):
                hg = g[head]
                joins = np.append(hg[1:] == hg[:-1], False)  # the next context has the same gram
                meets = joins | np.append(False, joins[:-1])
                if gram is not None and hg[0] == gram:
                    meets[0] = True
                    if waiting:
                        out.append((np.array([CANDIDATE], np.int8), np.array([waiting[0]]), np.array([waiting[1]]), np.array([waiting[2]])))
                        waiting = None
                elif waiting:
                    waiting = None
                hd, ho, hr = d[head], o[head], r[head]
                if not meets[-1]:
                    waiting = (hd[-1], ho[-1], ho[-1] + hr[-1])
                else:
                    waiting = None
                out.append((np.full(meets.sum(), CANDIDATE, np.int8), hd[meets], ho[meets], (ho + hr)[meets]))
                gram, context, doc, off = g[-1], c[-1], hd[-1], ho[-1]
        kind, doc_out, low_out, high_out = (np.concatenate(v) for v in zip(*out, strict=True))
        if len(kind):
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(doc_out.astype(np.int64)), pa.array(low_out.astype(np.int64)), pa.array(high_out.astype(np.int64))], schema=SPAN)


def cut_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lead, context, doc, off and low (the context's start) of each candidate of each text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            lead, context, docs, offs, lows = [], [], [], [], []
            for doc, text, places in zip(part.column("doc").to_pylist(), part.column("text").to_pylist(), part.column("offs").to_pylist(), strict=True):
                raw = (text or "").encode()
                for off in places:
                    if off + GRAM > len(raw):
                        continue  # found in another row with the same doc_id
                    low = max(0, off - (LENGTH - GRAM))
                    lead.append(raw[off : off + GRAM])
                    context.append(raw[low : off + LENGTH])
                    docs.append(doc)
                    offs.append(off)
                    lows.append(low)
            yield pa.RecordBatch.from_arrays([pa.array(lead, pa.binary()), pa.array(context, pa.binary()), pa.array(docs, pa.int64()), pa.array(offs, pa.int64()), pa.array(lows, pa.int64())], names=["lead", "context", "doc", "off", "low"])


def multikey_order(digest: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort strings by a digest, then, within runs that tie and differ, word by word.

    Returns the order and the class (equal strings) of each place in it.
    """
    order = np.argsort(digest, kind="stable")
    d = digest[order]
    new = np.ones(len(order), bool)
    new[1:] = d[1:] != d[:-1]
    differs = np.zeros(len(order), bool)
    tied = np.flatnonzero(~new)
    differs[tied] = (rows[order[tied]] != rows[order[tied - 1]]).any(axis=1)
    if differs.any():  # different strings with one digest: refine those runs on the next keys
        edges = np.append(np.flatnonzero(new), len(order))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if differs[a:b].any():
                order[a:b] = sorted(order[a:b], key=lambda i: rows[i].tobytes())
                new[a + 1 : b] = (rows[order[a + 1 : b]] != rows[order[a : b - 1]]).any(axis=1)
    return order, np.cumsum(new) - 1


def compare_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered windows of a bucket of sorted suffixes, and what must meet other pieces.

    kind COVERED: a span.  kind ACROSS: the first place of a window whose lead
    may go on in another piece, with two digests of its bytes.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(PIECE - rows, batch.num_rows - at)
            held.append(batch.slice(at, take))
            rows, at = rows + take, at + take
            if rows == PIECE:
                yield from _compare_piece(pa.Table.from_batches(held))
                held, rows = [], 0
    if rows:
        yield from _compare_piece(pa.Table.from_batches(held))


MEETING = pa.schema([*SPAN, ("a", pa.int64()), ("b", pa.int64())])


def _compare_piece(piece: pa.Table) -> Iterator[pa.RecordBatch]:
    lead = piece.column("lead").to_pylist()
    contexts = piece.column("context").to_pylist()
    doc, off, low = (piece.column(c).to_numpy() for c in ("doc", "off", "low"))
    outer = np.array([x == lead[0] or x == lead[-1] for x in lead])
    lengths = np.array([len(c) for c in contexts])
    ends = np.cumsum(lengths)
    x = np.frombuffer(b"".join(contexts), np.uint8)
    member = np.repeat(np.arange(len(contexts)), lengths)
    place = np.arange(len(x)) - (ends - lengths)[member]
    start = np.flatnonzero(place + LENGTH <= lengths[member])
    if not len(start):
        return
    owner = member[start]
    where_doc, where = doc[owner], low[owner] + place[start]
    strings = np.lib.stride_tricks.sliding_window_view(x, LENGTH)[start]
    first_digest = _window_hashes(x)[start]
    # Earlier places first, so that the first of each class is the earliest.
    by_place = np.lexsort((where, where_doc))
    order, cls = multikey_order(first_digest[by_place], strings[by_place])
    order = by_place[order]
    new = np.ones(len(order), bool)
    new[1:] = cls[1:] != cls[:-1]
    head = order[np.flatnonzero(new)[cls]]
    again = order[~new & ((where_doc[order] != where_doc[head]) | (where[order] != where[head]))]
    if len(again):
        d, lo, hi = _merged(where_doc[again], where[again], where[again] + LENGTH)
        none = pa.nulls(len(d), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), COVERED, np.int8)), pa.array(d), pa.array(lo), pa.array(hi), none, none], schema=MEETING)
    across = order[new & outer[owner[order]]]
    # A class whose first place has an inner lead may still hold outer members.
    outer_classes = np.unique(cls[outer[owner[order]]])
    across = order[np.flatnonzero(new)[outer_classes]] if len(outer_classes) else across
    if len(across):
        second = np.fromiter((xxhash.xxh3_64_intdigest(strings[i].tobytes()) for i in across), np.uint64, len(across))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(across), ACROSS, np.int8)), pa.array(where_doc[across]), pa.array(where[across]), pa.array(where[across] + LENGTH), pa.array(first_digest[across].view(np.int64)), pa.array(second.view(np.int64))], schema=MEETING)


def meet_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by digests and place: all but the first of each are covered; spans pass."""
    a = b = doc = at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind, d, lo, hi = (batch.column(c).to_numpy() for c in ("kind", "doc", "low", "high"))
        x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
        keep = kind == COVERED
        out = [(d[keep], lo[keep], hi[keep])]
        d, lo, hi, x, y = d[~keep], lo[~keep], hi[~keep], x[~keep].astype(np.int64), y[~keep].astype(np.int64)
        if len(d):
            first = np.ones(len(d), bool)
            first[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            first[0] = not (a is not None and x[0] == a and y[0] == b)
            head, which = np.flatnonzero(first), np.cumsum(first) - 1
            fd, fo = np.append(d[head], doc or 0), np.append(lo[head], at or 0)
            again = ~first & ((d != fd[which]) | (lo != fo[which]))
            out.append((d[again], lo[again], hi[again]))
            if len(head):
                a, b, doc, at = x[-1], y[-1], fd[len(head) - 1], fo[len(head) - 1]
        d, lo, hi = (np.concatenate(v) for v in zip(*out, strict=True))
        if len(d):
            d, lo, hi = _merged(d, lo, hi)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), COVERED, np.int8)), pa.array(d), pa.array(lo), pa.array(hi)], schema=SPAN)


def remove_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, n_removed, n_spans, kept and its digest."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            out = []
            for text, lows, highs in zip(part.column("text").to_pylist(), part.column("lows").to_pylist(), part.column("highs").to_pylist(), strict=True):
                raw = (text or "").encode()
                pieces, end, removed, spans = [], 0, 0, 0
                begin = 0
                for lo, hi in sorted(zip(lows or (), highs or (), strict=True)):
                    hi = min(hi, len(raw))
                    if hi <= end and spans or lo >= hi:
                        continue
                    if lo > end or not spans:
                        pieces.append(raw[begin:lo])
                        spans += 1
                        removed += hi - lo
                    else:
                        removed += hi - end
                    end = begin = hi
                pieces.append(raw[begin:])
                kept = b"".join(pieces)
                out.append((len(raw), removed, spans, kept, hashlib.sha256(kept).hexdigest()))
            n, removed, spans, kept, sha = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """doc and text, where ``doc`` tells texts apart and puts them in the order of doc_id; and the id of each doc.

    ``doc`` is the doc_id itself (and no table of ids is needed) unless one
    names several texts.  If any does, all texts are numbered in the order of
    doc_id (null first) and of a hash of the text.  Rows equal in doc_id and
    text are one document.
    """
    plain = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    hashed = docs.select(plain.alias("id"), F.xxhash64("text").alias("twin"))
    if hashed.groupBy("id").agg(F.min("twin").alias("a"), F.max("twin").alias("b")).where("a <> b").isEmpty():
        return docs.select(plain.alias("doc"), "text"), None
    # The ids of partitions and rows rise along the sorted ranges.
    ranked = cut(hashed.distinct().repartitionByRange("id", "twin").sortWithinPartitions("id", "twin").withColumn("doc", F.monotonically_increasing_id()))
    again = docs.select(plain.alias("id"), F.xxhash64("text").alias("twin"), "text")
    return again.join(ranked, ["id", "twin"]).select("doc", "text"), ranked.select("doc", "id")


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """doc, low, high (bytes) of strings of LENGTH bytes that start earlier too, as spans."""
    anchors = keyed.mapInArrow(find_anchors, "gram long, context long, doc long, off long, right int")
    dealt = anchors.repartition("gram").sortWithinPartitions("gram", "context", "doc", "off")
    compared = dealt.mapInArrow(compare_contexts, "kind byte, doc long, low long, high long")
    candidates = compared.where(F.col("kind") == CANDIDATE).groupBy("doc").agg(F.collect_set("low").alias("offs"))
    suffixes = keyed.repartition("doc").join(candidates, "doc").mapInArrow(cut_suffixes, "lead binary, context binary, doc long, off long, low long")
    buckets = suffixes.repartitionByRange("lead", "context", "doc", "off").sortWithinPartitions("lead", "context", "doc", "off")
    met = buckets.mapInArrow(compare_buckets, "kind byte, doc long, low long, high long, a long, b long")
    # Spans have no digests; a salt deals them out evenly.
    across = met.withColumn("salt", F.coalesce(F.col("a"), F.xxhash64("doc", "low"))).repartition("salt").sortWithinPartitions("salt", "a", "b", "doc", "low").drop("salt")
    settled = across.mapInArrow(meet_across, "kind byte, doc long, low long, high long")
    return compared.where(F.col("kind") == COVERED).unionByName(settled).select("doc", "low", "high")


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) and kept_sha256 of each row.

    Removed is each byte that lies in a string of 100 bytes which also starts
    earlier: in a row of smaller doc_id, or further up in the same text.
    Strings are judged on the input.  A null text counts as empty; texts under
    100 bytes stay whole.  A null doc_id counts as the smallest.  Of rows that
    repeat a doc_id with different texts one counts as the earlier, by a hash
    of the text; rows equal in doc_id and text are one document, so they lose
    the same bytes, and none to each other.  Extra columns are left out.
    """
    keyed, ids = numbered(docs)
    spans = repeated_spans(keyed).groupBy("doc").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    joined = keyed.repartition("doc").join(spans, "doc", "left")  # the texts are dealt out once for both uses
    joined = joined.withColumn("id", F.col("doc")) if ids is None else joined.join(ids, "doc")
    named = joined.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "text", "lows", "highs")
    return named.mapInArrow(remove_spans, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op10_suffixes(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 10 over the whole of ``documents``."""
    return dedup_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
