"""Phrase collocations by SON partitioning.

1. Documents are dealt into ``SHARDS`` shards by a hash of their text.  A phrase
   with ``least`` occurrences has at least ``least / SHARDS`` of them in one shard,
   so each shard is mined completely at that local support, level by level: words
   and pairs first, then longer phrases whose shorter ones were locally frequent.
   A shard is no task: many tasks count its phrases, by 62 bits of hash.
2. The locally frequent hashes of all shards are united.
   Those that all shards together hold fewer than ``least`` times are left out: a
   hash's counts of all shards meet in one place, and are never below its phrase's.
3. One more pass counts all candidates globally, as strings; what a hash let
   through by chance is below ``least`` there, and goes.

The union travels as a bit set, which has an upper size.  Where it would be too
full to sieve, or the strings it lets through would take much more disk than the
texts, the last pass is made in several rounds, each for the keys of one range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ._shared import ASCII_LOWER, ASCII_UPPER, Scratch, shuffles_freed, table

LEAST = 10
LONGEST = 3
#: A candidate goes if a longer one that holds it has this share of its count, in percent.
HELD_PERCENT = 50
FIRST = 2000
#: Shards that are mined for themselves, a power of two: more of them would lower the local support to one.
SHARDS = 4
#: Bits of the set that carries the candidates, powers of two: at least 8 and at most 32 MB, whatever the input.
LEAST_BITS, SET_BITS = 1 << 26, 1 << 28
#: Rounds at most, a power of two: the upper bits of a key tell its round.  Beyond, sets are fuller and let more through.
ROUNDS = 16
#: Bytes that a counted string takes on disk, about, and times the bytes of all texts that a round's strings may take.
COUNTED, TEXT_SHARE = 24, 1.5
#: Bytes of text that are arrays at a time.
SLICE = 1 << 19
#: Counts that a task holds before it hands them on.
HELD = 1 << 19
#: Bytes of an Arrow batch, and texts that are Python objects at a time.
BATCH, TEXTS = 1 << 22, 200
#: Ways over which a frequent word is dealt where its phrases are joined to it.
SALTS = 8

_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(ASCII_UPPER.encode() + b"\t" + _ENDS, ASCII_LOWER.encode() + b" " + b"\n" * len(_ENDS))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of each value (a 64-bit finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as many as were asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(n + n // 4, b, np.uint64))) for b in (self.base, self.inverse))

    def of_slices(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A polynomial hash of each slice of ``data``, from sums over its beginning."""
        self.upto(len(data) + 1)
        sums = np.append(np.uint64(0), np.cumsum(data.astype(np.uint64) * self.up[: len(data)]))
        return (sums[end] - sums[start]) * self.down[start]


class Pieces:
    """Phrases of some texts: words of one piece in a row, with one blank in between.

    The first ``skip`` words only lead in: phrases that end in them are not counted.
    """

    def __init__(self, data: bytes, ends: np.ndarray, skip: int = 0):
        raw = np.frombuffer(data.translate(_PLAIN), np.uint8)
        inside = (raw != 32) & (raw != 10)
        before = np.append(False, inside[:-1])
        start = np.flatnonzero(inside & ~before)
        stop = np.flatnonzero(before & ~inside)  # texts end in a line feed
        self.skip, self.length = skip, stop - start
        self.piece = np.cumsum(raw == 10, dtype=np.int64)[start] if len(raw) else start
        self.text = np.searchsorted(ends, start, "right")
        self.data = raw[inside | before].copy()
        self.start = np.cumsum(self.length + 1) - self.length - 1
        self.data[self.start + self.length] = 32

    def of_size(self, size: int) -> np.ndarray:
        """Numbers of the first words of all phrases of so many words."""
        n = len(self.start) - size + 1
        if n <= 0:
            return np.empty(0, np.int64)
        first = np.flatnonzero(self.piece[:n] == self.piece[size - 1 :])
        return first[first + size > self.skip]

    def span(self, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        return self.start[first], self.start[first + size - 1] + self.length[first + size - 1]


def _slices(texts: list[bytes], longest: int) -> Iterator[tuple[bytes, np.ndarray, int, int]]:
    """(bytes, where texts end, number of the first text, words to skip) of a bounded number of bytes each.

    A longer text is cut behind a word; the next part begins ``longest - 1`` words earlier.
    """
    held, size, first = [], 0, 0
    for number, text in enumerate(texts):
        if held and size + len(text) > SLICE:
            yield b"\n".join(held) + b"\n", np.cumsum([len(t) + 1 for t in held]), first, 0
            held, size = [], 0
        if not held:
            first = number
        if len(text) <= SLICE:
            held.append(text)
            size += len(text) + 1
            continue
        plain, at, lead = text.translate(_PLAIN), 0, 0
        while at < len(plain):
            stop = min((p for p in (plain.find(b" ", at + SLICE), plain.find(b"\n", at + SLICE)) if p >= 0), default=len(plain)) if len(plain) - at > SLICE else len(plain)
            part = plain[lead:stop] + b"\n"
            yield part, np.array([len(part)]), number, len(plain[lead:at].split())
            at, lead = stop, stop
            for _ in range(longest - 1):  # back over a word and what is before it
                while lead and plain[lead - 1] in b" \n":
                    lead -= 1
                while lead and plain[lead - 1] not in b" \n":
                    lead -= 1
    if held:
        yield b"\n".join(held) + b"\n", np.cumsum([len(t) + 1 for t in held]), first, 0


_POWERS = _Powers(_BASE), _Powers(_OTHER)


def _phrases(batch: pa.RecordBatch, sizes: range, longest: int) -> Iterator[tuple]:
    """(phrases, first words by size, keys by size, texts by size) of each slice; keys differ by language."""
    langs = batch.column("lang").to_pylist()
    seed = {name: xxhash.xxh64_intdigest(name.encode()) for name in set(langs)}
    seeds = np.array([seed[name] for name in langs], np.uint64)
    for at in range(0, batch.num_rows, TEXTS):
        for data, ends, number, skip in _slices(batch.column("text").slice(at, TEXTS).cast(pa.binary()).to_pylist(), longest):
            found = Pieces(data, ends, skip)
            first = {n: found.of_size(n) for n in sizes}
            text = {n: at + number + found.text[first[n]] for n in sizes}
            key = {n: _mixed(_POWERS[0].of_slices(found.data, *found.span(first[n], n)) ^ seeds[text[n]]) for n in sizes}
            yield found, first, key, text


class BitSet:
    """A set of hashes of 62 bits in a power of two of bits: it never misses a member."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, keys: np.ndarray) -> np.ndarray:
        out, within = np.ones(len(keys), bool), np.uint64(64 * len(self.words) - 1)
        for place in ((keys & within), (keys >> np.uint64(_SECOND)) & within):
            out &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return out


#: First bits of a key that make its second place in a set, and its round; up to there no two uses share a bit.
_SECOND, _ROUND = 30, 62 - (ROUNDS.bit_length() - 1)


def bit_set(candidates: DataFrame, bits: int = LEAST_BITS) -> BitSet:
    """The candidates' bits; what reaches the driver is bounded by the set, not by their number."""
    low, high = F.col("key").bitwiseAND(bits - 1), F.shiftright("key", _SECOND).bitwiseAND(bits - 1)
    places = candidates.select(F.explode(F.array(low, high)).alias("place"))
    bit = F.expr("shiftleft(1L, cast(place & 63 AS INT))")
    with shuffles_freed(candidates.sparkSession):
        filled = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[filled.column("word").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)
    return BitSet(words)


def _bits(keys: int, fill: float) -> int:
    """Bits of a set of so many keys, each of which sets two."""
    bits = LEAST_BITS
    while bits < SET_BITS and 2 * keys > fill * bits:
        bits *= 2
    return bits


def locally_frequent(docs: DataFrame, sizes: range, least: int, longest: int, shorter: BitSet | None = None, in_all: int = 1) -> DataFrame:
    """key of each phrase of these sizes with ``least`` occurrences in one shard and ``in_all`` in all of them, and their number ``n``.

    ``docs`` has text, lang and shard.  With ``shorter``, a phrase counts only if
    both phrases of one word less are in it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(shorter) if shorter else None
    bits = SHARDS.bit_length() - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            return keys[begin], np.add.reduceat(counts, begin)

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("shard").to_numpy().astype(np.uint64)
            below = range(sizes[0] - 1, sizes[-1] + 1) if sent else sizes
            for found, first, key, text in _phrases(batch, below, longest):
                for n in sizes:
                    k, of = key[n], text[n]
                    if sent:
                        frequent = np.zeros(len(found.start) + 1, bool)
                        frequent[first[n - 1]] = sent.value.has(key[n - 1] >> np.uint64(bits))
                        # The lead-in of a cut text has no key of its own: it rules nothing out.
                        frequent[: found.skip] = True
                        both = frequent[first[n]] & frequent[first[n] + 1]
                        k, of = k[both], of[both]
                    if len(k):
                        held.append(np.unique((k >> np.uint64(bits) << np.uint64(bits)) | shard[of], return_counts=True))
                if sum(len(k) for k, _ in held) > HELD:
                    held = [merged()]
                    if len(held[0][0]) > HELD // 2:
                        yield from _counts(*held.pop())
        if held:
            yield from _counts(*merged())

    # Counts are combined in Python already; a second time before the shuffle would only take memory.
    phrase = F.expr(f"shiftrightunsigned(key, {bits})")
    dealt = docs.mapInArrow(count, "key long, n long").repartition(phrase).select(phrase.alias("key"), F.col("key").bitwiseAND(SHARDS - 1).alias("shard"), "n")
    shards = [f"n{s}" for s in range(SHARDS)]
    counted = dealt.groupBy("key").agg(*[F.sum(F.when(F.col("shard") == s, F.col("n")).otherwise(0)).alias(name) for s, name in enumerate(shards)])
    total = reduce(lambda x, y: x + y, map(F.col, shards))
    return counted.where((F.greatest(*shards) >= least) & (total >= in_all)).select("key", total.alias("n"))


def _counts(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)].view(np.int64)), pa.array(counts[at : at + (1 << 16)])], names=["key", "n"])


def counted_phrases(docs: DataFrame, longest: int, sieve: BitSet, number: int = 0, rounds: int = 1) -> DataFrame:
    """lang, size, phrase, key and n, partly summed, of all phrases in ``sieve``; size 0 has all words of a language.

    Of several rounds, that of this number has the phrases of its keys, the first also the words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(sieve)
    bits, kind = SHARDS.bit_length() - 1, pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("key", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = batch.column("lang")
            for found, first, key, text in _phrases(batch, range(1, longest + 1), longest):
                words = np.bincount(text[1], minlength=len(langs))
                some = np.flatnonzero(words) if number == 0 else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(some)), pa.array(np.zeros(len(some), np.int32)), pa.array([""] * len(some)), pa.array(np.zeros(len(some), np.int64)), pa.array(words[some])], schema=kind)
                for n in range(1, longest + 1):
                    k, at, of = key[n], first[n], text[n]
                    if rounds > 1:
                        own = k >> np.uint64(_ROUND + bits) & np.uint64(rounds - 1) == number
                        k, at, of = k[own], at[own], of[own]
                    into = sent.value.has(k >> np.uint64(bits))
                    k, at, of = k[into], at[into], of[into]
                    start, end = found.span(at, n)
                    other = _POWERS[1].of_slices(found.data, start, end)
                    # Of one key, a second hash and the length tell phrases apart; then strings do.
                    order = np.lexsort((end - start, other, k)) if _ambiguous(k, other, end - start) else np.argsort(k, kind="stable")
                    k, start, end, of, other = (x[order] for x in (k, start, end, of, other))
                    begin = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (other[1:] != other[:-1]) | (end[1:] - start[1:] != end[:-1] - start[:-1]))) if len(k) else np.empty(0, np.int64)
                    n_of = np.diff(np.append(begin, len(k)))
                    for a in range(0, len(begin), 1 << 15):
                        b = begin[a : a + (1 << 15)]
                        yield pa.RecordBatch.from_arrays(
                            [langs.take(pa.array(of[b])), pa.array(np.full(len(b), n, np.int32)), _strings(found.data, start[b], end[b]), pa.array((k[b] >> np.uint64(bits)).view(np.int64)), pa.array(n_of[a : a + (1 << 15)])],
                            schema=kind,
                        )

    return docs.select("text", "lang").mapInArrow(count, "lang string, size int, phrase string, key long, n long")


def _ambiguous(key: np.ndarray, other: np.ndarray, length: np.ndarray) -> bool:
    """Whether two phrases share a key."""
    order = np.argsort(key, kind="stable")
    k, o, n = key[order], other[order], length[order]
    return bool(((k[1:] == k[:-1]) & ((o[1:] != o[:-1]) | (n[1:] != n[:-1]))).any())


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    length = end - start
    offsets = np.append(0, np.cumsum(length))
    body = data[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body))


def _rounds(candidates: DataFrame, docs: DataFrame, keys: int, fill: float) -> int:
    """Rounds of the last pass: so many that a set is filled to ``fill`` and that what it lets through stays below a multiple of all texts' bytes."""
    parts = docs.select(F.octet_length("text").alias("size"), F.spark_partition_id().alias("part"))
    texts, tasks = parts.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("part") + 1, F.lit(1))).first()
    # A task hands on a row for each of its phrases.
    rows = candidates.agg(F.sum(F.least("n", F.lit(tasks)))).first()[0] or 0
    most, rounds = max(2 * keys / SET_BITS, 1e-9), 1
    while rounds < ROUNDS and (most > rounds * fill or rows * COUNTED > rounds * TEXT_SHARE * texts):
        rounds *= 2
    return rounds


def frequent_phrases(docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST, fill: float = 0.25) -> DataFrame:
    """lang, size, phrase, n of all phrases of 1 to ``longest`` words with ``least`` occurrences; size 0: all words.

    ``fill`` is the share of a bit set's bits above which there are several rounds.
    """
    local = -(-least // SHARDS)
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang")).withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(SHARDS)).cast("int"))
    united, keys, shorter = None, 0, None
    for n in range(min(2, longest), longest + 1):
        level = scratch.keep(locally_frequent(rows, range(1 if n <= 2 else n, n + 1), local, longest, shorter, least), f"level-{n}")
        united = level if united is None else united.unionByName(level)
        keys += (own := level.count())
        # Without a set all phrases of the next level are counted; the result is the same.
        shorter = bit_set(level, _bits(own, fill)) if n < longest and 2 * own <= fill * SET_BITS else None
    rounds, found = _rounds(united, rows, keys, fill), []
    for number in range(rounds):
        own = united.where(F.shiftright("key", _ROUND).bitwiseAND(rounds - 1) == number)
        counted = counted_phrases(rows, longest, bit_set(own, _bits(keys // rounds, fill)), number, rounds)
        part = counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("size") == 0))
        found.append(scratch.keep(part, f"frequent-{number}"))
    scratch.drop(*[f"level-{n}" for n in range(min(2, longest), longest + 1)])
    return reduce(DataFrame.unionByName, found)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, held_percent: int = HELD_PERCENT, first: int = FIRST, fill: float = 0.25) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases.

    Texts lose their capitals A-Z and are split at ``[.,;:!?\\x0A-\\x0D]`` into
    pieces, those at blanks and tabs into words.  Candidates have 2 to
    ``longest`` words and a >= ``least`` occurrences, overlapping ones included.
    Of all cuts into two parts with l and r occurrences the one with the least
    floor(1000000 a a / (l r)) counts, of equal ones the first.  Candidates within
    a longer one that has ``held_percent`` of their count go.  A null text is
    empty, a null lang is ``und``; repeated rows count each, and other columns
    play no part.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, BATCH)
    known = frequent_phrases(docs, scratch, least, longest, fill)
    # Parts of one word may be in very many phrases, so both sides are dealt over several ways.
    words = F.split("phrase", " ")
    one = F.instr("part", " ") == 0
    parts = known.where(f"size between 1 and {longest - 1}").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    parts = parts.withColumn("salt", F.explode(F.when(one, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    salt = F.when(one, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(0).cast("int")
    longer = known.where("size >= 2").select("lang", "phrase", F.col("n").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = longer.withColumn("left", F.array_join(F.slice(words, 1, F.col("k")), " ")).withColumn("right", F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " "))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.withColumnRenamed(side, "part").withColumn("salt", salt).join(parts, ["lang", "part", "salt"]).withColumnRenamed("f", name).drop("part", "salt")
    score = F.expr("(1000000 * cast(a as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Phrases within longer ones: the largest count of a longer one.
    inner = known.where(f"size between 3 and {longest}").select("lang", "n", "size", words.alias("w"))
    inner = inner.withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1))).withColumn("i", F.explode(F.expr("sequence(1, size - m + 1)")))
    within = inner.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("n").alias("longer"))
    left = scored.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < held_percent * F.col("a")))
    order = W.Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    totals = known.where("size = 0").select("lang", F.col("n").alias("total"))
    out = best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").cast("long").alias("score"))
    out = scratch.keep(out, "result")
    scratch.drop_all_but("result")
    return out


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 11 over the whole of ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))


COLLOCATIONS_SQL = f"""
WITH piece AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(body, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS body FROM documents)
), total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM piece GROUP BY lang
), word AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece
), f AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS n
  FROM word, (VALUES (1), (2), (3)) AS s(size) WHERE i + size - 1 <= len(w) GROUP BY ALL HAVING count(*) >= {LEAST}
), cut AS (
  SELECT lang, phrase, n AS a, size, k, string_split(phrase, ' ') AS w FROM f, (VALUES (1), (2)) AS c(k) WHERE size >= 2 AND k < size
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.size, c.k, x.n AS l, y.n AS r,
         CAST((1000000::HUGEINT * c.a * c.a) // (x.n::HUGEINT * y.n) AS BIGINT) AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 : c.size], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), held AS (
  SELECT lang, array_to_string(w[k : k + 1], ' ') AS phrase, max(a) AS longer FROM cut WHERE size = 3 GROUP BY ALL
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase
  WHERE h.longer IS NULL OR 100 * h.longer < {HELD_PERCENT} * b.a
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN total t ON t.lang = r.lang WHERE r.rank <= {FIRST}
"""
