"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact check.

A window of a text has as many words as the benchmark item it is held against.
A similar one shares at least one of the item's rarest shingles, those that
outweigh what may be missing, so items are looked up by these and fingerprints
computed for such windows alone.  They have 256 bits in 8 blocks: of a
fingerprint within the radius at least one block lies within an eighth of the
radius of the item's, which few others do.  What passes is checked exactly, by
the weighted Jaccard similarity of the two multisets of shingles.  (Blocks are a
test here, not tables: a quarter of the bits may differ, and a block has too many
neighbours at that distance to be looked up by its value.)
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, table

WORDS = 5
SIMILARITY = 0.8
BITS, BLOCKS = 256, 8
#: Bits that fingerprints of windows at the least similarity may differ in: the
#: expected 256 * acos(0.89) / pi = 38.8 bits and more than four deviations (of 5.7) on top.
RADIUS = 64
#: Benchmark text that travels with the tasks at once; a larger benchmark is read in blocks.
BLOCK_BYTES = 16 << 20
#: Shingles or windows whose bits are held at once.
CHUNK = 2048
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def tokens(text: str | None) -> list[bytes]:
    """Words: ASCII lower-cased runs of non-blank bytes."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """A 64-bit hash of each k words in a row, computed for the whole text at once."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for d in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[d : d + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _bits(hashes: np.ndarray) -> np.ndarray:
    """-1 or +1 for each of the 256 bits that are drawn from each hash."""
    drawn = (hashes[:, None] ^ (hashes[:, None] >> np.uint64(31))) * _SPREAD
    drawn ^= drawn >> np.uint64(32)
    return np.unpackbits(drawn.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def _prints(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of four 64-bit numbers."""
    return np.packbits(sums > 0, axis=1).view(np.uint64)


class Index:
    """Benchmark items by shingle, and their fingerprints by Hamming block."""

    def __init__(self, items: list[tuple[int, str | None]], words: int, similarity: float, radius: int):
        self.similarity, self.radius = similarity, radius
        self.items, by_shingle = [], defaultdict(set)
        self.met = self.near_ones = 0  # windows that were fingerprinted, and those that the index returned
        spread: Counter = Counter()  # items that hold a shingle
        for item_id, text in items:
            found = tokens(text)
            if not found:
                continue
            k = min(words, len(found))
            weights = Counter(shingle_hashes(found, k).tolist())
            self.items.append((item_id, len(found), k, weights))
            spread.update((k, h) for h in weights)
        for at, (_, _, k, weights) in enumerate(self.items):
            # A similar window shares ``similarity`` of the item's weight at least, so not all of the rest can be
            # missing: the rarest shingles that outweigh it find every such window, and boilerplate finds none.
            left = (1 - similarity) * weights.total() + 1e-9
            for h, weight in sorted(weights.items(), key=lambda w, k=k: (spread[(k, w[0])], w[0])):
                by_shingle[(k, h)].add(at)
                left -= weight
                if left < 0:
                    break
        self.sizes = sorted({k for _, _, k, _ in self.items})
        self.known = {k: np.array(sorted(h for size, h in by_shingle if size == k), dtype=np.uint64) for k in self.sizes}
        self.by_shingle = by_shingle
        self.prints = [_prints(self._sum(c)) for *_, c in self.items]

    @staticmethod
    def _sum(weights: Counter) -> np.ndarray:
        hashes, counts = np.array(list(weights), np.uint64), np.array(list(weights.values()))
        total = np.zeros((1, BITS), np.int64)
        for at in range(0, len(hashes), CHUNK):
            total += (_bits(hashes[at : at + CHUNK]) * counts[at : at + CHUNK, None]).sum(axis=0)
        return total

    def near(self, item: int, prints: np.ndarray) -> np.ndarray:
        """Which fingerprints have a block near the item's and lie within the radius as a whole."""
        apart = np.bitwise_count((prints ^ self.prints[item]).view(np.uint32).reshape(-1, BLOCKS))
        found = np.flatnonzero(apart.min(axis=1) <= self.radius // BLOCKS)
        return found[apart[found].sum(axis=1) <= self.radius]

    def search(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item_id, first word, words, similarity): the best window of each run of similar ones."""
        found, words = [], tokens(text)
        for k in self.sizes:
            hashes = shingle_hashes(words, k)
            if not len(hashes):
                continue
            place = np.searchsorted(self.known[k], hashes)
            hit = np.flatnonzero(self.known[k][np.minimum(place, len(self.known[k]) - 1)] == hashes)
            places: dict[int, list[int]] = defaultdict(list)
            for p in hit.tolist():
                for item in self.by_shingle[(k, int(hashes[p]))]:
                    places[item].append(p)
            for item, at in places.items():
                found += self._windows(item, hashes, np.array(at), len(words))
        return found

    def _windows(self, item: int, hashes: np.ndarray, at: np.ndarray, n_words: int) -> list[tuple[int, int, int, float]]:
        item_id, size, k, weights = self.items[item]
        span = size - k + 1  # shingles of a window
        if n_words <= size:
            starts, length = np.array([0]), len(hashes)
        else:
            # Windows with a shared shingle: counted by running sums, so memory follows the text's length.
            count = np.zeros(len(hashes) + 1, np.int64)
            count[at + 1] = 1
            np.cumsum(count, out=count)
            starts, length = np.flatnonzero(count[span:] > count[:-span]), span
        if not len(starts):
            return []
        best: list[tuple[int, int, int, float]] = []
        # Cut where windows have nothing in common, and every so often, which bounds memory.
        cuts = (np.diff(starts) > length) | (np.diff(starts // CHUNK) > 0)
        for group in np.split(starts, np.flatnonzero(cuts) + 1):
            near = group[self.near(item, _prints(self._sums(hashes, group, length)))]
            self.met += len(group)
            self.near_ones += len(near)
            for start, both in zip(near.tolist(), self._overlaps(hashes, near.tolist(), length, weights), strict=True):
                similarity = both / (length + span - both)
                if similarity >= self.similarity:
                    row = (item_id, start, min(size, n_words), similarity)
                    if best and start < best[-1][1] + size:  # windows that overlap are one finding
                        best[-1] = max(best[-1], row, key=lambda r: (r[3], -r[1]))
                    else:
                        best.append(row)
        return best

    @staticmethod
    def _sums(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """Sums of bits of the windows that begin at ``starts`` (rising, closer than a window): the first whole, the others by what comes and goes."""
        low, high = int(starts[0]), int(starts[-1])
        first = np.zeros(BITS, np.int64)
        for at in range(low, low + length, CHUNK):
            first += _bits(hashes[at : min(at + CHUNK, low + length)]).sum(axis=0)
        moved = np.zeros((high - low + 1, BITS), np.int32)
        for at in range(low, high, CHUNK):
            stop = min(at + CHUNK, high)
            moved[at + 1 - low : stop + 1 - low] = _bits(hashes[at + length : stop + length]) - _bits(hashes[at:stop])
        np.cumsum(moved, axis=0, out=moved)
        return first + moved[starts - low]

    @staticmethod
    def _overlaps(hashes: np.ndarray, starts: list[int], length: int, weights: Counter) -> Iterator[int]:
        """Shingles that each window shares with the item, repeats counted; windows slide from one start to the next."""
        have: Counter = Counter()
        both, begin, end = 0, 0, 0
        for start in starts:
            if start >= end:  # nothing in common with the last window
                have, both, begin, end = Counter(), 0, start, start
            for h in hashes[begin:start].tolist():
                both -= have[h] <= weights.get(h, 0)
                have[h] -= 1
            for h in hashes[end : start + length].tolist():
                have[h] += 1
                both += have[h] <= weights.get(h, 0)
            begin, end = start, start + length
            yield both


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity of every window of a text similar to an item.

    Overlapping windows of one item are one row, the most similar (then the
    first) of them.  An item with fewer words than a shingle is one shingle.  Null or empty texts and
    items match nothing; repeated rows are searched each for themselves; an
    empty benchmark finds nothing.  Extra columns are left out.

    The benchmark is cut into blocks of at most ``block_bytes`` of text, which
    bounds what the driver holds and what is sent to a task; each block is one
    pass over the documents, whose findings are written before the next begins.
    """
    schema = "doc_id long, item_id long, first_word long, n_words long, similarity double"

    def pass_over(items: list) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(items, words, similarity, radius)
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for hit in index.search(t)]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, schema)

    count, blocks = _blocks(benchmark, block_bytes)
    if count == 1:
        return pass_over(next(blocks))
    scratch = Scratch(docs.sparkSession)
    found = [scratch.keep(pass_over(items), f"findings-{i}") for i, items in enumerate(blocks)]
    return reduce(DataFrame.unionByName, found)


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Iterator[list]]:
    """How many blocks the items make, and the blocks, one collected after the other."""
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    return count, ([(r["item_id"], r["text"]) for r in sized.where(of == block).orderBy("item_id", "text").collect()] for block in range(count))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose own text has no finding: a filter, without a shuffle.

    Rows without a doc_id and rows that repeat one are judged by their text like others.
    """
    count, blocks = _blocks(benchmark, block_bytes)
    scratch = Scratch(docs.sparkSession) if count > 1 else None
    for number, items in enumerate(blocks):

        def clean(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = Index(items, words, similarity, radius)
            for batch in batches:
                yield batch.filter(pa.array([not index.search(t) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
        if scratch:
            docs = scratch.keep(docs, f"clean-{number}")
            scratch.drop(f"clean-{number - 1}")
    return docs


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every benchmark passage found in the whole of ``documents``."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
