"""Byte-level BPE encoding and decoding by monoid tree reduction.

A piece (one match of the split pattern) is encoded by halves: short halves by
plain merging, longer ones recursively.  Two neighbouring encodings are joined
by re-encoding a window of tokens on both sides of the seam.  The window grows
until the tokens just outside it stay as they are.  That test is exact: a token
sequence is the encoding of its bytes if and only if each two neighbouring
tokens are the encoding of theirs, so two checked seams settle the join.
Decoding concatenates token bytes pairwise up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

#: Bytes up to which a piece is merged directly.
LEAF = 4
#: Bytes up to which a worker remembers what a string merges to.
SHORT = 8
#: Chunks that a worker remembers: the first ones, among them all frequent ones.
REMEMBER = 300_000
#: Pairs of tokens, and short strings, that a worker remembers before it starts anew.
REMEMBER_PAIRS = 100_000
#: Characters of a text that go to the tiktoken library at a time (up to the next seam).
BLOCK = 1 << 16
_NO_RANK = 1 << 62
MARKS = (".", ",", ";", ":", "!", "?")

#: A single blank between two non-blank characters: no match of the split
#: pattern reaches over it from the left, so text can be cut before it.
_SEAM = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile(r"[^\S \n]")
#: Two blanks in a row; what is a blank to ``re`` includes all that the split pattern's \s means.
_BLANKS = re.compile(r"\s\s")


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        # \s of the pattern means the Unicode property, nothing more.
        unicode_space = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pattern = regex.compile(unicode_space)
        self.leaf = leaf
        self._fits: dict[tuple[int, int], bool] = {}
        self._merged: dict[bytes, list[int]] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    # -- one piece ---------------------------------------------------------

    def merge(self, data: bytes) -> list[int]:
        """Plain merging: always the pair of lowest rank, the leftmost first."""
        n = len(data)
        if n <= SHORT:  # leaves and seams, most of which come again and again
            if (known := self._merged.get(data)) is None:
                if len(self._merged) > REMEMBER_PAIRS:
                    self._merged.clear()
                known = self._merged[data] = self._merge_short(data)
            return known
        if n <= 32:
            return self._merge_short(data)
        ranks = self.ranks
        start, after, before = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1))
        # A part is the bytes from i to after[i]; parts that were merged away have after -1.
        queue = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, end = heapq.heappop(queue)
            middle = after[i]
            if middle == -1 or middle >= n or after[middle] != end:
                continue  # one of the two parts has changed since
            after[i], after[middle] = end, -1
            if end < n:
                before[end] = i
                if (rank := ranks.get(data[i : after[end]])) is not None:
                    heapq.heappush(queue, (rank, i, after[end]))
            if (left := before[i]) >= 0 and (rank := ranks.get(data[left:end])) is not None:
                heapq.heappush(queue, (rank, left, end))
        out, i = [], start[0]
        while i < n:
            out.append(ranks[data[i : after[i]]])
            i = after[i]
        return out

    def _merge_short(self, data: bytes) -> list[int]:
        """The same by looking for the lowest rank anew after each merge."""
        ranks, none = self.ranks, _NO_RANK
        get, n = ranks.get, len(data)
        edge = list(range(n + 1))
        pair = [get(data[i : i + 2], none) for i in range(n - 1)]
        while pair and (least := min(pair)) != none:
            i = pair.index(least)
            del edge[i + 1], pair[i]
            if i < len(pair):
                pair[i] = get(data[edge[i] : edge[i + 2]], none)
            if i:
                pair[i - 1] = get(data[edge[i - 1] : edge[i + 1]], none)
        return [ranks[data[a:b]] for a, b in pairwise(edge)]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, are what their bytes encode to."""
        key = (left, right)
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > REMEMBER_PAIRS:
                self._fits.clear()
            known = self._fits[key] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's operation: the encoding of both byte strings in a row."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.merge(b"".join([self.bytes_of[t] for t in left[-i:] + right[:j]]))
            left_settled = i >= len(left) or self.fits(left[-i - 1], window[0])
            right_settled = j >= len(right) or self.fits(window[-1], right[j])
            if left_settled and right_settled:
                return left[: max(0, len(left) - i)] + window + right[j:]
            i = i if left_settled else min(2 * i, len(left))
            j = j if right_settled else min(2 * j, len(right))

    def reduce(self, data: bytes) -> list[int]:
        """The encoding of both halves, joined; up to ``leaf`` bytes are merged plainly."""
        if len(data) <= self.leaf:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.reduce(data[:half]), self.reduce(data[half:]))

    def piece(self, data: bytes) -> list[int]:
        """One match of the pattern; a match that is a token itself stays one."""
        return [whole] if (whole := self.ranks.get(data)) is not None else self.reduce(data)

    # -- texts -------------------------------------------------------------

    def matches(self, text: str) -> list[str]:
        """The pattern's matches; plain words with a mark after them need no search."""
        body = text[1:] if text[:1] == " " else text
        if body.isalpha() and max(body) < "\u0250":
            return [text]
        if body[-1:] in MARKS and (word := body[:-1]).isalpha() and max(word) < "\u0250":
            return [text[:-1], text[-1]]
        return self.pattern.findall(text)

    def encode(self, text: str) -> list[int]:
        found = self.matches(text)
        return self.piece(found[0].encode()) if len(found) == 1 else [t for match in found for t in self.piece(match.encode())]

    def decode(self, ids: list[int]) -> bytes:
        of = self.bytes_of
        return concatenated([of[i] for i in ids])


def concatenated(parts: list[bytes], fan: int = 32) -> bytes:
    """Concatenation up a tree of the given fan-in."""
    while len(parts) > 1:
        parts = [b"".join(parts[i : i + fan]) for i in range(0, len(parts), fan)]
    return parts[0] if parts else b""


class ChunkedCodec:
    """Encodes whole texts chunk by chunk and remembers chunks it has met.

    A chunk runs from one seam to the next; all but a text's first chunk keep
    the blank they begin with.
    """

    def __init__(self, codec: Codec):
        self.codec = codec
        self.first: dict[str, tuple] = {}
        self.later: dict[str, tuple] = {}
        self.text_of = {i: str(i).encode() for i in codec.bytes_of}

    def _chunk(self, chunk: str, blank: str, known: dict[str, tuple]) -> tuple:
        ids = self.codec.encode(blank + chunk)
        text = self.text_of
        got = (len(ids), b",".join([text[i] for i in ids]), self.codec.decode(ids), array("i", ids).tobytes())
        if len(chunk) <= 48 and len(known) < REMEMBER:
            known[chunk] = got
        return got

    def split(self, text: str) -> tuple[str, list[str]]:
        """The first chunk, and the others without the blank they begin with."""
        # Where every blank is a seam, a plain split does.
        odd = text[0] == " " or text[-1] == " " or "  " in text or "\n " in text or " \n" in text or _OTHER_SPACE.search(text)
        head, *tail = _SEAM.split(text) if odd else text.split(" ")
        return head, tail

    def chunks(self, text: str) -> list[tuple]:
        """(count, ids as text, decoded bytes, ids as 32-bit numbers) of each chunk in turn.

        Numbers and bytes alone, so that the garbage collector need not look at them.
        """
        if not text:
            return []
        head, tail = self.split(text)
        later, make = self.later, self._chunk
        out = [self.first.get(head) or make(head, "", self.first)]
        out += [later.get(chunk) or make(chunk, " ", later) for chunk in tail]
        return out

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join([c[3] for c in self.chunks(text)]), np.int32)


class LibraryCodec:
    """Ids alone, by the tiktoken library; a long text goes to it in blocks that end at seams."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.ranks = ranks
        # Where no two blanks (of any kind) stand in a row, ``\s+(?!\S)`` adds nothing to ``\s+``,
        # and without looking ahead the library searches by a faster engine.
        plain = pattern.replace(r"|\s+(?!\S)|\s+", r"|\s+")
        self.encoding, self.plain = (tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (pattern, plain))

    @classmethod
    @lru_cache(maxsize=2)
    def of(cls, path: str, pattern: str) -> LibraryCodec:
        return cls(Codec.load(path, pattern).ranks, pattern)

    def ids(self, text: str) -> np.ndarray:
        found, at = [], 0
        while at < len(text):
            seam = _SEAM.search(text, at + BLOCK) if len(text) - at > BLOCK else None
            block = text[at : seam.start() if seam else len(text)]
            found.append(np.array((self.encoding if _BLANKS.search(block) else self.plain).encode_ordinary(block), np.int32))
            at += len(block)
        return found[0] if len(found) == 1 else np.concatenate([np.empty(0, np.int32), *found])


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> ChunkedCodec:
    """A worker keeps its codec, and what it remembers, from task to task."""
    return ChunkedCodec(Codec.load(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: str = "digest") -> DataFrame:
    """Encode ``text`` of each row and decode the ids again.

    Returns per input row doc_id, n_tokens, ids_sha256 (of the decimal ids,
    joined by commas) and decoded_sha256; with ``keep="ids"`` also token_ids.
    A null text counts as empty: no tokens, digests of nothing.  Repeated rows
    stay, other columns are left out, an empty table gives an empty table.
    No shuffle; each task holds one Arrow batch and a bounded memory of chunks.
    ``path`` must be readable on the executors.
    """
    with_ids = keep == "ids"
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + ([("token_ids", pa.list_(pa.int32()))] if with_ids else []))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts, ids_sha, decoded_sha, ids = [], [], [], []
                for text in part.column("text").to_pylist():
                    chunks = coder.chunks(text or "")
                    counts.append(sum([c[0] for c in chunks]))
                    ids_sha.append(hashlib.sha256(b",".join([c[1] for c in chunks])).hexdigest())
                    decoded_sha.append(hashlib.sha256(concatenated([c[2] for c in chunks], 512)).hexdigest())
                    if with_ids:
                        ids.append(np.frombuffer(b"".join([c[3] for c in chunks]), np.int32))
                columns = [part.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, schema.field("token_ids").type)] if with_ids else []), schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(encode, ddl)


def decode_tokens(tokens: DataFrame, path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """Add ``decoded`` (binary) to rows with token ids; null ids give null.

    An id outside the rank file is an error, as the text can't be recovered.
    """
    names = [c for c in tokens.columns if c != "decoded"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path, pattern)
        for batch in batches:
            rows = batch.column(ids).to_pylist()
            out = [None if row is None else codec.decode(row) for row in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "decoded"])

    kept = tokens.select(*names)
    return kept.mapInArrow(decode, StructType([*kept.schema.fields, StructField("decoded", BinaryType())]))


def op8_byte_pairs(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 8 over the whole of ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
