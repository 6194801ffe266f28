"""Byte-level BPE encoding and decoding by a monoid tree reduction.

The encodings of byte strings form a monoid: a string is cut into halves, the halves are encoded on
their own, and two neighbours are joined by encoding a window around the cut again. A sequence of tokens
is *the* encoding of its bytes if and only if each neighbouring pair of tokens encodes to itself: a merge
that would cross a boundary first has the lowest rank in the whole string, so it has it in the pair as
well. The window grows until the pairs at both its edges pass that test; then no token outside it can
change. Decoding concatenates the tokens' bytes, up the same tree.

A text is first split by a pattern, and each match is encoded separately (a match that is a token itself
becomes that token); the tree's upper levels concatenate. One map over the rows, no shuffle; a worker
keeps the encodings of a bounded number of short matches and strings, the ones met lately.

Defined results: a null or empty text has no tokens and decodes to no bytes; a null key stays null; rows
that repeat give equal rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, trim

#: A string of at most so many bytes is a leaf of the tree; so many tokens are one when decoding.
LEAF, TOKENS = 6, 256
#: Matches of at most MATCH characters and strings of at most SHORT bytes are kept, twice so many of each.
CACHE, MATCH, SHORT = 120_000, 32, 16
NO_RANK = 1 << 60


class Codec:
    """The encoder and decoder of one vocabulary: tokens' bytes with their ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        # the tokenizer's \s is Unicode's White_Space
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.known = _Recent(self.encode_match, MATCH)
        self.short = _Recent(self.merge, SHORT)

    def forget(self) -> None:
        """Drop what was met, at the end of a task: a worker lives on, and other stages need the room."""
        for kept in (self.fits, self.known, self.known.old, self.short, self.short.old):
            kept.clear()
        trim()

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}, pattern)

    def merge(self, data: bytes) -> list[int]:
        """A leaf: merge the neighbours of the lowest rank, the leftmost first, until none is left."""
        if len(data) > 64:
            return self._merge_long(data)
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i : i + 2], NO_RANK) for i in range(len(data) - 1)]
        while pairs and (low := min(pairs)) < NO_RANK:
            at = pairs.index(low)
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], NO_RANK)
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1], NO_RANK)
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same for a long string, by a heap over a linked list."""
        n, ranks = len(data), self.ranks
        end = list(range(1, n + 1))  # of the part that starts here; 0: it was merged away
        before = list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            mid = end[at]
            if not mid or mid >= n or ranks.get(data[at : end[mid]]) != rank:
                continue
            end[at], end[mid] = end[mid], 0
            if end[at] < n:
                before[end[at]] = at
                if (r := ranks.get(data[at : end[end[at]]])) is not None:
                    heapq.heappush(heap, (r, at))
            if at and (r := ranks.get(data[before[at] : end[at]])) is not None:
                heapq.heappush(heap, (r, before[at]))
        out, at = [], 0
        while at < n:
            out.append(ranks[data[at : end[at]]])
            at = end[at]
        return out

    def pair(self, a: int, b: int) -> bool:
        """The bytes of the two tokens encode to the two tokens."""
        ok = self.fits.get((a, b))
        if ok is None:
            if len(self.fits) >= 4 * CACHE:
                self.fits.clear()
            ok = self.fits[a, b] = self.short[self.bytes[a] + self.bytes[b]] == [a, b]
        return ok

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's operation."""
        if not left or not right:
            return left or right
        i = j = 1
        if self.pair(left[-1], right[0]):
            return left + right
        while True:
            window = self.short[b"".join(map(self.bytes.__getitem__, left[-i:] + right[:j]))]
            left_ok = i == len(left) or self.pair(left[-i - 1], window[0])
            right_ok = j == len(right) or self.pair(window[-1], right[j])
            if left_ok and right_ok:
                return left[:-i] + window + right[j:]
            i, j = min(len(left), i if left_ok else 2 * i), min(len(right), j if right_ok else 2 * j)

    def encode_bytes(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.short[data]
        half = len(data) // 2
        return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def encode_match(self, match: str) -> tuple[int, ...]:
        data = match.encode()
        rank = self.ranks.get(data)
        return (rank,) if rank is not None else tuple(self.encode_bytes(data))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text))))

    def decode(self, ids) -> bytes:
        """Up the tree: the bytes of a few tokens are a leaf, and neighbours are joined until one string is left."""
        parts = [b"".join(map(self.bytes.__getitem__, ids[i : i + TOKENS])) for i in range(0, len(ids), TOKENS)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


class _Recent(dict):
    """Results of a function for short arguments met before, in two generations of at most CACHE each."""

    def __init__(self, of, longest: int):
        self.of, self.longest, self.old = of, longest, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.of(key)
        if len(key) <= self.longest:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """A worker loads a vocabulary once."""
    return Codec.load(path, pattern)


def _ids(rows: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids): the tokens of each row's whole text."""
    return _run(docs, path, pattern, text, key, False)


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded): the tokens of each row's whole text and the bytes that they decode to."""
    return _run(docs, path, pattern, text, key, True)


def _run(docs: DataFrame, path: str, pattern: str, text: str, key: str, back: bool) -> DataFrame:
    names = [key, "ids", *["decoded"] * back]

    def run(batches):
        c = codec(path, pattern)
        for b in chunks(batches):
            rows = [c.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _ids(rows), *[pa.array(map(c.decode, rows), pa.binary())] * back], names)
        c.forget()

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, ids array<int>" + ", decoded binary" * back)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, decoded): the bytes of each row's tokens (null: none)."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or ()) for x in b.column(1).to_pylist()], pa.binary())], [key, "decoded"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {dict(encoded.dtypes)[key]}, decoded binary")


def ids_sha256(ids: str = "ids") -> Column:
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The query's form."""
    return encode_decode(docs, path, pattern).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_sha256().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
