"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is a linked list of byte pieces. Mergeable neighbours wait in one bucket per merge
rank; a two-level bitmap marks the buckets in use, and find-first-set on it picks the lowest rank.
Entries whose neighbours changed since are skipped when they come up. A pre-token of n bytes takes
O(n log n) steps, so very long ones (no spaces, base64, long runs of white space) stay cheap.

Defined results: null text encodes like an empty text, to no ids; ids outside the vocabulary (or null)
decode to no bytes; null id lists decode to no bytes; extra columns pass through.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct pre-tokens of a generation of the worker's cache; it keeps two. A pre-token enters when it comes a second time.
CACHE_ENTRIES = 250_000
#: Marks of pre-tokens seen once, by hash.
SEEN = 1 << 22
#: Longer pre-tokens are not kept.
CACHE_CHARS = 64


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class _Vocabulary(dict):
    def __missing__(self, rank: int) -> bytes:
        return b""


@lru_cache(maxsize=4)
def _vocabulary(path: str) -> _Vocabulary:
    return _Vocabulary((rank, token) for token, rank in load_ranks(path).items())


#: The bits of a word of the lower level; the upper level is one integer, with a bit per word of however many ranks.
_BIT = [1 << i for i in range(256)]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token.

    ``buckets[rank]`` is a position or a heap of them; ``words`` holds the lower level of the bitmap in words of
    256 ranks, ``top`` a bit per word that is not zero. The queue is written out in the loop, as a call per
    entry would take most of the time.
    """
    rank_of = ranks.get
    whole = rank_of(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    waiting = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)]  # the rank of the pair that starts here
    waiting.append(-1)
    buckets: dict[int, int | list[int]] = {}
    words: dict[int, int] = {}
    top = 0
    for at, rank in enumerate(waiting):
        if rank >= 0:
            if rank in buckets:
                bucket = buckets[rank]
                if type(bucket) is int:
                    buckets[rank] = [bucket, at]
                else:
                    bucket.append(at)
            else:
                buckets[rank] = at
                word = rank >> 8
                if word in words:
                    words[word] |= _BIT[rank & 255]
                else:
                    words[word] = _BIT[rank & 255]
                    top |= 1 << word
    while top:
        word = (top & -top).bit_length() - 1
        bits = words[word]
        bit = bits & -bits
        rank = (word << 8) + bit.bit_length() - 1
        left = buckets[rank]
        if type(left) is int:
            del buckets[rank]
            bits ^= bit
            if bits:
                words[word] = bits
            else:
                del words[word]
                top &= top - 1
        else:
            bucket = left
            left = heappop(bucket)
            if len(bucket) == 1:
                buckets[rank] = bucket[0]
        if waiting[left] != rank:
            continue  # a neighbour was merged since
        right = after[left]
        end = after[right]
        after[left] = end
        before[end] = left
        waiting[right] = -1
        if end < n:
            waiting[left] = rank = rank_of(piece[left : after[end]], -1)
            if rank >= 0:
                if rank in buckets:
                    bucket = buckets[rank]
                    if type(bucket) is int:
                        buckets[rank] = [bucket, left] if bucket < left else [left, bucket]
                    else:
                        heappush(bucket, left)
                else:
                    buckets[rank] = left
                    word = rank >> 8
                    if word in words:
                        words[word] |= _BIT[rank & 255]
                    else:
                        words[word] = _BIT[rank & 255]
                        top |= 1 << word
        else:
            waiting[left] = -1
        if left:
            left = before[left]
            waiting[left] = rank = rank_of(piece[left:end], -1)
            if rank >= 0:
                if rank in buckets:
                    bucket = buckets[rank]
                    if type(bucket) is int:
                        buckets[rank] = [bucket, left] if bucket < left else [left, bucket]
                    else:
                        heappush(bucket, left)
                else:
                    buckets[rank] = left
                    word = rank >> 8
                    if word in words:
                        words[word] |= _BIT[rank & 255]
                    else:
                        words[word] = _BIT[rank & 255]
                        top |= 1 << word
    ids, at = [], 0
    while at < n:
        end = after[at]
        ids.append(ranks[piece[at:end]])
        at = end
    return ids


class _Known(dict):
    """Packed int32 ids by pre-token: a generation of entries, and the one before it as a fallback."""

    def __init__(self, ranks: dict[bytes, int], entries: int) -> None:
        super().__init__()
        self.ranks, self.entries = ranks, entries
        self.earlier: dict[str, bytes] = {}
        self.seen = bytearray(SEEN)

    def __missing__(self, token: str) -> bytes:
        ids = self.earlier.get(token)
        if ids is None:
            ids = array("i", merge_bytes(token.encode("utf-8", "surrogatepass"), self.ranks)).tobytes()
            at = hash(token) & (SEEN - 1)
            if not self.seen[at]:
                self.seen[at] = 1
                return ids
        if len(token) <= CACHE_CHARS:
            if len(self) >= self.entries:
                self.earlier = dict(self)
                self.clear()
                self.seen = bytearray(SEEN)
            self[token] = ids
        return ids


class Encoder:
    """Splits by ``pattern`` and merges each match on its own; gives the ids as packed int32."""

    def __init__(self, path: str, pattern: str, entries: int = CACHE_ENTRIES) -> None:
        self.split = regex.compile(pattern).findall
        self.known = _Known(load_ranks(path), entries)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.split(text)))


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str, entries: int) -> Encoder:
    return Encoder(path, pattern, entries)


_IDS = T.ArrayType(T.IntegerType(), False)


def _encoded(texts: pa.Array, path: str, pattern: str, entries: int) -> pa.Array:
    encoder = _encoder(path, pattern, entries)
    rows = [encoder(value.as_py() or "") for value in texts]
    ends = np.cumsum([0, *map(len, rows)]) // 4
    values = pa.array(np.frombuffer(b"".join(rows), dtype=np.int32))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _decoded(lists: pa.Array, path: str) -> pa.Array:
    token = _vocabulary(path).__getitem__
    if lists.null_count or lists.values.null_count:
        return pa.array([b"".join(map(token, one.as_py() or ())) for one in lists], pa.binary())
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    spans = zip(ends[:-1], ends[1:], strict=True)
    return pa.array([b"".join(map(token, flat[a:b].tolist())) for a, b in spans], pa.binary())


def encode(text: Column, path: str, pattern: str, entries: int = CACHE_ENTRIES) -> Column:
    """array<int> of the ids of ``text``, without special tokens; a worker caches two generations of ``entries`` pre-tokens."""

    @F.arrow_udf(_IDS)
    def ids_of(texts: pa.Array) -> pa.Array:
        return _encoded(texts, path, pattern, entries)

    return ids_of(text)


def decode(ids: Column, path: str) -> Column:
    """binary: the bytes that ``ids`` stand for."""

    @F.arrow_udf(T.BinaryType())
    def bytes_of(lists: pa.Array) -> pa.Array:
        return _decoded(lists, path)

    return bytes_of(ids)


def encode_and_decode(text: Column, path: str, pattern: str, entries: int = CACHE_ENTRIES) -> Column:
    """struct<ids, decoded>: what :func:`encode` gives and what :func:`decode` makes of it, in one worker."""

    @F.arrow_udf(T.StructType().add("ids", _IDS).add("decoded", T.BinaryType()))
    def both(texts: pa.Array) -> pa.Array:
        ids = _encoded(texts, path, pattern, entries)
        return pa.StructArray.from_arrays([ids, _decoded(ids, path)], ["ids", "decoded"])

    return both(text)


def ids_digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
