"""Best-fit packing of tokenized texts into sequences of one size, planned on the histogram of piece lengths.

A text longer than a sequence is cut into full pieces, the first of which may be shorter; every piece then waits under
its length. Best fit, longest first, is run over the counts of the lengths (at most ``size`` of them), not over pieces:
sequences filled alike form one run, so a plan has a few rows a length however many pieces there are. Each piece takes
the planned place that its rank within its length names.

Ids are those of the ``tokenizers`` library with the strings of special tokens taken as ordinary text, then ``end``.
Texts of characters below U+0250 go through ``tiktoken`` with the same vocabulary and pattern, which gives the same ids
in a fraction of the time; all others, and stretches of over CHUNK characters without a place to cut, through
``tokenizers`` itself.

Defined results: a null or empty text is one piece, the end id alone; repeated rows are packed as often as they occur;
an empty table gives no rows; null keys stay null. Only the key and the text are read: other columns, whatever their
names, are not carried.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm.scratch import drop_scratch, in_order, materialize, with_rank

#: Characters tokenized at once.
CHUNK = 1 << 16

#: Characters that both libraries class alike (tests try each of them).
_FAR = re.compile("[^\x00-ɏ]")
#: A blank before something that is not white space: no token of the pattern reaches across its left side.
_CUT = re.compile(r" (?=\S)")


@lru_cache(maxsize=2)
def _exact(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(maxsize=2)
def _fast(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _chunks(text: str) -> Iterator[str]:
    """``text`` in chunks whose ids, joined, are its ids."""
    at = 0
    while len(text) - at > CHUNK:
        cut = _CUT.search(text, at + CHUNK // 2)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def token_ids(text: str, vocabulary: str, ranks: str, pattern: str) -> np.ndarray:
    """The ids of ``text`` as unsigned 32-bit integers."""
    found = []
    for chunk in _chunks(text):
        if len(chunk) > CHUNK or _FAR.search(chunk):
            found.append(np.array(_exact(vocabulary).encode(chunk, add_special_tokens=False).ids, np.uint32))
        else:
            found.append(np.array(_fast(ranks, pattern).encode_ordinary(chunk), np.uint32))
    return found[0] if len(found) == 1 else np.concatenate(found)


def token_pieces(docs: DataFrame, key: str, text: str, vocabulary: str, ranks: str, pattern: str, size: int, end: int, keep_ids: bool) -> DataFrame:
    """(key, piece, start, length, crc32 and, if asked for, ids) of every text, cut to ``size`` ids."""
    kind = docs.schema[key].dataType
    schema = T.StructType().add("_key", kind).add("piece", "integer").add("start", "long").add("length", "integer").add("crc32", "long")
    if keep_ids:
        schema.add("ids", T.ArrayType(T.IntegerType(), False))
    tail = np.array([end], np.uint32)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, starts, lengths, sums, parts = [], [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                ids = np.concatenate([token_ids(value.as_py() or "", vocabulary, ranks, pattern), tail]).astype("<u4", copy=False)
                cuts = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
                for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append(row)
                    numbers.append(number)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(zlib.crc32(ids[a:b]))
                    if keep_ids:
                        parts.append(ids[a:b])
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64())]
            columns += [pa.array(lengths, pa.int32()), pa.array(sums, pa.int64())]
            if keep_ids:
                ends = np.cumsum([0, *lengths], dtype=np.int32)
                flat = np.concatenate(parts) if parts else np.array([], np.uint32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(pieces, schema)


def plan_sequences(counts: dict[int, int], size: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Best fit, longest first: {length: [(first rank, pieces a sequence, first sequence, offset)]}.

    From its first rank on, a row's sequences take so many pieces of the length each, one after the other from
    ``offset``. ``runs`` holds, for each room left, runs (first sequence, number) of sequences with that room. The next
    pieces go where the least room is that holds one; the sequence just served has then the least, and takes more.
    """
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    runs: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    used = 0

    def leave(room: int, first: int, number: int) -> None:
        if room and number > 0:
            if room not in runs:
                insort(rooms, room)
                runs[room] = []
            runs[room].append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank, plan[length] = counts[length], 0, []
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:  # as many new sequences as the rest fills
                room, first, number = size, used, -(-left // (size // length))
                used += number
            each = room // length
            full = min(number, left // each)
            rest = left - full * each if full < number else 0  # fewer than a sequence takes
            plan[length].append((rank, each, first, size - room))
            leave(room - each * length, first, full)
            leave(room - rest * length, first + full, min(1, number - full))
            leave(room, first + full + 1, number - full - 1)
            taken = full * each + rest
            rank, left = rank + taken, left - taken
    return plan


def _last_at_most(starts: str, rank: str, entries: int) -> Column:
    """The last place (from 1) in the ascending array ``starts`` whose value is not above ``rank``, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, entries.bit_length())))])

    def further(at: Column, step: Column) -> Column:
        return F.when(F.get(starts, at + step - 1) <= F.col(rank), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def place_pieces(pieces: DataFrame, size: int, *order: str) -> DataFrame:
    """``pieces`` (length, ``order``) with ``sequence_id`` and ``offset``.

    Pieces are ranked by one range sort by (length, ``order``), which splits a length that many have. The plan is
    broadcast: one row a length, at most ``size`` rows with a few dozen runs each.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    plan, before, rows = plan_sequences(counts, size), 0, []
    for length in sorted(counts):
        ranks, each, first, offset = (list(c) for c in zip(*plan[length], strict=True))
        rows.append((length, before, ranks, each, first, offset))
        before += counts[length]
    columns = "length int, _base long, _ranks array<long>, _each array<int>, _first array<long>, _from array<int>"
    plans = pieces.sparkSession.createDataFrame(rows, columns)
    ranked = with_rank(in_order(pieces, "length", *order, name="pieces"), "_rank")
    placed = ranked.join(F.broadcast(plans), "length").withColumn("_rank", F.col("_rank") - F.col("_base"))
    placed = placed.withColumn("_at", _last_at_most("_ranks", "_rank", max((len(p) for p in plan.values()), default=1)) - 1)
    beyond = F.col("_rank") - F.get("_ranks", F.col("_at"))
    each = F.get("_each", F.col("_at"))
    sequence = F.get("_first", F.col("_at")) + F.expr("_beyond div _of")
    offset = F.get("_from", F.col("_at")) + F.pmod("_beyond", "_of") * F.col("length")
    placed = placed.withColumn("_beyond", beyond).withColumn("_of", each).withColumn("sequence_id", sequence).withColumn("offset", offset.cast("long"))
    return placed.drop("_base", "_ranks", "_each", "_first", "_from", "_at", "_beyond", "_of", "_rank")


def pack_documents(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, key: str = "doc_id", text: str = "text",
                   size: int = 2048, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """A row per piece: _key, piece, start, length, crc32, (ids,) sequence_id and offset.

    The pieces are written once, as both the histogram and the sort read them.
    """
    pieces = materialize(token_pieces(docs, key, text, vocabulary, ranks, pattern, size, end, keep_ids), "tokenized")
    placed = place_pieces(pieces, size, "_key", "piece", "crc32")
    drop_scratch(pieces)
    return placed


def packed_sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence of :func:`pack_documents` with ``keep_ids``, at most its size."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
