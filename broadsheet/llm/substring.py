"""Substring deduplication by content-defined chunking with a gear rolling hash.

A gear hash over the last 16 bytes picks chunk ends among the ends of words (inside words only where
nothing has been white space for ``LONG_WORD`` bytes), so equal passages are cut alike wherever they
stand and an insertion moves no cut beyond its neighbourhood. Chunks are compared by 128-bit digest. A
chunk is a repeat if a document with a smaller id holds it (with ``within``, also if it stood in the same
document before); runs of consecutive repeats of at least ``min_words`` words are deleted. The first
holder keeps its text.

Chunk rows are aggregated to one row per digest, with partial sums before the shuffle, and joined back;
no group of equal chunks is ever collected. Only the positions found in one text are.

Defined results: null text stays null, empty text empty; rows that share a doc_id count as one document
(none of their chunks repeats another's); rows without a doc_id yield to any that has one and else count
as one document; an empty table gives an empty result; extra columns pass through, but one named like the
spans' is replaced. A stretch of over 64 bytes without white space counts as a word per 8 bytes. The key must be an
integer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm.scratch import quoted, unused

#: One random 16-bit number per byte value, from a hash of the byte.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([i])) >> 16 for i in range(256)], np.uint16)
#: A word this long (bytes) may be cut inside, on average every LONG_CUT bytes.
LONG_WORD, LONG_CUT = 64, 64
#: A longer stretch without white space counts as a word per so many bytes.
WORD_BYTES = 8
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def gear_hash(data: np.ndarray) -> np.ndarray:
    """For each byte the sum of GEAR over it and the 15 before, each shifted by its distance."""
    h = GEAR[data]
    for reach in (1, 2, 4, 8):
        h[reach:] += h[:-reach] << np.uint16(reach)
    return h


def chunk_ends(text: bytes, spacing: int) -> np.ndarray:
    """Ends of the chunks of ``text``, on average ``spacing`` words apart; the last is its length."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.empty(0, np.int64)
    h, space = gear_hash(data), _SPACE[data]
    following = np.append(data[1:], np.uint8(0x20))
    word_start = space & ~_SPACE[following]
    cut = word_start & (h < 65536 // spacing)
    last_space = np.maximum.accumulate(np.where(space, np.arange(len(data)), -1))
    deep = np.arange(len(data)) - last_space >= LONG_WORD
    if deep.any():
        cut |= deep & (h < 65536 // LONG_CUT) & (following & 0xC0 != 0x80) & ~_SPACE[following]
    cut[-1] = True
    return np.flatnonzero(cut) + 1


def _digests(text: bytes, ends: np.ndarray) -> list[bytes]:
    digest, ends = xxhash.xxh3_128_digest, ends.tolist()
    return [digest(text[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def _chunk_rows(spacing: int):
    schema = pa.schema([(n, pa.int64()) for n in ("_doc", "_text_hash", "_d0", "_d1")])

    def rows(batches):
        for batch in batches:
            docs, hashes, texts = batch.column(0), batch.column(1), batch.column(2)
            for low in range(0, len(texts), 1000):
                digests, own = [], []
                for i in range(low, min(low + 1000, len(texts))):
                    text = (texts[i].as_py() or "").encode("utf-8", "surrogatepass")
                    distinct = set(_digests(text, chunk_ends(text, spacing)))
                    digests += distinct
                    own += [i] * len(distinct)
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                at = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays([docs.take(at), hashes.take(at), pa.array(halves[:, 0]), pa.array(halves[:, 1])], schema=schema)

    return rows, "_doc long, _text_hash long, _d0 long, _d1 long"


def _words(data: bytes) -> int:
    return sum(1 if len(w) <= LONG_WORD else len(w) // WORD_BYTES for w in data.split())


def _cleaned(text: Column, repeats: Column, spacing: int, min_words: int, within: bool) -> Column:
    """struct<text, spans>: ``text`` without its runs of repeats, and their code point spans in it."""
    kind = T.StructType().add("text", T.StringType()).add(
        "spans", T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()))
    )

    def clean(text: str, repeated: list[int] | None) -> tuple[str, list[dict]]:
        if not (repeated or within):
            return text, []
        data = text.encode("utf-8", "surrogatepass")
        ends = chunk_ends(data, spacing)
        digests = _digests(data, ends)
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        gone = np.zeros(len(ends) + 2, bool)
        gone[1:-1] = np.isin(halves[:, 0], np.array(repeated or [], np.int64))
        if within:
            seen: set[bytes] = set()
            for at, d in enumerate(digests, 1):
                gone[at] |= d in seen
                seen.add(d)
        edges = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)
        starts = np.concatenate([[0], ends])
        kept, spans, upto, chars = [], [], 0, 0
        for a, b in starts[edges].tolist():
            if _words(data[a:b]) < min_words:
                continue
            piece = data[upto:a].decode("utf-8", "surrogatepass")
            low = chars + len(piece)
            chars = low + len(data[a:b].decode("utf-8", "surrogatepass"))
            spans.append({"start": low, "end": chars})
            kept.append(piece)
            upto = b
        return ("".join(kept) + data[upto:].decode("utf-8", "surrogatepass") if spans else text), spans

    @F.arrow_udf(kind)
    def cleaned(texts: pa.Array, lists: pa.Array) -> pa.Array:
        rows = [clean(t.as_py(), r.as_py()) if t.is_valid else (None, []) for t, r in zip(texts, lists, strict=True)]
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], spans)], ["text", "spans"])

    return cleaned(text, repeats)


def dedup_substrings(
    docs: DataFrame, spacing: int = 5, min_words: int = 20, within: bool = False, text: str = "text", key: str = "doc_id", spans: str = "_spans"
) -> DataFrame:
    """``docs`` with repeats deleted from ``text``, and ``spans``, the deleted code point ranges.

    A passage of w words loses its inside: cuts lie ``spacing`` words apart on average, so about that
    many words remain at either edge, and a passage well over ``min_words`` + 2 * ``spacing`` words is found.
    """
    if docs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("the key must be an integer")
    rows, schema = _chunk_rows(spacing)
    own_key, own_text = F.col(quoted(key)).cast("long"), F.col(quoted(text))
    chunks = docs.select(own_key.alias("_doc"), F.xxhash64(own_text).alias("_text_hash"), own_text.alias("_text")).mapInArrow(rows, schema)
    holders = chunks.groupBy("_d0", "_d1").agg(F.min("_doc").alias("_first"), F.count(F.lit(1)).alias("_n"))
    shared = holders.filter("_n > 1 AND _first IS NOT NULL").drop("_n")
    repeats = chunks.join(shared, ["_d0", "_d1"]).filter("_doc IS NULL OR _doc > _first")
    # In one text half a digest names the chunk.
    of, of_text, repeated, clean = unused([*docs.columns, spans], "_of", "_of_text", "_repeated", "_clean")
    found = repeats.groupBy(F.col("_doc").alias(of), F.col("_text_hash").alias(of_text)).agg(F.collect_set("_d0").alias(repeated))
    joined = docs.join(found, own_key.eqNullSafe(F.col(of)) & (F.xxhash64(own_text) == F.col(of_text)), "left")
    result = _cleaned(own_text, F.col(repeated), spacing, min_words, within)
    kept = [c for c in docs.columns if c != spans]
    return joined.select(*[F.col(quoted(c)) for c in kept], result.alias(clean)).select(
        *[F.col(f"{clean}.text").alias(c) if c == text else F.col(quoted(c)) for c in kept], F.col(f"{clean}.spans").alias(spans)
    )
