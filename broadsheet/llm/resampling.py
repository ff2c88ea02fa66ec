"""Importance resampling of documents towards a target corpus, by hashed n-grams found in one overlapped regex scan.

A text is lower-cased (A-Z), its separators are collapsed to single blanks, and one ``finditer`` with ``overlapped=True``
emits, at every word, the span of the longest n-gram that begins there: after a blank, with a lookahead for the boundary
behind. Shorter n-grams end where the next words end. The CRC-32 of each span, modulo the number of buckets, is its feature.

Buckets of a document are kept (two bytes a feature, in the shared folder), so texts are scanned once for both the
counts over all documents and the weights. Counts are summed per partition first; what reaches the driver are the
sums of the buckets, BUCKETS of each corpus at most.

Defined results: a null text has no words, no features and weight 0; a null key draws like an empty one and comes last
among ties; repeated rows count and are drawn one by one; empty tables give empty results, and an empty target leaves
all gains to the smoothing. Only key and text are read: other columns, whatever their names, are not carried.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import methodcaller

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm.scratch import in_order, materialize, with_rank

BUCKETS = 10_000

#: ASCII letters are lower-cased, other ASCII characters but digits are separators; all bytes of other characters stay.
_CLEAN = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
#: Spans hashed at once.
_BLOCK = 1 << 16


def clean(text: str) -> bytes:
    """The words of ``text``, lower-cased, each after one blank, as UTF-8."""
    words = text.encode().translate(_CLEAN).split()
    return b" ".join([b"", *words]) if words else b""


@lru_cache(maxsize=4)
def _scan(most: int):
    return regex.compile(rb" [^ ]++(?: [^ ]++){0,%d}+(?![^ ])" % (most - 1)).finditer


def ngram_spans(words: bytes, most: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to ``most`` the starts and ends of the n-grams of ``words`` (as :func:`clean` gives them)."""
    matches = _scan(most)(words, overlapped=True)
    spans = np.fromiter(chain.from_iterable(map(methodcaller("span"), matches)), np.int64).reshape(-1, 2)
    starts, word_ends = spans[:, 0] + 1, np.append(spans[1:, 0], len(words))
    found = [(starts[: max(0, len(starts) - n)], word_ends[n:] if len(starts) else starts) for n in range(most - 1)]
    longest = max(0, len(starts) - most + 1)
    return [*found, (starts[:longest], spans[:longest, 1])]


def buckets_of(text: str, most: int = 3, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words of ``text`` and the bucket of each of its n-grams."""
    words, found, counts = clean(text), [], []
    for starts, ends in ngram_spans(words, most):
        counts.append(len(starts))
        for at in range(0, len(starts), _BLOCK):
            cuts = map(slice, starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist())
            sums = np.fromiter(map(zlib.crc32, map(words.__getitem__, cuts)), np.uint32)
            found.append((sums % buckets).astype("<u2"))
    return counts[0], np.concatenate(found) if found else np.array([], "<u2")


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """(_key, words, buckets): the number of words of each text and its n-grams' buckets, two bytes each."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket takes two bytes: at most 65,536")
    schema = T.StructType().add("_key", docs.schema[key].dataType).add("words", "integer").add("buckets", "binary")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [buckets_of(value.as_py() or "", most, buckets) for value in batch.column(1)]
            columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].tobytes() for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(scan, schema)


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all rows of ``found`` fall into each bucket; each partition is summed before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                sums += np.bincount(np.frombuffer(value.as_py(), "<u2"), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["bucket", "n"])

    summed = found.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in summed.collect():  # at most ``buckets`` rows
        total[row["bucket"]] = row["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket floor(1000 ln(target rate / source rate)), with one smoothing count a bucket."""
    more, of_all, of_target = float(len(source)), float(source.sum()), float(target.sum())
    rate = lambda s, t: math.log((t + 1.0) * (of_all + more) / ((s + 1.0) * (of_target + more)))
    return np.array([math.floor(1000 * rate(float(s), float(t))) for s, t in zip(source, target, strict=True)], np.int64)


def weigh(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``found`` as (_key, words, n_features, weight)."""
    schema = T.StructType().add("_key", found.schema["_key"].dataType).add("words", "integer").add("n_features", "long").add("weight", "long")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(value.as_py(), "<u2") for value in batch.column(2)]
            columns = [pa.array(list(map(len, lists)), pa.int64()), pa.array([int(gain[at].sum()) for at in lists], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=schema.names)

    return found.mapInArrow(sums, schema)


def gumbel(key, seed: int = 42):
    """floor(-1000 ln(-ln u)) of a uniform u that the seed and the key decide."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", most: int = 3, buckets: int = BUCKETS, least_words: int = 20,
             percent: int = 5, seed: int = 42) -> DataFrame:
    """A row per document: _key, words, n_features, weight, score and rank (from 1; null where not drawn).

    The ``percent`` of the documents with at least ``least_words`` words that score highest are drawn, without
    replacement; ties go to the smaller key. All scores are ranked by one range sort.
    """
    found = materialize(features(docs, key, text, most, buckets), "features")
    gain = gains(bucket_counts(found, buckets), bucket_counts(features(target, text, text, most, buckets), buckets))
    scored = weigh(found, gain).withColumn("score", F.col("weight") + gumbel("_key", seed)).withColumn("_fits", F.col("words") >= least_words)
    ranked = with_rank(in_order(scored, F.col("_fits").desc(), F.col("score").desc(), F.col("_key").asc_nulls_last(), name="scored"), "_rank")
    drawn = F.expr(f"_n * {percent} div 100")
    fitting = F.broadcast(found.agg(F.count_if(F.col("words") >= least_words).alias("_n")))  # one row
    rank = F.when(F.col("_fits") & (F.col("_rank") < drawn), F.col("_rank") + 1)
    return ranked.crossJoin(fitting).withColumn("rank", rank).drop("_fits", "_rank", "_n")
