"""From raw documents to token ids in five stages, each one operator over all that the stage before kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import bpe, mixing, quality, simhash, substring
from broadsheet.llm.scratch import all_columns, delete_scratch, materialize, scratch_scope, small_batches, unused

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Near copies: a Jaccard similarity of 0.8 or more of the distinct five-word shingles, computed on the texts. Pairs
#: meet through word-set SimHash fingerprints within 3 bits or through one of the operator's 24 min-hash keys.
NEAR = {"segments": 2, "jaccard": 0.8}
#: Pre-tokens of a generation of the coder's cache: fewer than by default, as workers hold what earlier stages left.
CACHE_ENTRIES = 64_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the co-trained classifier rejects."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies."""
    return simhash.drop_near_duplicates(docs, **NEAR)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes passages that a document with a smaller doc_id holds; n_chars follows the text."""
    spans = unused(docs.columns, "_spans")[0]
    cleaned = substring.dedup_substrings(docs, spans=spans)
    size = F.when(F.size(spans) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", size).select(*all_columns(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the source mix takes it."""
    return mixing.mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    coded = docs.select("doc_id", "source", "text", bpe.encode_and_decode(F.col("text"), RANKS, public_tokenizers.PATTERN, CACHE_ENTRIES).alias("coded"))
    exact = F.col("coded.decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select("doc_id", "source", F.col("coded.ids").alias("ids"), F.size("coded.ids").cast("long").alias("n_tokens"), exact.alias("round_trip"))


def _in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality classifier", _in_small_batches(quality_stage)),
    ("SimHash near-dedup", _in_small_batches(near_duplicate_stage)),
    ("substring dedup", _in_small_batches(substring_stage)),
    ("source mixing", _in_small_batches(mixing_stage)),
    ("byte-level BPE", _in_small_batches(token_stage)),
]
#: Trained scores, fingerprints and merges have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet in the shared folder and read back."""
    docs, earlier = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scratch_scope() as made:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        delete_scratch(spark, [*earlier, *made[:-1]])
        earlier = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
