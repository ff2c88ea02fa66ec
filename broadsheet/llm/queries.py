"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import bpe, mixing, orderhash, packing, pagetext, quality, resampling, sharding, simhash, substring, topk, trie, warc
from broadsheet.llm.scratch import small_batches

#: Fixed parameters of the registered queries.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model, _ = quality.train(docs, labels)
    scores = quality.score(docs, model)
    return scores.select(
        "doc_id",
        F.col("_scores.content").alias("content_score"),
        F.col("_scores.metadata").alias("metadata_score"),
        F.col("_scores.quality").alias("quality_score"),
        (F.col("_scores.quality") >= quality.THRESHOLD).alias("keep"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    coded = docs.select("doc_id", bpe.encode_and_decode(F.col("text"), RANKS, PATTERN).alias("coded"))
    return coded.select(
        "doc_id",
        F.size("coded.ids").cast("long").alias("n_tokens"),
        bpe.ids_digest(F.col("coded.ids")).alias("ids_sha256"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
    )


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.plan_mix(docs).select(
        "doc_id", "_plan.size", "_plan.source_size", "_plan.target", (F.col("_plan.size") * F.col("_plan.copies")).alias("taken"), "_plan.copies"
    )


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pagetext.extract_text(pages).select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = sharding.assign_shards(docs, sharding.layout(SHARDS))
    grown = sharding.assign_shards(placed, sharding.layout(SHARDS + 1), shard="grown_shard")
    return sharding.with_slots(grown)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_id"), topk.quantize(F.col("embedding")).alias("_x"))
    return topk.top_k(vectors, vectors.filter(F.col("_id") % 20 == 0), k=20)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.archive_round_trip(pages, min_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("_spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return substring.dedup_substrings(docs).select(
        "doc_id", "text", F.col("_spans").alias("removed_spans"), removed.cast("long").alias("removed_chars")
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = simhash.near_duplicates(docs, shingle=3, seeds=(42,), segments=2, most=3)
    return found.select("doc_id", simhash.hex_fingerprint("w0").alias("fingerprint"), F.col("_component").alias("component_id"))


def op10_orderhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderhash.compare_with_edits(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(_table(spark, sf_dir, "documents"), VOCABULARY, RANKS, PATTERN, size=2048)
    return placed.select(F.col("_key").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), F.col("crc32").alias("ids_crc32"), "sequence_id", "offset")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = trie.turn_paths(_table(spark, sf_dir, "conversations"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return trie.prefix_trie(trie.with_shared_heads(paths, F.col("conv_id") - F.col("conv_id") % 100, head.cast("int"), 5))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("_key").alias("doc_id"), "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality, "op2_bpe": op2_bpe, "op3_mix": op3_mix, "op4_page_text": op4_page_text, "op5_shards": op5_shards,
        "op6_topk": op6_topk, "op7_warc": op7_warc, "op8_substrings": op8_substrings, "op9_simhash": op9_simhash, "op10_orderhash": op10_orderhash,
        "op11_pack": op11_pack, "op12_trie": op12_trie, "op13_resample": op13_resample,
    }


_OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), hits AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM hits
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


_OP7_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
d AS (
  SELECT page_id, url, octet_length(encode(payload)) AS payload_bytes, CAST(CAST(unhex(sha1(payload)) AS BIT) AS VARCHAR) AS bits,
         min(page_id) OVER (PARTITION BY payload) AS first
  FROM p
)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
         16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER)
         + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER) + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url
FROM d
"""


def _crc32_sql(bytes_list: str) -> str:
    """The CRC-32 of a list of byte values, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_list}), lambda c, b: {step}), CAST(4294967295 AS BIGINT))"


_DIGITS = "list_transform(string_split(CAST({id} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"

_OP12_SQL = f"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS path
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
  SELECT conv_id, path, conv_id - conv_id % 100 AS base, {_crc32_sql(_DIGITS.format(id="conv_id"))} % 6 AS h FROM own
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.path[1:h], []), c.path[h + 1:]) AS path FROM heads c LEFT JOIN own b ON b.conv_id = c.base
), members AS (
  SELECT conv_id, path[1:d] AS k, d, len(path) = d AS ending FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ending), '')) AS ends
  FROM members GROUP BY k, d
), children AS (
  SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), own_sums AS (
  SELECT v.*, coalesce(c.n, 0) AS n_children, CASE WHEN v.d = 0 THEN 0 ELSE (v.n - 1) * length(v.k[v.d].text) END AS saved
  FROM nodes v LEFT JOIN children c ON c.d = v.d AND c.k = v.k
), sums AS (
  SELECT k[1:a] AS k, a AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT k, n_children, saved, unnest(range(d + 1)) AS a FROM own_sums) GROUP BY ALL
)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
       v.ends AS ends_sha256
FROM own_sums v JOIN sums s ON s.d = v.d AND s.k = v.k LEFT JOIN nodes p ON p.d = v.d - 1 AND p.k = v.k[1:v.d - 1]
"""

_OP13_SQL = f"""
WITH texts AS (SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 'b', NULL, row_number() OVER (), text FROM benchmark),
words AS (
  SELECT kind, id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts
), grams AS (
  SELECT kind, r, unnest(list_concat(w, list_transform(w[:-2], lambda x, i: x || ' ' || w[i + 1]),
         list_transform(w[:-3], lambda x, i: x || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gram
  FROM words
), counted AS (SELECT kind, r, gram, count(*) AS n FROM grams GROUP BY ALL),
hexed AS (SELECT gram, hex(encode(gram)) AS x FROM (SELECT DISTINCT gram FROM counted)),
hashed AS (
  SELECT gram, {_crc32_sql("list_transform(range(1, len(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))")} % 10000 AS bucket FROM hexed
), found AS (SELECT kind, r, bucket, sum(n) AS n FROM counted JOIN hashed USING (gram) GROUP BY ALL),
sums AS (
  SELECT b AS bucket, CAST(coalesce(sum(n) FILTER (kind = 'd'), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (kind = 'b'), 0) AS DOUBLE) AS t
  FROM range(10000) AS g(b) LEFT JOIN found ON bucket = b GROUP BY b
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000)))) AS BIGINT) AS gain FROM sums
), weights AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM found JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY r),
scored AS (
  SELECT id AS doc_id, r, len(w) >= 20 AS fits, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)
         / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (r) WHERE kind = 'd'
), ranked AS (SELECT *, row_number() OVER (ORDER BY fits DESC, score DESC, doc_id NULLS LAST) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * (SELECT count(*) FROM scored WHERE fits) // 100 THEN place END AS rank FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_topk": _OP6_SQL, "op7_warc": _OP7_SQL, "op12_trie": _OP12_SQL, "op13_resample": _OP13_SQL}
