"""Encoding against the tiktoken library, decoding as an exact round trip."""

import base64
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from broadsheet.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_equal_the_library(library):
    dice = random.Random(5)
    parts = ["a", "b", "aa", "é", "the", "ing", " ", "x", "日本", "!!", "==", "\n", "\x00", "🔥"]
    for n in [*range(1, 60)] * 20 + [5000]:
        piece = "".join(dice.choice(parts) for _ in range(n)).encode()
        assert bpe.merge_bytes(piece, bpe.load_ranks(PATH)) == library._core_bpe.encode_single_piece(piece)


TEXTS = [None, "", " ", "Hello  world", "it's <|endoftext|> here", "\n\n\t x", "日本語テキスト 123", "a" * 30_000, " " * 5_000 + "x", "ab==" * 20_000, "\x1c\x85  é"]


def test_documents_equal_the_library_and_decode_to_themselves(spark, library):
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string, n int").repartition(3)
    coded = docs.select("doc_id", "text", bpe.encode(F.col("text"), PATH, PATTERN).alias("ids"))
    for r in coded.select("*", bpe.decode(F.col("ids"), PATH).alias("back")).collect():
        assert list(r.ids) == library.encode_ordinary(r.text or "")
        assert bytes(r.back).decode() == (r.text or "")


def test_both_in_one_worker_equal_the_two(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    both = docs.select(bpe.encode_and_decode(F.col("text"), PATH, PATTERN).alias("c"), bpe.encode(F.col("text"), PATH, PATTERN).alias("ids"))
    for r in both.select("*", bpe.decode(F.col("ids"), PATH).alias("back")).collect():
        assert r.c.ids == r.ids and r.c.decoded == r.back


def test_odd_ids_and_empty_tables(spark):
    lists = spark.createDataFrame([([1, None, 99_999_999],), (None,), ([],)], "ids array<int>")
    assert [bytes(r[0]) for r in lists.select(bpe.decode(F.col("ids"), PATH)).collect()] == [b'"', b"", b""]
    none = spark.createDataFrame([], "text string")
    assert none.select(bpe.encode(F.col("text"), PATH, PATTERN)).count() == 0


def test_the_cache_changes_no_result(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    encoder = bpe.Encoder(PATH, PATTERN)
    text = " ".join(f"worrd{i % 11}x" for i in range(200))
    assert memoryview(encoder(text)).cast("i").tolist() == library.encode_ordinary(text)


def test_vocabulary_of_200000_ranks():
    """The bitmap has no bound on ranks: those of a small vocabulary, spread over 200,000, give the same pieces."""
    ranks = {bytes([b]): b for b in range(256)}
    for pair in (b"ab", b"bc", b"abc", b"aa", b"aaaa"):
        ranks[pair] = len(ranks)
    spread = {token: rank if rank < 256 else 65_000 + (rank - 256) * 33_000 for token, rank in ranks.items()}
    back = {rank: token for token, rank in spread.items()}
    assert max(spread.values()) > 190_000
    for piece in (b"abcabc", b"aabcb" * 9, b"aaaaaaabc", b"zzabz"):
        assert [back[i] for i in bpe.merge_bytes(piece, spread)] == [{r: t for t, r in ranks.items()}[i] for i in bpe.merge_bytes(piece, ranks)]
