"""Packing against document-by-document best fit, ids against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from broadsheet.llm import packing

VOCABULARY, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def _ids(text):
    return packing.token_ids(text, VOCABULARY, RANKS, PATTERN).tolist()


def test_both_libraries_class_the_lower_code_points_alike(library):
    for point in range(0x250):
        c = chr(point)
        for text in (c, f"a{c}b", f" {c}", f"{c} 1", f"1{c}1", f"!{c}!", f"{c}{c} x", f"a{c}s '{c}", f" {c} {c}\n{c}"):
            assert _ids(text) == library(text), repr(text)


def test_ids_of_long_texts_cut_at_blanks(library, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 64)
    dice = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", " \n ", "\t", "'s", "12", "!?", "é", "日本", " x", " ", "<|endoftext|>", "\x1c", "b" * 90]
    for _ in range(300):
        text = "".join(dice.choice(parts) for _ in range(dice.randrange(200)))
        assert _ids(text) == library(text), repr(text)


def _best_fit(lengths, size):
    """Rooms left after best fit, longest first, one piece at a time."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= length]
        room = min(fitting) if fitting else size
        if fitting:
            rooms.remove(room)
        rooms.append(room - length)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_plan_over_counts_equals_best_fit_by_pieces(seed):
    dice = random.Random(seed)
    size = dice.choice([10, 37, 100, 2048])
    lengths = [min(size, max(1, int(dice.choice([dice.expovariate(3 / size), dice.uniform(1, size), 1, size, size // 3])))) for _ in range(dice.randrange(400))]
    counts = Counter(lengths)
    plan, filled = packing.plan_sequences(counts, size), defaultdict(list)
    for length, rows in plan.items():
        bounds = [r[0] for r in rows] + [counts[length]]
        for (start, each, first, offset), end in zip(rows, bounds[1:], strict=True):
            for rank in range(start, end):
                filled[first + (rank - start) // each].append((offset + (rank - start) % each * length, length))
    rooms = []
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        rooms.append(size - at)
    assert sorted(rooms) == _best_fit(lengths, size)


def test_packed_documents_are_whole_and_gapless(spark, library):
    dice = random.Random(8)
    words = ["alpha", "beta", " ", "gamma", "日本", "\n", "12"]
    texts = [None, "", "x", "x", "long " * 700] + [" ".join(dice.choice(words) for _ in range(dice.randrange(1, 90))) for _ in range(200)]
    rows = [(i, t, "clash", 3) for i, t in enumerate(texts)] + [(1, "", "clash", 3), (None, "no key", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, length int").repartition(5)
    placed = packing.pack_documents(docs, VOCABULARY, RANKS, PATTERN, size=64, keep_ids=True).cache()
    found = placed.collect()
    by_document = defaultdict(list)
    for r in found:
        by_document[r["_key"]].append(r)
        assert r["crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"] <= 64
    expected = defaultdict(list)
    for key, text, *_ in rows:
        expected[key].append([*library(text or ""), 0])
    assert by_document.keys() == expected.keys()
    for key, lists in expected.items():
        pieces = sorted(by_document[key], key=lambda r: r["piece"])
        if len(lists) == 1:
            assert [i for r in pieces for i in r["ids"]] == lists[0]
            assert [r["piece"] for r in pieces] == list(range(len(pieces))) and pieces[0]["start"] == 0
            assert all(r["length"] == 64 for r in pieces[1:]) and [r["start"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"], list(r["ids"])))
    assert sorted(64 - sum(p[1] for p in s) for s in sequences.values()) == _best_fit([r["length"] for r in found], 64)
    for row in packing.packed_sequences(placed).collect():
        parts = sorted(sequences[row["sequence_id"]])
        assert [p[0] for p in parts] == np.cumsum([0] + [p[1] for p in parts])[:-1].tolist()
        assert list(row["ids"]) == [i for p in parts for i in p[2]]
    placed.unpersist()


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, VOCABULARY, RANKS, PATTERN).collect() == []
