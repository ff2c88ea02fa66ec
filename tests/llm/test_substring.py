"""Chunking laws, and repeats across documents against brute force over word windows."""

import random

import numpy as np
import pytest

from broadsheet.llm import substring

SCHEMA = "doc_id long, text string, _n int"


def words(dice, n):
    return ["".join(dice.choice("abcdefghé") for _ in range(dice.randrange(1, 9))) for _ in range(n)]


@pytest.fixture
def dice():
    return random.Random(9)


def test_chunks_cover_the_text_and_resist_shifts(dice):
    text = " ".join(words(dice, 3000)).encode()
    ends = substring.chunk_ends(text, 5)
    assert ends[-1] == len(text) and (np.diff(ends) > 0).all() and 3 < 3000 / len(ends) < 8
    moved = substring.chunk_ends(b"inserted words here " + text, 5) - 20
    assert len(set(ends) & set(moved)) > 0.98 * len(ends)


def test_long_words_and_white_space_are_cut_between_characters():
    text = ("é" * 5000 + " " * 500 + "x").encode()
    ends = substring.chunk_ends(text, 5)
    assert "".join(text[a:b].decode() for a, b in zip([0, *ends[:-1]], ends, strict=True)) == text.decode()
    assert not len(substring.chunk_ends(b"", 5))


def windows(text, n):
    w = text.split(" ")
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_passages_that_repeat_go_but_the_first(spark, dice):
    passages = [words(dice, n) for n in (51, 60, 80, 200)]
    rows = []
    for i in range(60):
        body = words(dice, 150)
        if i % 3:
            at = dice.randrange(150)
            body[at:at] = passages[i % 4]
        rows.append((i, " ".join(body), 1))
    out = {r.doc_id: r for r in substring.dedup_substrings(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    first = {}
    for i, text, _ in rows:
        r = out[i]
        gone, upto = [], 0
        for s in r._spans:
            gone.append(text[upto : s.start])
            upto = s.end
        assert "".join(gone) + text[upto:] == r.text  # spans and text agree
        if not i % 3 or first.setdefault(i % 4, i) == i:
            assert r.text == text and r._n == 1
    left = [windows(r.text, 45) for r in out.values()]
    assert sum(map(len, left)) == len(set().union(*left))  # no long passage stands twice


def test_nulls_ties_and_repeated_rows(spark, dice):
    text = " ".join(words(dice, 100))
    rows = [(1, text, 0), (1, text, 0), (2, text, 0), (None, text, 0), (3, None, 0), (4, "", 0), (5, "short text", 0), (6, "short text", 0)]
    out = substring.dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()
    kept = sorted((r.doc_id or 0, r.text or "") for r in out)
    assert kept == [(0, ""), (1, text), (1, text), (2, ""), (3, ""), (4, ""), (5, "short text"), (6, "short text")]
    assert [r.text for r in out if r.doc_id == 3] == [None]
    bare = spark.createDataFrame([(None, text, 0), (None, text, 0)], SCHEMA)
    assert {r.text for r in substring.dedup_substrings(bare).collect()} == {text}
    assert substring.dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeats_within_a_document_go_on_request(spark, dice):
    passage = " ".join(words(dice, 80)) + " "
    docs = spark.createDataFrame([(1, passage * 3 + "end", 0)], SCHEMA)
    assert substring.dedup_substrings(docs).first().text == passage * 3 + "end"
    assert len(substring.dedup_substrings(docs, within=True).first().text) < 1.5 * len(passage)


def test_long_passages_without_spaces_go(spark, dice):
    passage = "".join(dice.choice("天地人水火木金土日月山川") for _ in range(2000))
    rows = [(i, f"{' '.join(words(dice, 40))} {passage} {' '.join(words(dice, 40))}", 0) for i in range(3)]
    out = {r.doc_id: r.text for r in substring.dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[0] == rows[0][1] and all(len(out[i]) < len(rows[i][1]) - 1700 for i in (1, 2))


def test_a_key_that_is_no_integer_is_refused(spark):
    with pytest.raises(TypeError):
        substring.dedup_substrings(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
