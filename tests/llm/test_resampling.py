"""Resampling against a plain version and against SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from broadsheet.llm import queries, resampling

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def _grams(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def _buckets(text):
    return [zlib.crc32(g.encode()) % 10_000 for g in _grams(text)[1]]


@pytest.mark.parametrize("text", ["", " ", "A", "a b", "Hello, World! ÉCOLE été 12 x", "  x\x1c\x85y z\x7f", "ａＡ日本 \n\n k", "the the " * 80, "x" * 100_000, "- - -"])
def test_spans_are_the_ngrams(text):
    words, buckets = resampling.buckets_of(text)
    assert words == _grams(text)[0] and buckets.tolist() == _buckets(text)
    clean = resampling.clean(text)
    spans = [clean[a:b].decode() for starts, ends in resampling.ngram_spans(clean) for a, b in zip(starts, ends, strict=True)]
    assert spans == _grams(text)[1]


@pytest.mark.parametrize("most", [1, 2, 4])
def test_other_lengths(most):
    clean = resampling.clean("one two three four")
    words = clean.split()
    spans = [clean[a:b] for starts, ends in resampling.ngram_spans(clean, most) for a, b in zip(starts, ends, strict=True)]
    assert spans == [b" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(4 - n + 1)]


def test_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(resampling, "_BLOCK", 7)
    text = " ".join(str(i % 13) for i in range(200))
    assert resampling.buckets_of(text)[1].tolist() == _buckets(text)


def _plain(docs, target):
    s, t = Counter(b for _, x in docs for b in _buckets(x)), Counter(b for x in target for b in _buckets(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000))))
    rows = []
    for key, text in docs:
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) for b in _buckets(text))
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([key, len(_buckets(text)), weight, score, None, _grams(text)[0] >= 20])
    fitting = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(fitting[: 5 * len(fitting) // 100], 1):
        row[4] = rank
    return sorted(repr(tuple(r[:5])) for r in rows)


def _rows(df, key="_key"):
    return sorted(repr((r[key], *[r[c] for c in COLUMNS[1:]])) for r in df.collect())


def test_documents_equal_the_plain_version(spark):
    dice = random.Random(4)
    words = ["alpha", "Beta", "gamma,", "日本", "12", "é"]
    docs = [(i, " ".join(dice.choice(words) for _ in range(dice.randrange(60)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "alpha " * 30_000), (None, "beta " * 25), (5, docs[5][1]), (5, docs[5][1])]
    target = ["alpha beta gamma", None, "", "beta beta"]
    df = spark.createDataFrame([(k, x, 1, "c") for k, x in docs], "doc_id long, text string, rank int, _key string").repartition(4)
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    assert _rows(resampling.resample(df, goal)) == _plain(docs, target)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 20)], "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    assert _rows(resampling.resample(some, none)) == _plain([(1, "a b c " * 20)], [])


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    expected = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.oracle_sql()['op13_resample']})").fetchall()
    assert _rows(queries.op13_resample(spark, DATA), "doc_id") == sorted(map(repr, expected))
