"""The inverted index: the same rows as the search without one, bounded lists, and reruns by date."""

import datetime
import random

from pyspark.sql import functions as F

from broadsheet.operators import search

SCHEMA = "date date, item int, body string"


def _rows(dice, days, per_day):
    parts = ["heat", "map", "ed", "a", "é", "日本", "of", "x" * 40, "the"]
    word = lambda: "".join(dice.choice(parts) for _ in range(dice.randrange(1, 4)))
    return [(datetime.date(2024, 1, d), i, " ".join(word() for _ in range(dice.randrange(9))).title()) for d in days for i in range(per_day)]


def _questions(spark):
    terms = [("q", ["eathe", "zzz", "a"]), ("r", ["é"]), ("s", ["本", "日本é"]), ("t", ["mapof"]), ("none", ["nothing"]), ("empty", []), ("u", ["xxxx"]), ("v", ["the"])]
    return spark.createDataFrame(terms, "query string, terms array<string>")


def _both(spark, path, items):
    questions = _questions(spark)
    by_index = search.search_index(path, items, questions, "query", ["date"], "item", "body")
    plain = search.search_batch(items, questions, "query", ["date"], "item", "body", "body")
    assert by_index.columns == plain.columns
    return sorted(map(repr, by_index.collect())), sorted(map(repr, plain.collect()))


def test_index_finds_what_a_search_finds_and_renews_a_date(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "LIST", 4)
    dice, path = random.Random(1), f"file://{tmp_path}/index"
    rows = [*_rows(dice, (1, 2, 3), 30), (datetime.date(2024, 1, 2), 500, None), (datetime.date(2024, 1, 3), 501, "")]
    items = spark.createDataFrame(rows, SCHEMA).repartition(3)
    search.write_index(items, path, ["date"], "item", "body")
    found, plain = _both(spark, path, items)
    assert found == plain and len(found) > 10
    lists = spark.read.parquet(f"{path}/postings")
    assert lists.agg(F.max(F.size("items"))).first()[0] <= 4 and spark.read.parquet(f"{path}/lexicon").agg(F.max(F.size("words"))).first()[0] <= 4

    before = {f.name for f in (tmp_path / "index/postings/date=2024-01-01").iterdir()}
    changed = spark.createDataFrame(_rows(random.Random(2), (2,), 10), SCHEMA)
    search.write_index(changed, path, ["date"], "item", "body")
    assert {f.name for f in (tmp_path / "index/postings/date=2024-01-01").iterdir()} == before
    now = items.filter("date <> '2024-01-02'").union(changed)
    found, plain = _both(spark, path, now)
    assert found == plain


def test_grams_are_linear_and_padded(spark):
    rows = spark.createDataFrame([("the",), ("é日🔥x",), ("",), ("y" * 200_000,)], "word string")
    found = [r[0] for r in rows.select(search.grams(F.col("word"))).collect()]
    assert found[0] == ["the", "he\0", "e\0\0"] and found[1] == ["é日🔥", "日🔥x", "🔥x\0", "x\0\0"]
    assert found[2] in ([], ["\0\0"]) and found[3] == ["yyy", "yy\0", "y\0\0"]


def test_lists_are_merged_over_input_splits_and_know_their_first_item(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    long = "x" * 70 + "mapof" + "é" * 70
    rows = [(datetime.date(2024, 1, 1 + i % 2), i, f"the heat {long if i % 5 == 4 else ''} " + "the " * (i % 3)) for i in range(3000)]
    items = spark.createDataFrame(rows, SCHEMA).repartition(7)
    search.write_index(items, path, ["date"], "item", "body")
    lists = spark.read.parquet(f"{path}/postings")
    found = {(r.date.day, r.word): r for r in lists.groupBy("date", "word").agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("items"), F.min("first").alias("first")).collect()}
    assert {k: (r.n, r["items"], r["first"]) for k, r in found.items() if k[1] == "the"} == {(1, "the"): (2, 1500, 0), (2, "the"): (2, 1500, 1)}
    assert found[1, long].n == 1 and found[2, long]["first"] == 9 and found[1, long]["first"] == 4
    assert lists.filter("first <> array_min(items)").isEmpty()
    by_index, plain = _both(spark, path, items)
    assert by_index == plain and len(plain) > 5


def test_rows_of_grams_are_the_grams(spark):
    words = [("the",), ("a",), ("aaaa",), ("hahaha",), ("é日🔥x",), ("y" * 64,), ("ab" * 40,), ("z" * 300 + "é",)]
    rows = spark.createDataFrame(words, "word string")
    plain = {(r.word, g) for r in rows.select("word", search.grams(F.col("word")).alias("grams")).collect() for g in r.grams}
    found = [tuple(r) for r in search._with_grams(rows, "word").collect()]
    assert len(found) == len(plain) and set(found) == plain
    listed = [(w, r.gram) for r in search.lexicon(rows).collect() for w in r.words]
    assert sorted(listed) == sorted((w, g) for w, g in plain if not g.endswith("\0"))
