"""The join form of keyword scans, rules and themes, against the scan and against plain Python."""

import random
import time

from pyspark.sql import functions as F

from broadsheet.operators import classify


def _texts(dice, alphabet):
    texts = ["".join(dice.choice(alphabet) for _ in range(n)) for n in (0, 3, 50, 254, 255, 256, 257, 512, 600, 1500) for _ in range(3)]
    return [*enumerate(texts), (100, None), (101, texts[5]), (102, "abca" * 3)]


def test_hits_equal_a_search_in_python(spark):
    dice = random.Random(2)
    rows = _texts(dice, "abcdé日 🔥")
    words = {"".join(dice.choice("abcdé日 🔥") for _ in range(dice.choice([1, 2, 3, 4, 5, 8, 9, 17]))) for _ in range(200)} | {"", "abca" * 3}
    words |= {t[n : n + 40] for _, t in rows if t for n in (0, 230, 250, 255, 500) if len(t) > n}  # across the cuts
    words = sorted(words)
    items = spark.createDataFrame(rows, "id int, text string").repartition(3)
    keywords = spark.createDataFrame([(w, n) for n, w in enumerate(words)] + [(words[3], 999)], "kw string, n int")
    expected = sorted((i, w, n, t.find(w) + 1) for i, t in rows if t for n, w in [*enumerate(words), (999, words[3])] if w and w in t)
    for hits in (classify.keyword_hits_joined(items, "text", keywords), classify.keyword_hits(items, "text", keywords)):
        assert sorted((r.id, r.kw, r.n, r.pos) for r in hits.collect()) == expected
    assert classify.keyword_hits_joined(items, "text", keywords.limit(0)).count() == 0
    assert classify.keyword_hits_joined(items.limit(0), "text", keywords).count() == 0


def test_time_is_linear_in_a_text(spark):
    dice = random.Random(5)
    words = sorted({"".join(dice.choice("abcdefghijklmnop") for _ in range(dice.randrange(4, 12))) for _ in range(6_000)})
    keywords = spark.createDataFrame([(w,) for w in words], "kw string").cache()
    took = {}
    for size in (40_000, 40_000, 640_000):  # the first warms up
        text = " ".join(dice.choice(words) for _ in range(size // 8))[:size]
        items = spark.createDataFrame([(1, text)], "id int, text string")
        began = time.time()
        found = {r.kw: r.pos for r in classify.keyword_hits(items, "text", keywords).select("kw", "pos").collect()}
        took[size] = time.time() - began
        assert found == {w: text.find(w) + 1 for w in words if w in text}
    assert took[640_000] < 16 * max(took[40_000], 1)  # a quadratic form would take 256 times as long
    keywords.unpersist()


RULES = {"outreach_tag": ["出海", "x"], "outreach_title": ["赴外"], "strong_policy": ["规划"], "weak_national": ["数字", "全国"]}


def test_tables_of_rules_attribute_alike(spark):
    dice = random.Random(9)
    parts = ["出海", "赴外", "规划", "数字", "全国", "北京", "x", "y", "苏州"]
    pick = lambda n: [dice.choice(parts) for _ in range(dice.randrange(n))]
    rows = [(i, "".join(pick(3)), pick(3), "".join(pick(4))) for i in range(150)] + [(900, None, None, None), (901, "", [None, "x"], "")]
    items = spark.createDataFrame(rows, "id int, title string, tags array<string>, body string")
    places = [("北京", "北京", "place"), ("苏州", "江苏", "city")]
    table = spark.createDataFrame([(*p, n) for n, p in enumerate(places)], "kw string, place string, layer string, ord int")
    rules = spark.createDataFrame([(name, w) for name, words in RULES.items() for w in words], "rule_set string, kw string")
    plain = classify.attribute_places(items, places, RULES).orderBy("id")
    for max_terms in (5_000, 1):
        classify.MAX_TERMS, kept = max_terms, classify.MAX_TERMS
        try:
            joined = classify.attribute_places_joined(items, "id", table, rules).orderBy("id")
            assert joined.columns == plain.columns and joined.collect() == plain.collect()
        finally:
            classify.MAX_TERMS = kept


def test_tables_of_themes_give_the_same_lists(spark):
    themes = [("展览", "展"), ("考古", "考古"), ("展览", "特"), ("政策", "国家")]
    rows = [(1, ["考古展", "特展"]), (2, ["浙江"]), (3, []), (4, None), (5, ["国家", None, "考古", "国家"]), (6, ["特", "考古", "展"])]
    items = spark.createDataFrame(rows, "id int, tags array<string>")
    table = spark.createDataFrame([(t, n, w) for n, (t, w) in enumerate(themes)], "theme string, theme_ord int, word string")
    found = {r.id: r.themes for r in classify.themes_joined(items, "id", "tags", table).collect()}
    plain = items.withColumn("themes", F.coalesce(classify.themes_of(F.col("tags"), themes), F.array().cast("array<string>")))
    assert found == {r.id: r.themes for r in plain.collect()}


def test_only_what_may_be_a_keyword_is_shuffled(spark):
    dice = random.Random(3)
    words = sorted({"".join(dice.choice("abcdefgh") for _ in range(10)) for _ in range(50)})
    text = "".join(dice.choice("ijklmnop ") for _ in range(20_000)) + words[7]
    items = spark.createDataFrame([(1, text)], "id int, text string")
    found = classify.keyword_hits_joined(items, "text", spark.createDataFrame([(w,) for w in words], "kw string"))
    assert [(r.kw, r.pos) for r in found.select("kw", "pos").collect()] == [(words[7], 20_001)]
    hashes = spark.range(5_000).select(F.xxhash64("id").alias("h"), "id")
    bits = 1 << 18
    kept = {r.id for r in classify._possibly(hashes, "h", classify._bitmap(hashes.filter("id < 1000"), "h", bits), bits).collect()}
    assert set(range(1000)) <= kept and len(kept) < 1000 + 4000 * 0.02  # none is lost, and few others are kept
