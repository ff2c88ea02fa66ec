"""Edited texts and order against plain Python; likeness against edit distance."""

import hashlib
import random

from pyspark.sql import functions as F

from broadsheet.llm import orderhash

SCHEMA = "doc_id long, text string, _key string"


def words(dice, n):
    return " ".join("".join(dice.choice("abcdefgé日") for _ in range(dice.randrange(1, 12))) for _ in range(n))


def test_edits_follow_the_next_document(spark):
    dice = random.Random(8)
    rows = [(i * 3, words(dice, dice.randrange(1, 80)), "clash") for i in range(150)] + [(1000, None, ""), (1001, "", ""), (1002, "abc", ""), (1003, "abcdefgh", "")]
    dice.shuffle(rows)
    found = {r.doc_id: r for r in orderhash.compare_with_edits(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()}
    texts = {i: t or "" for i, t, _ in rows}
    order = sorted(texts)
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        text, quarter = texts[i], len(texts[i]) // 4
        edited = text[: len(text) - quarter] + texts[after][:quarter]
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and found[i].n_chars == len(text)
    same = lambda a, b: sum(a[k : k + 8] == b[k : k + 8] for k in range(0, len(a), 8)) / (len(a) // 8)
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        assert found[i].near_edited == same(found[i].fingerprint, found[i].edited_fingerprint)
        assert found[i].near_next == same(found[i].fingerprint, found[after].fingerprint)


def test_likeness_falls_with_edits_and_with_moved_passages(spark):
    dice = random.Random(3)
    base = [words(dice, 1) for _ in range(400)]
    moved = [w for k in range(0, 400, 8) for w in base[k : k + 8][::-1]]
    halves = base[200:] + base[:200]
    texts = [" ".join(base), " ".join([*base[:100], "new", *base[100:]]), " ".join(base[:200] + words(dice, 200).split(" ")), " ".join(halves), " ".join(moved), words(dice, 400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    sketches = [r.s for r in orderhash.with_sketches(df, "text", "s", sketches=128).orderBy("id").collect()]
    like = [sum(a == b for a, b in zip(sketches[0], s, strict=True)) / 128 for s in sketches]
    assert like[0] == 1 and like[1] > 0.9 and 0.1 < like[2] < 0.6 and like[5] < 0.05
    assert 0.3 < like[3] < 0.7  # the same k-mers but for one seam, half of the pairs in the other order
    assert like[4] < 0.1


def test_repeats_count(spark):
    df = spark.createDataFrame([(0, "a b c d " * 50), (1, "a b c d " * 51), (2, "a b c d " * 400), (3, "a b c d " * 50)], "id int, text string")
    sketches = [r.s for r in orderhash.with_sketches(df, "text", "s").orderBy("id").collect()]
    assert sketches[0] == sketches[3] and sketches[0] != sketches[2]
    near, far = (sum(a == b for a, b in zip(sketches[0], sketches[k], strict=True)) for k in (1, 2))
    assert near > far


def test_nulls_repeated_keys_and_empty_tables(spark):
    rows = [(1, "one two three four five", ""), (1, "one two three four five", ""), (2, "zzz", ""), (2, "aaa", ""), (None, "no key at all here", "")]
    found = orderhash.compare_with_edits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    edited = {r.edited_sha256 for r in found if r.doc_id == 1}
    text = rows[0][1]
    assert edited == {hashlib.sha256((text[: len(text) - len(text) // 4] + "aaa"[: len(text) // 4]).encode()).hexdigest()}
    assert [r.near_next for r in found if r.doc_id is None] == [None]
    assert orderhash.compare_with_edits(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = orderhash.compare_with_edits(spark.createDataFrame([(1, "only one document", "")], SCHEMA)).first()
    assert alone.near_next == 1.0


def test_no_python_runs(spark):
    df = spark.createDataFrame([(1, "a b c")], "id int, text string")
    plan = orderhash.with_sketches(df, "text", "s").select(F.col("s"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
