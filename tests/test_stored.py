"""Mergeable sums and bitmaps: replays, windows, streams, exact distinct counts, filters without false negatives."""

import datetime
import random

from pyspark.sql import functions as F

from broadsheet.operators import dedup, heat, stored


def _entries(spark, seed=0, n=300):
    dice = random.Random(seed)
    day = lambda: datetime.date(2024, 1, 1) + datetime.timedelta(days=dice.randrange(40))
    rows = [(i, dice.choice(["a", "b", None]), day(), dice.randrange(1, 5), dice.randrange(1, 4)) for i in range(n)]
    return spark.createDataFrame(rows, "id int, place string, date date, weight int, pcount int")


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_a_batch_that_comes_again_counts_once(spark, tmp_path):
    entries, path = _entries(spark), f"file://{tmp_path}/sums"
    for batch in (0, 1, 2):
        stored.store_sums(entries.filter(F.col("id") % 3 == batch), path, batch)
    plain = heat.windowed_heat(heat.with_as_of(entries), (7, 30, 90)).select("days", "place", "heat", "n")
    once = _rows(stored.windowed_heat_of(stored.stored_sums(spark, path), (7, 30, 90)))
    assert once == _rows(plain)
    stored.store_sums(entries.filter("id % 3 = 1"), path, 1)
    assert _rows(stored.windowed_heat_of(stored.stored_sums(spark, path), (7, 30, 90))) == once
    dated = heat.with_as_of(entries).withColumn("share", heat.decayed_weight(F.col("weight"), F.col("date"), F.col("as_of")) / F.col("pcount"))
    assert _rows(stored.heat_of(stored.stored_sums(spark, path))) == _rows(heat.heat_by_place(dated))


def test_a_stream_stores_each_of_its_batches_once(spark, tmp_path):
    entries = _entries(spark)
    source, path = f"{tmp_path}/in", f"file://{tmp_path}/sums"
    entries.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # the second run finds nothing new
        stored.store_stream(stream, path, f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    dated = heat.with_as_of(entries)
    assert _rows(stored.windowed_heat_of(stored.stored_sums(spark, path))) == _rows(heat.windowed_heat(dated).select("days", "place", "heat", "n"))


def test_distinct_keys_merge_exactly(spark):
    dice = random.Random(2)
    rows = [(dice.choice([None, *range(0, 200_000, 777)]), datetime.date(2024, 1, dice.randrange(1, 29))) for _ in range(2_000)]
    df = spark.createDataFrame(rows, "user long, date date")
    daily = stored.key_bitmaps(df, "user", "date")
    newest = max(d for _, d in rows)
    expected = {w: len({u for u, d in rows if u is not None and (newest - d).days < w}) for w in (3, 10, 30)}
    assert {r["days"]: r["keys"] for r in stored.windowed_keys(daily, (3, 10, 30)).collect()} == expected
    assert [r["keys"] for r in stored.distinct_keys_of(daily).collect()] == [len({u for u, _ in rows if u is not None})]


def test_a_filter_loses_no_known_title(spark):
    index = spark.createDataFrame([(f" Title {i} ",) for i in range(500)] + [(None,)], "title string")
    rows = [(i, f"TITLE {i}") for i in range(400, 600)] + [(1000, None), (1001, "")]
    candidates = spark.createDataFrame(rows, "id int, title string")
    filters = stored.title_filter(index, dedup.normal_title(F.col("title")))
    assert filters.count() <= 32
    found = {r.id: r.known for r in dedup.split_known(candidates, index, filters).collect()}
    assert found == {i: t is not None and i < 500 for i, t in rows}
    possible = stored.possibly_in(candidates, dedup.normal_title(F.col("title")), filters).filter("possible").count()
    assert 100 <= possible <= 110
    assert dedup.split_known(candidates, index.limit(0), filters.limit(0)).filter("known").count() == 0
