"""Numbering within groups of any size, with nulls."""

import random

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import heat, listing


def _expected(rows):
    groups = {}
    for g, c, i in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2] is not None, r[2] or 0)):
        groups.setdefault(g, []).append((c, i))
    return sorted(repr((g, n, c, i)) for g, found in groups.items() for n, (c, i) in enumerate(found, 1))


@pytest.mark.parametrize("seed", range(3))
def test_places_in_groups(spark, seed):
    dice = random.Random(seed)
    rows = [(dice.choice(["hot"] * 8 + ["a", "b", None]), dice.choice([1, 1, 1, 2, None]), i) for i in range(2_000)]
    df = spark.createDataFrame(rows, "g string, c int, i int").repartition(5)
    assert sorted(repr((r.g, r.position, r.c, r.i)) for r in listing.numbered(df, "g", "c", "i").collect()) == _expected(rows)
    assert listing.numbered(df.limit(0), "g", "c", "i").collect() == []


def test_a_hot_place_of_one_weight_is_numbered_by_several_tasks(spark):
    entries = spark.range(20_000).select(F.lit("hot").alias("place"), F.lit(1).alias("weight"), F.lit("2024-01-01").cast("date").alias("date"), "id")
    found = heat.drilldown(entries, "id")
    tasks = found.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len([t for t in tasks if t["count"]]) > 1
    assert found.filter("position = id + 1").count() == 20_000


def test_null_dates_places_and_weights_keep_their_rows(spark):
    rows = [("x", None, 1, 1), (None, "2024-01-02", 1, 2), ("x", "2024-01-02", None, 3), ("x", "2024-01-03", 1, 4)]
    entries = spark.createDataFrame(rows, "place string, day string, weight int, id int").withColumn("date", F.to_date("day"))
    assert sorted((str(r.place), r.position, r.id) for r in heat.place_items(entries, "id").collect()) == [("None", 1, 2), ("x", 1, 4), ("x", 2, 3), ("x", 3, 1)]
    assert sorted((str(r.place), r.position, r.id) for r in heat.drilldown(entries, "id").collect()) == [("None", 1, 2), ("x", 1, 4), ("x", 2, 1), ("x", 3, 3)]
    scored = entries.withColumn("share", F.lit(1.0))
    assert heat.heat_document(heat.heat_by_place(scored), scored, "id", "weight").count() == 4
