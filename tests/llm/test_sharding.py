"""The laws of the hash tree."""

from collections import Counter

from pyspark.sql import functions as F

from broadsheet.llm import sharding

SCHEMA = "doc_id long, text string, shard_hint int"


def docs(spark, n=8000):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("shard_hint"))


def test_one_more_shard_takes_rows_only_into_itself(spark):
    for n in (1, 3, 7, 35, 39, 40, 41, 45):
        shards = sharding.layout(n)
        both = sharding.assign_shards(sharding.assign_shards(docs(spark), shards), sharding.grown(shards), shard="grown")
        moved = both.filter("shard <> grown").select("grown").distinct().collect()
        assert {r.grown for r in moved} == {n}
    assert sharding.grown(sharding.layout(40)) == sharding.layout(41) and sharding.layout(42) == sharding.grown(sharding.layout(41))


def test_shares_follow_the_weights(spark):
    shards = [sharding.Shard("a", "a/1", 0, 1.0), sharding.Shard("a", "a/1", 1, 3.0), sharding.Shard("b", "b/1", 2, 4.0), sharding.Shard("b", "b/2", 3, 0.0)]
    counts = Counter(r.shard for r in sharding.assign_shards(docs(spark), shards).collect())
    assert 3 not in counts and abs(counts[0] - 1000) < 150 and abs(counts[1] - 3000) < 250 and abs(counts[2] - 4000) < 250


def test_a_weight_change_moves_rows_only_through_its_subtree(spark):
    old = [sharding.Shard(r, f"{r}/{k}", i * 2 + k) for i, r in enumerate("abc") for k in (0, 1)]
    new = [sharding.Shard(s.region, s.rack, s.number, 2.0 if s.number == 0 else 1.0) for s in old]
    both = sharding.assign_shards(sharding.assign_shards(docs(spark), old), new, shard="after").filter("shard <> after").collect()
    assert both and all(r.after in (0, 1) for r in both)  # into region a, whose weight grew
    assert all(r.after == 0 for r in both if r.shard == 1)


def test_slots_are_gapless_with_repeats_and_nulls(spark):
    rows = [(None, None, 1), (None, "", 2)] + [(5, "same", 3)] * 50 + [(i, "x", i) for i in range(200)]
    placed = sharding.with_slots(sharding.assign_shards(spark.createDataFrame(rows, SCHEMA).repartition(6), sharding.layout(7)))
    by = {}
    for r in placed.collect():
        by.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, by.values())) == len(rows) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert placed.filter("doc_id = 5").select("shard").distinct().count() == 1
    assert sharding.with_slots(sharding.assign_shards(spark.createDataFrame([], SCHEMA), sharding.layout(7))).count() == 0


def test_shards_are_written_one_folder_each(spark, tmp_path):
    placed = sharding.assign_shards(docs(spark, 300), sharding.layout(5))
    sharding.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 5
