import os

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import heat
from broadsheet.streaming.heat import daily_sums, heat_of

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.mark.skipif(not os.path.exists(EVENTS), reason="the driver's tables are not here")
def test_streamed_heat_equals_batch_heat(spark, tmp_path):
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    shaped = events.select("ts", F.col("event_type").alias("place"), F.lit(2).alias("weight"), F.lit(1).alias("pcount"))
    source = str(tmp_path / "in")
    shaped.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(shaped.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = daily_sums(stream, lateness="60 days").writeStream.outputMode("complete").format("memory").queryName("sums").start()
    query.processAllAvailable()
    query.stop()
    batch = heat.with_as_of(shaped.withColumn("date", F.to_date("ts")))
    batch = batch.withColumn("share", heat.decayed_weight(F.col("weight"), F.col("date"), F.col("as_of")))
    expected = {tuple(r) for r in heat.heat_by_place(batch).collect()}
    assert {tuple(r) for r in heat_of(spark.table("sums")).collect()} == expected
