"""Sums and bitmaps kept per day, which merge: heat and distinct counts of any window without reading entries again.

Sums are undecayed and kept by batch, so that a batch that comes again replaces itself and counts once; the decay
multiplies whole days and is applied when heat is read. Distinct keys are kept as bitmaps, 32,768 keys a row; merged by
OR they give exact counts, which sums of daily counts cannot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators.heat import DECAY, WINDOWS, in_window, with_as_of


def store_sums(entries: DataFrame, path: str, batch: int, date: str = "date", place: str = "place") -> None:
    """Adds the sums of one batch of ``entries`` (date, place, weight, pcount), or replaces those it gave before.

    ``batch`` names the entries, as a stream's batch id does. Entries without a date have no day to count for.
    """
    value = F.sum(F.col("weight") / F.nullif(F.col("pcount"), F.lit(0)))
    dated = entries.filter(F.col(date).isNotNull())
    sums = dated.groupBy(F.col(date).alias("date"), F.col(place).alias("place")).agg(value.alias("value"), F.count(F.lit(1)).alias("n"))
    sums.write.mode("overwrite").parquet(f"{path}/batch={int(batch)}")


def stored_sums(spark: SparkSession, path: str) -> DataFrame:
    """(date, place, value, n) of all batches."""
    kept = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return kept.groupBy("date", "place").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))


def store_stream(entries: DataFrame, path: str, checkpoint: str, **columns: str):
    """A query that stores every micro-batch of a stream of ``entries`` under its id: one that is run again counts once."""
    def store(batch: DataFrame, number: int) -> None:
        store_sums(batch, path, number, **columns)

    return entries.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def windowed_heat_of(sums: DataFrame, windows: Sequence[int] = WINDOWS, decay: float = DECAY) -> DataFrame:
    """(days, place, heat, n) for every trailing window, from stored sums: as :func:`broadsheet.operators.heat.windowed_heat`."""
    dated = with_as_of(sums)
    age = F.datediff("as_of", "date")
    days = F.explode(F.filter(F.array(*[F.lit(w) for w in windows]), lambda w: in_window(F.col("date"), F.col("as_of"), w)))
    shares = dated.select("place", "n", (F.col("value") * F.pow(F.lit(decay), age)).alias("share"), days.alias("days"))
    return shares.groupBy("days", "place").agg(F.round(F.sum("share"), 4).alias("heat"), F.sum("n").alias("n"))


def heat_of(sums: DataFrame, decay: float = DECAY) -> DataFrame:
    """(place, heat, n) of the whole history."""
    share = F.col("value") * F.pow(F.lit(decay), F.datediff("as_of", "date"))
    return with_as_of(sums).groupBy("place").agg(F.round(F.sum(share), 4).alias("heat"), F.sum("n").alias("n"))


# Bitmaps ------------------------------------------------------------------------------------------------


def key_bitmaps(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """(by, bucket, bits): the distinct keys (whole numbers from 0) of each group; null keys are none."""
    keys = rows.filter(F.col(key).isNotNull()).select(*by, F.bitmap_bucket_number(key).alias("bucket"), F.bitmap_bit_position(key).alias("_bit"))
    return keys.groupBy(*by, "bucket").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def distinct_keys_of(bitmaps: DataFrame, *by: str) -> DataFrame:
    """(by, keys): how many distinct keys the merged bitmaps (by, ..., bucket, bits) hold."""
    merged = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("keys"))


def windowed_keys(bitmaps: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """(days, keys): the distinct keys of every trailing window, from bitmaps per day (date, bucket, bits)."""
    days = F.explode(F.filter(F.array(*[F.lit(w) for w in windows]), lambda w: in_window(F.col("date"), F.col("as_of"), w)))
    return distinct_keys_of(with_as_of(bitmaps).select(days.alias("days"), "bucket", "bits"), "days")


#: Bits of the filter of possibly known titles: 32 rows of 4 KB.
FILTER_BITS = 1 << 20


def _slot(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(FILTER_BITS)).cast("long")


def title_filter(titles: DataFrame, title: Column) -> DataFrame:
    """(bucket, bits): a bitmap of the hashes of ``title``, of FILTER_BITS bits whatever their number."""
    return key_bitmaps(titles.select(_slot(title).alias("_slot")), "_slot")


def merged_filter(filters: DataFrame) -> DataFrame:
    """One filter of several, such as those of each day."""
    return filters.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def possibly_in(candidates: DataFrame, title: Column, filters: DataFrame, name: str = "possible") -> DataFrame:
    """``candidates`` with the boolean ``name``: false if their title is surely in no filter. The filter is broadcast: at
    most FILTER_BITS bits. A null title is in none."""
    slot = _slot(title)
    known = F.broadcast(filters.select(F.col("bucket").alias("_bucket"), "bits"))
    joined = candidates.withColumn("_slot", slot).join(known, F.bitmap_bucket_number("_slot") == F.col("_bucket"), "left")
    at = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(_byte, cast(_bit % 8 as int)) & 1") == 1
    marked = joined.withColumn("_byte", byte).withColumn("_bit", at).withColumn(name, F.coalesce(is_set, F.lit(False)) & title.isNotNull())
    return marked.drop("_slot", "_bucket", "bits", "_byte", "_bit")
