"""Heat kept up to date from a stream of entries.

The decay depends on the newest date, which a stream keeps moving, but it multiplies whole days: so the stream keeps
undecayed sums per day and place, which only ever add up, and the decay is applied when heat is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.operators.heat import DECAY


def daily_sums(entries: DataFrame, lateness: str = "2 days", time: str = "ts", place: str = "place") -> DataFrame:
    """(date, place, value, n) of a stream of entries (time, place, weight, pcount); later entries than ``lateness`` are dropped."""
    day = F.window(time, "1 day")
    sums = entries.withWatermark(time, lateness).groupBy(day.alias("day"), place)
    found = sums.agg(F.sum(F.col("weight") / F.col("pcount")).alias("value"), F.count(F.lit(1)).alias("n"))
    return found.select(F.to_date("day.start").alias("date"), place, "value", "n")


def heat_of(sums: DataFrame, decay: float = DECAY, place: str = "place") -> DataFrame:
    """Heat per place from stored daily sums, as of their newest date."""
    newest = sums.agg(F.max("date").alias("as_of"))
    decayed = F.col("value") * F.pow(F.lit(decay), F.datediff("as_of", "date"))
    joined = sums.crossJoin(F.broadcast(newest))
    return joined.groupBy(place).agg(F.round(F.sum(decayed), 4).alias("heat"), F.sum("n").alias("n"))
