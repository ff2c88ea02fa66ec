"""Time-decayed heat of places, for the whole history or several trailing windows in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.operators.listing import numbered

DECAY = 0.93
WINDOWS = (7, 30, 90)


def date_bounds(reports: DataFrame, date: str = "date") -> DataFrame:
    """One row: start and as_of, the first and last date of the data (never the clock)."""
    return reports.agg(F.min(date).alias("start"), F.max(date).alias("as_of"))


def decayed_weight(weight, date, as_of, decay: float = DECAY) -> Column:
    return weight * F.pow(F.lit(decay), F.datediff(as_of, date))


def with_as_of(items: DataFrame, date: str = "date") -> DataFrame:
    """``items`` with ``as_of``, the date of the newest; one row is broadcast."""
    return items.crossJoin(F.broadcast(date_bounds(items, date).select("as_of")))


def fan_out_share(items: DataFrame, places: str = "places", value: str = "value") -> DataFrame:
    """A row per (item, place) with ``share``: the value divided evenly; ``share_2dp`` rounded half up.

    explode_outer, as explode would push a test of the array below, where it is computed once more.
    """
    share = F.col(value) / F.nullif(F.size(places), F.lit(0))
    return items.withColumn("share", share).withColumn("share_2dp", F.round("share", 2)).withColumn("place", F.explode_outer(places)).filter("place IS NOT NULL")


def heat_by_place(entries: DataFrame, place: str = "place") -> DataFrame:
    """Sum of the unrounded shares (rounded once, to four places) and number of entries."""
    return entries.groupBy(place).agg(F.round(F.sum("share"), 4).alias("heat"), F.count(F.lit(1)).alias("n"))


def in_window(date, as_of, days) -> Column:
    """as_of and the ``days`` - 1 days before it."""
    return F.datediff(as_of, date) < days


def windowed_heat(entries: DataFrame, windows: Sequence[int] = WINDOWS, decay: float = DECAY, place: str = "place") -> DataFrame:
    """(days, place, heat, n) for every trailing window at once; ``entries`` has date, as_of, weight and pcount."""
    days = F.explode(F.filter(F.array(*[F.lit(w) for w in windows]), lambda w: in_window(F.col("date"), F.col("as_of"), w)))
    share = decayed_weight(F.col("weight"), F.col("date"), F.col("as_of"), decay) / F.col("pcount")
    counted = entries.withColumn("share", share).select(place, "share", days.alias("days"))
    return counted.groupBy("days", place).agg(F.round(F.sum("share"), 4).alias("heat"), F.count(F.lit(1)).alias("n"))


def heat_stats(items: DataFrame, entries: DataFrame, heat: DataFrame, item_key: Sequence[str], scored: Column) -> DataFrame:
    """One row: scored items, items with a place, those without, and the largest heat."""
    total = items.agg(F.count_if(scored).alias("total"))
    attributed = entries.agg(F.count_distinct(*item_key).alias("attributed"))
    return total.crossJoin(attributed).crossJoin(heat.agg(F.max("heat").alias("max_heat"))).select(
        "total", "attributed", (F.col("total") - F.col("attributed")).alias("excluded"), "max_heat"
    )


def theme_facets(entries: DataFrame, *by: str, themes: str = "themes") -> DataFrame:
    """Entries per theme (an entry counts once for each of its themes)."""
    return entries.withColumn("theme", F.explode(themes)).groupBy(*by, "theme").agg(F.count(F.lit(1)).alias("n"))


def filter_theme(entries: DataFrame, theme: str, themes: str = "themes") -> DataFrame:
    return entries.filter(F.array_contains(themes, theme))


def facet_hits(entries: DataFrame, theme: str, *by: str, themes: str = "themes") -> DataFrame:
    """How many of the entries have a theme: hits of total."""
    return entries.groupBy(*by).agg(F.count_if(F.array_contains(themes, theme)).alias("hits"), F.count(F.lit(1)).alias("total"))


def scale_layer(heat: DataFrame, value: str = "heat") -> DataFrame:
    """Map sizes: vm_max = max(1, ceil(1.05 * largest)), size 5 to 38, labels from 15 % of the largest, inside from size 26."""
    top = heat.agg(F.max(value).alias("_top")).withColumn("vm_max", F.greatest(F.lit(1), F.ceil(F.col("_top") * 1.05)))
    sized = heat.crossJoin(F.broadcast(top)).withColumn("size", 5 + F.col(value) / F.col("vm_max") * 33)
    return sized.withColumn("labelled", F.col(value) >= F.col("_top") * 0.15).withColumn("inside", F.col("size") >= 26).drop("_top")


def join_geo(heat: DataFrame, names: DataFrame, centroids: DataFrame) -> DataFrame:
    """``heat`` with full name (names: place, full_name) and centroid (centroids: full_name, ...); places without one go."""
    return heat.join(names, "place").join(centroids, "full_name")


def top_places(heat: DataFrame, n: int = 10, tie: str = "place") -> DataFrame:
    """The ``n`` hottest, ties by ``tie``."""
    return heat.orderBy(F.col("heat").desc(), tie).limit(n)


def drilldown(entries: DataFrame, *ties: str, place: str = "place") -> DataFrame:
    """``entries`` with their position in the place: by weight, then newest, then position in the text."""
    return numbered(entries, place, "weight", F.col("date").desc(), *ties)


def place_items(entries: DataFrame, *ties: str, place: str = "place") -> DataFrame:
    """``entries`` with their position in the place, newest first."""
    return numbered(entries, place, "date", *ties)


def heat_document(heat: DataFrame, entries: DataFrame, *item: str, place: str = "place") -> DataFrame:
    """A row per item of a place: the place's heat and n, the item's position (newest first, ties by the ``item``
    columns), date and ``item`` columns. A place holds too many items for one row."""
    shown = heat.withColumnRenamed(place, "_place")
    items = place_items(entries, *item, place=place).select(place, "position", "date", *item)
    return items.join(shown, F.col(place).eqNullSafe(F.col("_place"))).drop("_place")
