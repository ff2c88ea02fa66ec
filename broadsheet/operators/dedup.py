"""The index of known titles of the newest reports, and checks against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.text import strip
from broadsheet.operators.listing import newest_reports
from broadsheet.operators.stored import possibly_in


def normal_title(title) -> Column:
    return F.lower(strip(title))


def title_index(reports: DataFrame, items: DataFrame, n: int = 30, date: str = "date") -> DataFrame:
    """(date, item_id, title) of the items of the newest ``n`` reports; at most n keys are broadcast."""
    newest = F.broadcast(newest_reports(reports, n, date).select(date))
    return items.join(newest, date, "left_semi").select(date, "item_id", "title")


def anti_join_known(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """The candidates whose title the index does not have."""
    return _against(candidates, index, "left_anti")


def semi_join_known(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """The candidates whose title it has."""
    return _against(candidates, index, "left_semi")


def _against(candidates: DataFrame, index: DataFrame, how: str) -> DataFrame:
    known = index.select(normal_title(F.col("title")).alias("_known")).distinct()
    return candidates.join(known, normal_title(candidates["title"]) == known["_known"], how)


def split_known(candidates: DataFrame, index: DataFrame, filters: DataFrame, name: str = "known") -> DataFrame:
    """``candidates`` with the boolean ``name``: whether the index has their title.

    ``filters`` is a bitmap of the index's normal titles (:func:`broadsheet.operators.stored.title_filter`), kept per day
    and merged. Candidates that it excludes are unknown and meet no join; only the others are shuffled.
    """
    marked = possibly_in(candidates, normal_title(F.col("title")), filters, "_possible")
    known = index.select(normal_title(F.col("title")).alias("_known")).filter("_known IS NOT NULL").distinct()
    met = marked.filter("_possible").join(known, normal_title(F.col("title")) == F.col("_known"), "left")
    decided = met.withColumn(name, F.col("_known").isNotNull()).drop("_possible", "_known")
    return decided.union(marked.filter("NOT _possible").withColumn(name, F.lit(False)).drop("_possible"))


def index_size(index: DataFrame) -> DataFrame:
    """One row: reports and titles in the index (date, item_id, title)."""
    return index.agg(F.count_distinct("date").alias("reports"), F.count(F.lit(1)).alias("titles"))
