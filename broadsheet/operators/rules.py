"""Dictionary and rule tables, and their form as array literals inside expressions.

place_dict(kw, place, layer in place/city/site, ord); rules(rule_set, kw); theme_dict(theme, theme_ord, word).
A dictionary is a table of a few thousand rows at most: it is read once on the driver, checked against
``MAX_TERMS`` and written into the plan as a literal; a larger one goes through the join forms
(:func:`broadsheet.operators.classify.keyword_hits` and ``attribute_places_joined``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Above this many rows a dictionary does not become a literal.
MAX_TERMS = 5_000

PLACE_SCHEMA = "kw string, place string, layer string, ord int"
RULE_SCHEMA = "rule_set string, kw string"
THEME_SCHEMA = "theme string, theme_ord int, word string"


def place_table(spark: SparkSession, rows: Iterable[tuple[str, str, str, int]]) -> DataFrame:
    return spark.createDataFrame(list(rows), PLACE_SCHEMA)


def theme_table(spark: SparkSession, rows: Iterable[tuple[str, int, str]]) -> DataFrame:
    return spark.createDataFrame(list(rows), THEME_SCHEMA)


def without_forbidden(place_dict: DataFrame, forbidden: DataFrame) -> DataFrame:
    """``place_dict`` without the keywords listed in ``forbidden`` (kw)."""
    return place_dict.join(forbidden, "kw", "left_anti")


def terms(table: DataFrame, *columns: str, order: str | None = None) -> list[tuple]:
    rows = table.select(*columns, *([order] if order and order not in columns else [])).limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a dictionary of more than {MAX_TERMS} rows needs the join form")
    if order:
        rows.sort(key=lambda r: r[order])
    return [tuple(r[c] for c in columns) for r in rows]


def strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")
