"""Listings of reports: neighbours, newest k, unions and URL rows.

Windows without a partition run over one row per report date, never over items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.sources.shared import written


def prev_next(reports: DataFrame, *shown: str, date: str = "date") -> DataFrame:
    """``reports`` (one per date) with prev_* and next_* of ``shown``; null at the ends."""
    order = Window.orderBy(date)
    both = {f"{side}_{c}": f(c).over(order) for c in shown for side, f in (("prev", F.lag), ("next", F.lead))}
    return reports.withColumns(both)


def latest_k(reports: DataFrame, k: int, date: str = "date") -> DataFrame:
    """``reports`` with ``place`` from the newest, ``group`` latest or older, ``newest`` for the first, ``older_count``."""
    order = Window.orderBy(F.col(date).desc())
    ranked = reports.withColumn("place", F.row_number().over(order))
    count = F.count(F.lit(1)).over(Window.partitionBy())
    return ranked.withColumns({
        "group": F.when(F.col("place") <= k, "latest").otherwise("older"), "newest": F.col("place") == 1, "older_count": F.greatest(count - k, F.lit(0)),
    })


def newest_reports(reports: DataFrame, n: int, date: str = "date") -> DataFrame:
    """The newest ``n`` reports (not calendar days)."""
    return reports.orderBy(F.col(date).desc()).limit(n)


def digest_label(items: Column, rich: Column) -> Column:
    """How a digest is announced: its number of items, or composite when it has none but free sections."""
    return F.when(items > 0, F.concat(items.cast("string"), F.lit(" 条"))).when(rich > 0, "综合").otherwise("0 条")


#: monotonically_increasing_id() keeps the partition above this bit and the row within it below.
_ROW_BITS = 33


def numbered(rows: DataFrame, group: str, coarse: str, *order, name: str = "position") -> DataFrame:
    """``rows`` with their place (from 1) in ``group``: by ``coarse``, greatest first and null last, then ``order``.

    A group may be as large as the table, and all its rows may share a coarse value: rows are range-sorted by group and
    all order columns, which splits such a group, and written; each is numbered within its range partition and group, and
    the rows of the group in earlier partitions are added. Only a group that begins a partition can have such rows, so
    what is broadcast are at most two rows a partition. A null group is a group; rows equal in all these columns stay
    in one partition.
    """
    placed = rows.orderBy(group, F.col(coarse).desc(), *order).withColumn("_at", F.monotonically_increasing_id())
    kept = written(placed, "ordered").withColumn("_part", F.shiftright("_at", _ROW_BITS))
    openings = kept.groupBy("_part").agg(F.min_by(F.struct(group), "_at").alias("_open")).select(F.col(f"_open.{group}").alias("_open")).distinct()
    begun = kept.join(F.broadcast(openings), F.col(group).eqNullSafe(F.col("_open")), "left_semi")
    counts = begun.groupBy(F.col("_part").alias("_of"), F.col(group).alias("_open")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_open").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(counts.withColumn("_before", F.sum("_n").over(earlier)).drop("_n"))
    within = kept.withColumn("_within", F.row_number().over(Window.partitionBy("_part", group).orderBy("_at")))
    joined = within.join(offsets, (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_open")), "left")
    return joined.withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_within")).drop("_at", "_part", "_of", "_open", "_before", "_within")


def union_sections(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of ``first`` then of ``second`` (``section_ord`` 0, 1)."""
    return first.withColumn("section_ord", F.lit(0)).unionByName(second.withColumn("section_ord", F.lit(1)))


def distinct_keys(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


#: changefreq and priority of URL rows by kind.
URL_KINDS = {"daily": ("monthly", 0.8), "weekly": ("monthly", 0.7), "monthly": ("monthly", 0.7)}


def url_rows(base: str, static: DataFrame, **reports: DataFrame) -> DataFrame:
    """(loc, lastmod, changefreq, priority): ``static`` rows and one per report of each kind (date); only dailies have lastmod."""
    out = static
    for kind, rows in reports.items():
        freq, priority = URL_KINDS[kind]
        name = F.concat(F.lit(base + "reports/" + ("" if kind == "daily" else f"{kind}-")), F.col("date").cast("string"), F.lit(".html"))
        row = rows.select(name.alias("loc"), F.lit(freq).alias("changefreq"), F.lit(priority).alias("priority"), *(["date"] if kind == "daily" else []))
        out = out.unionByName(row.withColumnRenamed("date", "lastmod"), allowMissingColumns=True)
    return out


def deep_link(date, item_id) -> Column:
    return F.format_string("reports/%s.html#%s", date.cast("string"), item_id)
