"""Queries of the heat family: A1-A9, A14, O1-O4, J2, S4 over events, parts and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.operators import classify, heat, stored
from broadsheet.plans.base import THEMES, shared_path, sql_text, table
from broadsheet.sources import documents


def _entries_of(events: DataFrame) -> DataFrame:
    """event_id, user_id, place (event_type), date, weight and pcount of each event."""
    weight, pcount = 1 + F.floor(F.col("value") / 20), 1 + F.pmod("event_id", F.lit(3))
    return events.select(
        "event_id", "user_id", F.col("event_type").alias("place"), F.to_date("ts").alias("date"), weight.cast("long").alias("weight"),
        pcount.cast("long").alias("pcount"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored entries: event_id, place (event_type), date, as_of, weight, pcount, share."""
    dated = heat.with_as_of(_entries_of(table(spark, sf_dir, "events")))
    return dated.withColumn("share", heat.decayed_weight(F.col("weight"), F.col("date"), F.col("as_of")) / F.col("pcount"))


_E = """WITH ev AS (
  SELECT event_id, user_id, event_type AS place, CAST(ts AS DATE) AS date, CAST(1 + floor(value / 20) AS BIGINT) AS weight, 1 + event_id % 3 AS
    pcount FROM events
), e AS (
  SELECT *, date_diff('day', date, (SELECT max(date) FROM ev)) AS age FROM ev
), s AS (SELECT *, weight * pow(0.93, age) / pcount AS share FROM e)"""


def a01_bounds(spark, sf_dir):
    bounds = heat.date_bounds(table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")))
    return bounds.select(F.col("start").cast("string").alias("start"), F.col("as_of").cast("string").alias("as_of"))


def a02_decay(spark, sf_dir):
    value = heat.decayed_weight(F.col("weight"), F.col("date"), F.col("as_of"))
    return entries(spark, sf_dir).select("event_id", F.round(value, 6).alias("decayed"))


def a04_heat(spark, sf_dir):
    return heat.heat_by_place(entries(spark, sf_dir))


def a05_lists(spark, sf_dir):
    found = heat.place_items(entries(spark, sf_dir), "event_id", place="user_id")
    return found.select("user_id", "position", "event_id", F.col("date").cast("string").alias("date"))


def a06_stats(spark, sf_dir):
    items = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("date"), "event_type", "value")
    scored = entries(spark, sf_dir).filter("weight > 1")
    return heat.heat_stats(items, scored, heat.heat_by_place(scored), ["date", "event_id"], F.col("event_type").isNotNull())


def a07_windows(spark, sf_dir):
    return heat.windowed_heat(entries(spark, sf_dir), (7, 14, 30)).select("days", "place", "heat", "n")


def a07_stored(spark, sf_dir):
    """Stores sums of three batches of entries, the second one twice, and reads every window from the sums."""
    rows, path = entries(spark, sf_dir), shared_path(spark, "sums")
    for batch in (0, 1, 2, 1):
        stored.store_sums(rows.filter(F.col("event_id") % 3 == batch), path, batch)
    return stored.windowed_heat_of(stored.stored_sums(spark, path), (7, 14, 30)).select("days", "place", "heat", "n")


def a07_streamed(spark, sf_dir):
    """Events as a stream of files whose micro-batches are stored as sums; every window is read from the sums."""
    events, arrived = table(spark, sf_dir, "events"), shared_path(spark, "arrived")
    events.repartition(3, "event_id").write.parquet(arrived)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(arrived)
    sums, state = shared_path(spark, "sums"), shared_path(spark, "state")
    stored.store_stream(_entries_of(stream), sums, state).trigger(availableNow=True).start().awaitTermination()
    return stored.windowed_heat_of(stored.stored_sums(spark, sums), (7, 14, 30)).select("days", "place", "heat", "n")


def a06_distinct(spark, sf_dir):
    """Distinct users of every window, merged from a bitmap of each day's users."""
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("date"))
    return stored.windowed_keys(stored.key_bitmaps(events, "user_id", "date"), (7, 14, 30))


def themed_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", classify.themes_of(F.array("p_type", F.upper("p_name")), THEMES).alias("themes"))


def a08_facets(spark, sf_dir):
    return heat.theme_facets(themed_parts(spark, sf_dir), "p_brand")


def a09_facet_hits(spark, sf_dir):
    return heat.facet_hits(themed_parts(spark, sf_dir), "plan", "p_brand")


def balances(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("heat"))
    return customers.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("place"), "heat")


def a14_scale(spark, sf_dir):
    return heat.scale_layer(balances(spark, sf_dir)).select(
        "place", "heat", F.col("vm_max").cast("long").alias("vm_max"), F.round("size", 4).alias("size"), "labelled", "inside"
    )


def j02_geo(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("place"), F.col("n_regionkey").alias("full_name"))
    centroids = table(spark, sf_dir, "region").filter("r_regionkey < 4").select(F.col("r_regionkey").alias("full_name"), F.col("r_name").alias("region"))
    return heat.join_geo(balances(spark, sf_dir), names, centroids).select("place", "region", "heat")


def o01_order(spark, sf_dir):
    found = heat.heat_by_place(entries(spark, sf_dir)).orderBy(F.col("heat").desc(), "place")
    rank = F.row_number().over(Window.orderBy(F.col("heat").desc(), "place"))  # a row per place
    return found.withColumn("position", rank.cast("long"))


def o02_top(spark, sf_dir):
    return heat.top_places(balances(spark, sf_dir), 10)


def o03_drilldown(spark, sf_dir):
    return heat.drilldown(entries(spark, sf_dir), "event_id").select("place", "position", "event_id", "weight", F.col("date").cast("string").alias("date"))


def o04_place_items(spark, sf_dir):
    return heat.place_items(entries(spark, sf_dir), "event_id").select("place", "position", "event_id", F.col("date").cast("string").alias("date"))


def s04_heat_document(spark, sf_dir):
    """Writes the document as JSON lines to the shared folder and reads them back."""
    rows = entries(spark, sf_dir)
    found = heat.heat_document(heat.heat_by_place(rows), rows, "event_id", "weight")
    path = shared_path(spark, "heat")
    documents.write_json(found.withColumn("date", F.col("date").cast("string")), path)
    return spark.read.schema("place string, position long, date string, event_id long, weight long, heat double, n long").json(path)


_BAL = """WITH h AS (
  SELECT n_name AS place, n_regionkey, round(sum(c_acctbal), 2) AS heat FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
_THEME_VALUES = ", ".join(f"({sql_text(t)}, {sql_text(w)}, {i})" for i, (t, w) in enumerate(THEMES))
_PARTS = f"""WITH tags AS (
  SELECT p_partkey, p_brand, 0 AS k, p_type AS tag FROM part UNION ALL SELECT p_partkey, p_brand, 1, upper(p_name) FROM part
), hits AS (
  SELECT p_partkey, p_brand, k, arg_min(theme, ord) AS theme FROM tags JOIN (VALUES {_THEME_VALUES}) AS d(theme, word, ord) ON strpos(tag, word) > 0
    GROUP BY ALL
), th AS (SELECT DISTINCT p_partkey, p_brand, theme FROM hits)"""

_WINDOWS = _E + """ SELECT CAST(days AS INTEGER) AS days, place, round(sum(share), 4) AS heat, count(*) AS n
FROM s JOIN (VALUES (7), (14), (30)) AS w(days) ON age < days GROUP BY ALL"""

QUERIES = {
    "a01_date_bounds": (a01_bounds, "SELECT CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS start, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS as_of FROM events"),
    "a02_decayed_weight": (a02_decay, _E + " SELECT event_id, round(weight * pow(0.93, age), 6) AS decayed FROM s"),
    "a04_heat_by_place": (a04_heat, _E + " SELECT place, round(sum(share), 4) AS heat, count(*) AS n FROM s GROUP BY place"),
    "a05_place_lists": (a05_lists, _E + " SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, event_id) AS position, event_id, CAST(date AS VARCHAR) AS date FROM s"),
    "a06_heat_stats": (a06_stats, _E + """, sc AS (SELECT * FROM s WHERE weight > 1), h AS (SELECT round(sum(share), 4) AS heat FROM sc GROUP BY place)
SELECT (SELECT count(*) FROM events WHERE event_type IS NOT NULL) AS total, (SELECT count(DISTINCT (date, event_id)) FROM sc) AS attributed,
       (SELECT count(*) FROM events WHERE event_type IS NOT NULL) - (SELECT count(DISTINCT (date, event_id)) FROM sc) AS excluded, (SELECT max(heat)
  FROM h) AS max_heat"""),
    "a07_windowed_heat": (a07_windows, _WINDOWS),
    "a07_stored_heat": (a07_stored, _WINDOWS),
    "a07_streamed_heat": (a07_streamed, _WINDOWS),
    "a06_distinct_users": (a06_distinct, _E + """ SELECT CAST(days AS INTEGER) AS days, count(DISTINCT user_id) AS keys
FROM s JOIN (VALUES (7), (14), (30)) AS w(days) ON age < days GROUP BY ALL"""),
    "a08_theme_facets": (a08_facets, _PARTS + " SELECT p_brand, theme, count(*) AS n FROM th GROUP BY ALL"),
    "a09_facet_hits": (a09_facet_hits, _PARTS + """ SELECT p_brand, count(th.p_partkey) AS hits, count(*) AS total
FROM part LEFT JOIN (SELECT p_partkey FROM th WHERE theme = 'plan') th USING (p_partkey) GROUP BY p_brand"""),
    "a14_scale_layer": (a14_scale, _BAL + """, m AS (SELECT max(heat) AS top, greatest(1, ceil(max(heat) * 1.05)) AS vm FROM h)
SELECT place, heat, CAST(vm AS BIGINT) AS vm_max, round(5 + heat / vm * 33, 4) AS size, heat >= top * 0.15 AS labelled, 5 + heat / vm * 33 >= 26 AS
  inside FROM h, m"""),
    "j02_geo": (j02_geo, _BAL + " SELECT place, r_name AS region, heat FROM h JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 4"),
    "o01_place_order": (o01_order, _E + """, h AS (SELECT place, round(sum(share), 4) AS heat, count(*) AS n FROM s GROUP BY place)
SELECT *, row_number() OVER (ORDER BY heat DESC, place) AS position FROM h"""),
    "o02_top_places": (o02_top, _BAL + " SELECT place, heat FROM h ORDER BY heat DESC, place LIMIT 10"),
    "o03_drilldown": (o03_drilldown, _E + """ SELECT place, row_number() OVER (PARTITION BY place ORDER BY weight DESC, date DESC, event_id) AS position, event_id, weight, CAST(date AS VARCHAR) AS date FROM s"""),
    "o04_place_items": (o04_place_items, _E + " SELECT place, row_number() OVER (PARTITION BY place ORDER BY date DESC, event_id) AS position, event_id, CAST(date AS VARCHAR) AS date FROM s"),
    "s04_heat_document": (s04_heat_document, _E + """, h AS (SELECT place, round(sum(share), 4) AS heat, count(*) AS n FROM s GROUP BY place)
SELECT place, row_number() OVER (PARTITION BY place ORDER BY date DESC, event_id) AS position, CAST(date AS VARCHAR) AS date, event_id, weight, heat,
  n FROM s JOIN h USING (place)"""),
}
