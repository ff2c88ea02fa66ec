"""Queries of the listing, search, index and sink families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.functions.text import percent_encode
from broadsheet.operators import dedup, listing, search, stored
from broadsheet.plans.base import ITEMS_SQL, documents_as_items, flat, shared_path, table
from broadsheet.sources import documents


def _text(name: str):
    return F.col(name).cast("string").alias(name)


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per day of events: date, n, weekday."""
    events = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return events.withColumn("weekday", F.dayofweek("date").cast("long"))


_DAYS = "WITH d AS (SELECT CAST(ts AS DATE) AS date, count(*) AS n, dayofweek(CAST(ts AS DATE)) + 1 AS weekday FROM events GROUP BY 1)"


def w01_prev_next(spark, sf_dir):
    found = listing.prev_next(days(spark, sf_dir), "date", "weekday")
    return found.select(*[_text(c) for c in ("date", "prev_date", "next_date", "prev_weekday", "next_weekday")])


def w02_latest_k(spark, sf_dir):
    found = listing.latest_k(days(spark, sf_dir), 2)
    return found.select(_text("date"), F.col("place").cast("long").alias("place"), "group", "newest", "older_count")


def w03_first_match(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    hits = search.search(talk, "the  LES", "role", "text")
    return search.first_match(hits, ["conv_id"], "turn").select("conv_id", "turn")


def o06_by_date(spark, sf_dir):
    found = days(spark, sf_dir).orderBy(F.col("date").desc())
    rank = F.row_number().over(Window.orderBy(F.col("date").desc()))  # a row per day
    return found.select(_text("date"), "n", rank.cast("long").alias("position"))


def o07_newest(spark, sf_dir):
    return listing.newest_reports(days(spark, sf_dir), 5).select(_text("date"), "n")


def u01_urls(spark, sf_dir):
    base = "https://digest.example/"
    pages = [("", "daily", 1.0), ("jobs.html", "weekly", 0.6), ("about.html", "yearly", 0.3), ("intern.html", "weekly", 0.6), ("heatmap.html", "daily", 0.8)]
    static = spark.createDataFrame([(base + name, freq, priority) for name, freq, priority in pages], "loc string, changefreq string, priority double")
    static = static.withColumn("lastmod", F.lit(None).cast("date"))
    months = table(spark, sf_dir, "orders").select(F.to_date(F.date_format("o_orderdate", "yyyy-MM-28")).alias("date")).distinct()
    weeks = table(spark, sf_dir, "orders").select(F.date_add(F.trunc("o_orderdate", "week"), 6).alias("date")).distinct()
    found = listing.url_rows(base, static, daily=days(spark, sf_dir).select("date"), weekly=weeks, monthly=months)
    return found.select("loc", _text("lastmod"), "changefreq", "priority")


def u02_sections(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    clicks = F.coalesce(F.col("event_type") == "click", F.lit(False))
    found = listing.union_sections(events.filter(clicks), events.filter(~clicks))
    return found.withColumn("section_ord", F.col("section_ord").cast("long"))


def u03_distinct(spark, sf_dir):
    return listing.distinct_keys(table(spark, sf_dir, "events").withColumn("date", F.to_date("ts").cast("string")), "date", "user_id")


def q01_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", flat(search.query_terms(F.col("text"))).alias("terms"))


def q02_search(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), " Idiot WORTHLESS ", "text", "source").select("doc_id")


def q03_snippet(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", search.snippet(F.col("text"), F.lit("idiot")).alias("snippet"))


def q04_highlight(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", search.highlight(F.col("text"), "the", "[", "]").alias("marked"))


def q05_hits(spark, sf_dir):
    return search.search_hits(table(spark, sf_dir, "conversations"), "and der", ["conv_id"], "text")


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", search.query_terms(F.col("text")).alias("terms"))


def q06_batch(spark, sf_dir):
    items, questions = documents_as_items(spark, sf_dir), _questions(spark, sf_dir)
    found = search.search_batch(items, questions, "item_id", ["date"], "doc_id", "body", "title", "body")
    return found.select("item_id", _text("date"), "doc_id", "term", "snippet")


def q06_index(spark, sf_dir):
    """Builds the inverted index in the shared folder and probes it with all questions at once."""
    items, path = documents_as_items(spark, sf_dir), shared_path(spark, "index")
    search.write_index(items, path, ["date"], "doc_id", "title", "body")
    found = search.search_index(path, items, _questions(spark, sf_dir), "item_id", ["date"], "doc_id", "body")
    return found.select("item_id", _text("date"), "doc_id", "term", "snippet")


def j03_cards(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    cards = orders.select("o_orderkey", F.concat(F.lit("reports/"), F.to_date("o_orderdate").cast("string"), F.lit(".html")).alias("href"))
    reports = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.count(F.lit(1)).alias("items"))
    return search.join_cards_reports(cards, reports).select("o_orderkey", "href", _text("date"), "items")


def titled(spark, sf_dir):
    items = documents_as_items(spark, sf_dir)
    return items.select("date", F.format_string("item%012d", "doc_id").alias("item_id"), "title", "doc_id")


def _known(spark, sf_dir, how):
    items = titled(spark, sf_dir)
    index = dedup.title_index(items.select("date").distinct(), items, n=5)
    return how(items, index).select("doc_id")


def j04_unknown(spark, sf_dir):
    return _known(spark, sf_dir, dedup.anti_join_known)


def j04_known(spark, sf_dir):
    return _known(spark, sf_dir, dedup.semi_join_known)


def j04_filter(spark, sf_dir):
    """Known or not, by a bitmap of each day's titles, merged, and a join of those that may be known."""
    items = titled(spark, sf_dir)
    index = dedup.title_index(items.select("date").distinct(), items, n=5)
    daily = [stored.title_filter(index.filter(F.pmod(F.dayofmonth("date"), F.lit(2)) == k), dedup.normal_title(F.col("title"))) for k in (0, 1)]
    return dedup.split_known(items, index, stored.merged_filter(daily[0].union(daily[1]))).select("doc_id", "known")


def s03_search_index(spark, sf_dir):
    found = documents.build_search_index(table(spark, sf_dir, "conversations"), "conv_id", order="turn", body="text", body_chars=200, fields=("role",))
    texts = F.transform("items", lambda r: F.concat_ws(":", r["turn"].cast("string"), r["role"], r["text"]))
    return found.select("conv_id", flat(texts).alias("items"))


def s03_search_json(spark, sf_dir):
    """Writes the search index, a row per report with its items, as JSON lines to the shared folder and reads it back."""
    found = documents.build_search_index(table(spark, sf_dir, "conversations"), "conv_id", order="turn", body="text", body_chars=200, fields=("role",))
    path = shared_path(spark, "search")
    documents.write_json(found, path)
    read = spark.read.schema("conv_id long, items array<struct<turn long, role string, text string>>").json(path)
    texts = F.transform("items", lambda r: F.concat_ws(":", r["turn"].cast("string"), r["role"], r["text"]))
    return read.select("conv_id", flat(texts).alias("items"))


def s05_title_index(spark, sf_dir):
    """Writes the index, a row per item, as JSON lines to the shared folder and reads them back."""
    items = titled(spark, sf_dir)
    path = shared_path(spark, "titles")
    documents.write_json(dedup.title_index(items.select("date").distinct(), items, n=5).withColumn("date", _text("date")), path)
    return spark.read.schema("date string, item_id string, title string").json(path)


def a15_index_size(spark, sf_dir):
    items = titled(spark, sf_dir)
    return dedup.index_size(dedup.title_index(items.select("date").distinct(), items, n=5))


def s06_by_date(spark, sf_dir):
    """Writes events by date, one date twice, and reads the folders back."""
    events = table(spark, sf_dir, "events").select("event_id", "value", F.to_date("ts").alias("date"))
    path = shared_path(spark, "by_date")
    documents.write_by_date(events, path)
    documents.write_by_date(events.filter("date = '2024-01-02'"), path)
    return spark.read.parquet(path).groupBy(_text("date")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def f02_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    link = listing.deep_link(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(30)).cast("int")), F.concat(F.lit("item"), F.col("page_id").cast("string")))
    return pages.select("page_id", link.alias("link"), percent_encode(F.concat(F.lit("a b/"), F.col("url"))).alias("encoded"))


_TITLED = f"WITH {ITEMS_SQL}, newest AS (SELECT DISTINCT date FROM docs ORDER BY date DESC LIMIT 5)"
_INDEX = _TITLED + ", idx AS (SELECT DISTINCT lower(regexp_replace(title, '^\\s+|\\s+$', '', 'g')) AS t FROM docs WHERE date IN (SELECT date FROM newest))"
_CANDIDATE = "lower(regexp_replace(title, '^\\s+|\\s+$', '', 'g'))"

_BATCH = f"""WITH {ITEMS_SQL}, words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '') AS terms FROM benchmark
), asked AS (SELECT item_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS term_no FROM words),
hits AS (
  SELECT item_id, date, doc_id, term, body, row_number() OVER (PARTITION BY item_id, date ORDER BY doc_id, term_no) AS k
  FROM docs JOIN asked ON strpos(lower(title || ' ' || body), term) > 0
), c AS (
  SELECT *, strpos(lower(body), term) - 1 AS p, greatest(strpos(lower(body), term) - 31, 0) AS lo,
         least(strpos(lower(body), term) - 1 + length(term) + 40, length(body)) AS hi FROM hits WHERE k = 1
)
SELECT item_id, CAST(date AS VARCHAR) AS date, doc_id, term,
  CASE WHEN p >= 0 THEN CASE WHEN lo > 0 THEN '…' ELSE '' END || substr(body, lo + 1, hi - lo) || CASE WHEN hi < length(body) THEN '…' ELSE '' END
    END AS snippet
FROM c"""

_SEARCH = """SELECT conv_id, string_agg(concat_ws(':', CAST(turn AS VARCHAR), role, substr(text, 1, 200)), '|' ORDER BY turn) AS items
FROM conversations GROUP BY conv_id"""

QUERIES = {
    "w01_prev_next": (w01_prev_next, _DAYS + """ SELECT CAST(date AS VARCHAR) AS date, CAST(lag(date) OVER w AS VARCHAR) AS prev_date,
  CAST(lead(date) OVER w AS VARCHAR) AS next_date,
  CAST(lag(weekday) OVER w AS VARCHAR) AS prev_weekday, CAST(lead(weekday) OVER w AS VARCHAR) AS next_weekday FROM d WINDOW w AS (ORDER BY date)"""),
    "w02_latest_k": (w02_latest_k, _DAYS + """, r AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS place, count(*) OVER () AS c FROM d)
SELECT CAST(date AS VARCHAR) AS date, place, CASE WHEN place <= 2 THEN 'latest' ELSE 'older' END AS "group", place = 1 AS newest, greatest(c - 2, 0)
  AS older_count FROM r"""),
    "w03_first_match": (w03_first_match, """SELECT conv_id, min(turn) AS turn FROM conversations
WHERE strpos(lower(role || ' ' || text), 'the') > 0 OR strpos(lower(role || ' ' || text), 'les') > 0 GROUP BY conv_id"""),
    "o06_reports_by_date": (o06_by_date, _DAYS + " SELECT CAST(date AS VARCHAR) AS date, n, row_number() OVER (ORDER BY date DESC) AS position FROM d"),
    "o07_newest_reports": (o07_newest, _DAYS + ", t AS (SELECT date, n FROM d ORDER BY date DESC LIMIT 5) SELECT CAST(date AS VARCHAR) AS date, n FROM t"),
    "u01_url_rows": (u01_urls, _DAYS + """, m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-28') AS date FROM orders),
w AS (SELECT DISTINCT CAST(CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS VARCHAR) AS date FROM orders)
SELECT 'https://digest.example/' || name AS loc, NULL AS lastmod, freq AS changefreq, CAST(priority AS DOUBLE) AS priority
FROM (VALUES ('', 'daily', 1.0), ('jobs.html', 'weekly', 0.6), ('about.html', 'yearly', 0.3), ('intern.html', 'weekly', 0.6), ('heatmap.html',
  'daily', 0.8)) AS p(name, freq, priority)
UNION ALL SELECT 'https://digest.example/reports/weekly-' || date || '.html', NULL, 'monthly', 0.7 FROM w
UNION ALL SELECT 'https://digest.example/reports/' || CAST(date AS VARCHAR) || '.html', CAST(date AS VARCHAR), 'monthly', 0.8 FROM d
UNION ALL SELECT 'https://digest.example/reports/monthly-' || date || '.html', NULL, 'monthly', 0.7 FROM m"""),
    "u02_union_sections": (u02_sections, "SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 0 ELSE 1 END AS section_ord FROM events"),
    "u03_distinct_keys": (u03_distinct, "SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, user_id FROM events"),
    "q01_query_terms": (q01_terms, """SELECT item_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> ''),
  '|') AS terms FROM benchmark"""),
    "q02_search": (q02_search, """SELECT doc_id FROM documents WHERE strpos(lower(text || ' ' || source), 'idiot') > 0 OR strpos(lower(text || ' '
  || source), 'worthless') > 0"""),
    "q03_snippet": (q03_snippet, """WITH m AS (SELECT doc_id, text, strpos(lower(text), 'idiot') - 1 AS p FROM documents),
c AS (SELECT doc_id, text, p, greatest(p - 30, 0) AS lo, least(p + 5 + 40, length(text)) AS hi FROM m)
SELECT doc_id, CASE WHEN p >= 0 THEN CASE WHEN lo > 0 THEN '…' ELSE '' END || substr(text, lo + 1, hi - lo) || CASE WHEN hi < length(text) THEN '…'
  ELSE '' END END AS snippet FROM c"""),
    "q04_highlight": (q04_highlight, "SELECT doc_id, regexp_replace(text, '(the)', '[\\1]', 'gi') AS marked FROM documents"),
    "q05_search_hits": (q05_hits, """SELECT count(DISTINCT conv_id) AS hits FROM conversations WHERE strpos(lower(text), 'and') > 0 OR
  strpos(lower(text), 'der') > 0"""),
    "q06_search_batch": (q06_batch, _BATCH),
    "q06_search_index": (q06_index, _BATCH),
    "j03_cards_reports": (j03_cards, """WITH r AS (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS items FROM lineitem GROUP BY 1), c AS (SELECT
  o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT o_orderkey, 'reports/' || CAST(c.date AS VARCHAR) || '.html' AS href, CAST(c.date AS VARCHAR) AS date, items FROM c LEFT JOIN r USING (date)"""),
    "j04_unknown_titles": (j04_unknown, _INDEX + f" SELECT doc_id FROM docs WHERE {_CANDIDATE} NOT IN (SELECT t FROM idx)"),
    "j04_known_titles": (j04_known, _INDEX + f" SELECT doc_id FROM docs WHERE {_CANDIDATE} IN (SELECT t FROM idx)"),
    "j04_filtered_titles": (j04_filter, _INDEX + f" SELECT doc_id, {_CANDIDATE} IN (SELECT t FROM idx) AS known FROM docs"),
    "s03_search_index": (s03_search_index, _SEARCH),
    "s03_search_json": (s03_search_json, _SEARCH),
    "s05_title_index": (s05_title_index, _TITLED + """ SELECT CAST(date AS VARCHAR) AS date, 'item' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS item_id, title
FROM docs WHERE date IN (SELECT date FROM newest)"""),
    "a15_index_size": (a15_index_size, _TITLED + " SELECT count(DISTINCT date) AS reports, count(*) AS titles FROM docs WHERE date IN (SELECT date FROM newest)"),
    "s06_write_by_date": (s06_by_date, "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1"),
    "f02_links": (f02_links, """SELECT page_id, 'reports/' || CAST(DATE '2024-01-01' + CAST(page_id % 30 AS INTEGER) AS VARCHAR) || '.html#item' ||
  page_id AS link,
  url_encode('a b/' || url) AS encoded FROM pages"""),
}
