"""What the registered queries share: tables, rendering of report texts, the sample dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.sources.shared import shared_path  # noqa: F401  (the plans take it from here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_block(*lines) -> Column:
    """Lines (columns or strings) joined by newlines; null lines are left out."""
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def ordered_join(order, text: Column, by: str = "\n") -> Column:
    """Aggregate: ``text`` of all rows in ``order``, joined."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), by)


def flat(array) -> Column:
    """An array as one string, so that engines hash it alike."""
    return F.array_join(array, "|")


#: A dictionary of words of the sample texts (keyword, place, layer), in order.
DICTIONARY = [
    ("North", "North", "place"), ("der", "East", "place"), ("les", "South", "place"), ("West", "West", "place"),
    ("heit", "East", "city"), ("ment", "South", "city"), ("osa", "West", "city"), ("tion", "North", "city"),
    ("Thble", "North", "site"), ("auch", "East", "site"), ("queê", "South", "site"), ("Las", "West", "site"), ("ent", "Centre", "site"),
]
RULES = {
    "outreach_tag": ["src3", "src7"], "outreach_title": ["thatsh", "nicht"],
    "strong_policy": ["anti", "zu "], "weak_national": ["src1", "src2", "eine", "and "],
}
THEMES = [("size", "SMALL"), ("size", "LARGE"), ("plan", "ECON"), ("plan", "STANDARD"), ("look", "PROMO"), ("look", "PLATED"), ("size", "MEDIUM")]


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def documents_as_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title (first line), tags (source), body (other lines), date (30 days by doc_id)."""
    docs = table(spark, sf_dir, "documents")
    first = F.element_at(F.split("text", "\n", -1), 1)
    return docs.select(
        "doc_id", first.alias("title"), F.array("source").alias("tags"), F.substring(F.col("text"), F.length(first) + 2, F.length("text")).alias("body"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(30)).cast("int")).alias("date"),
    )


#: The same in SQL.
ITEMS_SQL = """
docs AS (
  SELECT doc_id, split_part(text, chr(10), 1) AS title, source AS tag,
         substr(text, length(split_part(text, chr(10), 1)) + 2) AS body,
         DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS date
  FROM documents
)"""


#: The sample dictionary as a CTE ``dictionary`` (kw, place, layer, ord).
DICTIONARY_SQL = "dictionary(kw, place, layer, ord) AS (VALUES " + ", ".join(
    f"({sql_text(k)}, {sql_text(p)}, {sql_text(la)}, {i})" for i, (k, p, la) in enumerate(DICTIONARY)) + ")"


def scan_sql(name: str, text: str, layers: tuple[str, ...] = ("place", "city", "site")) -> str:
    """CTEs ``name`` (doc_id, n, places joined by |, places cut to two) of the scan of ``text`` over docs by ``dictionary``."""
    return f"""
{name}_first AS (
  SELECT doc_id, place, arg_min(strpos({text}, kw), (layer <> 'place', ord, strpos({text}, kw))) AS pos
  FROM docs JOIN dictionary ON strpos({text}, kw) > 0 WHERE layer IN ({", ".join(map(sql_text, layers))}) GROUP BY doc_id, place
), {name}_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, place) AS k FROM {name}_first
), {name} AS (
  SELECT doc_id, count(*) AS n, string_agg(place, '|' ORDER BY k) AS places,
         string_agg(place, '|' ORDER BY k) FILTER (WHERE k <= 2) AS two, least(count(*), 2) AS n_two
  FROM {name}_ranked GROUP BY doc_id
)"""


def attributed_sql(dictionary: str = DICTIONARY_SQL) -> str:
    """CTEs up to ``attributed`` (doc_id, title, date, tier, places, n)."""
    def any_of(words, text):
        return "(" + " OR ".join(f"strpos({text}, {sql_text(w)}) > 0" for w in words) + ")"

    def in_tags(words):
        return "tag IN (" + ", ".join(map(sql_text, words)) + ")"

    out = f"({in_tags(RULES['outreach_tag'])} OR {any_of(RULES['outreach_title'], 'title')})"
    strong = f"({in_tags(RULES['strong_policy'])} OR {any_of(RULES['strong_policy'], 'title')})"
    weak = f"({in_tags(RULES['weak_national'])} OR {any_of(RULES['weak_national'], 'title')})"
    return f"""WITH {dictionary}, {ITEMS_SQL}, {scan_sql('t', 'title')}, {scan_sql('g', 'tag')}, {scan_sql('s', 'body', ('place', 'site'))}, {scan_sql('b', 'body')},
tiered AS (
  SELECT docs.doc_id, title, date,
    CASE WHEN t.n > 0 THEN 'title' WHEN g.n > 0 THEN 'tags' WHEN {out} THEN 'outreach' WHEN {strong} THEN 'national'
         WHEN s.n > 0 THEN 'site' WHEN {weak} THEN 'national' WHEN b.n > 0 THEN 'body' ELSE 'unassigned' END AS tier,
    t.places AS tp, t.n AS tn, g.places AS gp, g.n AS gn, s.two AS sp, s.n_two AS sn, b.two AS bp, b.n_two AS bn
  FROM docs LEFT JOIN t USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN b USING (doc_id)
), attributed AS (
  SELECT doc_id, title, date, tier,
    coalesce(CASE tier WHEN 'title' THEN tp WHEN 'tags' THEN gp WHEN 'site' THEN sp WHEN 'body' THEN bp END, '') AS places,
    coalesce(CASE tier WHEN 'title' THEN tn WHEN 'tags' THEN gn WHEN 'site' THEN sn WHEN 'body' THEN bn END, 0) AS n
  FROM tiered
)"""
