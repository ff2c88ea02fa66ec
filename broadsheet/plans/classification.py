"""Queries of the classification family (C1-C12, J1) and the attribution heat of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators import classify, heat
from broadsheet.plans.base import (
    DICTIONARY, DICTIONARY_SQL, ITEMS_SQL, RULES, THEMES, attributed_sql, documents_as_items, flat, scan_sql, sql_text, table,
)
from broadsheet.sources.shared import written


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.attribute_places(documents_as_items(spark, sf_dir), DICTIONARY, RULES)


def c01_scan_places(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", flat(classify.scan_places(F.col("text"), DICTIONARY)).alias("places"))


def c02_outreach(spark, sf_dir):
    rule = classify.matches_rules(F.col("title"), F.col("tags"), RULES["outreach_title"], RULES["outreach_tag"])
    return documents_as_items(spark, sf_dir).select("doc_id", rule.alias("outreach"))


def c03_weak_national(spark, sf_dir):
    rule = classify.matches_rules(F.col("title"), F.col("tags"), RULES["weak_national"], RULES["weak_national"])
    return documents_as_items(spark, sf_dir).select("doc_id", rule.alias("weak_national"))


def c04_strong_policy(spark, sf_dir):
    rule = classify.matches_rules(F.col("title"), F.col("tags"), RULES["strong_policy"], RULES["strong_policy"])
    return documents_as_items(spark, sf_dir).select("doc_id", rule.alias("strong_policy"))


def c05_attribute(spark, sf_dir):
    return attributed(spark, sf_dir).select("doc_id", "tier", flat("places").alias("places"))


def c06_themes(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    tags = F.array("p_type", F.upper(F.element_at(F.split("p_name", " "), 1)))
    return parts.select("p_partkey", flat(classify.themes_of(tags, THEMES)).alias("themes"))


def c07_emphasis(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", classify.emphasis_weight(F.col("text"), "the").cast("long").alias("weight"))


def c08_audit(spark, sf_dir):
    return classify.audit_rows(attributed(spark, sf_dir)).select("doc_id", "kind", "tier", "place_list")


def c09_review(spark, sf_dir):
    return classify.review_queue(classify.audit_rows(attributed(spark, sf_dir))).select("doc_id", "kind", "tier", "title")


def c10_section(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.col("event_type") == "click").select("event_id", "event_type", "value")


def c11_window(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("date"))
    return heat.with_as_of(events).filter(heat.in_window(F.col("date"), F.col("as_of"), 7)).select("event_id", F.col("date").cast("string").alias("date"))


def c12_theme_filter(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("themes", classify.themes_of(F.array("p_type"), THEMES))
    return heat.filter_theme(parts, "size").select("p_partkey", "p_type")


def j01_keyword_join(spark, sf_dir):
    words = spark.createDataFrame([(k, p) for k, p, _ in DICTIONARY], "kw string, place string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify.keyword_hits(docs, "text", words).select("doc_id", "kw", "place", F.col("pos").cast("long").alias("pos"))


def dictionary(spark, sf_dir):
    """A dictionary made from the documents: their distinct runs of 10 to 16 small letters, several thousand words."""
    words = F.explode(F.regexp_extract_all("text", F.lit("[a-zà-ÿ]{10,16}"), F.lit(0))).alias("kw")
    return written(table(spark, sf_dir, "documents").select(words).distinct(), "dictionary")  # made once, read several times


def j01_keyword_dictionary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify.keyword_hits_joined(docs, "text", dictionary(spark, sf_dir)).select("doc_id", "kw", F.col("pos").cast("long").alias("pos"))


def c05_attribute_dictionary(spark, sf_dir):
    """Tiers and places by a dictionary of several thousand words and a table of rules, joined, not written into the plan."""
    size = F.length("kw")
    layer = F.when(size % 3 == 0, "place").when(size % 3 == 1, "city").otherwise("site")
    places = dictionary(spark, sf_dir).select("kw", F.substring("kw", 1, 2).alias("place"), layer.alias("layer"), size.alias("ord"))
    rules = spark.createDataFrame([(name, word) for name, words in RULES.items() for word in words], "rule_set string, kw string")
    found = classify.attribute_places_joined(documents_as_items(spark, sf_dir), "doc_id", places, rules)
    return found.select("doc_id", "tier", flat("places").alias("places"))


def c06_themes_dictionary(spark, sf_dir):
    """Themes of parts by a table of words, joined: every word of a part's name stands for the theme of its first letter."""
    parts = table(spark, sf_dir, "part").withColumn("_tags", F.array("p_type", F.upper("p_name"), F.upper("p_brand")))
    words = parts.select(F.explode(F.split(F.upper("p_name"), " ")).alias("word")).distinct()
    themes = words.select(F.substring("word", 1, 1).alias("theme"), F.length("word").alias("theme_ord"), "word")
    return classify.themes_joined(parts, "p_partkey", "_tags", themes).select("p_partkey", flat("themes").alias("themes"))


def a10_audit_summary(spark, sf_dir):
    return classify.audit_summary(classify.audit_rows(attributed(spark, sf_dir)))


def attribution_entries(spark, sf_dir):
    """One row per (document, place) with its decayed even share."""
    items = heat.with_as_of(attributed(spark, sf_dir))
    weighted = items.withColumn("value", heat.decayed_weight(F.lit(1.0), F.col("date"), F.col("as_of")))
    return heat.fan_out_share(weighted)


def a03_fan_out(spark, sf_dir):
    return attribution_entries(spark, sf_dir).select("doc_id", "place", F.round("share", 6).alias("share"))


def flagship(spark, sf_dir):
    """Documents attributed to places, their time-decayed weight shared out: the ten hottest places."""
    return heat.top_places(heat.heat_by_place(attribution_entries(spark, sf_dir)), 10)


def _rule_sql(name: str, title: str, tag: str) -> str:
    tags = ", ".join(map(sql_text, RULES[tag]))
    words = " OR ".join(f"strpos(title, {sql_text(w)}) > 0" for w in RULES[title])
    return f"WITH {ITEMS_SQL} SELECT doc_id, (tag IN ({tags}) OR {words}) AS {name} FROM docs"


_DICT_VALUES = ", ".join(f"({sql_text(k)}, {sql_text(p)})" for k, p, _ in DICTIONARY)
_THEME_VALUES = ", ".join(f"({sql_text(t)}, {sql_text(w)}, {i})" for i, (t, w) in enumerate(THEMES))
_LARGE = "words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-zà-ÿ]{10,16}')) AS kw FROM documents)"
_SCAN_DOCS = "docs AS (SELECT doc_id, text FROM documents)"
_KIND = "CASE WHEN n > 1 THEN 'multi' WHEN n = 1 THEN 'prov' WHEN tier = 'unassigned' THEN 'unassigned' ELSE 'national' END AS kind"
_ENTRIES = (
    attributed_sql()
    + """, entries AS (
  SELECT doc_id, unnest(string_split(places, '|')) AS place, pow(0.93, date_diff('day', date, (SELECT max(date) FROM docs))) / n AS share
  FROM attributed WHERE n > 0)"""
)

QUERIES = {
    "c01_scan_places": (c01_scan_places, f"""WITH {DICTIONARY_SQL}, {_SCAN_DOCS}, {scan_sql('x', 'text')} SELECT doc_id, coalesce(places, '') AS
  places FROM docs LEFT JOIN x USING (doc_id)"""),
    "c02_outreach": (c02_outreach, _rule_sql("outreach", "outreach_title", "outreach_tag")),
    "c03_weak_national": (c03_weak_national, _rule_sql("weak_national", "weak_national", "weak_national")),
    "c04_strong_policy": (c04_strong_policy, _rule_sql("strong_policy", "strong_policy", "strong_policy")),
    "c05_attribute": (c05_attribute, attributed_sql() + " SELECT doc_id, tier, places FROM attributed"),
    "c06_themes": (c06_themes, f"""
WITH tags AS (
  SELECT p_partkey, 0 AS k, p_type AS tag FROM part UNION ALL SELECT p_partkey, 1, upper(split_part(p_name, ' ', 1)) FROM part
), hits AS (
  SELECT p_partkey, k, arg_min(theme, ord) AS theme FROM tags JOIN (VALUES {_THEME_VALUES}) AS d(theme, word, ord) ON strpos(tag, word) > 0 GROUP BY ALL
), firsts AS (SELECT p_partkey, theme, min(k) AS k FROM hits GROUP BY ALL)
SELECT p_partkey, coalesce(string_agg(theme, '|' ORDER BY k), '') AS themes FROM part LEFT JOIN firsts USING (p_partkey) GROUP BY p_partkey"""),
    "c07_emphasis": (c07_emphasis, "SELECT doc_id, 1 + (length(text) - length(replace(text, 'the', ''))) // 3 AS weight FROM documents"),
    "c08_audit": (c08_audit, attributed_sql() + f" SELECT doc_id, {_KIND}, tier, replace(places, '|', '/') AS place_list FROM attributed"),
    "c09_review": (c09_review, attributed_sql() + f""", audit AS (SELECT doc_id, {_KIND}, tier, title FROM attributed)
SELECT doc_id, kind, tier, substr(title, 1, 36) AS title FROM audit WHERE tier IN ('site', 'body', 'unassigned') OR kind = 'multi'"""),
    "c10_section": (c10_section, "SELECT event_id, event_type, value FROM events WHERE event_type = 'click'"),
    "c11_window": (c11_window, """WITH e AS (SELECT event_id, CAST(ts AS DATE) AS date FROM events)
SELECT event_id, CAST(date AS VARCHAR) AS date FROM e WHERE date_diff('day', date, (SELECT max(date) FROM e)) < 7"""),
    "c12_theme_filter": (c12_theme_filter, f"""
WITH hits AS (SELECT p_partkey, p_type, arg_min(theme, ord) AS theme FROM part JOIN (VALUES {_THEME_VALUES}) AS d(theme, word, ord) ON strpos(p_type,
  word) > 0 GROUP BY ALL)
SELECT p_partkey, p_type FROM hits WHERE theme = 'size'"""),
    "j01_keyword_join": (j01_keyword_join, f"""SELECT doc_id, kw, place, strpos(text, kw) AS pos FROM documents JOIN (VALUES {_DICT_VALUES}) AS d(kw,
  place) ON strpos(text, kw) > 0"""),
    "j01_keyword_dictionary": (j01_keyword_dictionary, f"""WITH {_LARGE} SELECT doc_id, kw, strpos(text, kw) AS pos FROM documents JOIN words ON
  strpos(text, kw) > 0"""),
    "c05_attribute_dictionary": (c05_attribute_dictionary, attributed_sql(_LARGE + """, dictionary AS (
  SELECT kw, substr(kw, 1, 2) AS place, length(kw) AS ord, CASE length(kw) % 3 WHEN 0 THEN 'place' WHEN 1 THEN 'city' ELSE 'site' END AS layer FROM words)""")
     + " SELECT doc_id, tier, places FROM attributed"),
    "c06_themes_dictionary": (c06_themes_dictionary, """
WITH words AS (SELECT DISTINCT unnest(string_split(upper(p_name), ' ')) AS word FROM part),
tags AS (
  SELECT p_partkey, 0 AS k, p_type AS tag FROM part UNION ALL SELECT p_partkey, 1, upper(p_name) FROM part UNION ALL SELECT p_partkey, 2,
    upper(p_brand) FROM part
), hits AS (
  SELECT p_partkey, k, arg_min(substr(word, 1, 1), (length(word), substr(word, 1, 1))) AS theme FROM tags JOIN words ON strpos(tag, word) > 0 GROUP BY ALL
), firsts AS (SELECT p_partkey, theme, min(k) AS k FROM hits GROUP BY ALL)
SELECT p_partkey, coalesce(string_agg(theme, '|' ORDER BY k), '') AS themes FROM part LEFT JOIN firsts USING (p_partkey) GROUP BY p_partkey"""),
    "a03_fan_out": (a03_fan_out, _ENTRIES + " SELECT doc_id, place, round(share, 6) AS share FROM entries"),
    "a10_audit_summary": (a10_audit_summary, attributed_sql() + f", audit AS (SELECT {_KIND} FROM attributed) SELECT kind, count(*) AS n FROM audit GROUP BY kind"),
    "flagship_attribution_heat": (flagship, _ENTRIES + """
SELECT place, round(sum(share), 4) AS heat, count(*) AS n FROM entries GROUP BY place ORDER BY heat DESC, place LIMIT 10"""),
}
