"""Items of daily reports, cut as pieces of text, against a plain grouping of their typed lines."""

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import segment

LINES = [
    "## 🇨🇳 国内要闻", "## 🌍 国际要闻 x", "## 📊 今日趋势总结", "## 📑 目录", "## other", "# title", "#no header", "### 1. one {#a}", "### 22.two", "### 3.", "### x. no",
    " ### 4. indented", "### 5. ### 6. twice", "🏷️ a · b、c", "x 🏷️ no tags", "🏷️", "📎 [n](u) 📎 [m](v)", "y 📎 [n](w)", "📎 none", "![p](i)", "x ![p](j)", "> **点评：** note", "> later",
    ">no", "---", "--- x", "| a | b |", "*本日报由 x*", "　*本日报由 y", "body", " indented　", "", "　 ", "a b", " ",
]


def _plain(typed, fmt):
    found = {}
    for r in sorted(typed, key=lambda r: (r.doc_id, r.line_no)):
        if r.item_no:
            found.setdefault((r.doc_id, r.item_no), []).append(r)
    last = lambda rows, kind: next((r.line for r in reversed(rows) if r.line_type == kind), None)
    return {k: (rows[0].section, rows[0].line, *(last(rows, n) for n in ("tags", "links", "image", "note")), "\n".join(r.line for r in rows if r.line_type == "body")) for k, rows in found.items()}


@pytest.mark.parametrize("fmt", [segment.DailyFormat(), dataclasses.replace(segment.DailyFormat(), item=r"(?Ud)^#{3} (\d+)\.\s*(.+)", tags=r"(?Ud)^🏷️?\s*(.+)", link=r"(?Ud)📎\s*\[(.+?)\]\((.+?)\) ?")])
def test_pieces_give_what_typed_lines_give(spark, fmt):
    dice = random.Random(4)
    texts = [dice.choice(["\n", "\n", "\r\n", "\r"]).join(["# t", *(dice.choice(LINES) for _ in range(dice.randrange(40)))]) for _ in range(400)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (902, "## 🇨🇳 国内要闻\n### 1. under a title"), (903, "\n")], "doc_id int, text string")
    expected = _plain(segment.daily_lines(docs, fmt).collect(), fmt)
    rows = segment.daily_items(docs, fmt).collect()
    lines = spark.createDataFrame([(*k, *v) for k, v in expected.items()], "doc_id int, item_no int, section string, first string, tags string, links string, image string, note string, body string")
    asked = lines.select(
        "doc_id", "item_no", "section", F.concat(F.lit("item"), "item_no").alias("item_id"),
        segment.strip_anchor(segment.strip(F.regexp_extract("first", fmt.item, 2))).alias("title"), segment.extract_tags(F.col("tags"), fmt).alias("tags"),
        segment.extract_links(F.col("links"), fmt.link).alias("sources"), segment.extract_image(F.col("image"), fmt.image).alias("image"), "body",
        segment.extract_note(F.col("note"), fmt.note_label).alias("commentary"),
    )
    assert len(rows) > 100 and sorted(map(repr, rows)) == sorted(map(repr, asked.collect()))


def test_single_lines_are_not_made_before_items_part(spark):
    docs = spark.createDataFrame([(1, "# t\n## 🇨🇳 国内要闻\n### 1. a")], "doc_id int, text string")
    plan = segment.daily_items(docs).select("doc_id", "section")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.replace("rlike", "RLIKE").split("Generate")[0] and "is_item" in plan and "header" not in plan
