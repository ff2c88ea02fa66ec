"""Hand-worked cases of the semantics that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from broadsheet.functions.text import cells_of, strip
from broadsheet.operators import classify, heat, jobs, listing, search, segment

PLACES = [(p, p, "place") for p in "北京 山东 河南 浙江 福建 四川 陕西 上海 海南 江苏 辽宁".split()] + [
    ("南京", "江苏", "city"), ("苏州", "江苏", "city"), ("滕州", "山东", "city"), ("杭州", "浙江", "city"), ("朝阳", "辽宁", "city"),
    ("海南", "海南", "city"), ("殷墟", "河南", "site"), ("福建博物院", "福建", "site"),
]
RULES = {"outreach_tag": ["文物出海"], "outreach_title": ["赴外"], "strong_policy": ["规划"], "weak_national": ["数字化", "数字"]}

CASES = [
    ("滕州考古特展", "考古", "", "山东", "title"),
    ("全国活动在河南举行", "", "", "河南", "title"),
    ("某展开幕", "浙江 展览", "", "浙江", "tags"),
    ("北京朝阳区展览", "", "", "北京 辽宁", "title"),
    ("上海南京路展览", "", "", "上海 海南 江苏", "title"),
    ("苏州 上海南京路", "", "", "上海 海南 江苏", "title"),
    ("某展赴外", "文物出海", "杭州", "", "outreach"),
    ("某规划印发", "", "殷墟", "", "national"),
    ("数字文物", "数字化", "福建博物院", "福建", "site"),
    ("数字文物", "", "在浙江举行", "浙江", "site"),
    ("数字文物", "", "在杭州举行", "", "national"),
    ("某展开幕", "", "在杭州举行", "浙江", "body"),
    ("某展开幕", "", "河南、四川、陕西", "河南 四川", "site"),
    ("某展开幕", "", "无地名", "", "unassigned"),
]


def test_tiers_of_attribution(spark):
    rows = [(i, t, g.split(), b) for i, (t, g, b, _, _) in enumerate(CASES)]
    items = spark.createDataFrame(rows, "id int, title string, tags array<string>, body string")
    found = classify.attribute_places(items, PLACES, RULES).orderBy("id").select("places", "tier").collect()
    assert [(" ".join(r.places), r.tier) for r in found] == [(p, t) for *_, p, t in CASES]


@pytest.mark.parametrize("most", [5_000, 3])
def test_the_join_form_attributes_alike(spark, monkeypatch, most):
    monkeypatch.setattr(classify, "MAX_TERMS", most)
    rows = [(i, t, g.split(), b) for i, (t, g, b, _, _) in enumerate(CASES)] + [(99, None, None, None), (100, "", ["苏州"], "殷墟 " * 3 + "上海")]
    items = spark.createDataFrame(rows, "id int, title string, tags array<string>, body string")
    places = spark.createDataFrame([(*row, at) for at, row in enumerate(PLACES)], "kw string, place string, layer string, ord int")
    plain = classify.attribute_places(items, PLACES, RULES).orderBy("id")
    joined = classify.attribute_places_joined(items, "id", places, RULES).orderBy("id")
    assert joined.columns == plain.columns and joined.collect() == plain.collect()
    assert classify.attribute_places_joined(items.limit(0), "id", places, RULES).count() == 0


def test_attribution_takes_nulls_and_empty_tables(spark):
    schema = "id int, title string, tags array<string>, body string"
    items = spark.createDataFrame([(1, None, None, None)], schema)
    row = classify.attribute_places(items, PLACES, RULES).first()
    assert (row.places, row.tier) == ([], "unassigned")
    assert classify.attribute_places(items.limit(0), PLACES, RULES).count() == 0


def test_themes_take_the_first_theme_with_a_word_inside_the_tag(spark):
    themes = [("展览", "展"), ("考古", "考古"), ("政策行业", "文物局"), ("国际交流", "国际")]
    themes = [("考古", "考古"), ("展览", "展览"), ("展览", "特展"), ("政策行业", "文物局"), ("国际交流", "国际")]
    rows = [(0, ["国际展览"]), (1, ["考古展"]), (2, ["国家文物局"]), (3, ["浙江"]), (4, ["展览", "考古", "特展"])]
    df = spark.createDataFrame(rows, "id int, tags array<string>").orderBy("id")
    assert [r[0] for r in df.select(classify.themes_of(F.col("tags"), themes)).collect()] == [["展览"], ["考古"], ["政策行业"], [], ["展览", "考古"]]


def test_emphasis_and_decay(spark):
    row = spark.range(1).select(
        classify.emphasis_weight(F.lit("🔥🔥x"), "🔥").alias("w"),
        heat.decayed_weight(F.lit(3), F.to_date(F.lit("2026-07-01")), F.to_date(F.lit("2026-07-06"))).alias("d"),
    ).first()
    assert row.w == 3 and row.d / 2 == pytest.approx(1.0435, abs=1e-4)


def test_window_keeps_the_last_days_only(spark):
    ages = spark.range(10).select("id", F.date_sub(F.lit("2026-07-30").cast("date"), F.col("id").cast("int")).alias("date"))
    kept = ages.filter(heat.in_window(F.col("date"), F.lit("2026-07-30").cast("date"), 7)).select("id").collect()
    assert [r.id for r in kept] == list(range(7))


DAILY = """# 🏛️ 资讯 | 2026年7月11日（周六）
## 🇨🇳 国内要闻
### 7. First {#x}
🏷️ a · b、 c
📎 [one](http://1)
📎 [two](http://2) | 📎 [three](http://3)
body
> **点评：** good
## unknown
leaks into the body
> later note
## 🌍 国际要闻
### 1. Second
| not | a table |
## 📊 今日趋势总结
| h1 | h2 |
|---|---|
| c1 | c2 |
| c3 | lost
*本日报由 x*
"""


@pytest.mark.parametrize("text", [DAILY, DAILY.replace("\n", "\r\n")])
def test_daily_report(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    typed = segment.daily_lines(docs)
    first, second = segment.daily_items(docs).orderBy("item_no").collect()
    assert (first.section, first.item_id, first.title, first.tags) == ("domestic", "item1", "First", ["a", "b", "c"])
    assert [(s["name"], s["url"]) for s in first.sources] == [("two", "http://2"), ("three", "http://3")]
    assert (first.body, first.commentary) == ("body\nleaks into the body", "later note")
    assert (second.section, second.item_id, second.title) == ("international", "item2", "Second")
    assert second.body == "| not | a table |"
    rows = [r.cells for r in segment.table_rows(typed, "trends").orderBy("row_no").collect()]
    assert rows == [["h1", "h2"], ["c1", "c2"], ["c3"]]
    header = segment.parse_header(docs, "daily").first()
    assert (str(header.date), header.weekday) == ("2026-07-11", "周六")
    assert typed.filter(typed.line_type.isNull()).count() == 0


def test_weekly_header_without_second_year(spark):
    docs = spark.createDataFrame([(1, "# x | 2025年12月29日 — 1月4日")], "doc_id int, text string")
    plain, carried = (segment.parse_header(docs, "weekly", carry_year=c).first() for c in (False, True))
    assert (str(plain.ref_date), str(carried.ref_date)) == ("2025-01-04", "2026-01-04")


DIGEST = """# 📚 月报 | 2026年7月
## 📊 本月概览
first
second
## 🔝 要闻
| rank | title | date | why |
|---|---|---|---|
| 1 | A | 7月 | big |
| x | B | 7月 | no |
## 📊 趋势
rich line
*本月报由 y*
### 要闻 ## again
### 3. Item
text
## 📑 目录
not text
"""


def test_monthly_digest(spark):
    docs = spark.createDataFrame([(1, DIGEST)], "doc_id int, text string")
    typed = segment.digest_lines(docs, "monthly")
    assert segment.overview_and_footer(docs, "monthly").first().overview == "first second"
    assert segment.overview_and_footer(docs, "monthly").first().footer is None  # the free section holds it
    assert [(r.item_id, r.body) for r in segment.ranking_rows_to_items(typed).collect()] == [("item1", "📅 7月 ｜ big")]
    assert segment.rich_sections(docs, "monthly").first().lines == ["rich line", "*本月报由 y*"]
    assert [(r.item_id, r.body) for r in segment.digest_items(docs, "monthly").collect()] == [("item3", "text")]
    assert segment.rich_sections(docs, "monthly", strict=True).first().lines[2:] == ["### 要闻 ## again", "### 3. Item", "text"]


JOBS = """# 招聘 | 2026-8-22
> hello
### 9. before - any category
## 🏛️ 博物馆
### 1. ⏰ A馆 — x-y
- 📅 **截止日期**：2026-08-20
### 2. B馆 - z
- 📅 **截止日期**：2026-08-25（note）
### 3. C馆 — z
- 📅 **截止日期**：2026-08-26
- 📧 投递：a@b.c
### 4. D馆 — z
- 📅 **截止日期**：长期招募
### 5. E馆 — z
- 📅 **截止日期**：2026-13-40
- 🔗 [go](http://e)
"""


def test_jobs(spark):
    docs = spark.createDataFrame([(1, JOBS)], "doc_id int, text string")
    found = {r.number: r for r in jobs.parse_jobs(docs, default_category="default").collect()}
    assert found[9].category == "default" and found[1].category == "博物馆"
    assert (found[1].institution, found[1].position) == ("A馆", "x-y")
    assert [(found[n].days_left, found[n].urgent) for n in (1, 2, 3, 4, 5)] == [(-2, True), (3, True), (4, False), (None, False), (None, False)]
    assert (found[3].link_url, found[5].link_url, found[5].link_text) == ("mailto:a@b.c", "http://e", "go")
    order = [r.number for r in jobs.sort_jobs(jobs.parse_jobs(docs).filter("section_no = 1"), "section_no").collect()]
    assert order == [1, 2, 3, 4, 5]


def test_blocks(spark):
    text = "### Head {#a}\n\npara one\n para two\n| a | b |\n|---|---|\n> quote\n> next\n- x\n- y\n1. z\n---\nend"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    found = segment.segment_blocks(docs).orderBy("block_no").collect()
    assert [(r.block_type, r["items"]) for r in found] == [
        ("heading", ["Head"]), ("paragraph", ["para one para two"]), ("table", ["| a | b |", "|---|---|"]), ("quote", ["quote"]), ("quote", ["next"]),
        ("bullets", ["x", "y"]), ("numbered", ["z"]), ("paragraph", ["end"]),
    ]


def test_snippet_in_code_points(spark):
    text = "é" * 40 + "AB" + "🔥" * 158
    row = spark.range(1).select(search.snippet(F.lit(text), F.lit("ab")).alias("s")).first()
    assert row.s == "…" + text[10:82] + "…"


def test_strip_and_cells(spark):
    row = spark.range(1).select(strip(F.lit("　 x　")).alias("s"), cells_of(F.lit("| a |b| c")).alias("c")).first()
    assert (row.s, row.c) == ("x", ["a", "b"])


def test_highlight_escapes_the_term(spark):
    row = spark.range(1).select(search.highlight(F.lit("a.b A.B axb $"), "a.b", "$", "$").alias("s")).first()
    assert row.s == "$a.b$ $A.B$ axb $"


def test_a_category_closes_the_open_listing(spark):
    text = "# 招聘 | 2026年8月22日\n### 1. A — b\n- 📅 **截止日期**：2026-08-25\n## 🏛️ next\n- 📅 **截止日期**：2026-09-30\n- 🔗 [x](http://x)\n### 2. C — d\n- 📧 投递：a@b.c"
    found = {r.number: r for r in jobs.parse_jobs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert str(found[1].deadline_date) == "2026-08-25" and found[1].link_url is None and found[1].link_text == "招聘公告"
    assert (found[1].category, found[1].icon) == ("招聘", "💼") and (found[2].category, found[2].icon) == ("next", "🏛️")
    assert found[2].deadline is None and (found[2].link_url, found[2].link_text) == ("mailto:a@b.c", "a@b.c")


def test_contents_headers_and_icons_of_free_sections(spark):
    text = "# 📰 周报 | x\n## 🧭 目录\n- a\n## 🌍 World\nb\n## 🏛️ Two\nc\n## None\nd"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = sorted((r.section_no, r.icon, r.heading, r.lines) for r in segment.rich_sections(docs, "weekly").collect())
    assert found == [(1, "🌍", "🌍 World", ["b"]), (2, "📄", "🏛️ Two", ["c"]), (3, "📄", "None", ["d"])]


def test_batch_search_finds_terms_inside_words(spark):
    rows = [(1, 3, "Nothing here"), (1, 1, "the HEATMAP of it"), (1, 2, "heat"), (2, 9, "reheated"), (2, 4, ""), (3, 5, None)]
    items = spark.createDataFrame(rows, "report int, item int, body string")
    queries = spark.createDataFrame([("q", ["heat", "of"]), ("r", ["eated"]), ("none", ["zzz"]), ("empty", [])], "query string, terms array<string>")
    found = sorted((r["query"], r.report, r.item, r.term) for r in search.search_batch(items, queries, "query", ["report"], "item", "body", "body").collect())
    assert found == [("q", 1, 1, "heat"), ("q", 2, 9, "heat"), ("r", 2, 9, "eated")]


def test_large_dictionaries_are_met_by_an_equality_join(spark, monkeypatch):
    rows = [(1, "the heat of the heath"), (2, ""), (3, None), (4, "eat")]
    items = spark.createDataFrame(rows, "id int, text string")
    words = spark.createDataFrame([("heat", "a"), ("eat", "b"), ("the heat", "c"), ("cold", "d")], "kw string, place string")
    small = sorted(map(tuple, classify.keyword_hits(items, "text", words).select("id", "kw", "pos").collect()))
    monkeypatch.setattr(classify, "MAX_TERMS", 2)
    large = classify.keyword_hits(items, "text", words)
    assert large.columns == ["id", "text", "kw", "place", "pos"]
    assert sorted(map(tuple, large.select("id", "kw", "pos").collect())) == small == [(1, "eat", 6), (1, "heat", 5), (1, "the heat", 1), (4, "eat", 1)]


def test_numbers_in_a_group_that_coarse_values_split(spark):
    rows = [("a", d, i) for d in range(3) for i in range(4)] + [("b", 7, 1)]
    found = listing.numbered(spark.createDataFrame(rows, "g string, d int, i int"), "g", "d", "i").collect()
    assert sorted((r.g, r.position, r.d, r.i) for r in found) == sorted([("a", 1 + 4 * (2 - d) + i, d, i) for d in range(3) for i in range(4)] + [("b", 1, 7, 1)])


def test_places_are_computed_once_for_the_fan_out(spark):
    items = spark.createDataFrame([("山东 and 河南", 2.0), ("nothing", 1.0)], "title string, value double")
    placed = items.withColumn("places", classify.scan_places(F.col("title"), PLACES))
    shared = heat.fan_out_share(placed)
    assert sorted((r.place, r.share) for r in shared.collect()) == [("山东", 1.0), ("河南", 1.0)]
    assert shared._jdf.queryExecution().optimizedPlan().toString().count("instr(") == 1


def test_daily_reports_and_blocks_are_segmented_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, DAILY), (1, DAILY), (2, None), (3, ""), (4, "### 1. x\n- a\n- b")], "doc_id int, text string")
    fmt = segment.DailyFormat()
    for found in (segment.daily_lines(docs), segment.daily_items(docs), segment.segment_blocks(docs), segment.assign_sections(docs, fmt.sections)):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.item_no) for r in segment.daily_items(docs).collect()) == [(1, 1), (1, 1), (1, 2), (1, 2)]
    assert sorted((r.block_no, r.block_type, r["items"]) for r in segment.segment_blocks(docs.filter("doc_id > 1")).collect()) == [(1, "heading", ["1. x"]), (2, "bullets", ["a", "b"])]
    lines = segment.daily_lines(docs.filter("doc_id = 1").limit(1)).orderBy("line_no").collect()
    assert [r.line for r in lines] == DAILY.split("\n")[1:] and [r.line_no for r in lines] == list(range(1, len(lines) + 1))


def test_segmentation_takes_texts_of_many_lines(spark):
    text = "# t\n" + "\n".join(f"## 🇨🇳 国内要闻\n### {i}. title {i}\nbody {i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert segment.daily_items(docs).filter("body = concat('body ', item_no - 1)").count() == 20_000
    assert segment.segment_blocks(docs).count() == 40_000
