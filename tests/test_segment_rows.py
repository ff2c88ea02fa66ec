"""Digests and job lists cut within their row: no shuffle, white space of any script, icons."""

from broadsheet.operators import jobs, segment

WEEKLY = """# 📰 周报 |　2026年7月6日　—　7月12日
## 📊 概览
　first
second　
## 🔟 要闻
###　1. lost, as the marker has a plain blank
### 2.　Item two　{#b}
　body
> **本周新进展：**　more
📎　[a](u)
📎 [b](v) [c](w)
### 3. Item three
## 🌍　世界
rich line
| a | b |
## 📊七月趋势
*本周报由 x*
"""

JOBS = """# 招聘 | 2026年8月22日
> one
>> no summary
>　neither
> > two
### 9. lost — before any category　
- 🎓 **学历要求**：本科
##　🏛️　博物馆
- 📅 **截止日期**：2030-09-30
###　1.　某馆　—　讲解员
-　🎓 **学历要求**　：　硕士
- 🎓 **学历**：博士
- 🔗　[公告](http://a)
- 📧　投递：　x@y.z
### ２. ⏰　乙馆-研究员
- 📅 **截止日期**：2026-08-24（周一）
"""


def _docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")


def test_nothing_is_shuffled(spark):
    docs = _docs(spark, WEEKLY, JOBS, None, "")
    typed = segment.digest_lines(docs, "monthly")
    for found in (
        typed, segment.ranking_rows_to_items(typed), segment.digest_items(docs, "weekly"), segment.rich_sections(docs, "weekly"),
        segment.overview_and_footer(docs, "weekly"), segment.digest_counts(docs, "weekly"), jobs.parse_jobs(docs), jobs.job_summary_text(docs),
    ):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        found.collect()


def test_weekly_digest(spark):
    docs = _docs(spark, WEEKLY, None, "", "# only a title")
    items = segment.digest_items(docs, "weekly").collect()
    assert [(r.item_id, r.title, r.body, r.progress, [tuple(s) for s in r.sources or []]) for r in items] == [
        ("item2", "Item two", "body", "more", [("b", "v")]), ("item3", "Item three", "", None, []),
    ]
    rich = segment.rich_sections(docs, "weekly").collect()
    assert [(r.section_no, r.icon, r.heading, r.lines) for r in rich] == [(1, "🌍", "🌍　世界", ["rich line", "| a | b |"])]
    first, *rest = segment.overview_and_footer(docs, "weekly").orderBy("doc_id").collect()
    assert (first.overview, first.footer) == ("first second", "本周报由 x") and [(r.overview, r.footer) for r in rest] == [("", None)] * 3
    assert [tuple(r)[1:] for r in segment.digest_counts(docs, "weekly").orderBy("doc_id").collect()] == [(2, 1), (0, 0), (0, 0), (0, 0)]
    header = segment.parse_header(docs.limit(1), "weekly").first()
    assert str(header.start_date) == "2026-07-06" and str(header.ref_date) == "2026-07-12"


def test_monthly_trends_keep_their_icon(spark):
    rich = segment.rich_sections(_docs(spark, WEEKLY), "monthly").collect()
    assert [(r.icon, r.heading) for r in rich] == [("🌍", "🌍　世界"), ("📊", "📊七月趋势")]


def test_job_list(spark):
    found = {r.number: r for r in jobs.parse_jobs(_docs(spark, JOBS, None, "", "# x")).collect()}
    assert sorted(found) == [1, 2, 9]
    one, two, stray = found[1], found[2], found[9]
    assert (stray.category, stray.icon, stray.section_no, stray.education) == ("招聘", "💼", 0, "本科")
    assert (one.category, one.icon, one.section_no, one.institution, one.position) == ("博物馆", "🏛️", 1, "某馆", "讲解员")
    assert (one.education, one.link_url, one.link_text, one.deadline, one.marked) == ("博士", "mailto:x@y.z", "x@y.z", None, False)
    assert (two.marked, two.institution, two.position, two.days_left, two.urgent, two.link_text) == (True, "乙馆", "研究员", 2, True, "招聘公告")
    assert [r.line_no for r in sorted(found.values(), key=lambda r: r.line_no)] == [5, 9, 14]
    summaries = jobs.job_summary_text(_docs(spark, JOBS, None, "")).orderBy("doc_id").collect()
    assert [r.summary for r in summaries] == ["one > two", "", ""]


def test_repeated_documents_stay_apart(spark):
    docs = spark.createDataFrame([(1, JOBS), (1, JOBS)], "doc_id int, text string")
    assert jobs.parse_jobs(docs).count() == 6
    assert segment.digest_items(spark.createDataFrame([(1, WEEKLY)] * 2, "doc_id int, text string"), "weekly").count() == 4


def test_long_lists(spark):
    text = "# t | 2026年1月1日\n" + "\n".join(f"## 🏛️ c{i % 7}\n### {i}. a{i} — b\n- 🎓 **学历**：e{i}" for i in range(10_000))
    found = jobs.parse_jobs(_docs(spark, text))
    assert found.filter("education = concat('e', number) and institution = concat('a', number) and section_no = number + 1").count() == 10_000


def test_a_list_is_dated_before_its_listings_part(spark):
    plan = jobs.parse_jobs(_docs(spark, JOBS)).select("number", "days_left")._jdf.queryExecution().optimizedPlan().toString()
    behind = plan[: plan.index("Generate explode")]
    assert "update_date" in behind and "substring_index" not in behind and "split" not in behind  # lines above the explode run once a listing
    rows = jobs.parse_jobs(_docs(spark, JOBS, JOBS.replace("\n", "\r"), JOBS.replace("\n", "\r\n"))).collect()
    assert len(rows) == 9 and {str(r.update_date) for r in rows} == {"2026-08-22"}
