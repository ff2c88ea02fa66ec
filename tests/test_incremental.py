"""Refreshing a table by date from files: what is read, what is replaced, and equality with a full rebuild."""

import os

from pyspark.sql import functions as F

from broadsheet.operators import segment
from broadsheet.sources import incremental


def _report(day, *titles):
    items = "\n".join(f"### {n}. {t}" for n, t in enumerate(titles, 1))
    return f"# 🏛️ 资讯 | 2026年7月{day}日（周一）\n## 🇨🇳 国内要闻\n{items}\n"


def _rows(docs):
    dated = segment.parse_header(docs.withColumnRenamed("doc_id", "name"), "daily", key="file").select(F.col("doc_id").alias("file"), "date")
    items = segment.daily_items(docs, key="file").select(F.col("doc_id").alias("file"), "title")
    return dated.join(items, "file")


def _found(spark, target):
    return sorted((str(r.date), r.title) for r in spark.read.parquet(f"{target}/data").collect())


def test_only_changed_files_are_read_and_only_their_dates_replaced(spark, tmp_path):
    source, target = tmp_path / "in put", f"file://{tmp_path}/out"
    source.mkdir()
    write = lambda name, text: (source / name).write_text(text, encoding="utf-8")
    refresh = lambda to=target: incremental.refresh_by_date(spark, f"file://{source}", to, _rows)
    for day in (1, 2, 3):
        write(f"{day}.md", _report(day, f"a{day}", f"b{day}"))
    write("3b.md", _report(3, "more"))
    write("bad.md", "no date")
    assert refresh() == {"read": 5, "replaced": 3, "emptied": 0}
    assert refresh() == {"read": 0, "replaced": 0, "emptied": 0}

    kept = {day: sorted(os.listdir(tmp_path / f"out/data/date=2026-07-0{day}")) for day in (1, 2, 3)}
    write("2.md", _report(2, "changed", "and longer"))
    assert refresh() == {"read": 1, "replaced": 1, "emptied": 0}
    now = {day: sorted(os.listdir(tmp_path / f"out/data/date=2026-07-0{day}")) for day in (1, 2, 3)}
    assert now[1] == kept[1] and now[3] == kept[3] and now[2] != kept[2]

    write("3.md", _report(4, "moved to another day"))  # the other report of day 3 is read again
    (source / "1.md").unlink()
    assert refresh() == {"read": 2, "replaced": 2, "emptied": 1}
    assert _found(spark, target) == [("2026-07-02", "and longer"), ("2026-07-02", "changed"), ("2026-07-03", "more"), ("2026-07-04", "moved to another day")]
    refresh(f"file://{tmp_path}/rebuilt")
    assert _found(spark, f"file://{tmp_path}/rebuilt") == _found(spark, target)


def test_a_run_that_broke_off_is_done_again(spark, tmp_path):
    source, target = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    (source / "1.md").write_text(_report(1, "a"), encoding="utf-8")
    incremental.refresh_by_date(spark, f"file://{source}", target, _rows)
    (tmp_path / "out/manifest/run=1/_SUCCESS").unlink()
    assert incremental.refresh_by_date(spark, f"file://{source}", target, _rows)["read"] == 1
    assert _found(spark, target) == [("2026-07-01", "a")]
