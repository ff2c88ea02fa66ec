import json

from pyspark.sql import functions as F

from broadsheet.operators import dedup, segment
from broadsheet.sources import documents


def test_files_become_documents_with_kind_and_skip_reason(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "2026-07-11.md").write_bytes("# 🏛️ 资讯 | 2026年7月11日（周六）\r\n## x".encode())
    (tmp_path / "in" / "weekly.md").write_text("# 📰 周报 | 2026年7月6日 — 7月12日", encoding="utf-8")
    (tmp_path / "in" / "bad.md").write_text("no date", encoding="utf-8")
    (tmp_path / "in" / "other.txt").write_text("ignored")
    docs = documents.read_documents(spark, str(tmp_path / "in"))
    dated = segment.parse_header(docs, "daily").select("doc_id", "date")
    found = {r.doc_id: r for r in documents.route_documents(docs, dated).collect()}
    assert set(found) == {"2026-07-11", "weekly", "bad"} and found["2026-07-11"].text.endswith("\n## x")
    assert (found["weekly"].kind, found["bad"].kind) == ("weekly", "daily")
    assert found["2026-07-11"].skip_reason is None and found["bad"].skip_reason


def test_a_rerun_replaces_only_its_dates(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2026-01-01"), (2, "2026-01-02")], "id int, date string")
    path = str(tmp_path / "out")
    documents.write_by_date(rows, path)
    documents.write_by_date(rows.filter("id = 2").withColumn("id", F.lit(9)), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 9]


def test_nested_indexes_are_written_as_json(spark, tmp_path):
    items = spark.createDataFrame([("2026-01-01", 2, "b", "x" * 300), ("2026-01-01", 1, "a", "y")], "date string, no int, title string, body string")
    path = str(tmp_path / "index")
    documents.write_json(documents.build_search_index(items, "date", order="no", fields=("title",)), path)
    (row,) = [json.loads(line) for f in (tmp_path / "index").glob("part-*") for line in f.read_text().splitlines()]
    assert [(i["no"], len(i["body"])) for i in row["items"]] == [(1, 1), (2, 200)]


def test_known_titles(spark):
    reports = spark.createDataFrame([(f"2026-01-0{d}",) for d in range(1, 6)], "date string")
    items = spark.createDataFrame([(f"2026-01-0{d}", f"i{d}", f" Title {d} ") for d in range(1, 6)], "date string, item_id string, title string")
    index = dedup.title_index(reports, items, n=2)
    candidates = spark.createDataFrame([("title 5",), ("TITLE 1",), (None,)], "title string")
    assert [r.title for r in dedup.semi_join_known(candidates, index).collect()] == ["title 5"]
    assert {r.title for r in dedup.anti_join_known(candidates, index).collect()} == {"TITLE 1", None}


def test_many_documents_share_a_file_and_none_is_changed(spark, tmp_path):
    texts = ["", "a\n", "\n\nb", "\x1e", "x\x10y\x1e\x100\x101\x10", "日\x1f\n# c"] * 40 + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(2)
    path = f"file://{tmp_path}/bundles"
    documents.write_bundles(docs, path, most=50)
    assert len(list((tmp_path / "bundles").glob("part-*.txt"))) <= 6  # not a file for each
    found = {int(r.doc_id): r.text for r in documents.read_documents(spark, path, "*.txt", bundled=True).collect()}
    assert found == {n: t or "" for n, t in enumerate(texts)}
