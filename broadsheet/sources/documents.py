"""Whole-document scans, routing by first line, and JSON and partitioned sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions.text import lines_of, normalize_newlines


#: Ends a document of a bundle, and what stands for it, and for itself, inside a text.
_END, _ESCAPE = "\x1e", "\x10"


def read_documents(spark: SparkSession, path: str | list[str], pattern: str = "*.md", bundled: bool = False) -> DataFrame:
    """(doc_id, path, text) of the files under ``path`` or of a list of files; doc_id is the file name without its ending.

    ``bundled`` files hold many documents each, as :func:`write_bundles` has written them, with a doc_id of their own.
    """
    reader = spark.read.option("pathGlobFilter", pattern)
    files = reader.option("lineSep", _END).text(path) if bundled else reader.text(path, wholetext=True)
    files = files.select("value", F.col("_metadata.file_path").alias("path"))
    if bundled:
        name, value = F.substring_index("value", "\n", 1), F.substring(F.col("value"), F.instr("value", "\n") + 1, F.length("value"))
        text = F.replace(F.replace(value, F.lit(f"{_ESCAPE}1"), F.lit(_END)), F.lit(f"{_ESCAPE}0"), F.lit(_ESCAPE))
    else:
        name, text = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1), F.col("value")
    return files.select(name.alias("doc_id"), "path", normalize_newlines(text).alias("text"))


def write_bundles(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", most: int = 10_000) -> None:
    """Adds ``docs`` to the folder ``path`` in .txt files of at most ``most`` documents, the id in the first line of each.

    A file of its own for every short document costs more than its text. Ids hold no newline; a null text is empty.
    """
    escaped = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(_ESCAPE), F.lit(f"{_ESCAPE}0")), F.lit(_END), F.lit(f"{_ESCAPE}1"))
    rows = docs.select(F.concat_ws("\n", F.col(key).cast("string"), escaped).alias("value"))
    rows.write.mode("append").option("lineSep", _END).option("maxRecordsPerFile", most).text(path)


def document_kind(text, rules: tuple[tuple[str, str], ...] = (("周报", "weekly"), ("月报", "monthly")), default: str = "daily") -> Column:
    """The kind of the first rule whose word stands in the first line."""
    first = F.element_at(lines_of(text), 1)
    kind = F.lit(default)
    for word, name in reversed(rules):
        kind = F.when(first.contains(word), F.lit(name)).otherwise(kind)
    return kind


def route_documents(docs: DataFrame, dated: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with kind and skip_reason: documents without a date in ``dated`` (doc_id, date) are to be skipped."""
    routed = docs.withColumn("kind", document_kind(F.col(text), **options)).join(dated, "doc_id", "left")
    return routed.withColumn("skip_reason", F.when(F.col("date").isNull(), "no date in the first line"))


def build_search_index(items: DataFrame, *report: str, order: str, body: str = "body", body_chars: int = 200, fields: tuple[str, ...] = ()) -> DataFrame:
    """One row per report with its items in order; bodies are cut to ``body_chars`` code points."""
    cut = F.substring(body, 1, body_chars).alias(body)
    rows = F.array_sort(F.collect_list(F.struct(order, *fields, cut)))
    return items.groupBy(*report).agg(rows.alias("items"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)


def write_by_date(df: DataFrame, path: str, date: str = "date") -> None:
    """One folder per date; a rerun replaces only the dates it holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)
