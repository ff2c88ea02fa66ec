"""A scan that reads only the files that changed since the last one and rewrites only the dates they touch.

What was read last is kept as a manifest, a row per file and date with the file's size and modification time. Files are
compared with it by a join, without being opened. The manifest is written last: a run that broke off is done again by the
next one, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.sources.documents import read_documents, write_by_date
from broadsheet.sources.shared import written

_MANIFEST = "file string, path string, size long, modified timestamp, date date"


def list_files(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(file, path, size, modified) of the files under ``path``; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("_metadata.file_path").alias("file"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def last_manifest(spark: SparkSession, target: str) -> tuple[int, DataFrame]:
    """The number of the last run (0: none) and its manifest."""
    folder, store = _folder(spark, f"{target}/manifest")
    runs = [int(s.getPath().getName()[4:]) for s in store.listStatus(folder) if s.getPath().getName().startswith("run=")] if store.exists(folder) else []
    done = [n for n in runs if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/manifest/run={n}/_SUCCESS"))]
    last = max(done, default=0)
    return last, spark.read.schema(_MANIFEST).parquet(f"{target}/manifest/run={last}") if last else spark.createDataFrame([], _MANIFEST)


def refresh_by_date(spark: SparkSession, source: str, target: str, rows_of: Callable[[DataFrame], DataFrame], pattern: str = "*.md", bundled: bool = False) -> dict[str, int]:
    """Brings ``target``/data, a folder per date, up to date with the files under ``source``.

    ``rows_of`` makes rows with ``file`` and ``date`` of documents (doc_id, file, text), each row of one document; rows
    without a date are not written. ``bundled`` files hold many documents, of any dates. Read are the new and changed files, and the unchanged ones that have rows of a date
    that those, or removed files, touch. Returns the numbers of files read, of dates replaced and of dates emptied. Only
    file names, which the scan itself lists on the driver, and dates are collected.
    """
    run, before = last_manifest(spark, target)
    now = written(list_files(spark, source, pattern), "files")
    kept = before.select("file", F.col("size").alias("_size"), F.col("modified").alias("_modified")).distinct()
    compared = written(now.join(kept, "file", "full_outer"), "compared")
    changed = compared.filter("size IS NOT NULL AND (_size IS NULL OR _size <> size OR _modified <> modified)")
    stale = compared.filter("_size IS NOT NULL AND (size IS NULL OR _size <> size OR _modified <> modified)").select("file")

    def rows_in(paths: list[str]) -> DataFrame | None:
        docs = read_documents(spark, paths, pattern, bundled).withColumnRenamed("path", "file") if paths else None
        return None if docs is None else rows_of(docs)

    to_read = [r["path"] for r in changed.select("path").collect()]
    fresh = rows_in(to_read)
    fresh = None if fresh is None else written(fresh, "fresh")
    dates = before.join(stale, "file", "left_semi").select("date")
    dates = (dates if fresh is None else dates.union(fresh.select("date"))).filter("date IS NOT NULL").distinct()
    touched = [r["date"] for r in dates.collect()]
    unchanged = before.join(stale, "file", "left_anti")
    beside = [r["path"] for r in unchanged.filter(F.col("date").isin(touched)).select("path").distinct().collect()] if touched else []
    others = rows_in(beside)
    parts = [p.filter("date IS NOT NULL") for p in (fresh, None if others is None else others.filter(F.col("date").isin(touched))) if p is not None]
    emptied = set(touched)
    if parts:
        rows = written(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "rows")
        write_by_date(rows, f"{target}/data")
        emptied -= {r["date"] for r in rows.select("date").distinct().collect()}
    for date in emptied:
        folder, store = _folder(spark, f"{target}/data/date={date}")
        store.delete(folder, True)
    if to_read or not stale.isEmpty() or not run:
        read = changed.select("file", "path", "size", "modified")
        found = read.withColumn("date", F.lit(None).cast("date")) if fresh is None else read.join(fresh.select("file", "date").distinct(), "file", "left")
        unchanged.select("file", "path", "size", "modified", "date").unionByName(found).write.mode("overwrite").parquet(f"{target}/manifest/run={run + 1}")
    return {"read": len(to_read) + len(beside), "replaced": len(touched) - len(emptied), "emptied": len(emptied)}
