"""Shared-folder tables and distributed row order used by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _test_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="broadsheet-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, the folder that driver and executors share.

    Where that setting is absent a temporary folder is used, but only if driver and executors are one process.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _test_folder()
    path = f"{root.rstrip('/')}/broadsheet-{uuid.uuid4().hex}/{name}"
    for paths in _SCOPES:
        paths.append(path)
    return path


#: The paths given out within each open :func:`scratch_scope`.
_SCOPES: list[list[str]] = []


@contextlib.contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """Collects the scratch paths given out inside, so that they can be deleted once nothing reads them."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        _SCOPES.pop()


def delete_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables by path."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage at files that survive the loss of any executor, and fixes the values of
    columns that depend on how rows were dealt to partitions.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1_000, mb: int = 4) -> None:
    """Lets Python workers take at most ``rows`` rows or ``mb`` MB at once, so that long texts cost them little memory."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")


def unused(taken: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores behind as keep it apart from the columns ``taken`` and the others."""
    known, found = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        found.append(name)
    return found


def quoted(name: str) -> str:
    """``name`` as Spark's parsers take it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def all_columns(df: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in df.columns]


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that no later plan reads."""
    jvm = df.sparkSession._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


#: monotonically_increasing_id() keeps the partition above this bit and the row within it below.
_ROW_BITS = 33


def in_order(df: DataFrame, *keys, name: str = "ordered") -> DataFrame:
    """``df`` range-sorted by ``keys`` and materialized, with ``_part`` and ``_row`` (its place).

    (_part, _row) ascend with the keys. No task holds more than one range partition.
    """
    placed = df.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id())
    kept = materialize(placed, name)
    row_mask = F.lit((1 << _ROW_BITS) - 1)
    return kept.select(
        *[c for c in kept.columns if c != "_at"],
        F.shiftright("_at", _ROW_BITS).alias("_part"),
        F.col("_at").bitwiseAND(row_mask).alias("_row"),
    )


def part_table(ordered: DataFrame, *aggregates) -> DataFrame:
    """One row per range partition with ``_before``, the rows that precede it.

    Its size is the number of partitions of one sort, whatever the data hold, so a window over all
    of it and a broadcast of it are bounded.
    """
    parts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *aggregates)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def with_rank(ordered: DataFrame, rank: str) -> DataFrame:
    """Adds the gapless rank from 0 in the order made by :func:`in_order`."""
    parts = part_table(ordered).select("_part", "_before")
    return (
        ordered.join(F.broadcast(parts), "_part")
        .withColumn(rank, F.col("_before") + F.col("_row"))
        .drop("_part", "_row", "_before")
    )


def same(left, right):
    """Equality that also joins null to null."""
    return left.eqNullSafe(right)


def unit_draw(*columns):
    """A uniform draw in (0, 1) that the given columns decide."""
    bits = F.shiftrightunsigned(F.xxhash64(*columns), 11)
    return (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
