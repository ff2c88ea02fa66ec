"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _test_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="broadsheet-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share; a temporary one only where they are one process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _test_folder()
    return f"{root.rstrip('/')}/broadsheet-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from the loss of an executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
