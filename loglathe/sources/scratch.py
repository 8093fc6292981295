"""Folders that all executors share, and tables written there: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_of: dict[str, list[str]] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder, removed when the driver ends: below spark.checkpoint.dir, or in /tmp where that is unset and the master is local."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir", None)
    if not top and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{(top or f'file:///tmp/checkpoints/{sc.applicationId}').rstrip('/')}/loglathe-{uuid.uuid4().hex[:12]}-{name}"
    if sc.applicationId not in _of:
        _of[sc.applicationId] = []
        atexit.register(_clean, spark, sc.applicationId)
    _of[sc.applicationId].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to a fresh folder and read from there."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clean(spark: SparkSession, app: str) -> None:
    for path in _of.pop(app, []):
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended before: nothing can be removed any more
            return
