"""Text lists: one value a line, trimmed, unquoted, without a trailing comma."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_line(value: Column) -> Column:
    """Trims, strips one pair of quotes, then drops one trailing comma: ``"x",`` keeps its quotes, as the order says."""
    out = F.regexp_replace(value, r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", "")
    quoted = out.rlike(r'(?s)^".*"$') & (F.length(out) >= 2)
    out = F.when(quoted, F.substring(out, F.lit(2), F.length(out) - 2)).otherwise(out)
    return F.regexp_replace(out, r",\z", "")


def clean_lines(df: DataFrame, column: str = "value") -> DataFrame:
    return df.withColumn(column, clean_line(F.col(column))).where(F.col(column) != "")


def load_lines(spark: SparkSession, path: str) -> DataFrame:
    return clean_lines(spark.read.text(path))
