"""Per-batch string dictionaries: build, count, encode, decode."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("resource", "endpoint")
NOT_FOUND = "NOT_FOUND"


def build(df: DataFrame, batch: str = "batch_id", order: str = "sequence") -> DataFrame:
    """(batch_id, kind, id, value): the distinct values of each kind in a batch, numbered by first appearance.

    Values are pre-aggregated in each task; a window spans the distinct values of one batch, of which there
    are at most as many as rows in a batch.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in KINDS]))
    first = (
        df.select(F.col(batch).alias("batch_id"), F.col(order).alias("o"), pairs.alias("p"))
        .groupBy("batch_id", "p.kind", "p.value").agg(F.min("o").alias("first"))
    )
    by = Window.partitionBy("batch_id", "kind").orderBy("first", "value")
    return first.select("batch_id", "kind", (F.row_number().over(by) - 1).cast("bigint").alias("id"), "value")


def counts(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Rows and distinct values of each kind in every batch."""
    return df.groupBy(F.col(batch).alias("batch_id")).agg(
        F.count("*").alias("rows"), *[F.count_distinct(k).alias(f"{k}_count") for k in KINDS]
    )


def encode(df: DataFrame, dictionary: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Replaces both strings by their ids (url_idx, ip_idx)."""
    out = df
    for kind, idx in zip(KINDS, ("url_idx", "ip_idx"), strict=True):
        own = dictionary.where(F.col("kind") == kind).select(F.col("batch_id").alias(batch), F.col("id").alias(idx), F.col("value").alias(kind))
        out = out.join(own, [batch, kind], "left").drop(kind)
    return out


def decode(records: DataFrame, dictionary: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The strings of both ids; ``NOT_FOUND`` where a dictionary lacks the id.  Of repeated ids one value counts."""
    unique = dictionary.groupBy("batch_id", "kind", "id").agg(F.min("value").alias("value"))
    out = records
    for kind, idx in zip(KINDS, ("url_idx", "ip_idx"), strict=True):
        own = unique.where(F.col("kind") == kind).select(F.col("batch_id").alias(batch), F.col("id").alias(idx), F.col("value").alias(kind))
        out = out.join(own, [batch, idx], "left").withColumn(kind, F.coalesce(F.col(kind), F.lit(NOT_FOUND))).drop(idx)
    return out
