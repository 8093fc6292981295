"""Decoded events as text lines, JSON lines, and filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_line, format_ts, verb_name


def filtered(events: DataFrame, condition: Column | str) -> DataFrame:
    """Filtered decode: a plain filter, which Spark pushes to what can evaluate it."""
    return events.where(condition)


def lines(events: DataFrame, epoch: str = "1601") -> DataFrame:
    """``line`` of each decoded event, other columns kept."""
    return events.withColumn(
        "line",
        format_line(
            F.col("sequence"), format_ts(F.col("timestamp_us"), epoch), F.col("resource"), F.col("endpoint"), F.col("http_code"),
            verb_name(F.col("http_verb")), F.col("duration_ms"), F.col("response_size"), F.col("flags"),
        ),
    )


def text_export(decoded: DataFrame, headers: bool = True) -> DataFrame:
    """Lines (value) in the order of file, block and place; good blocks begin with a header, bad ones are a marker.

    ``decoded`` is what the block source yields: a corrupt block is one row with a ``corrupt_reason``.  Headers and
    markers begin with a line feed, so an empty line stands before them.
    """
    bad = F.col("corrupt_reason").isNotNull()
    block = F.concat(F.lit("\n=== BLOCK "), F.col("block").cast("string"))
    body = lines(decoded).select("file", "block", "pos", F.when(bad, F.concat(block, F.lit(" FAILED ==="))).otherwise(F.col("line")).alias("value"))
    if not headers:
        return body.orderBy("file", "block", "pos").select("value")
    sizes = decoded.where(~bad).groupBy("file", "block").agg(F.count("*").alias("n"))
    heads = sizes.select("file", "block", F.lit(-1).cast("bigint").alias("pos"), F.concat(block, F.lit(" === ("), F.col("n").cast("string"), F.lit(" entries)")).alias("value"))
    return body.unionByName(heads).orderBy("file", "block", "pos").select("value")


def corrupt_blocks(decoded: DataFrame) -> DataFrame:
    return decoded.where("corrupt_reason is not null").select("file", "block", F.col("corrupt_reason").alias("reason"))


def json_lines(events: DataFrame) -> DataFrame:
    return events.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns])).alias("value"))


def absolute_order(events: DataFrame) -> DataFrame:
    """Events of all shards in the order of their global sequence."""
    return events.orderBy("sequence")
