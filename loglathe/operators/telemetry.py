"""Counters of the write path, as aggregates, observed metrics and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import dictionary


def telemetry(batched: DataFrame, blocks: DataFrame | None = None, seconds: float | None = None) -> DataFrame:
    """One row of counters over events with ``batch_id``, ``resource`` and ``endpoint``.

    Dictionary hits are rows less distinct values of their batch.  ``blocks`` (raw_bytes, stored_bytes) adds the
    mean of the blocks' ratios, cut to four digits each, and the counts of what was compressed and written; with a
    column ``file`` also how often a file was closed for the next.  ``seconds`` adds the throughput in millions.  What
    Spark never does (refuse rows, lose batches, wait in a queue of its own) is 0.
    """
    per = dictionary.counts(batched)
    out = per.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("log_processed_total"),
        F.count("*").alias("batch_flushed_total"),
        F.coalesce(F.sum(F.col("rows") - F.col("resource_count")), F.lit(0)).alias("dictionary_hits_resource"),
        F.coalesce(F.sum(F.col("rows") - F.col("endpoint_count")), F.lit(0)).alias("dictionary_hits_endpoint"),
        F.coalesce(F.max("resource_count"), F.lit(0)).alias("resource_count_max"),
        F.coalesce(F.max("endpoint_count"), F.lit(0)).alias("endpoint_count_max"),
    )
    share = lambda c: F.round(F.when(F.col("log_processed_total") > 0, 100 * F.col(c) / F.col("log_processed_total")).otherwise(0.0), 4)
    out = out.withColumns({
        "hit_pct_resource": share("dictionary_hits_resource"), "hit_pct_endpoint": share("dictionary_hits_endpoint"),
        **{c: F.lit(0).cast("bigint") for c in ("lost_logs_total", "log_refused_total")},
    })
    if blocks is not None:
        counted = [
            F.count("*").alias("batch_written_total"), F.count_if(F.col("stored_bytes") < F.col("raw_bytes")).alias("batch_compressed_total"),
            compression_ratio().alias("compression_lz4_ratio_avg"),
        ]
        if "file" in blocks.columns:
            counted.append(F.greatest(F.count_distinct("file") - 1, F.lit(0)).alias("log_rotation"))
        out = out.crossJoin(F.broadcast(blocks.agg(*counted)))  # one row each
        out = out.withColumns({c: F.lit(0).cast("bigint") for c in ("compression_failure_total", "backpressure_count", "writer_waitfile_max", "rotation_resync_total")})
    if seconds is not None:
        out = out.withColumn("throughput_sec", F.col("log_processed_total") / F.lit(seconds) / 1e6)
    return out


def compression_ratio(raw: str = "raw_bytes", stored: str = "stored_bytes"):
    """The unweighted mean over blocks of stored / raw, each cut to four digits."""
    return F.avg(F.floor(F.col(stored) * 10000 / F.col(raw))) / 10000


def as_json(row: DataFrame) -> DataFrame:
    return row.select(F.to_json(F.struct(*row.columns)).alias("telemetry"))


def observed(df: DataFrame, name: str = "loglathe") -> tuple[DataFrame, Observation]:
    """Counts while the data is written, at no extra pass: rows, largest and least timestamp, stored bytes of text."""
    seen = Observation(name)
    return df.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.max("timestamp_us").alias("timestamp_max"), F.min("timestamp_us").alias("timestamp_min"),
        F.sum(F.octet_length("resource") + F.octet_length("endpoint")).alias("text_bytes"),
    ), seen
