"""Synthetic events: uniform, independent picks by a hash of row number and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EPOCH_1601_US

#: The codes and operations picked from.
CODES = (200, 201, 204, 301, 302, 304, 400, 401, 403, 404, 409, 500, 502, 503)
OPERATIONS = (1, 2, 3, 4, 5, 6, 8)


def _pick(salt: str, n: Column, seed: int, size: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), F.lit(seed), n), F.lit(size))


def events(rows: DataFrame, seed: int = 1, resources: int = 1000, endpoints: int = 5000, start_us: int = EPOCH_1601_US + 1_700_000_000_000_000) -> DataFrame:
    """Raw events for rows with ``id``; equal seeds give equal events, however they are dealt to tasks."""
    n = F.col("id")
    r, e = _pick("resource", n, seed, resources), _pick("endpoint", n, seed, endpoints)
    return rows.select(
        F.element_at(F.array(*map(F.lit, OPERATIONS)), (_pick("op", n, seed, len(OPERATIONS)) + 1).cast("int")).cast("smallint").alias("operation_id"),
        F.concat(F.lit("/"), F.hex(F.xxhash64(r)).substr(1, 6), F.lit("/page-"), r.cast("string"), F.when(r % 20 == 0, F.lit("?q=1")).otherwise(F.lit(""))).alias("resource"),
        F.element_at(F.array(*map(F.lit, CODES)), (_pick("code", n, seed, len(CODES)) + 1).cast("int")).cast("bigint").alias("status_code"),
        F.concat_ws(".", F.lit("10"), *[F.pmod(F.shiftright(F.xxhash64(e), s), F.lit(256)).cast("string") for s in (0, 8, 16)]).alias("endpoint"),
        _pick("duration", n, seed, 65535).cast("int").alias("duration_ms"),
        _pick("size", n, seed, 65535).cast("int").alias("data_size_bucket"),
        _pick("flags", n, seed, 255).cast("smallint").alias("flags"),
        (F.lit(start_us) + n).alias("timestamp_us"),
    )


def generate(spark: SparkSession, rows: int, seed: int = 1, **sizes: int) -> DataFrame:
    return events(spark.range(rows), seed, **sizes)


def stream(spark: SparkSession, rows_per_second: int = 1000, seed: int = 1, **sizes: int) -> DataFrame:
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return events(rate.select(F.col("value").alias("id")), seed, **sizes)
