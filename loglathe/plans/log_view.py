"""Raw events out of the driver's tables, and the flagship report on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.endpoint import anon_ip
from ..functions.text import normalize_resource
from ..schema import EPOCH_1601_US


def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with a page's url as resource and an endpoint made from the ids; one shuffle-free or equi-join."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url").alias("resource"))
    n = max(1, pages.count())
    user, event = F.col("user_id"), F.col("event_id")
    mod = lambda c, k: F.pmod(c, F.lit(k)).cast("string")
    kind = F.pmod(user, F.lit(5))
    endpoint = (
        F.when(kind == 0, F.concat(F.lit("2001:db8::"), mod(user, 100)))
        .when(kind == 1, F.concat(F.lit("10."), mod(user, 256), F.lit(".7."), mod(event, 250), F.lit(":8080")))
        .when(kind == 2, F.concat(F.lit("host"), user.cast("string"), F.lit(".example.net")))
        .otherwise(F.concat(F.lit("192.168."), mod(user, 256), F.lit("."), mod(event, 256)))
    )
    # a wall-clock difference, which no session time zone changes
    unix = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    kinds = F.col("event_type")
    return events.join(pages, F.pmod(event, F.lit(n)) == F.col("page_id"), "left").select(
        (event + 1).alias("sequence"),
        (unix + EPOCH_1601_US).alias("timestamp_us"),
        "resource",
        endpoint.alias("endpoint"),
        F.when(kinds == "error", 500).when(kinds == "signup", 201).otherwise(200).cast("bigint").alias("status_code"),
        F.when(kinds.isin("view", "click"), 1).when(kinds == "purchase", 2).when(kinds == "signup", 3).otherwise(0).cast("smallint").alias("operation_id"),
        F.floor("value").cast("int").alias("duration_ms"),
        F.pmod(user, F.lit(64)).cast("int").alias("data_size_bucket"),
        F.pmod(event, F.lit(256)).cast("smallint").alias("flags"),
    )


def traffic_report(raw: DataFrame, level: int = 2) -> DataFrame:
    """Requests, errors and time by masked endpoint and normalised resource: one partial and one final aggregate."""
    return (
        raw.select(anon_ip(F.col("endpoint"), level).alias("endpoint"), normalize_resource(F.col("resource")).alias("resource"), "status_code", "duration_ms")
        .groupBy("endpoint", "resource")
        .agg(
            F.count("*").alias("requests"), F.sum((F.col("status_code") >= 400).cast("int")).alias("errors"),
            F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"),
        )
    )
