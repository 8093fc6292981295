"""The write path's projection: raw events to stored events, one stage of expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.endpoint import anon_ip
from ..functions.text import narrow_u16, normalize_resource
from ..schema import Config


def normalize(raw: DataFrame, config: Config | None = None) -> DataFrame:
    """Normalised resource, masked endpoint, narrowed code; works on batch and streaming DataFrames alike.

    A ``sequence`` column is passed through where there is one; it is 0 where the configuration has no sequence.
    """
    c = config or Config()
    return raw.select(
        *([(F.col("sequence") if c.sequence else F.lit(0)).cast("bigint").alias("sequence")] if "sequence" in raw.columns or not c.sequence else []),
        F.col("timestamp_us").cast("bigint").alias("timestamp_us"),
        normalize_resource(F.col("resource"), c.strip_params).alias("resource"),
        anon_ip(F.col("endpoint"), c.level, c.strict_cidr, c.collapse_mask).alias("endpoint"),
        narrow_u16(F.col("status_code")).alias("http_code"),
        F.col("duration_ms").cast("int").alias("duration_ms"),
        F.col("data_size_bucket").cast("int").alias("response_size"),
        F.col("operation_id").cast("smallint").alias("http_verb"),
        F.col("flags").cast("smallint").alias("flags"),
    )
