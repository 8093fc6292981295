"""Counters of a running stream: observed while rows pass, merged by a listener after every micro-batch, told as JSON.

What ``watched`` adds to a stream is computed in the pass that writes it.  A micro-batch is a batch; its counters are sums, the
least and greatest, and a sketch of each dictionary, so those of all micro-batches merge into what one aggregate over all
rows gives.  Counters live as long as the listener: a restarted driver begins at 0, as every process does.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.dictionary import KINDS
from ..operators.sketches import PRECISION

NAME = "loglathe-telemetry"
SUMS = ("log_processed_total", "errors_total", "text_bytes_total", "duration_ms_total")
#: Sketches held before they are merged to one.
SKETCHES = 64


def counters() -> list:
    """Aggregates over stored events."""
    return [
        F.count(F.lit(1)).alias("log_processed_total"), F.coalesce(F.sum((F.col("http_code") >= 400).cast("bigint")), F.lit(0)).alias("errors_total"),
        F.coalesce(F.sum((F.octet_length("resource") + F.octet_length("endpoint")).cast("bigint")), F.lit(0)).alias("text_bytes_total"),
        F.coalesce(F.sum(F.col("duration_ms").cast("bigint")), F.lit(0)).alias("duration_ms_total"),
        F.min("timestamp_us").alias("timestamp_min"), F.max("timestamp_us").alias("timestamp_max"),
        *[F.hex(F.hll_sketch_agg(k, PRECISION)).alias(f"{k}_sketch") for k in KINDS],
    ]


def watched(stored: DataFrame, name: str = NAME) -> DataFrame:
    return stored.observe(name, *counters())


class Telemetry(StreamingQueryListener):
    """Add it by ``spark.streams.addListener``; ``name`` as given to ``watched``."""

    def __init__(self, spark: SparkSession, name: str = NAME):
        self.spark, self.name = spark, name
        self.sums = dict.fromkeys(SUMS, 0)
        self.batches = self.failed = 0
        self.least = self.most = None
        self.rows_per_second_max = 0.0
        self.sketches: dict[str, list[str]] = {k: [] for k in KINDS}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        told = event.progress.observedMetrics.get(self.name)
        if told is None or not told["log_processed_total"]:
            return
        self.batches += 1
        for k in SUMS:
            self.sums[k] += told[k]
        self.least = min((x for x in (self.least, told["timestamp_min"]) if x is not None), default=None)
        self.most = max((x for x in (self.most, told["timestamp_max"]) if x is not None), default=None)
        self.rows_per_second_max = max(self.rows_per_second_max, event.progress.processedRowsPerSecond or 0.0)
        for k in KINDS:
            self.sketches[k].append(told[f"{k}_sketch"])

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.failed += event.exception is not None

    def _estimate(self, kind: str) -> int:
        held = self.sketches[kind]
        if not held:
            return 0
        rows = self.spark.createDataFrame([(s,) for s in held], "s string")  # few, and of one size
        one = F.hll_union_agg(F.unhex("s"))
        merged, estimate = rows.agg(F.hex(one), F.hll_sketch_estimate(one)).first()
        if len(held) > SKETCHES:
            self.sketches[kind] = [merged, *self.sketches[kind][len(held) :]]
        return estimate

    def counts(self) -> dict[str, int | None]:
        """All counters but the rate, which hangs on the machine."""
        return {
            **self.sums, "batch_flushed_total": self.batches, "timestamp_min": self.least, "timestamp_max": self.most,
            **{f"{k}_count": self._estimate(k) for k in KINDS}, "lost_logs_total": 0, "log_refused_total": 0, "backpressure_count": 0,
        }

    def as_json(self) -> str:
        return json.dumps(self.counts() | {"throughput_sec": self.rows_per_second_max / 1e6})
