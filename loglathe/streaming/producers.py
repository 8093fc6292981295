"""Batches of each producer on a stream, with state: what is not yet a full batch waits, and a silent producer is flushed.

A producer's state is how many batches it has closed (a value) and the rows of the open one (a list), both in RocksDB.  A
batch leaves when it is full, whole and under the next number, so numbers have no gaps over micro-batches and restarts.
Every micro-batch that brings rows of a producer sets its timer anew; when it runs out the open batch leaves as it is.
With ``forget`` the state of a producer that is silent for so long goes, and its numbers begin at 0 again.

The state of one producer is at most the rows of a batch, and those that one micro-batch brings are dealt in parts as Spark
hands them over.  A producer is in one task at a time, as it is one writer; one that is too much for a task should be
split by its source.

Defined results: a null producer is a producer; rows are numbered in the order of ``order`` within a micro-batch (nulls last,
ties in any order), and micro-batches in turn; without input nothing leaves.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import LongType, StructField, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that leave at a time, in whole batches.
LEAVE_ROWS = 50_000


class ProducerBatches(StatefulProcessor):
    def __init__(self, schema: StructType, rows: int, order: str, idle_ms: int, forget_ms: int | None):
        self.schema, self.rows, self.order, self.idle, self.forget = schema, rows, order, idle_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closed = handle.getValueState("closed", "batches long, held long", self.forget)
        self.open = handle.getListState("open", self.schema, self.forget)

    def _leave(self, part: pd.DataFrame, first: int) -> Iterator[pd.DataFrame]:
        """Rows with the numbers of their batches, many batches at a time: each frame is handed over by itself."""
        for at in range(0, len(part), step := max(1, LEAVE_ROWS // self.rows) * self.rows):
            some = part.iloc[at : at + step]
            yield some[self.schema.names].assign(batch=first + np.arange(at, at + len(some)) // self.rows)

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.open.get()), columns=self.schema.names)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batches, held = self.closed.get() if self.closed.exists() else (0, 0)
        new = pd.concat(list(rows)).sort_values(self.order, kind="stable", na_position="last")
        if held + len(new) < self.rows:
            self._add(new)
            held += len(new)
        else:
            whole = pd.concat([self._held(), new]) if held else new
            self.open.clear()
            full = len(whole) // self.rows
            yield from self._leave(whole.iloc[: full * self.rows], batches)
            rest = whole.iloc[full * self.rows :]
            self._add(rest)
            batches, held = batches + full, len(rest)
        self.closed.update((batches, held))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if held:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def _add(self, part: pd.DataFrame) -> None:
        if len(part):
            self.open.appendList([tuple(None if pd.isna(x) else x for x in row) for row in part[self.schema.names].itertuples(index=False)])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batches, held = self.closed.get() if self.closed.exists() else (0, 0)
        if held:
            yield from self._leave(self._held(), batches)
            self.open.clear()
            self.closed.update((batches + 1, 0))

    def close(self) -> None:
        pass


def producer_batches(events: DataFrame, producer: str, rows: int, order: str = "sequence", idle_ms: int = 60_000, forget_ms: int | None = None) -> DataFrame:
    """The stream's rows with ``batch_id``, as their batches close."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # numbered names: Spark's rows for Python rename those that begin with an underscore
    names, schema = events.columns, StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(events.schema.fields)])
    key = F.coalesce(F.concat(F.lit("p"), F.col(f"`{producer}`").cast("string")), F.lit("n"))  # null is one as well
    keyed = events.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)], key.alias("key"))
    out = StructType([*schema.fields, StructField("batch", LongType())])
    processor = ProducerBatches(schema, rows, f"c{names.index(order)}", idle_ms, forget_ms)
    closed = keyed.groupBy("key").transformWithStateInPandas(processor, out, outputMode="append", timeMode="processingTime")
    return closed.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names) if c != "batch_id"], F.col("batch").alias("batch_id"))


def start(batches: DataFrame, path: str, checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Stores closed batches as they come.  Timers are looked at once a trigger, so this stream never ends by itself: see ``drain``."""
    writer = batches.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start()


def _until(query: StreamingQuery, reached: Callable[[dict], bool], seconds: float) -> None:
    """Waits for a finished micro-batch of which ``reached`` holds."""
    end = time.monotonic() + seconds
    while not ((told := query.lastProgress) and reached(told)):
        if query.exception() is not None:
            raise query.exception()
        if time.monotonic() > end:
            raise TimeoutError("the stream took too long")
        time.sleep(0.1)


def caught_up(query: StreamingQuery, seconds: float = 300.0) -> None:
    """Waits until a micro-batch found nothing new at the sources."""
    _until(query, lambda told: told["numInputRows"] == 0, seconds)


def drain(query: StreamingQuery, idle_ms: int, seconds: float = 300.0) -> None:
    """Graceful end: what has arrived is processed, open batches leave when their timers run out, then the stream stops."""
    caught_up(query, seconds)
    last = max((_began(told) for told in query.recentProgress if told["numInputRows"]), default=_began(query.lastProgress))
    # timers were set while a micro-batch ran that was over before the next began
    after = min((_began(told) for told in query.recentProgress if _began(told) > last), default=last)
    _until(query, lambda told: told["numInputRows"] == 0 and _began(told) > after + idle_ms / 1000, seconds + idle_ms / 1000)
    query.stop()


def _began(told: dict) -> float:
    return datetime.fromisoformat(told["timestamp"]).timestamp()
