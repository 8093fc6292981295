"""Streaming ingest: any stream of raw events through the same projection as batch, exactly once into files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamReader, StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.normalize import normalize
from ..schema import Config
from ..sources.sinks import Failover, write_parquet


def ingest(raw: DataFrame, config: Config, checkpoint: str, drain: bool = True) -> StreamingQuery:
    """Normalises and writes a stream.  ``drain``: all that is there, then stops; else it keeps running.

    The stream's batch number is part of the path, and a repeated batch overwrites its own folder, so a batch that
    is run again after a failure is stored once.
    """
    config.check()
    route = Failover(config.path, config.backup_path)

    def put(batch: DataFrame, number: int) -> None:
        route.run(lambda path: write_parquet(batch, f"{path}/batch={number}", config, "overwrite"))

    writer = normalize(raw, config).writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime="10 seconds")).start()


def stop(query: StreamingQuery) -> None:
    """Graceful end: what has arrived is processed first."""
    query.processAllAvailable()
    query.stop()


#: How each kind of source is told to take no more at a time.
LIMITS = {"rows": {"kafka": "maxOffsetsPerTrigger", "rate-micro-batch": "rowsPerBatch"}, "files": {"": "maxFilesPerTrigger"}, "bytes": {"": "maxBytesPerTrigger"}}


def limited(reader: DataStreamReader, source: str, rows: int | None = None, files: int | None = None, bytes: int | None = None) -> DataStreamReader:
    """Backpressure: the most that one micro-batch takes; the rest waits at the source, nothing is refused or lost."""
    for what, most in (("rows", rows), ("files", files), ("bytes", bytes)):
        if most is not None:
            option = LIMITS[what].get(source) or LIMITS[what].get("")
            if option is None:
                raise ValueError(f"{source} cannot be limited by {what}")
            reader = reader.option(option, str(most))
    return reader


class Counters(StreamingQueryListener):
    """Counters over all micro-batches of a session's streams: add it by ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.batches = self.rows = self.failed = 0
        self.rows_per_second_max = 0.0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.batches += 1
        self.rows += event.progress.numInputRows
        self.rows_per_second_max = max(self.rows_per_second_max, event.progress.processedRowsPerSecond or 0.0)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.failed += event.exception is not None


def numbered_batches(events: DataFrame, producer: str, rows: int, order: str | None = None) -> DataFrame:
    """Gap-free row-count batches of each producer on a stream: the state is one row counter a producer.

    With ``order`` the rows that one micro-batch has of a producer are numbered in that column's order.
    """
    fields = [f for f in events.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", batch_id long"

    def number(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (seen,) = state.get if state.exists else (0,)
        if order is not None:
            parts = iter([pd.concat(list(parts)).sort_values(order, kind="stable")])
        for part in parts:
            yield part.assign(batch_id=(seen + pd.RangeIndex(len(part)).to_series(index=part.index)) // rows)
            seen += len(part)
        state.update((seen,))

    return events.groupBy(producer).applyInPandasWithState(number, schema, "seen long", "append", GroupStateTimeout.NoTimeout)


def each_progress(query: StreamingQuery, tell: Callable[[dict], None]) -> None:
    """Hands the counters of every finished micro-batch to ``tell``."""
    for p in query.recentProgress:
        tell({"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p.get("processedRowsPerSecond", 0.0)})
