"""Files of binary blocks as a Spark data source, batch and streaming, and through Spark's own file reader.

Options of a read: ``path``, ``backup_path`` (a second folder, which took the first one's place), ``columns`` (the strings
to decode: ``resource,endpoint``), ``filters`` (comparisons of number columns: ``http_code>=400,sequence<500``),
``resource`` and ``endpoint`` (the one wanted string), ``split_bytes`` (128 MiB; a block belongs to the partition in which
it begins).  Filters are options because those that Spark pushes into a Python source stay with the relation: a later
query on the same DataFrame would be filtered as well.  Files whose ranges hold no wanted row are never opened, and of
the others only blocks that may hold one by their statistics are read.

A stream takes ``log_path`` besides, a folder of its own, and ``max_bytes_per_trigger``.  Its offset is the number of an entry
in that log; an entry lists (file, from, to) in bytes and is written before Spark sees its number, so a restart reads
the same.  Files may grow: a block belongs to the entry that holds its last byte.

Options of a write: ``path``, ``backup_path``, ``rows_per_batch``, ``flush_per_file``, ``compression``, for a stream ``stream``
(its name, if several write to a folder).  A task that cannot go on in the first folder goes on in the second, from the
first byte of the block it was writing.  What was written is published by one list when all tasks are done.
"""

from __future__ import annotations

import errno
import io
import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ..schema import DECODED_EVENT, EPOCH_1601_US, rows_per_batch
from . import block_stats, codec, manifest
from .sinks import MENDABLE

FORMAT = "loglathe_shard"
_ARROW = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), ("sequence", pa.int64()), ("timestamp_us", pa.int64()), ("resource", pa.string()),
    ("endpoint", pa.string()), ("http_code", pa.int32()), ("http_verb", pa.int16()), ("duration_ms", pa.int32()), ("response_size", pa.int32()),
    ("flags", pa.int16()), ("corrupt_reason", pa.string()),
])
_COMPARE = {"=": np.equal, ">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}
_TEST = re.compile(r"\s*(\w+)\s*(<=|>=|=|<|>)\s*(-?\d+)\s*")
#: Entries of a stream's log after which they are put together in one.
COMPACT = 50


@dataclass
class Wanted:
    """Which strings to decode, and which rows to keep."""

    columns: set[str] | None
    tests: list[tuple[str, str, int]]
    equal: dict[str, str]

    @classmethod
    def of(cls, options: dict) -> Wanted:
        columns, tests = options.get("columns"), []
        for part in filter(None, (options.get("filters") or "").split(",")):
            m = _TEST.fullmatch(part)
            if m is None or m[1] not in block_stats.NUMBERS:
                raise ValueError(f"not a comparison of a number column: {part}")
            tests.append((m[1], m[2], int(m[3])))
        equal = {c: options[c] for c in block_stats.STRINGS if options.get(c) is not None}
        return cls({c.strip() for c in columns.split(",")} if columns else None, tests, equal)


ALL = Wanted(None, [], {})


def decode_blocks(name: str, blocks: Iterator[tuple[int, bytes, int]], wanted: Wanted = ALL) -> Iterator[pa.RecordBatch]:
    """One batch a block; a block that does not parse is one row with its reason, and the next block follows."""
    for number, stored, size in blocks:
        try:
            got = codec.decode_block(stored, size, None if wanted.columns is None else wanted.columns | set(wanted.equal))
        except codec.Corrupt as error:
            row = {f.name: pa.nulls(1, f.type) for f in _ARROW}
            row |= {"file": pa.array([name]), "block": pa.array([number]), "pos": pa.array([0]), "corrupt_reason": pa.array([str(error)])}
            yield pa.RecordBatch.from_arrays([row[f.name] for f in _ARROW], schema=_ARROW)
            continue
        keep = np.ones(len(got["sequence"]), bool)
        for column, sign, value in wanted.tests:
            keep &= _COMPARE[sign](got[column], value)
        for column, value in wanted.equal.items():
            keep &= pc.equal(got[column], value).to_numpy(zero_copy_only=False)
        chosen = np.flatnonzero(keep)
        cols = []
        for f in _ARROW:
            if f.name == "file":
                cols.append(pa.array([name] * len(chosen), pa.string()))
            elif f.name == "block":
                cols.append(pa.array(np.full(len(chosen), number)))
            elif f.name == "pos":
                cols.append(pa.array(chosen))
            elif f.name in block_stats.STRINGS and f.name in got and (wanted.columns is None or f.name in wanted.columns):
                cols.append(got[f.name].take(pa.array(chosen)))
            elif f.name in block_stats.NUMBERS:
                cols.append(pa.array(got[f.name][chosen]).cast(f.type, safe=False))
            else:
                cols.append(pa.nulls(len(chosen), f.type))
        yield pa.RecordBatch.from_arrays(cols, schema=_ARROW)


def decode_file(name: str, file, wanted: Wanted = ALL) -> Iterator[pa.RecordBatch]:
    return decode_blocks(name, codec.blocks(file), wanted)


@dataclass
class ShardPart(InputPartition):
    """Bytes ``start`` to ``end`` of a file: the blocks that begin there, or with ``growing`` that end there."""

    folder: str
    file: str
    start: int
    end: int
    indexed: bool = False
    growing: bool = False

    def blocks(self, wanted: Wanted) -> Iterator[tuple[int, bytes, int]]:
        store, folder = manifest.store_of(self.folder)
        path = f"{folder}/{self.file}"
        if self.indexed:
            with store.open_input_file(path + block_stats.SUFFIX) as file:
                table = block_stats.read(file)
            start, stored = (table.column(c).to_numpy() for c in ("start", "stored_bytes"))
            end = start + codec.HEADER.size + stored
            own = (end > self.start) & (end <= self.end) if self.growing else (start >= self.start) & (start < self.end)
            table = block_stats.wanted(table.filter(pa.array(own)), wanted.tests, wanted.equal)
            if not table.num_rows:
                return
        with store.open_input_file(path) as file:
            if self.indexed:
                for number, at in zip(table.column("block").to_pylist(), table.column("start").to_pylist(), strict=True):
                    yield number, *codec.block_at(file, at)
            else:
                yield from (codec.blocks_ending if self.growing else codec.blocks_between)(file, self.start, self.end)

    def read(self, wanted: Wanted) -> Iterator[pa.RecordBatch]:
        return decode_blocks(self.file.rsplit("/", 1)[-1], self.blocks(wanted), wanted)


class ShardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.wanted = options, Wanted.of(options)
        self.split = int(options.get("split_bytes", 128 << 20))

    def partitions(self) -> list[InputPartition]:
        out = []
        for e in manifest.entries(self.options["path"], self.options.get("backup_path")):
            if block_stats.file_can_hold(e.get("ranges"), self.wanted.tests):
                indexed = e.get("indexed", False)
                out += [ShardPart(e["folder"], e["file"], at, min(at + self.split, e["bytes"]), indexed) for at in range(0, e["bytes"], self.split)]
        return out or [ShardPart("", "", 0, 0)]

    def read(self, partition: ShardPart) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from partition.read(self.wanted)


class ShardStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        if not options.get("log_path"):
            raise ValueError("a stream of blocks needs a folder of its own in log_path")
        self.options, self.log, self.wanted = options, options["log_path"], Wanted.of(options)
        self.most = int(options.get("max_bytes_per_trigger", 1 << 62))
        self.seen: dict[tuple[str, str], int] | None = None
        self.number = 0

    def _entries(self) -> dict[int, str]:
        store, folder = manifest.store_of(self.log)
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return {int(i.base_name[1:-5]): i.path for i in found if re.fullmatch(r"[es]\d{12}\.json", i.base_name)}

    def _load(self, path: str) -> list[dict]:
        store, _ = manifest.store_of(self.log)
        with store.open_input_stream(path) as file:
            return json.loads(file.read())

    def _known(self) -> dict[tuple[str, str], int]:
        """How far each file has been read: from the log when the stream begins, kept up to date since."""
        if self.seen is None:
            self.seen = {}
            for number, path in sorted(self._entries().items()):
                self.seen |= {(p["folder"], p["file"]): p["end"] for p in self._load(path)}
                self.number = number
        return self.seen

    def initialOffset(self) -> dict:  # noqa: N802
        return {"entry": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        seen, left, parts = self._known(), self.most, []
        for e in manifest.entries(self.options["path"], self.options.get("backup_path")):
            start = seen.get((e["folder"], e["file"]), 0)
            if e["bytes"] > start and left > 0:
                end = min(e["bytes"], start + left)
                left -= end - start
                parts.append({"folder": e["folder"], "file": e["file"], "start": start, "end": end, "indexed": e.get("indexed", False)})
        if parts:
            manifest.write_whole(self.log, f"e{self.number + 1:012d}.json", json.dumps(parts).encode())
            self.number += 1
            seen |= {(p["folder"], p["file"]): p["end"] for p in parts}
        return {"entry": self.number}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        paths = self._entries()
        return [ShardPart(**p, growing=True) for n in range(start["entry"] + 1, end["entry"] + 1) for p in self._load(paths[n])]

    def read(self, partition: ShardPart) -> Iterator[pa.RecordBatch]:
        yield from partition.read(self.wanted)

    def commit(self, end: dict) -> None:
        """What was read for good: its entries become one, which says how far each file was read."""
        paths = {n: p for n, p in self._entries().items() if n < end["entry"]}  # the last may be asked for again
        if len(paths) >= COMPACT:
            store, _ = manifest.store_of(self.log)
            whole: dict[tuple[str, str], dict] = {}
            for _, path in sorted(paths.items()):
                whole |= {(p["folder"], p["file"]): p for p in self._load(path)}
            manifest.write_whole(self.log, f"s{max(paths):012d}.json", json.dumps(list(whole.values())).encode())
            for path in paths.values():
                store.delete_file(path)


@dataclass
class Written(WriterCommitMessage):
    """The files of a task, as lines of a list."""

    entries: str


class BlockFiles:
    """The block files of one task: rotation, statistics, and the way out to a second folder."""

    def __init__(self, options: dict):
        self.folders = [options["path"], *filter(None, [options.get("backup_path")])]
        self.most, self.compress = int(options.get("flush_per_file", 512)), options.get("compression", "balanced") != "none"
        self.task, self.entries, self.name, self.out = uuid.uuid4().hex[:12], [], "", None
        self.blocks: list[dict] = []
        self.size = self.made = 0

    def _open(self) -> None:
        store, folder = manifest.store_of(self.folders[0])
        store.create_dir(folder, recursive=True)
        stamp = time.time_ns() // 100 + EPOCH_1601_US * 10
        self.name = f"shard_{stamp}_{self.task}_{self.made}.bin"
        self.out = store.open_output_stream(f"{folder}/{self.name}")
        self.blocks, self.size, self.made = [], 0, self.made + 1

    def put(self, batch: pa.RecordBatch) -> None:
        raw, records, strings = codec.encode_block(batch, self.compress)
        while True:
            try:
                if self.out is None:
                    self._open()
                self.out.write(raw)
                break
            except OSError as error:
                self._leave(error)
        stored, size = codec.HEADER.unpack(raw[: codec.HEADER.size])
        place = {"block": len(self.blocks), "start": self.size, "stored_bytes": stored, "raw_bytes": size}
        self.blocks.append(place | block_stats.of_block(records, strings))
        self.size += len(raw)
        if len(self.blocks) == self.most:
            self.close()

    def _leave(self, error: OSError) -> None:
        """On to the second folder; the block is written again there, whole blocks that got through stay where they are."""
        if len(self.folders) < 2 or not (error.errno in (errno.ENOSPC, errno.EDQUOT, errno.ENOENT, errno.EACCES, errno.EPERM, errno.EROFS, errno.ENOTDIR) or any(m in str(error) for m in MENDABLE)):
            raise error
        if self.out is not None:
            try:
                self.out.close()
            except OSError:
                pass  # what counts is what is there
            self.out = None
            if self.blocks:
                store, folder = manifest.store_of(self.folders[0])
                if store.get_file_info(f"{folder}/{self.name}").size < self.size:
                    raise error  # whole blocks are lost: the task runs again
                self._told()
        self.folders.pop(0)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            self._told()

    def _told(self) -> None:
        store, folder = manifest.store_of(self.folders[0])
        indexed = True
        try:
            with store.open_output_stream(f"{folder}/{self.name}{block_stats.SUFFIX}") as out:
                out.write(block_stats.table_bytes(self.blocks))
        except OSError:
            indexed = False  # readers go from header to header
        self.entries.append({
            "folder": self.folders[0], "file": self.name, "bytes": self.size, "blocks": len(self.blocks), "rows": sum(b["rows"] for b in self.blocks),
            "ranges": block_stats.ranges(self.blocks), "indexed": indexed,
        })
        self.blocks = []

    def drop(self) -> None:
        """Removes what this task has written."""
        if self.out is not None:
            with_file = {"folder": self.folders[0], "file": self.name}
            try:
                self.out.close()
            except OSError:
                pass
            self.entries.append(with_file)
        remove(self.entries)


def remove(entries: list[dict]) -> None:
    for e in entries:
        store, folder = manifest.store_of(e["folder"])
        for name in (e["file"], e["file"] + block_stats.SUFFIX):
            if store.get_file_info(f"{folder}/{name}").type == fs.FileType.File:
                store.delete_file(f"{folder}/{name}")


def write_blocks(options: dict, iterator: Iterator[pa.RecordBatch]) -> Written:
    """A block every ``rows_per_batch`` rows of a task."""
    rows, files = int(options.get("rows_per_batch", rows_per_batch())), BlockFiles(options)
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        files.put(pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)[0])
        held, size = [], 0

    try:
        for batch in iterator:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows - size)
                held.append(part)
                at, size = at + part.num_rows, size + part.num_rows
                if size == rows:
                    flush()
        if size:
            flush()
        files.close()
    except BaseException:
        files.drop()
        raise
    return Written(json.dumps(files.entries))


def _entries_of(messages: list[WriterCommitMessage | None]) -> list[dict]:
    return [e for m in messages if m for e in json.loads(m.entries)]


def _publish(options: dict, name: str, entries: list[dict]) -> bool:
    """One list for all files, in the first folder that takes it."""
    folders = [options["path"], *filter(None, [options.get("backup_path")])]
    for k, folder in enumerate(folders):
        try:
            return manifest.publish(folder, name, entries)
        except OSError:
            if k == len(folders) - 1:
                raise
    return False


class ShardWriter(DataSourceArrowWriter):
    """A file a task, or more by rotation; files of failed tasks and jobs are in no list, and removed."""

    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return write_blocks(self.options, iterator)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        _publish(self.options, f"batch-{uuid.uuid4().hex}", _entries_of(messages))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        remove(_entries_of(messages))


class ShardStreamWriter(DataSourceStreamArrowWriter):
    """A list a micro-batch; one that is run again after it was published is left as it was."""

    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return write_blocks(self.options, iterator)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        entries = _entries_of(messages)
        if not _publish(self.options, f"{self.options.get('stream', 'stream')}-{batchId:012d}", entries):
            remove(entries)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        remove(_entries_of(messages))


class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return DECODED_EVENT

    def reader(self, schema: StructType) -> DataSourceReader:
        return ShardReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return ShardStreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ShardWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
        return ShardStreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShardSource)


def decode_files(files: DataFrame) -> DataFrame:
    """Rows of Spark's ``binaryFile`` source (any store that Spark reads, batch or stream) -> decoded events."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield from decode_file(path.rsplit("/", 1)[-1], io.BytesIO(content))

    return files.select("path", "content").mapInArrow(run, DECODED_EVENT)


def block_sizes(files: DataFrame) -> DataFrame:
    """(file, block, raw_bytes, stored_bytes) of every block in rows of the ``binaryFile`` source, from the headers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = [(n, raw, len(stored)) for n, stored, raw in codec.blocks(io.BytesIO(content))]
                cols = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]] * len(found), pa.string()), *cols], names=["file", "block", "raw_bytes", "stored_bytes"])

    return files.select("path", "content").mapInArrow(run, "file string, block long, raw_bytes long, stored_bytes long")


def listed(spark: SparkSession, path: str) -> DataFrame | None:
    """The lines of a folder's lists, read by Spark from any store it reaches; None where there are no lists."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{manifest.FOLDER}")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema("folder string, file string, bytes long, blocks long, rows long, indexed boolean").json(f"{path}/{manifest.FOLDER}")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """The block files of a folder as rows of Spark's ``binaryFile`` source: the listed ones, or all where there are no lists."""
    lists = listed(spark, path)
    if lists is None:
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    names = [f"{r['folder']}/{r['file']}" for r in lists.select("folder", "file").collect()]  # a row a file, as for any scan
    return spark.read.format("binaryFile").load(names or f"{path}/{manifest.FOLDER}")


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """The statistics of all blocks of listed files: (file, block, start, rows, ranges, filters)."""
    names = [f"{r['folder']}/{r['file']}{block_stats.SUFFIX}" for r in listed(spark, path).where("indexed").select("folder", "file").collect()]
    table = spark.read.parquet(*names)
    return table.withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.idx$", 1))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Decoded events through Spark's own file reader: from any store it reaches, a task a file of 2 GB at most."""
    return decode_files(binary_files(spark, path))
