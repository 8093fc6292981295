"""Schemas, size presets and the configuration of the write path."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import types as T

#: Microseconds between 1601-01-01 and 1970-01-01; byte limits of the two strings.
EPOCH_1601_US = 11_644_473_600_000_000
RESOURCE_LIMIT, RESOURCE_HEAD, RESOURCE_TAIL = 563, 80, 479
ENDPOINT_LIMIT = 79
RECORD_BYTES = 32
FILES_DEFAULT = 512

#: Bytes of a batch by preset; a batch holds a record for every 32 bytes.
BATCH_BYTES = {
    "500KB": 512_000, "1MB": 1 << 20, "2MB": 1 << 21, "4MB": 1 << 22, "8MB": 1 << 23, "16MB": 1 << 24,
    "32MB": 1 << 25, "64MB": 1 << 26, "128MB": 1 << 27, "256MB": 1 << 28, "512MB": 1 << 29,
}
#: Dictionary slots by preset.
DICT_SLOTS = {"16K": 1 << 14, "32K": 1 << 15, "64K": 1 << 16, "128K": 1 << 17, "256K": 1 << 18, "512K": 1 << 19, "1M": 1 << 20, "2M": 1 << 21, "4M": 1 << 22, "8M": 1 << 23, "16M": 1 << 24}
COMPRESSIONS = ("none", "balanced", "fast")


class Status(IntEnum):
    """Outcomes of ``Config.check``."""

    OK = 0
    MISSING_PARAMETER = 15
    INVALID_PARAMETER = 16  # a default was put in its place


def rows_per_batch(preset: str = "8MB") -> int:
    """The row count at which a batch closes: capacity less a thirty-second of it."""
    return flush_rows(BATCH_BYTES[preset] // RECORD_BYTES)


def flush_rows(capacity: int) -> int:
    return capacity - capacity // 32


RAW_EVENT = T.StructType([
    T.StructField("operation_id", T.ShortType()), T.StructField("resource", T.StringType()), T.StructField("status_code", T.LongType()),
    T.StructField("endpoint", T.StringType()), T.StructField("duration_ms", T.IntegerType()), T.StructField("data_size_bucket", T.IntegerType()),
    T.StructField("flags", T.ShortType()), T.StructField("timestamp_us", T.LongType()),
])
STORED_RECORD = T.StructType([
    T.StructField("batch_id", T.LongType()), T.StructField("sequence", T.LongType()), T.StructField("timestamp_us", T.LongType()),
    T.StructField("url_idx", T.LongType()), T.StructField("ip_idx", T.LongType()), T.StructField("http_code", T.IntegerType()),
    T.StructField("duration_ms", T.IntegerType()), T.StructField("response_size", T.IntegerType()), T.StructField("http_verb", T.ShortType()),
    T.StructField("flags", T.ShortType()),
])
DICTIONARY = T.StructType([
    T.StructField("batch_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("id", T.LongType()), T.StructField("value", T.StringType()),
])
DECODED_EVENT = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("sequence", T.LongType()),
    T.StructField("timestamp_us", T.LongType()), T.StructField("resource", T.StringType()), T.StructField("endpoint", T.StringType()),
    T.StructField("http_code", T.IntegerType()), T.StructField("http_verb", T.ShortType()), T.StructField("duration_ms", T.IntegerType()),
    T.StructField("response_size", T.IntegerType()), T.StructField("flags", T.ShortType()), T.StructField("corrupt_reason", T.StringType()),
])


@dataclass
class Config:
    """How events are normalised and stored; ``check`` replaces invalid values by defaults, as documented there."""

    path: str | None = None
    backup_path: str | None = None
    error_path: str = "error"
    level: int = 0
    strip_params: bool = True
    sequence: bool = True
    batch: str = "8MB"
    dictionary: str = "256K"
    files: int = FILES_DEFAULT
    compression: str = "balanced"
    strict_cidr: bool = False
    collapse_mask: bool = False
    warnings: list[str] = field(default_factory=list)

    def check(self) -> Status:
        """No path (or ``NUL``) fails; an empty error path is ``error``; a level outside 0-4 is 0; batches to a
        file that are no power of two are 512; unknown compression is balanced, unknown sizes 8MB and 256K."""
        if not self.path or self.path == "NUL":
            return Status.MISSING_PARAMETER
        self.warnings = []

        def default(name: str, bad: bool, value: object) -> None:
            if bad:
                self.warnings.append(name)
                setattr(self, name, value)

        self.error_path = self.error_path or "error"
        default("level", self.level not in range(5), 0)
        default("strip_params", self.strip_params not in (True, False), True)
        default("sequence", self.sequence not in (True, False), True)
        default("files", self.files < 1 or self.files & (self.files - 1) != 0, FILES_DEFAULT)
        default("compression", self.compression not in COMPRESSIONS, "balanced")
        default("batch", self.batch not in BATCH_BYTES, "8MB")
        default("dictionary", self.dictionary not in DICT_SLOTS, "256K")
        return Status.INVALID_PARAMETER if self.warnings else Status.OK

    @property
    def rows_per_batch(self) -> int:
        """A batch closes at its own size or, if that is smaller, at the dictionary's: no row is ever refused."""
        return min(rows_per_batch(self.batch), flush_rows(DICT_SLOTS[self.dictionary]))

    @property
    def rows_per_file(self) -> int:
        return self.rows_per_batch * self.files

    @property
    def parquet_codec(self) -> str:
        return {"none": "none", "balanced": "zstd", "fast": "lz4_raw"}[self.compression]
