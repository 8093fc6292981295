"""Columnar sinks: dictionary-encoded Parquet with rotation, and a one-way switch to a backup path."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..schema import Config, Status

#: The error's own text tells what a backup path may mend: a full disk, a missing folder, a refused access.
MENDABLE = ("No space left", "Mkdirs failed", "Permission denied", "No such file", "AccessControlException", "FileNotFoundException", "Read-only", "NotDirectory", "Not a directory", "PATH_NOT_FOUND")


class ErrorLog:
    """Appends ``[time] message`` lines in local time: one small file a message, in any store Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def write(self, message: str) -> None:
        now = datetime.now()
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_error_{now:%Y%m%d%H%M%S%f}.txt")
        out = path.getFileSystem(conf).create(path, True)
        try:
            out.write(bytearray(f"[{now:%Y-%m-%d %H:%M:%S}] {message}\n".encode()))
        finally:
            out.close()


class Failover:
    """Runs a write on the primary path; from the first mendable failure on, on the backup path only."""

    def __init__(self, primary: str, backup: str | None, log: ErrorLog | None = None):
        self.path, self.backup, self.log = primary, backup, log

    def run(self, write: Callable[[str], None]) -> str:
        try:
            write(self.path)
        except (PySparkException, Exception) as error:
            if self.log:
                self.log.write(f"{self.path}: {str(error).splitlines()[0][:500]}")
            if self.backup is None or self.path == self.backup or not any(m in str(error) for m in MENDABLE):
                raise
            self.path, self.backup = self.backup, None
            write(self.path)
        return self.path


def write_parquet(df: DataFrame, path: str, config: Config, mode: str = "append") -> None:
    """A file holds at most ``files`` batches of rows; strings are dictionary-encoded in every row group."""
    (
        df.write.mode(mode).option("compression", config.parquet_codec).option("maxRecordsPerFile", config.rows_per_file)
        .option("parquet.enable.dictionary", "true").parquet(path)
    )


def write_events(df: DataFrame, config: Config, log: ErrorLog | None = None) -> str:
    """Checks the configuration, writes with failover, returns the path that was written.

    Failures go to ``log``, by default to the error log in the configuration's ``error_path``.
    """
    if config.check() == Status.MISSING_PARAMETER:
        raise ValueError("a path is needed")
    log = log or ErrorLog(df.sparkSession, config.error_path)
    return Failover(config.path, config.backup_path, log).run(lambda path: write_parquet(df, path, config))
