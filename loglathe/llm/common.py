"""Shared helpers: the shared folder, materialised tables, table reading."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one narrow (at most about 100 bytes) broadcast table; above it a shuffled join is used.
BROADCAST_ROWS = 200_000
#: Rows of one file of a narrow table whose number of rows is bounded beforehand.
FILE_ROWS = 100_000

_ours: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one under /tmp only where that is unset and the master is local."""
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file:///tmp/checkpoints/{sc.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/loglathe-{uuid.uuid4().hex[:12]}-{name}"
    app = spark.sparkContext.applicationId
    if app not in _ours:
        _ours[app] = []
        atexit.register(_clean, spark, app)
    _ours[app].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean(spark: SparkSession, app: str) -> None:
    for path in _ours.pop(app, []):
        try:
            remove(spark, path)
        except Exception:  # the session has ended before: nothing can be removed any more
            return


_passing: list[list[Kept]] = []


@contextlib.contextmanager
def passing() -> Iterator[None]:
    """Tables that are kept inside are removed at its end, but for those told to stay."""
    _passing.append([])
    try:
        yield
    finally:
        for kept in _passing.pop():
            kept.drop()


class Kept:
    """A table written to the shared folder: cuts lineage, survives lost executors, keeps column pruning.

    ``rows``, where a bound is known, bounds the files too: on local folders Hadoop starts about three processes a file
    (chmod), each of which shares all memory of its executor for a moment.
    """

    def __init__(self, df: DataFrame, name: str, rows: int | None = None):
        self.spark = df.sparkSession
        if rows is not None:
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
        self.path = new_path(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        if _passing:
            _passing[-1].append(self)

    def stay(self) -> Kept:
        """Not removed at the end of the innermost ``passing``, but with what encloses it."""
        if _passing and self in _passing[-1]:
            _passing[-1].remove(self)
            if len(_passing) > 1:
                _passing[-2].append(self)
        return self

    def drop(self) -> None:
        remove(self.spark, self.path)


def keep(df: DataFrame, name: str) -> DataFrame:
    return Kept(df, name).df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """At a task's end in a Python worker, which later tasks use again: gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def settle(spark: SparkSession) -> None:
    """Between stages: the executors collect their garbage and give the heap that this frees back to the system.

    A heap that has grown to its limit stays there, beside the Python workers of the next stage, which need their own memory.
    A task a core; where Spark deals them unevenly, an executor may be left out, which changes no results.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def packed(carry: tuple[str, ...]) -> Column:
    """The carried columns as one struct, so that no name of theirs clashes with an operator's own."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]) if carry else F.struct(F.lit(0).alias("none"))


def unpacked(carry: tuple[str, ...], results: tuple[str, ...], row: str = "row") -> list[Column]:
    """The carried columns, but for those that results of the same name replace, then the results."""
    return [*(F.col(row).getField(c).alias(c) for c in carry if c not in results), *(F.col(c) for c in results)]


def unit(*cols: Column) -> Column:
    """A uniform number in [0, 1) from the hash of cols."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def empty_text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def bound_arrow(spark: SparkSession) -> None:
    """Batches that go to Python: few rows and, where Spark knows that setting, few bytes.

    They are settings of the session and hold when a query runs, so all operators set the same.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
