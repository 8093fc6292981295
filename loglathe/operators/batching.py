"""Global sequence numbers and row-count batches without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows a range aims at; the most ranges.
RANGE_ROWS, RANGES = 200_000, 10_000


def range_bounds(df: DataFrame, key: Column, rows: int = RANGE_ROWS) -> list[int]:
    """Quantiles of a whole-number key that cut df into ranges of about ``rows`` rows; one value a range."""
    k = min(RANGES, df.count() // max(1, rows))
    if k < 2:
        return []
    got = df.agg(F.percentile_approx(key, [i / k for i in range(1, k)], 10 * k + 100)).first()[0] or []
    return sorted(set(got))


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many sorted bounds are below key, by binary search in a constant array; 0 for null."""
    if not bounds:
        return F.lit(0)
    cut = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    strides = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(strides, F.lit(0), lambda at, s: F.when(F.get(cut, at + s - 1) < key, at + s).otherwise(at))


def assign_sequence(df: DataFrame, order: str, ties: tuple[str, ...] = (), name: str = "sequence", rows: int = RANGE_ROWS) -> DataFrame:
    """1-based numbers in the order of a whole-number column (nulls first), then of ``ties``.

    Ranges between quantiles are numbered each by itself; the offsets are a running sum over one row a range.
    """
    key = F.col(order).cast("bigint")
    keyed = df.withColumn("_range", range_of(key, range_bounds(df, key, rows)))
    counts = keyed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_range").orderBy(key.asc_nulls_first(), *ties)
    numbered = keyed.withColumn("_k", F.row_number().over(own)).join(F.broadcast(offsets), "_range")
    return numbered.withColumn(name, F.col("_k") + F.col("_base")).drop("_range", "_k", "_base")


def positions(df: DataFrame, sequence: str = "sequence", producer: str | None = None, name: str = "position", range_rows: int = RANGE_ROWS) -> DataFrame:
    """0-based places in the order of a sequence, of every producer's rows by themselves.

    Without producers a gapless 1-based sequence already says the place, and nothing is shuffled.
    """
    if producer is None:
        return df.withColumn(name, F.col(sequence).cast("bigint") - 1)
    # a producer of very many rows is numbered in ranges of the sequence, with an offset for each
    keyed = df.withColumn("_range", range_of(F.col(sequence), range_bounds(df, F.col(sequence), range_rows)))
    counts = keyed.groupBy(producer, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(producer).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(producer).alias("_producer"), F.col("_range").alias("_own"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy(producer, "_range").orderBy(sequence)
    same = F.col(producer).eqNullSafe(F.col("_producer")) & (F.col("_range") == F.col("_own"))
    numbered = keyed.withColumn("_k", F.row_number().over(own)).join(offsets, same)
    return numbered.withColumn(name, F.col("_base") + F.col("_k") - 1).drop("_range", "_k", "_base", "_producer", "_own")


def assign_batches(df: DataFrame, rows: int, sequence: str = "sequence", producer: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``batch_id``: every producer's rows in sequence order, ``rows`` to a batch."""
    placed = positions(df, sequence, producer, "_place", range_rows)
    return placed.withColumn("batch_id", F.floor(F.col("_place") / rows).cast("bigint")).drop("_place")


def dense_numbers(df: DataFrame, *by: str, name: str = "number") -> DataFrame:
    """df with numbers from 0 in the order of ``by``, whose values must be unique: ranges, and an offset for each."""
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = written(dealt, "numbers").withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    number = F.col("_base") + F.col("_at") - F.shiftleft("_part", 33)
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, number).drop("_part", "_at", "_base")
