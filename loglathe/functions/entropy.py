"""Shannon entropy of the bytes of a string, in bits, without leaving the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shannon_entropy(text: Column) -> Column:
    """-sum p log2 p over bytes; 0 for the empty string, null for null.

    The sorted hexadecimal bytes are walked once: a run that ends adds n log2 n.
    """
    units = F.array_sort(F.regexp_extract_all(F.hex(text.cast("binary")), F.lit("(..)"), 1))
    n = F.size(units).cast("double")
    term = lambda k: F.when(k > 1, k * F.log2(k)).otherwise(F.lit(0.0))
    start = F.struct(F.lit("").alias("at"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    walked = F.aggregate(
        units, start,
        lambda acc, u: F.when(acc["at"] == u, F.struct(u.alias("at"), (acc["run"] + 1).alias("run"), acc["sum"].alias("sum"))).otherwise(
            F.struct(u.alias("at"), F.lit(1.0).alias("run"), (acc["sum"] + term(acc["run"])).alias("sum"))
        ),
        lambda acc: acc["sum"] + term(acc["run"]),
    )
    return F.when(text.isNotNull(), F.when(n > 0, F.greatest(F.log2(n) - walked / n, F.lit(0.0))).otherwise(F.lit(0.0)))
