"""Batches that close on rows or on distinct values, whichever comes first.

A batch takes rows in order until it has ``rows`` of them, or until the next row would bring it more than ``values``
distinct values of a dictionary column; that row then begins the next batch.  With ``shrink``, a producer whose dictionary
was once full holds ``values`` less a thirty-second of it rows a batch from then on, which no dictionary of its can exceed.

Where a batch ends hangs on where it began, so the cuts are a chain along the whole order.  It is walked in parallel:

1. The order is dealt to ranges of at least ``rows`` rows, each with the ``rows`` that follow it.  A task slides over a range
   once and knows for every row where a batch that begins there ends; so it knows, for every place at which a batch
   may first begin in the range, at which place of the next range one begins.
2. These functions of neighbouring ranges compose; they never decrease and soon become equal, so they are kept as steps.
   A tree of compositions, ``FAN`` ranges at a time, gives each range its first begin.
3. From there every range lists its begins; a running sum over one row a range numbers them, and each row is told its batch.

Values are told apart by 128 bits of hash within a range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import flush_rows
from ..sources.scratch import written
from .batching import RANGE_ROWS, positions
from .dictionary import KINDS

#: Ranges that one task composes.
FAN = 64


def ends(codes: list[np.ndarray], begins: int, rows: int, values: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first ``begins`` rows: where a batch that begins there ends, and whether a dictionary was full.

    ``codes``: a number from 0 a row for each column.  Two marks slide over the rows, the values between are counted.
    """
    total = len(codes[0])
    (one, two), end, full = (c.tolist() for c in codes), np.empty(begins, np.int64), np.zeros(begins, bool)
    held_one, held_two = ([0] * (max(c, default=-1) + 1) for c in (one, two))
    different_one = different_two = at = 0
    for k in range(begins):
        most = min(k + rows, total)
        while at < most:
            a, b = one[at], two[at]
            new_a, new_b = not held_one[a], not held_two[b]
            if (new_a and different_one == values) or (new_b and different_two == values):
                full[k] = True
                break
            held_one[a] += 1
            held_two[b] += 1
            different_one += new_a
            different_two += new_b
            at += 1
        end[k] = at
        a, b = one[k], two[k]
        held_one[a] -= 1
        held_two[b] -= 1
        different_one -= not held_one[a]
        different_two -= not held_two[b]
    return end, full


def _numbered(lanes: list[np.ndarray]) -> np.ndarray:
    """Numbers from 0 for the pairs of two hashes."""
    first, second = (pd.factorize(x)[0].astype(np.int64) for x in lanes)
    return pd.factorize(first * (second.max(initial=0) + 1) + second)[0]


def _scan(rows: int, values: int, size: int):
    """A range's rows and those after it -> its begins that can be reached, where they lead, and the function as steps."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        part = int(key[1].as_py())
        table = table.sort_by("position")
        place = table.column("position").to_numpy()
        codes = [_numbered([table.column(f"{kind}{k}").to_numpy() for k in (0, 1)]) for kind in KINDS]
        own = int(np.searchsorted(place, (part + 1) * size))  # the rest belongs to the next range
        end, full = ends(codes, own, rows, values)
        entries = 1 if part == 0 else min(rows, own)
        reached = np.zeros(own, bool)
        reached[:entries] = True
        steps = end.tolist()
        for k in range(own):
            if reached[k] and steps[k] < own:
                reached[steps[k]] = True
        land, jump = end.copy(), end < own
        while jump.any():
            land[jump] = land[land[jump]]
            jump = land < own
        land = land[:entries]
        last = np.append(np.flatnonzero(np.diff(land)), entries - 1)  # the last entry of each step
        begin = np.flatnonzero(reached)
        cols = [begin + part * size, end[begin] + part * size, full[begin], last + part * size, land[last] + part * size]
        names = ["producer", "part", "begin", "end", "full", "upto", "land"]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([part], pa.int64()), *(pa.array([c]) for c in cols)], names=names)

    return run


def _into(upto: np.ndarray, land: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Steps, applied; what lies behind the last row of all stays there."""
    step = np.searchsorted(upto, entry)
    return np.where(step < len(land), land[np.minimum(step, len(land) - 1)], entry)


def _compose(parts: pd.DataFrame, fan: int) -> pd.DataFrame:
    """The function of a run of ranges: from a begin in the first to one behind the last."""
    parts = parts.sort_values("part")
    upto, land = (np.asarray(parts[c].iloc[0]) for c in ("upto", "land"))
    for later_upto, later_land in zip(parts["upto"].iloc[1:], parts["land"].iloc[1:], strict=True):
        land = _into(np.asarray(later_upto), np.asarray(later_land), land)
    keep = np.append(np.flatnonzero(np.diff(land)), len(land) - 1)
    return pd.DataFrame({"producer": parts["producer"].iloc[:1], "part": parts["part"].iloc[:1] // fan, "upto": [upto[keep]], "land": [land[keep]]})


def _walk(parts: pd.DataFrame) -> pd.DataFrame:
    """Each range's first begin, from that of their run."""
    parts = parts.sort_values("part")
    at, entries = int(parts["entry"].iloc[0]), []
    for upto, land in zip(parts["upto"], parts["land"], strict=True):
        entries.append(at)
        at = int(_into(np.asarray(upto), np.asarray(land), np.array([at]))[0])
    return pd.DataFrame({"producer": parts["producer"], "part": parts["part"], "entry": entries})


_FUNCTION = "producer string, part bigint, upto array<bigint>, land array<bigint>"


def first_begins(functions: DataFrame, fan: int = FAN) -> DataFrame:
    """(producer, part, entry) from (producer, part, upto, land): where the first batch of every range begins."""
    levels = [functions]
    while (levels[-1].agg(F.max("part")).first()[0] or 0) > 0:
        runs = levels[-1].withColumn("run", F.floor(F.col("part") / fan))
        levels.append(written(runs.groupBy("producer", "run").applyInPandas(lambda parts: _compose(parts, fan), _FUNCTION), "batch-functions"))
    entries = levels.pop().select("producer", "part", F.lit(0).cast("bigint").alias("entry"))
    for level in reversed(levels):
        known = entries.select(F.col("producer").alias("_producer"), F.col("part").alias("run"), "entry")
        runs = level.withColumn("run", F.floor(F.col("part") / fan)).join(known, ["run"]).where(F.col("producer").eqNullSafe(F.col("_producer")))
        entries = written(runs.groupBy("producer", "run").applyInPandas(_walk, "producer string, part bigint, entry bigint"), "batch-entries")
    return entries


def _listed(batches):
    """The begins of each range, from its first: (producer, part, begins, full)."""
    for frame in batches:
        found = []
        for begin, end, full, at in zip(frame["begin"], frame["end"], frame["full"], frame["entry"], strict=True):
            place, begins, was_full = dict(zip(begin, range(len(begin)), strict=True)), [], []
            while (k := place.get(at)) is not None:
                begins.append(at)
                was_full.append(bool(full[k]))
                at = end[k]
            found.append((begins, was_full))
        yield pd.DataFrame({"producer": frame["producer"], "part": frame["part"], "begins": [b for b, _ in found], "full": [f for _, f in found]})


def dynamic_batches(
    df: DataFrame, rows: int, values: int, sequence: str = "sequence", producer: str | None = None, shrink: bool = False, range_rows: int = RANGE_ROWS, fan: int = FAN,
) -> DataFrame:
    """df with ``batch_id``; without producers the sequence must be gapless from 1.

    Nulls of a dictionary column are one value; a null producer is a producer; an empty table stays empty.
    """
    if rows < 1 or values < 1:
        raise ValueError("a batch holds at least a row and a value")
    size = max(rows, range_rows)
    placed = written(positions(df, sequence, producer, "_place", range_rows), "batch-places") if producer else positions(df, sequence, None, "_place")
    named = F.col(producer).cast("string") if producer else F.lit(None).cast("string")
    part = F.floor(F.col("_place") / size).cast("bigint")
    hashes = [F.xxhash64(F.lit(k), F.col(kind).isNull(), kind).alias(f"{kind}{k}") for kind in KINDS for k in (0, 1)]
    # the rows that follow a range are dealt to it as well
    both = F.when((part > 0) & (F.col("_place") - part * size < rows), F.array(part, part - 1)).otherwise(F.array(part))
    dealt = placed.select(named.alias("producer"), F.explode(both).alias("part"), F.col("_place").alias("position"), *hashes)
    schema = "producer string, part bigint, begin array<bigint>, end array<bigint>, full array<boolean>, upto array<bigint>, land array<bigint>"
    scanned = written(dealt.groupBy("producer", "part").applyInArrow(_scan(rows, values, size), schema), "batch-scan")
    entries = first_begins(scanned.select("producer", "part", "upto", "land"), fan).select(F.col("producer").alias("_producer"), F.col("part").alias("_part"), "entry")
    same = (F.col("part") == F.col("_part")) & F.col("producer").eqNullSafe(F.col("_producer"))
    known = scanned.select("producer", "part", "begin", "end", "full").join(entries, same).drop("_producer", "_part")
    listed = written(known.mapInPandas(_listed, "producer string, part bigint, begins array<bigint>, full array<boolean>"), "batch-begins")
    before = Window.partitionBy("producer").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    based = listed.select(F.col("producer").alias("_producer"), F.col("part").alias("_part"), "begins", F.coalesce(F.sum(F.size("begins")).over(before), F.lit(0)).alias("_base"), "full")
    # rows before the first begin of a range belong to the last batch of the range before
    count = F.aggregate("begins", F.lit(0), lambda n, b: n + (b <= F.col("_place")).cast("int"))
    batch = F.col("_base") + count - 1
    if shrink:
        then = flush_rows(values)
        each = based.select(F.col("_producer").alias("_owner"), "_base", F.posexplode(F.arrays_zip("begins", "full")).alias("_k", "_b")).where("_b.full")
        first = each.groupBy("_owner").agg(F.min(F.struct(F.col("_b.begins").alias("begin"), (F.col("_base") + F.col("_k")).alias("id"))).alias("_full"))
        based = based.join(first, F.col("_producer").eqNullSafe(F.col("_owner")), "left").drop("_owner")
        # the cut after the first full batch is where the next batch begins
        later = F.explode_outer(F.filter(F.col("begins"), lambda b: b > F.col("_full.begin")))
        nexts = based.where("_full is not null").select(F.col("_producer").alias("_owner"), later.alias("_next")).groupBy("_owner").agg(F.min("_next").alias("_cut"))
        based = based.join(nexts, F.col("_producer").eqNullSafe(F.col("_owner")), "left").drop("_owner")
        batch = F.when(F.col("_place") >= F.col("_cut"), F.col("_full.id") + 1 + F.floor((F.col("_place") - F.col("_cut")) / then)).otherwise(batch)
    rows_of = placed.withColumn("_own", part).withColumn("_named", named)
    joined = rows_of.join(based.drop("full"), (F.col("_own") == F.col("_part")) & F.col("_named").eqNullSafe(F.col("_producer")))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != "batch_id"], batch.cast("bigint").alias("batch_id"))
