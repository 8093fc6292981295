"""All events of many block files in the order of their sequence, by merging blocks instead of sorting events.

The blocks' statistics say from which sequence to which each reaches.  Quantiles of their begins and ends cut the order into
ranges of about ``rows`` rows, a task each; a block is read in every range that it reaches into.  Only this list of blocks is
dealt and sorted.  A task goes through the blocks of its range by their begin: what lies before the begin of the next block
is final, is put in order and leaves, so it holds the blocks that overlap at one place, and no more than as much again.

A block that reaches into more than ``REACH`` ranges (of a writer that got its rows in no order) would be read again and again.
Such blocks are decoded once, their rows are dealt by range and sorted, and join the merge where they belong.  So what is read
grows with the blocks, not with blocks times ranges; where all blocks are like that, this is a sort of the events.

Rows of equal sequence keep the order of their blocks' begins, then of file and place.  Only listed files with statistics can
be merged; for others sort (``export.absolute_order``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..schema import DECODED_EVENT
from ..sources import block_stats, codec, manifest, scratch, shard
from .batching import range_of

#: Rows of a range by default; so many ranges are made of less rows than that where ``rows`` asks for them; the most ranges.
RANGE_ROWS, SMALL_RANGES, RANGES = 1_000_000, 400, 10_000
#: Ranges that a block may be read in; files of a task that reads statistics; rows that a merging task lets come together.
REACH, TASK_FILES, HELD_ROWS = 2, 32, 50_000

_WITH_BEGIN = StructType([*DECODED_EVENT.fields, StructField("low", LongType())])
_LISTED = "folder string, file string, block long, start long, rows long, low long, high long"


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            store, folder = manifest.store_of(r["folder"])
            with store.open_input_file(f"{folder}/{r['file']}{block_stats.SUFFIX}") as file:
                known = block_stats.read(file, ["block", "start", "rows", "min_sequence", "max_sequence"])
            own = [pa.array([r[c]] * known.num_rows, pa.string()) for c in ("folder", "file")]
            table = pa.table([*own, *known.columns], ["folder", "file", "block", "start", "rows", "low", "high"])
            yield from table.to_batches()


def block_list(spark: SparkSession, path: str) -> DataFrame:
    """(folder, file, block, start, rows, low, high) of every block, from the statistics beside the files."""
    files = shard.listed(spark, path).where("indexed").select("folder", "file")
    return files.repartition(-(-max(1, files.count()) // TASK_FILES), "file").mapInArrow(_statistics, _LISTED).where("rows > 0")


def _read(rows: list[dict]) -> Iterator[tuple[dict, pa.Table]]:
    """The decoded events of blocks, one after another, with their blocks' begins."""
    for r in rows:
        store, folder = manifest.store_of(r["folder"])
        with store.open_input_file(f"{folder}/{r['file']}") as file:
            stored, raw = codec.block_at(file, r["start"])
        (events,) = shard.decode_blocks(r["file"], iter([(r["block"], stored, raw)]))
        table = pa.Table.from_batches([events])
        yield r, table.append_column("low", pa.array(np.full(len(table), r["low"], np.int64)))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, events in _read(batch.to_pylist()):
            yield from events.to_batches()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = DECODED_EVENT.fieldNames()
    held: list[pa.Table] = []
    count, most = 0, HELD_ROWS

    def leave(upto: int | None) -> Iterator[pa.RecordBatch]:
        """What lies before ``upto``, in order; all with None."""
        nonlocal held, count, most
        if not count:
            return
        table = pa.concat_tables(held).combine_chunks()
        final = table if upto is None else table.filter(pc.less(table.column("sequence"), upto))
        held = [] if upto is None else [table.filter(pc.greater_equal(table.column("sequence"), upto))]
        count = sum(map(len, held))
        most = 2 * count + HELD_ROWS  # a row that stays is looked at a few times, however many overlap
        if len(final):
            order = pc.sort_indices(final, [(c, "ascending") for c in ("sequence", "low", "file", "block", "pos")])
            yield from final.select(names).take(order).combine_chunks().to_batches()

    for batch in batches:
        table, at = pa.Table.from_batches([batch]), batch.column("at").to_numpy()
        place = 0
        # blocks to read, and between them rows that were dealt
        for k in [*np.flatnonzero(batch.column("start").is_valid().to_numpy(zero_copy_only=False)).tolist(), len(table)]:
            if k > place:
                held.append(table.slice(place, k - place).select([*names, "low"]))
                count += k - place
                if count >= most:
                    yield from leave(int(at[k - 1]))
            if k < len(table):
                for r, events in _read(table.slice(k, 1).to_pylist()):
                    own = pc.and_(pc.greater_equal(events.column("sequence"), r["first"]), pc.less(events.column("sequence"), r["behind"]))
                    held.append(events.filter(own).select([*names, "low"]))
                    count += len(held[-1])
                if count >= most:
                    yield from leave(int(at[k]))
            place = k + 1
    yield from leave(None)


def _quantiles(values: DataFrame, k: int) -> list[int]:
    return [] if k < 2 else values.agg(F.percentile_approx("at", [i / k for i in range(1, k)], 10 * k + 100)).first()[0] or []


def _ends(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.explode(F.array("low", "high")).alias("at"))


def merged_order(spark: SparkSession, path: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Decoded events in the order of ``sequence``, over all partitions one after another."""
    blocks = scratch.written(block_list(spark, path), "block-list")
    total = blocks.agg(F.sum("rows")).first()[0] or 0
    share = lambda n: min(RANGES, n // max(1, rows), max(SMALL_RANGES, n // RANGE_ROWS))
    reach = lambda cuts: range_of(F.col("high"), cuts) - range_of(F.col("low"), cuts) + 1
    decoded = lambda listed, n: listed.repartition(max(1, n // 200_000), "file", "block").sortWithinPartitions("file", "block").mapInArrow(_decode, _WITH_BEGIN)
    cuts = sorted(set(_quantiles(_ends(blocks), share(total))))
    wide = blocks.where(reach(cuts) > REACH)
    n = wide.agg(F.sum("rows")).first()[0] or 0
    events = None
    if n:  # ranges of as many rows that are dealt, and of as many in blocks that are read
        blocks = blocks.where(reach(cuts) <= REACH)
        events = scratch.written(decoded(wide, n).where("sequence is not null"), "wide-blocks")
        cuts = sorted({*_quantiles(events.select(F.col("sequence").alias("at")), share(n)), *_quantiles(_ends(blocks), share(total - n))})
        again = blocks.where(reach(cuts) > REACH)  # for these ranges
        m = again.agg(F.sum("rows")).first()[0] or 0
        if m:
            blocks = blocks.where(reach(cuts) <= REACH)
            events = events.unionByName(decoded(again, m).where("sequence is not null"))
    # range r holds cuts[r - 1] < sequence <= cuts[r]
    edges = [-(1 << 63), *(c + 1 for c in cuts), (1 << 63) - 1]
    edge = F.split(F.lit(",".join(map(str, edges))), ",").cast("array<bigint>")
    dealt = blocks.withColumn("range", F.explode(F.sequence(range_of(F.col("low"), cuts), range_of(F.col("high"), cuts))))
    dealt = dealt.withColumn("first", F.get(edge, F.col("range"))).withColumn("behind", F.get(edge, F.col("range") + 1))
    dealt = dealt.withColumn("at", F.greatest("low", "first")).drop("rows", "high")
    if events is not None:
        events = events.withColumn("range", range_of(F.col("sequence"), cuts)).withColumn("at", F.col("sequence"))
        dealt = dealt.unionByName(events, allowMissingColumns=True)
    else:
        dealt = dealt.select("*", *_nothing(dealt.columns))
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("range").cast("int")).sortWithinPartitions("at", "low", "file", "block", "pos")
    return dealt.mapInArrow(_merge, DECODED_EVENT)


def _nothing(but: list[str]) -> list[Column]:
    """Columns of events, empty."""
    return [F.lit(None).cast(f.dataType).alias(f.name) for f in DECODED_EVENT.fields if f.name not in but]
