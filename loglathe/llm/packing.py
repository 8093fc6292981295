"""Best-fit packing of documents into sequences, planned on the histogram of their lengths.

Lengths never exceed the sequence, so their histogram has at most ``capacity`` entries whatever the
corpus.  The driver plans on it:

1. Lengths above ``capacity / LARGE`` are sorted and cut into groups of equal cardinality; each group is
   rounded up to its longest (linear grouping).
2. The few sizes are packed by a linear programme over configurations (column generation; pricing is
   an unbounded knapsack), rounded down.
3. The groups' actual documents take the places of the rounded ones, in configurations that do not leave too
   much room by that.
4. What is left, large remainders first, then the small lengths in descending order, goes where it fits
   best: to the open sequence with the least room that is enough.

The plan is a list of *placements*: of the documents of one length, ranks ``first ...`` lie ``q`` to a
sequence in ``bins`` consecutive sequences, at one offset.  Equal sequences stay one run, so the plan too
is bounded by the capacity.  Ranks within a length are taken in salted pieces, and each document finds its
placement by binary search.

Defined results: a null text is empty and one token (the end id) long; equal rows are packed each for
itself; null ids are kept; an empty table gives an empty result; columns besides the carried ones are
ignored, and carried ones of the names of results give way to these.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import BROADCAST_ROWS, Kept, bound_arrow, empty_text, packed, release, unpacked

CAPACITY = 4096
#: A length is large above capacity / LARGE; rows ranked together.
LARGE, RANKED = 8, 50_000
#: Numbers of groups, with the part of a sequence that a configuration may leave, tried in turn.  The plan of fewest
#: sequences is taken; one with the least that all tokens need ends the search.
ATTEMPTS = ((16, 1.0), (48, 1.0), (96, 1.0), (16, 1 / 64), (16, 1 / 128), (48, 1 / 128))
PIECES = StructType([StructField("piece", IntegerType()), *(StructField(c, LongType()) for c in ("start", "length", "ids_crc32"))])
PLACES = StructType([StructField("sequence_id", LongType()), StructField("offset", LongType())])


def tokenized_pieces(docs: DataFrame, carry: tuple[str, ...], tokenizer: str, spaces: bool, end_id: int, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """``row`` (a struct of the ``carry`` columns) and the pieces of each document: whole up to capacity, else cut every capacity ids."""
    bound_arrow(docs.sparkSession)
    rows = docs.select(packed(carry).alias("row"), empty_text(F.col(f"`{text}`")).alias("text"))
    schema = StructType([rows.schema["row"], *PIECES])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import batches as runs
        from .tokens import encoder

        enc = encoder(tokenizer, spaces)
        for batch in batches:
            texts = batch.column("text")
            for first, last in runs(texts):
                ids, lens = enc.encode(texts.slice(first, last - first))
                out: list[tuple[int, int, int, int, int]] = []
                at = 0
                for i, n in enumerate(lens.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for p, start in enumerate(range(0, n + 1, capacity)):
                        part = own[start : start + capacity]
                        out.append((first + i, p, start, len(part), zlib.crc32(part.tobytes())))
                row, *cols = (np.array(c) for c in zip(*out, strict=True))
                held = batch.column("row").take(pa.array(row))
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [held, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["row", "piece", "start", "length", "ids_crc32"],
                )
        release()

    return rows.mapInArrow(cut, schema)


class _Open:
    """Runs of equal open sequences by the room they have."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, seq: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in self.runs:
                insort(self.rooms, room)
                self.runs[room] = []
            self.runs[room].append((seq, n))

    def take(self, need: int, most: int) -> tuple[int, int, int] | None:
        """A run (room, first sequence, count) of up to ``most`` sequences with the least room that is enough."""
        at = bisect_left(self.rooms, need)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        seq, n = self.runs[room].pop()
        if n > most:
            self.runs[room].append((seq + most, n - most))
        elif not self.runs[room]:
            del self.runs[room], self.rooms[at]
        return room, seq, min(n, most)


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 300) -> list[tuple[list[int], float]]:
    """The basis of the configuration programme: (copies of each size, times used), by column generation."""
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    demand = np.array(counts, float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        times = inverse @ demand
        duals = inverse.sum(0)
        # unbounded knapsack by number of items: value[c] is the best of at most that many in room c
        value, picks = np.zeros(capacity + 1), []
        order = [g for g in range(k) if duals[g] > 1e-12]
        for _ in range(capacity // min(sizes)):
            best, pick = value.copy(), np.full(capacity + 1, -1)
            for g in order:
                s = sizes[g]
                other = value[: capacity + 1 - s] + duals[g]
                better = other > best[s:] + 1e-12
                best[s:][better] = other[better]
                pick[s:][better] = g
            picks.append(pick)
            if (pick < 0).all():
                break
            value = best
        if value[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for pick in reversed(picks):
            if (g := pick[room]) >= 0:
                column[g] += 1
                room -= sizes[g]
        step = inverse @ column
        ratio = np.where(step > 1e-9, times / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    times = np.linalg.inv(basis) @ demand
    return [(basis[:, j].astype(int).tolist(), max(0.0, float(times[j]))) for j in range(k)]


def _first(queue: list[list[int]], want: int) -> int:
    """The lengths of the first ``want`` documents of a group together."""
    total = 0
    for x, n in queue:
        total += x * min(n, want)
        want -= min(n, want)
        if not want:
            break
    return total


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = ATTEMPTS[0][0], loose: float = 1.0) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Placements (length, first rank, sequences, per sequence, first sequence, offset), and the number of sequences."""
    placed: list[tuple[int, int, int, int, int, int]] = []
    rank = dict.fromkeys(histogram, 0)
    open_ = _Open()
    n_seq = histogram.get(capacity, 0)
    if n_seq:
        placed.append((capacity, 0, n_seq, 1, 0, 0))
        rank[capacity] = n_seq

    large = [(x, histogram[x]) for x in sorted(histogram, reverse=True) if capacity / LARGE < x < capacity]
    total = sum(n for _, n in large)
    if groups and total:  # without groups: plain best fit, to compare with
        # group g: its part of each length, longest first
        parts: list[list[list[int]]] = [[]]
        each, held = -(-total // groups), 0
        for x, n in large:
            while n:
                if held == each:
                    parts.append([])
                    held = 0
                m = min(n, each - held)
                parts[-1].append([x, m])
                n, held = n - m, held + m
        sizes = [p[0][0] for p in parts]
        # groups of one size are one
        merged: dict[int, list[list[int]]] = {}
        for s, p in zip(sizes, parts, strict=True):
            merged.setdefault(s, []).extend(p)
        sizes = sorted(merged, reverse=True)
        for copies, times in configurations(sizes, [sum(n for _, n in merged[s]) for s in sizes], capacity):
            left = int(times + 1e-6)
            slots = [s for s, c in zip(sizes, copies, strict=True) for _ in range(c)]
            while left and slots:
                # as many sequences as the actual documents at the head of each group stay the same for
                heads, run = [], left
                for s in set(slots):
                    queue = merged[s]
                    run = min(run, queue[0][1] // slots.count(s)) if queue else 0
                if not run:  # a length ends within a sequence: fill one sequence by single documents
                    run, need = 1, {s: slots.count(s) for s in set(slots)}
                    if any(sum(n for _, n in merged[s]) < m for s, m in need.items()):
                        break
                if capacity - sum(_first(merged[s], slots.count(s) * run) for s in dict.fromkeys(slots)) / run > loose * capacity:
                    break
                offset = 0
                for s in dict.fromkeys(slots):
                    want = slots.count(s) * run
                    while want:
                        x, n = merged[s][0]
                        m = min(n, want)
                        heads.append((x, m // run if m % run == 0 else m))
                        placed.append((x, rank[x], run, m // run, n_seq, offset))
                        rank[x] += m
                        offset += x * (m // run)
                        want -= m
                        if m == n:
                            merged[s].pop(0)
                        else:
                            merged[s][0][1] -= m
                open_.add(capacity - offset, n_seq, run)
                n_seq, left = n_seq + run, left - run

    for x in sorted(histogram, reverse=True):
        left = histogram[x] - rank[x]
        while left:
            got = open_.take(x, left)
            if got is None:
                per = capacity // x
                bins = left // per or 1
                room, seq, n = capacity, n_seq, bins
                n_seq += bins
            else:
                room, seq, n = got
            per = min(room // x, left)
            bins = min(n, left // per)
            placed.append((x, rank[x], bins, per, seq, capacity - room))
            rank[x] += bins * per
            left -= bins * per
            open_.add(room - per * x, seq, bins)
            open_.add(room, seq + bins, n - bins)
    return placed, n_seq


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY, attempts: tuple[tuple[int, float], ...] = ATTEMPTS) -> list[tuple[int, int, int, int, int, int]]:
    least = -(-sum(x * n for x, n in histogram.items()) // capacity)
    best, fewest = [], None
    for groups, loose in attempts:
        placed, n = plan(histogram, capacity, groups, loose)
        if fewest is None or n < fewest:
            best, fewest = placed, n
        if fewest <= least:
            break
    return best


def pack(pieces: DataFrame, order: tuple[str, ...], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a materialised table with ``length``) with sequence_id and offset; ``order`` makes ranks repeatable."""
    spark = pieces.sparkSession
    counted = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most capacity rows
    histogram = {r["length"]: r["n"] for r in counted}
    placed = sorted(best_plan(histogram, capacity))
    table = np.array(placed, np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table)  # at most some placements a length

    salts = max(1, -(-sum(histogram.values()) // RANKED))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    running = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_base"))
    if salts * len(histogram) <= BROADCAST_ROWS:
        counts = F.broadcast(counts)
    own = Window.partitionBy("length", "_salt").orderBy(*order)
    ranked = salted.withColumn("_rank", F.row_number().over(own) - 1).join(counts, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_salt", "_base")
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        span = np.int64(1) << 44
        keys = rows[:, 0] * span + rows[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            at = rows[np.searchsorted(keys, length * span + rank, "right") - 1]
            i = rank - at[:, 1]
            # of the documents of a placement, the i-th lies in sequence i // per, at place i % per there
            seq, offset = at[:, 4] + i // at[:, 3], at[:, 5] + i % at[:, 3] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"]
            )

    return ranked.select(*names, "_rank").mapInArrow(place, StructType([*pieces.schema, *PLACES]))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, spaces: bool = False, carry: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY) -> DataFrame:
    """Tokenizes once (the pieces, a few bytes each, are written to the shared folder) and packs."""
    pieces = Kept(tokenized_pieces(docs, carry, tokenizer, spaces, end_id, capacity), "pieces").df
    return pack(pieces, ("row", "piece"), capacity).select(*unpacked(carry, (*PIECES.names, *PLACES.names)))
