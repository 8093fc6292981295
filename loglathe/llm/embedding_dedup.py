"""Near-duplicate embeddings by a subspace pigeonhole join of blocks, exact for a cosine threshold.

For unit vectors cosine >= t means a squared distance of at most 2 - 2t.  Vectors are rotated to the
principal directions of all vectors and cut into ``BLOCKS`` subspaces, which take the directions in turn.
Each subspace gets a share of the squared distance in proportion to its share of the variance.  Of two
vectors within the whole distance, at least one subspace is within its share (pigeonhole), so a range join
in every subspace finds all pairs:

* A k-d tree over principal directions, grown on a bounded sample, deals the vectors to leaves; this is the only
  shuffle of vectors.  It holds all copies of a vector, so equal vectors are one weighted vector from here on.
* A leaf is written as blocks of at most ``TILE`` rows with the range of each leading direction.  Pairs of
  blocks come from a cartesian product, which rereads the written blocks and copies no vector to disk, and
  which leaves out pairs whose ranges are too far apart.
* In a pair of blocks, subspaces whose ranges are too far apart are skipped; squared distances in the others
  choose candidates (matrix products, with slack for single precision), and cosines in double precision
  decide.  A pair that several subspaces find counts in the first.

Tasks give, for each vector, the number of its links and one edge to the first vector reachable among the
task's; no pairs leave a task.  So vectors are on disk twice (shuffle, blocks), whatever the number of pairs.
Rows find their vector again by a digest of 128 bits: N different vectors are expected to have N^2/2^129
pairs that share one.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; vectors of different lengths never link; equal rows are vectors of their own and link; rows that
link with nothing have their own vec_id as component; a null vec_id is kept, and never names a component
that has another; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Kept, bound_arrow
from .components import components

BLOCKS, TILE = 4, 4096
#: Rows that meet a block at a time; slack of single-precision distances; pairs that are gathered one by one.
STRIP, SLACK, PAIRS = 256, 1e-4, 20_000
#: Lengths up to which principal directions are computed; longer vectors keep their axes.
PRINCIPAL = 2048
#: Rows of a matrix that are summed together.
BAND = 64
#: Bytes of the tree's sample, of a block, and of blocks that a task of the product reads on either side; most tasks on a side, least.
SAMPLE_BYTES, BLOCK_BYTES, SIDE_BYTES, SIDES = 16 << 20, 1 << 20, 16 << 20, (12, 256)
#: Leading directions that a tree cuts and whose ranges a block has; levels of a tree; numbers of rows that a block may have.
LEADING, LEVELS, PLACES = 32, 12, 1 << 16
#: Components of blocks that a task keeps decoded.
DECODED = 2 << 20


def unit_rows(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


class Space:
    """Rotation, subspaces and budgets for vectors of one length."""

    def __init__(self, dim: int, moments: np.ndarray | None, threshold: float):
        if moments is None:
            variance, axes = np.ones(dim), np.eye(dim)
        else:
            variance, axes = np.linalg.eigh(moments)
            order = np.argsort(-variance)
            variance, axes = np.maximum(variance[order], 1e-12), axes[:, order]
        self.axes = axes
        self.parts = [np.arange(b, dim, BLOCKS) for b in range(min(BLOCKS, dim))]
        share = np.array([variance[p].sum() for p in self.parts])
        self.budget = (2 - 2 * threshold + 1e-9) * share / share.sum()

        self.axis, self.cut = np.zeros(0, np.int64), np.zeros(0)

    def grow(self, x: np.ndarray, leaves: int) -> None:
        """The k-d tree of a sample of unit vectors: each node is cut at the median of its widest direction."""
        z = self._whole(x)
        levels = min(LEVELS, max(0, int(np.log2(max(1, min(leaves, len(z)))))))
        self.axis, self.cut = np.zeros((1 << levels) - 1, np.int64), np.zeros((1 << levels) - 1)
        node = np.zeros(len(z), np.int64)
        for level in range(levels):
            for k in range((1 << level) - 1, (2 << level) - 1):
                own = np.flatnonzero(node == k)
                if len(own):
                    self.axis[k] = z[own].var(0).argmax()
                    self.cut[k] = np.median(z[own, self.axis[k]])
            node = self._below(z, node)

    def _whole(self, x: np.ndarray) -> np.ndarray:
        """Leading coordinates of rows as whole numbers: sums of these are exact, so copies get the same leaf in whatever batch."""
        return np.rint(x * (1 << 20)) @ np.rint(self.axes[:, :LEADING] * (1 << 20))

    def _below(self, z: np.ndarray, node: np.ndarray) -> np.ndarray:
        return 2 * node + 1 + (z[np.arange(len(z)), self.axis[node]] > self.cut[node])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        z, node = self._whole(x), np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(self.cut) + 1))):
            node = self._below(z, node)
        return node


def _labels(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels after i - j are linked: rows of one label keep one, the smaller of the two that meet."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        lower = np.arange(len(label))
        np.minimum.at(lower, np.maximum(a, b), np.minimum(a, b))
        while True:
            deeper = lower[lower]
            if (deeper == lower).all():
                break
            lower = deeper
        label = lower[label]


class Block:
    """A block's unit vectors, rotated, with what its matrix products need."""

    def __init__(self, raw: pa.Buffer, kind: str, space: Space):
        self.x = unit_rows(np.frombuffer(raw, kind).reshape(-1, len(space.axes)))
        self.z = self.x @ space.axes
        self.lo, self.hi = self.z.min(0), self.z.max(0)
        self.squares = [(self.z[:, p] * self.z[:, p]).sum(1) for p in space.parts]
        ones = np.ones((len(self.x), 1))
        # the product of these is the squared distance less the budget: one matrix product finds candidates
        self.left = [np.hstack([-2 * self.z[:, p], s[:, None] - t, ones]).astype(np.float32) for p, s, t in zip(space.parts, self.squares, space.budget, strict=True)]
        self.right = [np.ascontiguousarray(np.hstack([self.z[:, p], ones, s[:, None]]).astype(np.float32).T) for p, s in zip(space.parts, self.squares, strict=True)]


def block_links(a: Block, b: Block, space: Space, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i of a and j of b that link, each pair once; of a block with itself the pairs with i < j."""
    gap = np.maximum(np.maximum(a.lo - b.hi, b.lo - a.hi), 0) ** 2
    for s, part in enumerate(space.parts):
        if gap[part].sum() > space.budget[s] + SLACK:
            continue
        for at in range(0, len(a.x), STRIP):
            end = min(len(a.x), at + STRIP)
            skip = at if a is b else 0
            flat = np.flatnonzero(a.left[s][at:end] @ b.right[s][:, skip:] <= SLACK)
            if not len(flat):
                continue
            i, j = np.divmod(flat, len(b.x) - skip)
            i, j = i + at, j + skip
            if a is b:
                i, j = i[i < j], j[i < j]
            if len(i) > PAIRS:  # dense: products of whole strips are cheaper than gathering pairs
                good = (a.x[at:end] @ b.x.T)[i - at, j] >= threshold
                i, j = i[good], j[good]
                first = np.ones(len(i), bool)
                for c in range(s + 1):
                    p = space.parts[c]
                    d = a.squares[c][i] + b.squares[c][j] - 2 * (a.z[at:end, p] @ b.z[:, p].T)[i - at, j]
                    first &= (d > space.budget[c]) if c < s else (d <= space.budget[c])
            else:
                good = (a.x[i] * b.x[j]).sum(1) >= threshold
                i, j = i[good], j[good]
                diff = (a.z[i] - b.z[j]) ** 2
                first = diff[:, part].sum(1) <= space.budget[s]
                for c in range(s):
                    first &= diff[:, space.parts[c]].sum(1) > space.budget[c]
            if first.any():
                yield i[first], j[first]


def _near(budget: float) -> Column:
    """Whether the ranges of two blocks are within the whole distance, and which of the two orders is taken."""
    gap = F.zip_with(
        F.zip_with("lo", "hi_2", lambda a, b: a - b), F.zip_with("lo_2", "hi", lambda a, b: a - b),
        lambda a, b: F.pow(F.greatest(a, b, F.lit(0.0)), F.lit(2.0)),
    )
    one = (F.col("bid") == F.col("bid_2")) | ((F.col("bid") < F.col("bid_2")) == ((F.col("bid") + F.col("bid_2")) % 2 == 0)) & (F.col("bid") != F.col("bid_2"))
    return (F.col("dim") - F.col("dim_2") == 0) & one & (F.aggregate(gap, F.lit(0.0), lambda s, g: s + g) <= budget + SLACK)


def _raw(lists: pa.Array, kind: str) -> list[bytes | None]:
    """The bytes of each vector; equal vectors have equal bytes."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)  # minus zero is zero
    data, size = flat.tobytes(), np.dtype(kind).itemsize
    out, at = [], 0
    for n in lists.value_lengths().to_pylist():
        out.append(None if n is None else data[at : at + n * size])
        at += (n or 0) * size
    return out


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _of_lengths(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, unit vectors) of a batch with raw."""
    dims = pa.compute.binary_length(batch.column("raw")).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize
    for d in np.unique(dims).tolist():
        own = np.flatnonzero(dims == d)
        yield d, own, unit_rows(_matrix(batch.column("raw").take(pa.array(own)), d, kind))


def usable_rows(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """All rows with ``v``, null where unusable."""
    v = F.col(f"`{vector}`").cast("array<double>")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    kind = [f for f in df.schema.fields if f.name == vector][0].dataType.simpleString()
    kept = F.col(f"`{vector}`") if kind == "array<float>" else v
    return df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.when(usable, kept).alias("v"))


def fit_spaces(vectors: DataFrame, kind: str, threshold: float) -> tuple[dict[int, Space], float]:
    """The space of each length, and the bytes of all vectors; raw of all vectors is read once, and once for the sample."""

    # second moments of the unit vectors, summed in each task, then over tasks: a bounded table a length
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        rows: dict[int, int] = {}
        for batch in batches:
            for d, own, x in _of_lengths(batch, kind):
                rows[d] = rows.get(d, 0) + len(own)
                if d <= PRINCIPAL:
                    sums[d] = sums.get(d, 0) + x.T @ x
        for d, n in rows.items():  # band -1 is the number of rows
            parts = [np.array([n], np.float64).tobytes()] + [sums[d][k : k + BAND].tobytes() for k in range(0, d if d in sums else 0, BAND)]
            yield pa.RecordBatch.from_pydict({"dim": pa.array([d] * len(parts), pa.int32()), "band": pa.array(range(-1, len(parts) - 1), pa.int32()), "s": pa.array(parts, pa.binary())})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(s) for s in pdf["s"])
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "band": pdf["band"].iloc[:1], "s": [total.tobytes()]})

    shape = "dim int, band int, s binary"
    parts = vectors.select("raw").mapInArrow(moments, shape).withColumn("salt", F.pmod(F.xxhash64("s"), F.lit(16)))
    summed = parts.groupBy("dim", "band", "salt").applyInPandas(merge, shape).groupBy("dim", "band").applyInPandas(merge, shape)
    got: dict[int, np.ndarray] = {}
    rows: dict[int, int] = {}
    for r in summed.collect():  # a matrix a length
        d, band = r["dim"], r["band"]
        if band < 0:
            rows[d] = int(np.frombuffer(r["s"])[0])
        else:
            got.setdefault(d, np.zeros((d, d)))[band * BAND : (band + 1) * BAND] = np.frombuffer(r["s"]).reshape(-1, d)
    spaces = {d: Space(d, got.get(d), threshold) for d in rows}
    size = np.dtype(kind).itemsize * sum(d * n for d, n in rows.items())
    if spaces:
        most = min(BROADCAST_ROWS, max(1, SAMPLE_BYTES * sum(rows.values()) // size))
        some = vectors.select("raw").where(F.rand(17) < min(1.0, most / sum(rows.values()))).limit(2 * most).collect()
        of: dict[int, set[bytes]] = {}
        for r in some:
            of.setdefault(len(r["raw"]) // np.dtype(kind).itemsize, set()).add(bytes(r["raw"]))
        for d, raws in of.items():
            spaces[d].grow(unit_rows(np.frombuffer(b"".join(sorted(raws)), kind).reshape(-1, d)), rows[d] // _block_rows(d, kind) * 4)
    return spaces, size


def _block_rows(dim: int, kind: str) -> int:
    return max(1, min(TILE, PLACES, BLOCK_BYTES // (dim * np.dtype(kind).itemsize)))


def write_blocks(vectors: DataFrame, spaces, kind: str, sides: int) -> Kept:
    """One row a block: distinct vectors of one leaf with their first ids, numbers of rows and digests."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # copies within a batch are one row from here on, so a vector of many copies doesn't fill its leaf
            one = pa.Table.from_batches([batch]).group_by("raw").aggregate([("vec_id", "min"), ("vec_id", "count", pa.compute.CountOptions(mode="all"))]).combine_chunks()
            for part in one.to_batches():
                for d, own, x in _of_lengths(part, kind):
                    take = part.take(pa.array(own))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), d), pa.int32()), pa.array(spaces.value[d].leaf(x), pa.int32()), take.column("raw"), take.column("vec_id_min"), take.column("vec_id_count").cast("int64")],
                        names=["dim", "leaf", "raw", "rep", "weight"],
                    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bid, now, held = TaskContext.get().partitionId() << 24, None, []

        def block() -> pa.RecordBatch:
            nonlocal bid
            d, raws = now[0], [r for r, _, _ in held]
            z = unit_rows(np.frombuffer(b"".join(raws), kind).reshape(-1, d)) @ spaces.value[d].axes[:, :LEADING]
            row = {
                "bid": pa.array([bid], pa.int64()), "dim": pa.array([d], pa.int32()), "raw": pa.array([b"".join(raws)], pa.binary()),
                "lo": pa.array([z.min(0).tolist()], pa.list_(pa.float64())), "hi": pa.array([z.max(0).tolist()], pa.list_(pa.float64())),
                "weight": pa.array([np.array([w for _, _, w in held], np.int64).tobytes()], pa.binary()),
                "rep": pa.array([[i for _, i, _ in held]], pa.list_(pa.int64())), "digest": pa.array([b"".join(map(_digest, raws))], pa.binary()),
            }
            bid += 1
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for d, leaf, raw, rep, weight in zip(*(batch.column(c).to_pylist() for c in ("dim", "leaf", "raw", "rep", "weight")), strict=True):
                if held and (now != (d, leaf) or len(held) == _block_rows(d, kind)):
                    yield block()
                    held = []
                now = (d, leaf)
                held.append((raw, rep, weight))
        if held:
            yield block()

    dealt = vectors.mapInArrow(deal, "dim int, leaf int, raw binary, rep long, weight long").repartition(sides, "dim", "leaf")
    one = dealt.groupBy("dim", "leaf", "raw").agg(F.min("rep").alias("rep"), F.sum("weight").alias("weight"))
    shape = "bid long, dim int, raw binary, lo array<double>, hi array<double>, weight binary, rep array<long>, digest binary"
    return Kept(one.sortWithinPartitions("dim", "leaf").mapInArrow(pack, shape), "blocks")


def link_blocks(blocks: DataFrame, spaces, kind: str, threshold: float, sides: int) -> DataFrame:
    """(did, links, root) of linked vectors, a row a task that finds links of it."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded: dict[int, Block] = {}
        starts: dict[int, int] = {}
        did, links, label = (np.zeros(0, np.int64) for _ in range(3))

        def block(bid: int, raw: pa.Buffer, space: Space) -> Block:
            if bid not in decoded:
                while decoded and sum(b.x.size for b in decoded.values()) > DECODED:
                    decoded.pop(next(iter(decoded)))
                decoded[bid] = Block(raw, kind, space)
            return decoded[bid]

        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column("bid")[k].as_py(), batch.column("bid_2")[k].as_py()
                space = spaces.value[batch.column("dim")[k].as_py()]
                weights = [np.frombuffer(batch.column(c)[k].as_buffer(), np.int64) for c in ("weight", "weight_2")]
                a = block(ids[0], batch.column("raw")[k].as_buffer(), space)
                b = a if ids[0] == ids[1] else block(ids[1], batch.column("raw_2")[k].as_buffer(), space)
                for i, j in block_links(a, b, space, threshold):
                    for bid, w in zip(ids, weights, strict=True):
                        if bid not in starts:
                            starts[bid] = len(did)
                            did = np.r_[did, bid * PLACES + np.arange(len(w))]
                            links, label = np.r_[links, np.zeros(len(w), np.int64)], np.r_[label, starts[bid] + np.arange(len(w))]
                    np.add.at(links, starts[ids[0]] + i, weights[1][j])
                    np.add.at(links, starts[ids[1]] + j, weights[0][i])
                    label = _labels(starts[ids[0]] + i, starts[ids[1]] + j, label)
        some = np.flatnonzero(links)
        for at in range(0, len(some), 50_000):
            own = some[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"did": did[own], "links": links[own], "root": did[label[own]]})

    left = blocks.select("bid", "dim", "raw", "weight", "lo", "hi").coalesce(sides)
    right = blocks.select(*[F.col(c).alias(f"{c}_2") for c in ("bid", "dim", "raw", "weight", "lo", "hi")]).coalesce(sides)
    pairs = left.join(right.hint("shuffle_replicate_nl"), _near(2 - 2 * threshold))
    return pairs.select("bid", "bid_2", "dim", "raw", "raw_2", "weight", "weight_2").mapInArrow(link, "did long, links long, root long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = df.sparkSession
    bound_arrow(spark)
    rows = usable_rows(df, id_col, vector)
    kind = "<f4" if dict(rows.dtypes)["v"] == "array<float>" else "<f8"

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(_raw(batch.column("v"), kind), pa.binary())], names=["vec_id", "raw"])

    def to_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [None if r is None else _digest(r) for r in _raw(batch.column("v"), kind)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(digests, pa.binary())], names=["vec_id", "digest"])

    def to_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bid, reps, weights, digests in zip(*(batch.column(c).to_pylist() for c in ("bid", "rep", "weight", "digest")), strict=True):
                own = [digests[k : k + 16] for k in range(0, len(digests), 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bid * PLACES + np.arange(len(reps))), pa.array(reps, pa.int64()), pa.array(np.frombuffer(weights, np.int64)), pa.array(own, pa.binary())],
                    names=["did", "rep", "weight", "digest"],
                )

    vectors = rows.where("v is not null").mapInArrow(to_bytes, "vec_id long, raw binary")
    fitted, size = fit_spaces(vectors, kind, threshold)
    spaces = spark.sparkContext.broadcast(fitted)
    sides = int(min(SIDES[1], max(SIDES[0], -(-size // SIDE_BYTES))))
    blocks = write_blocks(vectors, spaces, kind, sides).df
    table = blocks.select("bid", "rep", "weight", "digest").mapInArrow(to_vectors, "did long, rep long, weight long, digest binary")
    linked = Kept(link_blocks(blocks, spaces, kind, threshold, sides), "links").df
    counts = linked.groupBy("did").agg(F.sum("links").alias("links"))
    named = components(linked.select(F.col("did").alias("a"), F.col("root").alias("b")).distinct())
    member = named.withColumnRenamed("id", "did").join(table.select("did", "rep"), "did")
    first = member.groupBy("component_id").agg(F.min("rep").alias("first"))
    of = member.join(first, "component_id").select("did", "first")
    known = (
        table.join(counts, "did", "left").join(of, "did", "left")
        .select("digest", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("first", "rep").alias("component_id"))
    )
    return rows.mapInArrow(to_digests, "vec_id long, digest binary").join(known, "digest", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.col("component_id").isNull()).alias("kept"),
    )
