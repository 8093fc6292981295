"""N-gram Jaccard join with adaptive multi-match prefixes, exact for a threshold in per cent.

A document's set is its distinct five-word shingles.  All shingles have one global order, by estimated
frequency (a counting sketch of fixed size over all documents), then by hash.  With t = ceil(0.8 n), two
sets of Jaccard similarity 0.8 or more share at least t of the n shingles of either, so for any l their
*l-prefixes*, the first n - t + l shingles, share at least l.  Each document chooses its l by estimated cost:
a longer prefix brings more postings, but of the candidates that its frequent shingles bring only those
count that share l.  A pair needs the smaller l of the two.

Only components are wanted, so candidates are verified in two rounds.  First each prefix shingle offers
its documents two of them, the likeliest centre and the smallest, and each document is compared with those
offered most often, its *references*.  Then, of the shingles whose documents are not yet in one component,
pairs across components that pass the filters (size, shared prefix shingles, and what can be shared behind the
last of them).  Two documents with one reference c, which share x and y shingles with it, share at most
min(x, y) inside c; if that is too little, they must share some outside c, so they meet by prefixes of what
they have outside c instead, and no more by the shingles that all of the group have.  A shingle's most frequent
component, or the documents of its most frequent reference that can only meet outside it, are never
paired among themselves, so a large group of near copies costs no more than its size.

Equal sets are one throughout; a set is named by 64 bits (of N different sets, N*N / 2**65 pairs are expected
to share a name).  Sets are hashed again from the texts where they are needed, only prefixes and the sets
of candidates are shuffled.

Defined results: a null text or one without words has the empty set and links with nothing; equal rows
link; a null doc_id names no component that has another; a component without any id has a null one; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Kept, bound_arrow, packed, passing, release, unpacked
from .components import components

#: The sketch has about a counter (one byte: a level) for every BYTES_EACH bytes of text, so that it tells
#: as much at any size, but 2 ** 25 at most; counters to a chunk of it.
BYTES_EACH, LEAST_BITS, MOST_BITS, CHUNK = 12, 16, 25, 1 << 16


#: What a counter's byte says: counts up to 64, then steps of 8 %.
LEVELS = np.concatenate([np.arange(64), np.round(64 * 1.08 ** np.arange(192))]).astype(np.int64)


def sketch_bits(docs: DataFrame, text: str) -> int:
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("bigint"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, round(np.log2(max(1, total / BYTES_EACH)))))

#: Shingles gathered before they are counted; bounds of l, as a number and as a part of n.
GATHER, LONGEST, SHARE = 3_000_000, 8, 32
#: Other documents that a shingle has unseen by the sketch, and what verifying costs, in postings a shingle.
UNSEEN, VERIFY = 0.05, 0.5
SIMILAR = 80
#: Documents compared with one other in one group of rows; those of a shingle that are looked through in one.
TOGETHER, HOT = 512, 1000


def _level(counts: np.ndarray) -> np.ndarray:
    return (np.searchsorted(LEVELS, counts, "right") - 1).astype(np.uint8)


def _count(parts: list[np.ndarray], bits: int) -> Iterator[tuple[int, bytes]]:
    import zstandard

    slots = np.concatenate(parts)
    slots.sort()
    first = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
    counts = _level(np.diff(np.r_[first, len(slots)]))
    slots = slots[first]
    ends = np.searchsorted(slots, np.arange(0, (1 << bits) + 1, CHUNK))
    for k, (at, end) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        if at < end:
            part = np.zeros(CHUNK, np.uint8)
            part[slots[at:end] - k * CHUNK] = counts[at:end]
            yield k, zstandard.compress(part.tobytes(), 1)


def _slot(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (shingles >> np.uint64(64 - bits)).astype(np.int32)


def describe(docs: DataFrame, id_col: str, text: str, bits: int) -> Kept:
    """One pass: a row a document (doc_id, tid: hash of its text, sid, n), and rows of counts (chunk, counts)."""
    from .shingles import set_id, sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        seen: set[int] = set()
        held = 0

        def counted() -> Iterator[pa.RecordBatch]:
            out = list(_count(parts, bits))
            n = len(out)
            none = pa.nulls(n, pa.int64())
            if n:
                yield pa.RecordBatch.from_arrays(
                    [none, none, none, none, pa.array([k for k, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())],
                    names=["doc_id", "tid", "sid", "n", "chunk", "counts"],
                )

        for batch in batches:
            sids, sizes = [], []
            for s in sets(batch.column("text")):
                sid = set_id(s) if len(s) else None
                sids.append(sid)
                sizes.append(len(s))
                if sid is not None and sid not in seen:  # equal sets count once a task
                    seen.add(sid)
                    parts.append(_slot(s, bits))
                    held += len(s)
            n = len(sids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tid"), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=["doc_id", "tid", "sid", "n", "chunk", "counts"],
            )
            if held >= GATHER:
                yield from counted()
                parts, held = [], 0
        if parts:
            yield from counted()
        parts.clear()
        release()

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("tid"), F.col(f"`{text}`").alias("text"))
    return Kept(rows.mapInArrow(run, "doc_id long, tid long, sid long, n long, chunk int, counts binary"), "sets")


def sketch(described: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """The counters (levels) of all documents, a table of fixed size, merged in two steps; and the sum of all counts."""
    import zstandard

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.int64)
        for blob in pdf["counts"]:
            total += LEVELS[np.frombuffer(zstandard.decompress(blob, CHUNK), np.uint8)]
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1].astype("int32"), "counts": [zstandard.compress(_level(total).tobytes(), 1)]})

    shape = "chunk int, counts binary"
    parts = described.where("chunk is not null").select("chunk", "counts").withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(16)))
    some = parts.groupBy("chunk", "salt").applyInPandas(merge, shape)
    out, total = np.zeros(1 << bits, np.uint8), 0
    for r in some.groupBy("chunk").applyInPandas(merge, shape).collect():
        part = np.frombuffer(zstandard.decompress(r["counts"], CHUNK), np.uint8)
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = part
        total += int(LEVELS[part].sum())
    return out, total


def prefix(counts: np.ndarray, usual: float, similar: int = SIMILAR) -> tuple[np.ndarray, int]:
    """Which shingles of a sorted set make its prefix, and its l.

    ``counts``: the sketch's estimate for each shingle; ``usual``: what a shingle of one document may show.
    """
    n = len(counts)
    t = -(-similar * n // 100)
    order = np.argsort(counts, kind="stable")
    most = min(max(LONGEST, n // SHARE), t, n)
    others = np.cumsum(np.maximum(counts[order[: n - t + most]].astype(np.float64) - usual, UNSEEN))
    choices = np.arange(1, most + 1)
    # at most others / l documents can share l of these shingles
    cost = (n - t + choices) + VERIFY * n * others[n - t + choices - 1] / choices
    ell = int(choices[int(np.argmin(cost))])
    return order[: n - t + ell], ell


def postings(docs: DataFrame, text: str, shared: Broadcast, total: int) -> DataFrame:
    """(token, sid, n, l, pos: place in the global order, parts, part) of the prefixes; equal sets once a task.

    A shingle that the sketch shows in HOT documents or more has several parts, to which its documents are dealt.
    """
    from .shingles import set_id, sets

    bits = len(shared.value).bit_length() - 1
    load = total / len(shared.value)
    usual = load + 4 * load**0.5 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            tokens, sids, sizes, ells, places, lens, parts = [], [], [], [], [], [], []
            for s in sets(batch.column("text")):
                if len(s) and (sid := set_id(s)) not in seen:
                    seen.add(sid)
                    c = LEVELS[shared.value[_slot(s, bits)]]
                    order, ell = prefix(c, usual)
                    tokens.append(s[order].view(np.int64)), places.append(np.arange(len(order), dtype=np.int32))
                    sids.append(sid), sizes.append(len(s)), ells.append(ell), lens.append(len(order))
                    parts.append(np.maximum(c[order] - int(usual), 0) // HOT + 1)
            if tokens:
                col = lambda v, t: pa.array(np.repeat(np.array(v, t), lens))  # noqa: B023, E731
                own, many = np.repeat(np.array(sids, np.int64), lens), np.concatenate(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tokens)), pa.array(own), col(sizes, np.int32), col(ells, np.int32), pa.array(np.concatenate(places)),
                        pa.array(many.astype(np.int32)), pa.array(((own & 0xFFFFFF) % many).astype(np.int32)),
                    ],
                    names=["token", "sid", "n", "l", "pos", "parts", "part"],
                )
        release()

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "token long, sid long, n int, l int, pos int, parts int, part int")


def offered(found: DataFrame) -> Kept:
    """The postings of shingles of more than one set, with the least set (lo) and the likeliest centre of each shingle:
    the document with the fewest rarer shingles before this one."""
    of_part = Window.partitionBy("token", "part")
    near = found.withColumn("lo", F.min("sid").over(of_part)).withColumn("hi", F.max("sid").over(of_part))
    near = near.withColumn("first", F.min(F.struct("pos", "sid")).over(of_part)).where("lo <> hi or parts > 1")
    near = Kept(near, "parts")
    hot = near.df.where("parts > 1").groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first")).where("lo <> hi")
    columns = ("token", "sid", "n", "l", "pos", "lo", F.col("first.sid").alias("centre"))
    rest = near.df.where("parts > 1").drop("lo", "hi", "first").join(hot, "token").select(*columns)
    out = Kept(near.df.where("parts = 1").select(*columns).unionByName(rest), "postings")
    near.drop()
    return out


def compared(docs: DataFrame, text: str, described: DataFrame, pairs: Kept, counters: Broadcast | None = None) -> Kept:
    """The pairs (a, b) of set names with the sets' sizes and how many shingles they share: a, b, n_a, n_b, common, rest.

    ``rest``, if counters are given: the shingles of a outside b in the global order, where both share two thirds of the
    larger; else null.
    """
    from .shingles import set_id, sets

    wanted = pairs.df.select(F.col("a").alias("sid")).unionByName(pairs.df.select(F.col("b").alias("sid"))).distinct()
    n = pairs.df.count()
    texts = Kept(described.where("sid is not null").join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min("tid").alias("tid")).select("tid").distinct(), "texts", 2 * n)
    some = F.broadcast(texts.df) if texts.df.count() <= BROADCAST_ROWS else texts.df
    chosen = docs.select(F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("tid")).join(some, "tid", "left_semi")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sids, raws = [], []
            for s in sets(batch.column("text")):
                if len(s) and (sid := set_id(s)) not in seen:
                    seen.add(sid)
                    sids.append(sid), raws.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(raws, pa.binary())], names=["sid", "raw"])
        release()

    whole = Kept(chosen.select("text").mapInArrow(hashed, "sid long, raw binary"), "candidates")
    unique = whole.df.groupBy("sid").agg(F.any_value("raw").alias("raw"))
    # the documents to be compared with one b, TOGETHER at a time: b's own set comes first, once for all of them
    many = pairs.df.groupBy("b").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    dealt = Kept(pairs.df.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part")), "dealt", n)
    members = dealt.df.join(unique.withColumnRenamed("sid", "a"), "a").select("b", "part", "a", "raw")
    centres = dealt.df.select("b", "part").distinct().join(unique.withColumnRenamed("sid", "b"), "b").select("b", "part", F.lit(None).cast("bigint").alias("a"), "raw")
    rows = members.unionByName(centres).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, y = None, np.empty(0, np.uint64)
        bits = len(counters.value).bit_length() - 1 if counters else 0
        for batch in batches:
            out: list[tuple] = []
            for b, part, a, raw in zip(*(batch.column(c).to_pylist() for c in ("b", "part", "a")), batch.column("raw"), strict=True):
                x = np.frombuffer(raw.as_buffer(), np.uint64)
                if a is None:
                    centre, y = (b, part), x.copy()
                    continue
                if centre != (b, part):
                    raise ValueError("a document without the one to compare it with")
                if len(x) <= len(y):
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    shared = y[at] == x
                    common = int(shared.sum())
                    left = x[~shared] if 3 * common >= 2 * len(y) else None
                else:
                    at = np.searchsorted(x, y)
                    at[at == len(x)] = 0
                    shared = x[at] == y
                    common, left = int(shared.sum()), None
                    if 3 * common >= 2 * len(x):
                        alone = np.ones(len(x), bool)
                        alone[at[shared]] = False
                        left = x[alone]
                if left is not None and counters:
                    left = left[np.argsort(counters.value[_slot(left, bits)], kind="stable")].view(np.int64)
                out.append((a, b, len(x), len(y), common, left if counters else None))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.list_(pa.int64()))], names=["a", "b", "n_a", "n_b", "common", "rest"]
            )

    done = Kept(rows.mapInArrow(compare, "a long, b long, n_a long, n_b long, common long, rest array<long>"), "compared")
    for used in (whole, texts, dealt):
        used.drop()
    return done


def links_of(pairs: DataFrame) -> DataFrame:
    return pairs.where(f"100 * common >= {SIMILAR} * (n_a + n_b - common)").select("a", "b")


#: How many shingles sets of n_a and n_b share at least if they link.
NEED = f"(({SIMILAR} * (n_a + n_b) + {100 + SIMILAR - 1}) div {100 + SIMILAR})"


def _side(rows: DataFrame, k: str, key: tuple[str, ...]) -> DataFrame:
    return rows.select(*key, *[F.col(c).alias(k if c == "sid" else f"{c}_{k}") for c in rows.columns if c not in key])


def _by_pair(near: DataFrame, pos: str, size: str, *more: Column) -> DataFrame:
    """(a, b, shared: rows of the pair, p1, p2: greatest places, n1, n2: sizes) with a < b, and ``more``."""
    swap = F.col("a") > F.col("b")
    first, second = (lambda c: F.when(swap, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a"))), (lambda c: F.when(swap, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")))
    return near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.count("*").alias("shared"), F.max(first(pos)).alias("p1"), F.max(second(pos)).alias("p2"), F.min(first(size)).alias("n1"), F.min(second(size)).alias("n2"), *more
    )


def outside_pairs(refs: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs across components with one reference that can link only by what they share outside it.

    refs: (sid, c: its reference, n, o: shingles shared with c, rest: those outside c); named: (sid, root).
    """
    rows = refs.join(named, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    mixed = rows.groupBy("c").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("c")
    # a partner has four fifths of the size at least, so fewer shingles outside c than this do not do
    least = f"greatest(1, ({SIMILAR} * n + 99) div 100 - o)"
    tokens = rows.join(mixed, "c").select("c", "sid", "root", "n", "o", F.size("rest").cast("bigint").alias("e"), F.posexplode("rest").alias("pos", "token"))
    tokens = Kept(tokens.where(f"pos <= e - {least}"), "outside")
    per = tokens.df.groupBy("c", "token", "root").agg(F.count("*").alias("m"))
    main = per.groupBy("c", "token").agg(F.count("*").alias("roots"), F.max(F.struct("m", "root")).alias("top")).where("roots > 1")
    split = Kept(tokens.df.join(main.select("c", "token", F.col("top.root").alias("main")), ["c", "token"]), "outside")
    key = ("c", "token")
    k = f"({NEED} - least(o_a, o_b))"
    near = _side(split.df.where("root <> main"), "a", key).join(_side(split.df, "b", key), list(key)).where(
        (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("main_b")) | (F.col("a") < F.col("b")))
        & F.expr(f"100 * least(n_a, n_b) >= {SIMILAR} * greatest(n_a, n_b) and {k} >= 1 and pos_a <= e_a - {k} and pos_b <= e_b - {k}")
    )
    pair = _by_pair(near.withColumn("k", F.expr(k)), "pos", "e", F.min("k").alias("k"))
    out = Kept(pair.where("shared + least(n1 - p1, n2 - p2) - 1 >= k").select("a", "b"), "outside-pairs").df
    split.drop()
    tokens.drop()
    return out


def cross_pairs(found: DataFrame, named: DataFrame, refs: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Pairs across components that can still link: near in size, sharing as many prefix shingles as they need,
    with enough shingles left behind the last shared one; without those that ``outside_pairs`` finds.

    found: (token, sid, n, l, pos), at most ``most`` rows, if given; named: (sid, root); refs: (sid, c, n, o), at most two
    rows a document.
    """
    spark = found.sparkSession
    if refs is None:
        refs = spark.createDataFrame([], "sid long, c long, n long, o long")
    # the bounds multiply sizes by up to 18000, which an int holds only up to 119,304 shingles
    found = found.select("token", "sid", *[F.col(c).cast("bigint").alias(c) for c in ("n", "l", "pos")])
    # no shingle before a document's first shared one is in any other, so n - first are left to share: that bounds the
    # sizes of both together, and rules a document out that nothing could be near
    first = found.groupBy("sid").agg(F.min("pos").alias("first"))
    # "apart" are documents too large to link with any other of their reference but by what they share outside it
    smallest = refs.groupBy("c").agg(F.min("n").alias("n_b"))
    ends = refs.groupBy("sid", "n").agg(F.max(F.struct("o", "c")).alias("one"), F.min(F.struct("o", "c")).alias("two"))
    ends = ends.join(smallest.withColumnRenamed("c", "c1"), F.col("one.c") == F.col("c1")).select(
        "sid", "c1", F.col("one.o").alias("o1"), F.col("two.c").alias("c2"), F.col("two.o").alias("o2"), F.expr(f"{NEED.replace('n_a', 'n')} > one.o").alias("apart")
    )
    of_set = first.join(named, "sid", "left").join(ends, "sid", "left").withColumn("root", F.coalesce("root", "sid")).withColumn("apart", F.coalesce("apart", F.lit(False)))
    rows = found.join(of_set, "sid").withColumn("cap", F.expr(f"{100 + SIMILAR} * (n - first)"))
    rows = Kept(rows.where(F.expr(f"100 * cap >= {SIMILAR * (100 + SIMILAR)} * n")).drop("first"), "rows", most)
    per = rows.df.groupBy("token", "root").agg(F.count("*").alias("m"))
    main = per.groupBy("token").agg(F.count("*").alias("roots"), F.max(F.struct("m", "root")).alias("top")).where("roots > 1")
    other = rows.df.where("apart").groupBy("token", "c1").agg(F.count("*").alias("m")).groupBy("token").agg(F.max(F.struct("m", "c1")).alias("other"))
    # of these two kinds of rows that need not meet among themselves, the more
    kinds = main.join(other, "token", "left").select("token", F.col("top.root").alias("main"), F.when(F.col("other.m") > F.col("top.m"), F.col("other.c1")).alias("ref"))
    shut = F.when(F.col("ref").isNull(), F.col("root") == F.col("main")).otherwise(F.col("apart") & F.col("c1").eqNullSafe(F.col("ref")))
    split = Kept(rows.df.join(kinds, "token").select("token", "sid", "root", "n", "l", "pos", "cap", "c1", "o1", "c2", "o2", shut.alias("shut")), "split", rows.df.count())
    rows.drop()
    elsewhere = [f"(c{i}_a = c{j}_b and {NEED} > least(o{i}_a, o{j}_b))" for i in (1, 2) for j in (1, 2)]
    elsewhere += [f"(c{i}_a = b and {NEED} > o{i}_a)" for i in (1, 2)] + [f"(c{i}_b = a and {NEED} > o{i}_b)" for i in (1, 2)]
    near = _side(split.df.where("not shut"), "a", ("token",)).join(_side(split.df, "b", ("token",)), "token").where(
        (F.col("root_a") != F.col("root_b")) & (F.col("shut_b") | (F.col("a") < F.col("b")))
        & (100 * F.least("n_a", "n_b") >= SIMILAR * F.greatest("n_a", "n_b"))
        & (SIMILAR * (F.col("n_a") + F.col("n_b")) <= F.least("cap_a", "cap_b"))
        # a pair that links shares o shingles or more, so of its first need shared ones none lies behind n - o + need - 1
        & F.expr(f"greatest(pos_a - n_a, pos_b - n_b) <= least(l_a, l_b) - 1 - {NEED}")
        # up to here at most the lesser place is shared, from here on at most what is left of either
        & (SIMILAR * (F.col("n_a") + F.col("n_b")) <= (100 + SIMILAR) * (F.least("pos_a", "pos_b") + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))))
        & F.expr(f"not coalesce({' or '.join(elsewhere)}, false)")
    )
    pair = _by_pair(near, "pos", "n", F.min(F.least("l_a", "l_b")).alias("need"))
    # both prefixes show all that is shared up to the last shared shingle seen; behind it, at most what is left of either
    most = "(shared + least(n1 - p1, n2 - p2) - 1)"
    out = Kept(pair.where(F.expr(f"shared >= need and {100 + SIMILAR} * {most} >= {SIMILAR} * (n1 + n2)")).select("a", "b"), "cross-pairs").df
    split.drop()
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int | None = None) -> DataFrame:
    """doc_id, tid (the hash of the text), n_shingles, component_id and root of every row.

    ``root`` names the component by one of its sets, so unlike component_id, a doc_id, no two components share it; it
    is null for a document without words.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    bits = bits or sketch_bits(docs, text)
    described = describe(docs, id_col, text, bits)
    rows = described.df.where("chunk is null")
    counters, total = sketch(described.df, bits)

    shared = spark.sparkContext.broadcast(counters)  # of fixed size

    found = offered(postings(docs, text, shared, total))
    # of the centres and of the smallest documents that its shingles offer, each document tries those that most of
    # them agree on (where that are as many as its l: others are left to the second round)
    offers = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("centre").alias("end")), F.struct(F.lit(1).alias("kind"), F.col("lo").alias("end"))))
    offers = found.df.select("sid", "l", offers.alias("o")).select("sid", "l", "o.kind", "o.end").where("sid <> end")
    offers = offers.groupBy("sid", "l", "kind", "end").agg(F.count("*").alias("votes")).where("votes >= l")
    best = offers.groupBy("sid", "kind").agg(F.max(F.struct("votes", "end")).alias("top")).select("sid", F.col("top.end").alias("end"))
    n = rows.count()
    pairs = Kept(best.select(F.col("sid").alias("a"), F.col("end").alias("b")).distinct(), "pairs", 2 * n)
    met = compared(docs, text, rows, pairs, shared)
    links = links_of(met.df)
    named = Kept(components(links, most=2 * n).select(F.col("id").alias("sid"), F.col("component_id").alias("root")), "named", n)
    refs = met.df.where("rest is not null").select(F.col("a").alias("sid"), F.col("b").alias("c"), F.col("n_a").alias("n"), F.col("common").alias("o"), "rest")
    across = cross_pairs(found.df.select("token", "sid", "n", "l", "pos").distinct(), named.df, refs, found.df.count())
    more = Kept(across.unionByName(outside_pairs(refs, named.df)).distinct(), "pairs")
    found.drop()
    pairs.drop()
    if not more.df.isEmpty():
        again = compared(docs, text, rows, more)
        both = links.unionByName(links_of(again.df))
        named = Kept(components(both, most=2 * n + more.df.count()).select(F.col("id").alias("sid"), F.col("component_id").alias("root")), "named", n)

    least = rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("first"))
    rooted = least.join(named.df, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_set = rooted.join(names, "root").select("sid", "root", "component_id")
    return rows.join(of_set, "sid", "left").select(
        "doc_id", "tid", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without all but the first document (by id, then text hash) of each component, columns as they are.

    Documents without words stay.  Of wholly equal (id, text) rows of a component one stays.
    """
    with passing():
        joined = Kept(near_duplicates(docs, id_col, text), "joined").stay().df
    own = joined.where("n_shingles > 0")
    best = own.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tid")).alias("best")).select("root", "best.doc_id", "best.tid")
    same = (F.col("o.root") == F.col("k.root")) & F.col("o.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("o.tid") == F.col("k.tid"))
    gone = Kept(own.alias("o").join(best.alias("k"), same, "left_anti").select("doc_id", "tid").distinct(), "gone", joined.count())
    lost = F.broadcast(gone.df) if gone.df.count() <= BROADCAST_ROWS else gone.df
    keyed = docs.select(packed(tuple(docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("bigint").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("tid"))
    match = F.col("d.id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.tid") == F.col("g.tid"))
    left = keyed.alias("d").join(lost.alias("g"), match, "left_anti")
    repeated = own.groupBy("doc_id", "tid").count().where("count > 1").select("doc_id", "tid")
    if not repeated.isEmpty():
        twice = left.alias("d").join(repeated.alias("g"), match, "left_semi").dropDuplicates(["id", "tid"])
        left = left.alias("d").join(repeated.alias("g"), match, "left_anti").unionByName(twice)
    return left.select(*unpacked(tuple(docs.columns), ()))
