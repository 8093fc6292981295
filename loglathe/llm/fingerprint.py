"""Exact document fingerprints: canonical text, a wide xxhash, byte comparison inside equal buckets.

Canonical text: compatibility composition (NFKC), lower case, runs of white space as one space,
trimmed.  The fingerprint is the 128-bit hash of the canonical text (two chained xxhash64 lanes) as 32
hexadecimal digits.  Where texts with equal hashes are not equal byte for byte, the texts of that bucket
are numbered in byte order and ``-<number>`` is added from the second on.

Defined results: a null text counts as empty; equal rows have equal fingerprints; an empty table gives an
empty result; null ids are the smallest.  Columns besides the named ones are ignored; a carried
column named fingerprint gives way to the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Kept, empty_text, packed, unpacked

#: Rows a range bucket aims at, and the most buckets that quantiles of ids are asked for.
BUCKET_ROWS, BUCKETS = 4096, 20_000


def canonical(text: Column) -> Column:
    # white space as of Unicode; ICU's compose(text, true) is NFKC
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.trim(F.regexp_replace(F.lower(composed), r"(?U)\s+", " "))


def digest(canon: Column, mask: int = -1) -> Column:
    """128 bits as 32 hex digits; ``mask`` keeps only some bits of each lane (to test collisions)."""
    lane = lambda salt: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(salt), canon).bitwiseAND(F.lit(mask)))), 16, "0")
    return F.concat(lane(0), lane(1))


def collisions(docs: DataFrame, hashed: DataFrame, text: str, mask: int = -1) -> DataFrame:
    """(hash, canon, ordinal) of the hash buckets in which canonical bytes differ.

    ``hashed``, a written table, has the column ``hash``, one row a document.  Buckets of one document need no comparison.  The
    texts of the others are grouped by their own bytes, which partial aggregation collapses in each task
    before anything is shuffled, so a bucket of very many copies is no hot key.
    """
    shared = hashed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    if shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        shared = F.broadcast(shared)
    canon = canonical(empty_text(F.col(f"`{text}`")))
    texts = docs.select(canon.alias("canon")).withColumn("hash", digest(F.col("canon"), mask))
    distinct = texts.join(shared, "hash", "left_semi").groupBy("hash", "canon").agg(F.count("*").alias("n"))
    ordered = Window.partitionBy("hash").orderBy("canon")
    return (
        distinct.withColumn("ordinal", F.row_number().over(ordered) - 1)
        .withColumn("texts", F.count("*").over(Window.partitionBy("hash")))
        .where("texts > 1").select("hash", "canon", "ordinal")
    )


def tell_apart(hashed: Column, ordinal: Column) -> Column:
    return F.when(ordinal > 0, F.concat(hashed, F.lit("-"), ordinal.cast("string"))).otherwise(hashed)


def fingerprints(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), mask: int = -1) -> DataFrame:
    """``carry`` columns and ``fingerprint`` of every row."""
    base = docs.select(packed(carry).alias("row"), canonical(empty_text(F.col(f"`{text}`"))).alias("canon"))
    base = base.withColumn("hash", digest(F.col("canon"), mask))
    clash = Kept(collisions(docs, Kept(base.select("hash"), "hashes").df, text, mask), "clash")
    if clash.df.isEmpty():
        return base.select("row", F.col("hash").alias("fingerprint")).select(*unpacked(carry, ("fingerprint",)))
    out = base.join(clash.df, ["hash", "canon"], "left")
    return out.select("row", tell_apart(F.col("hash"), F.col("ordinal")).alias("fingerprint")).select(*unpacked(carry, ("fingerprint",)))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are below key, by binary search."""
    if not bounds:
        return F.lit(0)
    cut = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folds to one constant
    depth = len(bounds).bit_length()
    strides = F.array(*[F.lit(1 << i) for i in reversed(range(depth))])
    # get() beyond the end is null, and null is no smaller bound
    step = lambda acc, s: F.when(F.get(cut, acc + s - 1) < key, acc + s).otherwise(acc)
    return F.aggregate(strides, F.lit(0), step)


def with_next(docs: DataFrame, id_col: str, cols: tuple[str, ...]) -> DataFrame:
    """Adds ``next_<col>`` from the next row in descending order of id (after the last, the first row).

    Rows are dealt to ranges of ids between quantiles and sorted there; a copy of the first row of each
    range goes to the range before it as a guard.  No window spans more than a range, and rows are
    shuffled once.  Equal ids (they share a range) are ordered by the hash of ``cols``.
    """
    key = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    k = min(BUCKETS, docs.count() // BUCKET_ROWS)
    bounds: list[int] = []
    if k > 1:
        got = docs.select(key.alias("k")).agg(F.percentile_approx("k", [i / k for i in range(1, k)], 10 * k + 100))
        bounds = sorted(set(got.first()[0]))
    keyed = docs.withColumn("_k", key).withColumn("_b", _range_of(F.col("_k"), bounds))
    # at most BUCKETS rows: the largest key of each range, and the range in which it ends the sequence
    heads = keyed.groupBy("_b").agg(F.max("_k").alias("_k"))
    upward = Window.orderBy("_b")
    heads = heads.select(
        "_k",
        F.coalesce(F.lead("_b").over(upward), F.min("_b").over(upward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_to"),
    )
    rows = keyed.join(F.broadcast(heads), "_k", "left").withColumn("_h", F.xxhash64(*cols))
    place = lambda at, guard: F.struct(F.col(at).cast("int").alias("at"), F.lit(guard).alias("guard"))
    places = F.when(F.col("_to").isNull(), F.array(place("_b", False))).otherwise(F.array(place("_b", False), place("_to", True)))
    rows = rows.withColumn("_p", F.explode(places)).select("*", "_p.at", "_p.guard").drop("_p", "_b", "_to")
    order = Window.partitionBy("at").orderBy("guard", F.col("_k").desc(), F.col("_h").desc())
    for c in cols:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(order))
    return rows.where(~F.col("guard")).drop("at", "guard", "_k", "_h")


def likeness(one: Column, other: Column) -> Column:
    """An exact digest knows equal and different only."""
    return F.when(one == other, F.lit(1.0)).otherwise(F.lit(0.0))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text: str = "text", mask: int = -1) -> DataFrame:
    """Fingerprints of each text and of its edited text (see ``with_next`` for the next document's)."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), empty_text(text).alias("t"))
    hashed = base.withColumn("h", digest(canonical(F.col("t")), mask))
    clash = Kept(collisions(docs, Kept(hashed.select(F.col("h").alias("hash")), "hashes").df, text, mask), "clash")
    rows = with_next(hashed, "doc_id", ("t", "h"))
    n = F.char_length("t")
    cut = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("t"), F.lit(1), n - cut), F.substring(F.col("next_t"), F.lit(1), cut)))
    rows = rows.withColumn("edited_canon", canonical(F.col("edited"))).withColumn("eh", digest(F.col("edited_canon"), mask))
    out = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "h", "eh",
        # bytes are compared where hashes are equal
        ((F.col("h") == F.col("eh")) & (canonical(F.col("t")) == F.col("edited_canon"))).alias("as_edited"),
        ((F.col("h") == F.col("next_h")) & (canonical(F.col("t")) == canonical(F.col("next_t")))).alias("as_next"),
        *([] if clash.df.isEmpty() else [canonical(F.col("t")).alias("canon"), "edited_canon"]),
    )
    ordinal = edited_ordinal = F.lit(0)
    if "canon" in out.columns:
        for name, h in (("canon", "h"), ("edited_canon", "eh")):
            named = clash.df.select(F.col("hash").alias(h), F.col("canon").alias(name), F.col("ordinal").alias(f"{name}_ordinal"))
            out = out.join(named, [h, name], "left")
        ordinal, edited_ordinal = F.col("canon_ordinal"), F.col("edited_canon_ordinal")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", tell_apart(F.col("h"), ordinal).alias("fingerprint"),
        tell_apart(F.col("eh"), edited_ordinal).alias("edited_fingerprint"),
        likeness(F.col("as_edited"), F.lit(True)).alias("near_edited"), likeness(F.col("as_next"), F.lit(True)).alias("near_next"),
    )
