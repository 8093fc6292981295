"""Mixing sources to target weights by pivotal dependent rounding.

Targets are found by water filling: a source's target is ``min(cap * its size, level * its weight)``
with one level for all, so that targets add up to ``share`` of all sizes.  A document's expected number
of copies is target / source size; its whole part is certain, its fraction is rounded dependently.

Pivotal step, on documents i and j with fractions p, q and sizes s, t: either p rises by a/s while q falls
by a/t, or p falls by b/s while q rises by b/t, with a and b the largest steps that keep both in [0, 1]
and probabilities b/(a+b) and a/(a+b).  One of the two becomes integral, ``s*p + t*q`` is unchanged, and so
is the expectation of either.  Groups of at most ``FAN`` documents are folded by such steps, leaving one
undecided document each; these residuals form the next level of a reduction tree, until a source has one
left, which is rounded by itself.  So the words taken of a source differ from its target by less than
one document.  Randomness is the hash of seed, level and the documents' content: reruns agree, up to equal rows.

Defined results: a null text has size 0 and is not taken; equal rows are documents of their own; a null
source is a source, the last; an empty table gives an empty result; other columns pass through, and
results overwrite columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Kept, unit

#: Weights by the sources' code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents folded in one group; documents of a source sorted together at a time.
FAN, SORTED = 64, 8192
EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank``, their place by code point from 0, null last: ranges, and an offset for each."""
    dealt = sources.withColumn("_null", F.col("source").isNull()).repartitionByRange("_null", "source").sortWithinPartitions("_null", "source")
    placed = Kept(dealt.withColumn("_at", F.monotonically_increasing_id()), "mix-ranks").df
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.col("_base") + F.col("_at") - F.shiftleft("_part", 33)
    return placed.join(F.broadcast(offsets), "_part").withColumn("rank", rank).drop("_part", "_at", "_base", "_null")


def targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (source, source_size) with each source's target.

    The level is where the sum of all targets, a concave function of it made of straight lines, meets the total.  Each round
    follows the line at the present level, which never leads beyond, and halves what is left above; it ends when no more
    sources reach their cap.  A round is one aggregate, and only sums reach the driver.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    rows = Kept(ranked(sources).withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap))).drop("rank"), "mix-weights").df
    known = rows.agg(F.sum("source_size").alias("all"), F.sum("most").alias("most"), F.max(F.col("most") / F.col("weight")).alias("top")).first()
    total, level, top = share * (known["all"] or 0), 0.0, known["top"] or 0.0
    if total >= (known["most"] or 0):
        level = top
    held_before = None
    while level < top:
        middle, capped = (level + top) / 2, F.col("most") <= F.lit(level) * F.col("weight")
        if not level < middle < top:  # nothing lies between any more
            break
        got = rows.where("most > 0").agg(
            F.sum(F.when(~capped, F.col("weight"))).alias("w"), F.sum(F.when(capped, F.col("most"))).alias("held"), F.sum(F.when(capped, F.lit(1)).otherwise(0)).alias("n"),
            F.sum(F.least(F.col("most"), F.lit(middle) * F.col("weight"))).alias("at_middle"),
        ).first()
        if not got["w"] or got["n"] == held_before:
            break
        held_before = got["n"]
        level = max(level, (total - (got["held"] or 0.0)) / got["w"])
        if got["at_middle"] <= total:
            level, held_before = max(level, middle), None
        else:
            top = min(top, middle)
    return rows.withColumn("target", F.least(F.col("most"), F.lit(level) * F.col("weight")))


def _fold(docs: Column, seed: int, level: int) -> Column:
    """Folds an array of (key, uid, size, p) by pivotal steps: decided documents with 0 or 1, and the residual."""
    carry = "struct<key:long,uid:long,size:long,p:double>"
    done = "array<struct<uid:long,one:boolean>>"

    def step(acc: Column, d: Column) -> Column:
        c = acc["c"]
        s, t, p, q = c["size"].cast("double"), d["size"].cast("double"), c["p"], d["p"]
        a = F.least((1 - p) * s, q * t)
        b = F.least(p * s, (1 - q) * t)
        up = unit(F.lit(seed), F.lit(level), d["key"], c["key"]) * (a + b) < b
        p2 = F.when(up, p + a / s).otherwise(p - b / s)
        q2 = F.when(up, q - a / t).otherwise(q + b / t)
        first = (p2 <= EPS) | (p2 >= 1 - EPS)  # then c is decided and d goes on, else the other way round
        out = F.when(first, F.struct(c["uid"].alias("uid"), (p2 > 0.5).alias("one"))).otherwise(
            F.struct(d["uid"].alias("uid"), (q2 > 0.5).alias("one"))
        )
        rest = F.when(
            first, F.struct(d["key"].alias("key"), d["uid"].alias("uid"), d["size"].alias("size"), F.least(F.greatest(q2, F.lit(0.0)), F.lit(1.0)).alias("p"))
        ).otherwise(F.struct(c["key"].alias("key"), c["uid"].alias("uid"), c["size"].alias("size"), F.least(F.greatest(p2, F.lit(0.0)), F.lit(1.0)).alias("p")))
        return F.struct(rest.cast(carry).alias("c"), F.array_append(acc["d"], out).cast(done).alias("d"))

    head = F.element_at(docs, 1)
    start = F.struct(
        F.struct(head["key"].alias("key"), head["uid"].alias("uid"), head["size"].alias("size"), head["p"].alias("p")).cast(carry).alias("c"),
        F.array().cast(done).alias("d"),
    )
    return F.aggregate(F.slice(docs, 2, FAN), start, step)


def _grouped(rows: DataFrame, level: int) -> DataFrame:
    """rows (src, key, uid, size, p, n: rows of src) -> (src, docs) of groups of at most FAN."""
    salt = F.pmod(F.xxhash64(F.lit(level), "key"), F.ceil(F.col("n") / SORTED)).cast("long")
    order = Window.partitionBy("src", "salt").orderBy("key", "uid")
    # dealt by both, whatever came before: rows that lie by src alone would meet in one task
    dealt = rows.withColumn("salt", salt).repartition("src", "salt").withColumn("grp", F.floor((F.row_number().over(order) - 1) / FAN))
    return dealt.groupBy("src", "salt", "grp").agg(F.sort_array(F.collect_list(F.struct("key", "uid", "size", "p"))).alias("docs"))


def _level(rows: DataFrame, seed: int, level: int) -> Kept:
    """The groups folded: (src, c: the residual, d: the decided)."""
    folded = _grouped(rows, level).select("src", _fold(F.col("docs"), seed, level).alias("f"))
    return Kept(folded.select("src", "f.c", "f.d"), f"mix{level}")


def small(table: DataFrame) -> DataFrame:
    """A narrow written table, broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def round_copies(docs: DataFrame, seed: int = 20240229) -> DataFrame:
    """docs (uid: unique, key, src, size, expect: copies expected) -> (uid, extra): 1 where the fraction is rounded up.

    All choices hang on key; uid only tells rows of equal keys apart.
    """
    frac = docs.select("src", "key", "uid", "size", (F.col("expect") - F.floor("expect")).alias("p")).where(
        (F.col("size") > 0) & (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
    )
    decided, level, rows = [], 0, frac
    while True:
        counts = Kept(rows.groupBy("src").agg(F.count("*").alias("n")), "mix-counts").df
        kept = _level(rows.join(small(counts), "src"), seed, level)
        decided.append(kept.df.select(F.explode("d").alias("d")).select("d.uid", "d.one"))
        residual = kept.df.select("src", "c.key", "c.uid", "c.size", "c.p")
        # each source with rows has at least one residual, so as many rows as sources is one a source
        if residual.count() <= counts.count():
            last = residual.select("uid", (unit(F.lit(seed), F.lit("last"), "key") < F.col("p")).alias("one"))
            break
        rows, level = residual.where((F.col("p") > EPS) & (F.col("p") < 1 - EPS)), level + 1
        decided.append(residual.where((F.col("p") <= EPS) | (F.col("p") >= 1 - EPS)).select("uid", (F.col("p") > 0.5).alias("one")))
    out = last
    for part in decided:
        out = out.unionByName(part)
    return out.select("uid", F.col("one").cast("long").alias("extra"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", share: float = 1.5, cap: float = 2.0, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Sizes, targets and copies of each document.

    Returns (plan, sources); plan has the columns ``carry``, ``source``, ``size``, ``source_size``, ``target``,
    ``copies`` and ``taken`` = copies * size.  Texts are read once, for their sizes; what ``carry`` names is shuffled once.
    """
    carry = tuple(c for c in carry if c not in ("size", "source_size", "target", "copies", "taken"))
    sized = docs.select(
        *[F.col(f"`{c}`") for c in carry], F.col(f"`{source}`").cast("string").alias("_source"),
        word_count(F.col(f"`{text}`")).alias("_size"), F.monotonically_increasing_id().alias("uid"),
        F.xxhash64(*[F.col(f"`{c}`") for c in (*carry, text, source)]).alias("key"),
    )
    sized = Kept(sized, "mix-sizes").df
    sources = Kept(sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size")), "mix-sources").df
    sources = Kept(targets(sources, share, cap), "mix-targets").df
    src = F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("n"))
    named = sources.select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("src"), "source_size", "target"
    )
    ready = sized.withColumn("src", src).join(small(named), "src").withColumn(
        "expect", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )
    whole = F.floor(F.col("expect") + EPS)
    extra = round_copies(ready.select("uid", "key", "src", F.col("_size").alias("size"), F.greatest(F.col("expect"), F.lit(0.0)).alias("expect")))
    copies = F.when(F.col("_size") > 0, whole + F.coalesce("extra", F.lit(0))).otherwise(0)
    # rows of unknown width: shuffled by the unique uid at any size, so that small and large inputs behave alike
    plan = ready.join(extra.hint("merge"), "uid", "left").select(
        *[F.col(f"`{c}`") for c in carry], F.col("_source").alias("_src"), F.col("_size").alias("size"),
        "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("_size")).cast("long").alias("taken"),
    )
    return plan, sources


def apply_mix(docs: DataFrame, text: str = "text", source: str = "source", share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: every document as often as its copies say, with the columns of ``docs``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`"), F.col(f"`{source}`"))
    plan, _ = mix(rows, text, source, share, cap, carry=("_row",))
    return plan.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(
        *[F.col("_row")[c].alias(c) for c in docs.columns]
    )
