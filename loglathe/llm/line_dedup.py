"""Line deduplication: lines that stand in several documents stay in one of them only; the result is a bitmap a document.

A line's key is the line without white space at its ends, A-Z in lower case.  Of keys of at least ``min_chars`` code
points that at least ``min_docs`` documents hold, all lines are dropped but those of the largest id.

1. Every line is two xxhash64 numbers of its key, with its document and place: a narrow table, written once.
2. The numbers are dealt to ranges of equal width; they are uniform, so only a key of very many lines fills a range beyond
   its share.  Such a range is cut into slices by document.  One shuffle by (range, slice) sorts each key by document,
   largest first, and place: the first document met is the one that keeps its lines, how many follow says whether the
   others lose theirs.
3. What the slices of a cut range know of a key is one row a slice; these are put together, and every slice is told.
4. The dropped places of a document are encoded as the lengths of its runs of kept and dropped lines (``keep_bitmaps``);
   ``drop_lines`` takes them out of the texts, which are shuffled by then once, with their bitmaps.

Keys are told apart by 128 bits: N different keys are expected to have N²/2¹²⁹ pairs that share them.

Defined results: a null or empty text is one empty line; a null id is a document smaller than all others; rows of one id
are one document, each with its own bitmap; equal rows get equal results; an empty table gives an empty result; columns
of the names of results give way to these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, empty_text, packed, partitions, unpacked
from .mixing import small

MIN_CHARS, MIN_DOCS = 20, 3
#: Lines that a range aims at; a range of more than ``HOT`` times its share is cut into slices.
RANGE_ROWS, HOT = 500_000, 3
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """A-Z, and only these, in lower case; of ASCII texts that is what ``lower`` does, at less cost."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def keyed_lines(docs: DataFrame, text: str, id_col: str, min_chars: int) -> DataFrame:
    """(doc, rid, pos, h1, h2) of every line with a key that is long enough; rid is the hash of the text."""
    body = empty_text(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(body).alias("rid"), F.posexplode(F.split(folded(body), "\n")).alias("pos", "line"))
    rows = rows.select("doc", "rid", "pos", F.btrim("line", F.lit(SPACE)).alias("key")).where(F.char_length("key") >= min_chars)
    return rows.select("doc", "rid", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def sliced(lines: DataFrame, range_rows: int) -> DataFrame:
    """``lines`` with their range of the hash order, the number of its slices and their slice.

    Ranges that are cut have over ``HOT`` times their share, so there are about as many as keys of so many lines.
    """
    n = lines.count()
    ranges = max(partitions(lines.sparkSession), -(-n // range_rows))
    rows = lines.withColumn("range", F.floor((F.col("h1") / F.lit(2.0**64) + 0.5) * ranges).cast("long"))
    share = max(1, -(-n // ranges))
    hot = rows.groupBy("range").agg(F.count("*").alias("n")).where(F.col("n") > HOT * share)
    hot = Kept(hot.select("range", F.ceil(F.col("n") / share).cast("long").alias("slices")), "line-ranges", rows=ranges // HOT).df
    rows = rows.join(small(hot), "range", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    return rows.withColumn("slice", F.pmod(F.xxhash64("doc"), F.col("slices")))


def dropped_lines(lines: DataFrame, min_docs: int = MIN_DOCS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc, rid, pos) of the lines to drop."""
    key = Window.partitionBy("range", "slice", "h1", "h2")
    rows = sliced(lines, range_rows).repartition(partitions(lines.sparkSession), "range", "slice")
    rows = rows.withColumn("nth", F.dense_rank().over(key.orderBy(F.desc_nulls_last("doc"))))
    # of this slice: how many documents, and the first of them
    whole = key.orderBy(F.desc_nulls_last("doc")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"docs": F.last("nth").over(whole), "first": F.first("doc").over(whole), "head": F.row_number().over(key.orderBy(F.desc_nulls_last("doc"))) == 1})
    lost = (F.col("docs") >= min_docs) & ~F.col("doc").eqNullSafe(F.col("first"))
    met = Kept(rows.where((F.col("slices") > 1) | lost), "line-met").df
    whole_ranges = met.where("slices = 1").select("doc", "rid", "pos")
    cut = met.where("slices > 1")
    heads = cut.where("head").select("range", "slice", "h1", "h2", "docs", "first")  # a row a slice of a key
    of_key = heads.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("first").alias("first")).where(F.col("docs") >= min_docs)
    told = heads.select("range", "slice", "h1", "h2").join(of_key, ["h1", "h2"])
    sliced_ranges = cut.drop("docs", "first").join(told, ["range", "slice", "h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("first")))
    return whole_ranges.unionByName(sliced_ranges.select("doc", "rid", "pos"))


def _varint(v: Column) -> Column:
    """A number as hex digits of seven bits a byte, lowest first; all but the last byte have their top bit set."""
    byte = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    out = F.lit("")
    for k in range(5):
        rest = F.shiftright(v, 7 * k)
        out = F.concat(out, F.when(rest >= 128, byte(rest.bitwiseAND(F.lit(127)).bitwiseOR(F.lit(128)))).when((rest > 0) | F.lit(k == 0), byte(rest)).otherwise(""))
    return out


def runs_of(places: Column) -> Column:
    """The first and last place of every run, from the sorted places of dropped lines (a column, which the lambdas look up)."""
    starts = F.filter(places, lambda p, i: F.coalesce(F.get(places, i - 1) != p - 1, F.lit(True)))
    ends = F.filter(places, lambda p, i: F.coalesce(F.get(places, i + 1) != p + 1, F.lit(True)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def encode_runs(runs: Column) -> Column:
    """The bitmap: lengths of the runs of kept and dropped lines in turn; the kept run at the end is left out."""
    kept = lambda r, i: r["a"] - F.coalesce(F.get(runs, i - 1)["b"] + 1, F.lit(0))
    return F.unhex(F.array_join(F.transform(runs, lambda r, i: F.concat(_varint(kept(r, i)), _varint(r["b"] - r["a"] + 1))), ""))


def decode_runs(keep: Column) -> Column:
    """A bitmap as one boolean a line up to the last dropped one; all lines behind are kept."""
    numbers = F.regexp_extract_all(F.hex(keep), F.lit("(?:[89A-F][0-9A-F])*[0-7][0-9A-F]"), F.lit(0))

    def number(digits: Column) -> Column:
        out = F.lit(0)
        for k in range(5):
            byte = F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10).cast("int").bitwiseAND(F.lit(127))
            out = out.bitwiseOR(F.when(F.length(digits) > 2 * k, F.shiftleft(byte, 7 * k)).otherwise(F.lit(0)))
        return out

    return F.flatten(F.transform(numbers, lambda d, i: F.array_repeat(i % 2 == 0, number(d))))


def keep_bitmaps(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """(doc, rid, n_dropped, keep) of every document that loses lines; rid is xxhash64 of its text."""
    lines = Kept(keyed_lines(docs, text, id_col, min_chars), "line-keys").df
    found = dropped_lines(lines, min_docs, range_rows).groupBy("doc", "rid").agg(F.sort_array(F.collect_set("pos")).alias("places"))  # of one document
    found = Kept(found, "line-places").df  # written: the lambdas below look at it often
    runs = Kept(found.select("doc", "rid", F.size("places").cast("long").alias("n_dropped"), runs_of(F.col("places")).alias("runs")), "line-runs").df
    return runs.select("doc", "rid", "n_dropped", encode_runs(F.col("runs")).alias("keep"))


def drop_lines(docs: DataFrame, bitmaps: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``carry`` columns, n_lines (before), n_dropped and kept, the text without the dropped lines, of every row of docs."""
    body = empty_text(F.col(f"`{text}`"))
    rows = docs.select(packed(carry).alias("row"), F.col(f"`{id_col}`").alias("_doc"), body.alias("_text"), F.xxhash64(body).alias("_rid"))
    known = bitmaps.select(F.col("doc").alias("_own"), F.col("rid").alias("_rid"), "n_dropped", "keep")
    rows = rows.join(known, F.col("_doc").eqNullSafe(F.col("_own")) & (rows["_rid"] == known["_rid"]), "left")
    rows = rows.select("row", "_text", F.split("_text", "\n").alias("_lines"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), decode_runs(F.col("keep")).alias("_flags"))
    kept = F.array_join(F.filter("_lines", lambda line, i: F.coalesce(F.get(F.col("_flags"), i), F.lit(True))), "\n")
    rows = rows.select("row", F.size("_lines").cast("long").alias("n_lines"), "n_dropped", F.when(F.col("n_dropped") == 0, F.col("_text")).otherwise(kept).alias("kept"))
    return rows.select(*unpacked(carry, ("n_lines", "n_dropped", "kept")))


def dedup_lines(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", id_col: str = "doc_id", **limits: int) -> DataFrame:
    """The texts without repeated lines: ``keep_bitmaps``, then ``drop_lines``."""
    return drop_lines(docs, keep_bitmaps(docs, text, id_col, **limits), carry, text, id_col)
