"""Fill-in-the-middle: a text is cut at two line starts into prefix, middle and suffix, which sentinels put in another order.

A text's units are its lines, each with its line feed (``[^\\n]*\\n|[^\\n]+``).  The first four 8-digit groups of the hex
SHA-256 of ``<seed>:<id>`` are h1 to h4: of n units the prefix takes the smaller of h1 and h2 mod (n + 1), the middle
reaches to the larger; h3 mod 100 decides with ``rate`` whether a text stays plain, h4 mod 100 with ``spm`` between the
orders suffix-prefix-middle and prefix-suffix-middle.  A text that is empty or contains a sentinel is always plain, so
that parsing at the sentinels restores every text.

Expressions only; a text is never shuffled, and its choices hang on its id alone, so reruns agree.

Defined results: a null text is the empty one; a null id counts as the empty string in the hash; equal ids make equal
choices; an empty table gives an empty result; columns of the names of results give way to these.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import empty_text, packed, unpacked

#: What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
UNIT = r"[^\n]*\n|[^\n]+"
RESULTS = ("n", "form", "prefix", "middle", "suffix", "output")


def units(text: Column) -> Column:
    """The lines of a text, each with its line feed; together they are the text."""
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def draws(id_col: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 out of the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    # without < and > inside, none can begin within another or in what stands beside it
    if len(set(sentinels)) != 3 or not all(re.fullmatch(r"<[^<>\n]+>", s) for s in sentinels):
        raise ValueError("sentinels must be three different marks in angle brackets")
    return sentinels


def arrange(
    docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", id_col: str = "doc_id", seed: int = 7, rate: int = 100, spm: int = 50,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """``carry`` columns, n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain) and output of every row.

    ``rate`` is the per cent of texts to rearrange, ``spm`` the per cent of these that get the suffix first.
    """
    p, s, m = _checked(sentinels)
    h = draws(F.col("_id"), seed)
    has = F.lit(False)
    for mark in sentinels:
        has = has | F.contains("_text", F.lit(mark))
    rows = docs.select(packed(carry).alias("row"), F.col(f"`{id_col}`").alias("_id"), empty_text(F.col(f"`{text}`")).alias("_text"))
    rows = rows.select(
        "row", "_text", units(F.col("_text")).alias("_units"), F.when((F.col("_text") == "") | has | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm").alias("form"),
        *[h[k].alias(f"_h{k}") for k in (0, 1)],
    )
    n = F.size("_units")
    cuts = [F.pmod(F.col(f"_h{k}"), n + 1).cast("int") for k in (0, 1)]
    rows = rows.select("row", "_text", "_units", "form", n.cast("long").alias("n"), F.least(*cuts).alias("_a"), F.greatest(*cuts).alias("_b"))
    part = lambda start, size: F.when(F.col("form") != "plain", F.array_join(F.slice("_units", start, size), ""))
    rows = rows.select(
        "row", "_text", "form", "n", part(F.lit(1), F.col("_a")).alias("prefix"), part(F.col("_a") + 1, F.col("_b") - F.col("_a")).alias("middle"),
        part(F.col("_b") + 1, F.size("_units") - F.col("_b")).alias("suffix"),
    )
    output = (
        F.when(F.col("form") == "plain", F.col("_text"))
        .when(F.col("form") == "psm", F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle"))
        .otherwise(F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle"))
    )
    return rows.withColumn("output", output).select(*unpacked(carry, RESULTS))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, from an output and its form: parsed at the sentinels."""
    p, s, m = _checked(sentinels)
    ahead, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    # what lies between the first sentinel and the second, and behind the second
    one = lambda first, second: F.substr(F.substring_index(ahead, second, 1), F.lit(len(first) + 1))
    two = lambda second: F.substring_index(ahead, second, -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one(p, s), middle, two(s))).otherwise(F.concat(two(p), middle, one(s, p)))
