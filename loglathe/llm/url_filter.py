"""URL filters: host-suffix and path-prefix expressions against a rule table, by hash prefix, then full digest.

Each url is split into a host and a path.  Every suffix of the host of as many labels as some rule has, combined with
the path prefixes of the lengths that occur among the rules, is one *expression* (``host`` + ``path``
prefix).  Expressions meet the rules in an equi-join on the first 32 bits of their SHA-256; the whole
digests are then compared, so a shared prefix never decides.  Of the rules that fit, the longest
(host and path together) wins; on equal length the longer host, then ``block``.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule;
repeated rows are judged each for itself; an empty rule table allows everything; of two equal rules
with different verdicts ``block`` wins.  Other columns of the input are passed through under their
names; the results overwrite columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS

RULE_SCHEMA = "host string, path string, verdict string"
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Copies of a rule, each meeting its share of the expressions, where rules are too many to broadcast.
SALTS = 16


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    """A host has no slash, so the slash that always follows keeps (host, path) apart from any other pair."""
    return F.unhex(F.sha2(F.concat(host, F.lit("/"), path), 256))


def _prefix(digest: Column) -> Column:
    return F.substring(digest, 1, 4)


def host_suffixes(host: Column, labels: list[int]) -> Column:
    """The last n labels of a host, for each n of ``labels`` that it has: of ``a.b.c`` and [1, 3] ``c`` and ``a.b.c``."""
    n = F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit(""))) + 1
    return F.filter(F.array(*[F.when(n >= k, F.substring_index(host, ".", -k)) for k in labels]).cast("array<string>"), F.isnotnull)


def prepare(rules: DataFrame) -> DataFrame:
    """One row per distinct rule: expression digest, its prefix, the rule's text, lengths and verdict."""
    host, path = F.translate(F.coalesce("host", F.lit("")), *LOWER), F.coalesce("path", F.lit(""))
    rows = rules.select(host.alias("h"), path.alias("p"), F.col("verdict").alias("v")).where("v is not null")
    return (
        rows.groupBy("h", "p").agg(F.max("v").alias("rule_verdict"))
        .select(
            _digest(F.col("h"), F.col("p")).alias("digest"),
            F.concat("h", "p").alias("rule_text"),
            F.char_length("h").alias("host_len"),
            F.char_length("p").alias("path_len"),
            F.size(F.split("h", r"\.")).alias("labels"),
            "rule_verdict",
        )
        .withColumn("hash_prefix", _prefix(F.col("digest")))
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict of each row's url."""
    ruled = prepare(rules)
    stats = ruled.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("path_len")).alias("lens"), F.array_sort(F.collect_set("labels")).alias("labels")).first()
    small = stats["n"] <= BROADCAST_ROWS
    lens = stats["lens"]  # distinct lengths only: at most as many as the longest rule path has characters, and so for labels

    hold = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in hold]).alias("_row"),
        host_of(F.col(f"`{url}`")).alias("_host"),
        path_of(F.col(f"`{url}`")).alias("_path"),
        F.monotonically_increasing_id().alias("_id"),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lens]).cast("array<int>"), lambda n: n <= F.char_length("_path")),
        lambda n: F.substring(F.col("_path"), F.lit(1), n),
    )
    pairs = F.flatten(
        F.transform(host_suffixes(F.col("_host"), stats["labels"]), lambda h: F.transform(prefixes, lambda p: _digest(h, p)))
    )
    expanded = rows.withColumn("_digest", F.explode_outer(pairs)).withColumn("hash_prefix", _prefix(F.col("_digest")))
    if small:
        ruled, key = F.broadcast(ruled), ["hash_prefix"]
    else:
        ruled, key = ruled.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["hash_prefix", "salt"]
        expanded = expanded.withColumn("salt", F.pmod("_id", F.lit(SALTS)).cast("int"))
    joined = expanded.join(ruled, key, "left")
    fits = F.col("digest") == F.col("_digest")
    rank = F.struct(
        (F.col("host_len") + F.col("path_len")).alias("n"), "host_len", F.col("rule_verdict"), F.col("rule_text")
    )
    best = joined.groupBy("_id", "_host", "_path").agg(
        F.any_value("_row").alias("_row"), F.max(F.when(fits, rank)).alias("_best")
    )
    return best.select(
        *[F.col("_row")[c].alias(c) for c in hold],
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.rule_text").alias("rule"),
        F.coalesce(F.col("_best.rule_verdict"), F.lit(default)).alias("verdict"),
    )
