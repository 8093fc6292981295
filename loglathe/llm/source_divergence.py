"""Source divergence audit: how far the term shares of the sources of a language lie apart, and by which terms.

Terms are runs of letters A-Z (in lower case) and of all that is not ASCII.  A language keeps the terms that at least
``min_docs`` of its documents hold.  A share is ``1 + floor(10**9 * (count + 5) / (N + 5 * V))`` of a group (a language's
source) or of the language, with V kept terms and N occurrences of them there; all arithmetic is on whole numbers.

1. Every task counts the terms of its documents in byte tries, one a language, whose leaves have a counter a source.  A
   trie of ``LEAVES`` leaves is written out and a new one begun, so memory is bounded.
2. Their leaves, in the order of the bytes, are dealt to prefix ranges by Spark's range partitioner and merged as sorted
   streams: leaves of one term are neighbours there, of which all but their sums go.  What too few documents hold goes too.
3. The merged tries are walked in UTF-8 order: tiles of pairs of sources add up their distances, and each group keeps its
   ``top`` terms, of equal ones the first.  Sums and candidates of the ranges are then put together.

What reaches the driver and every task is a row a (language, source) group: its pairs are the result, the square of that.
Counters are exact up to 9 * 10**15 occurrences in a language.

Defined results: null text, language and source are empty strings; a text without terms still makes its group occur; equal
rows count each; a language without kept terms has pairs of value 0; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import gc
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, bound_arrow, empty_text, partitions, release
from .radix_trie import Trie

MIN_DOCS, TOP = 30, 50
#: Leaves of one task's tries and terms counted beside them before they go; bytes of a text looked at together.
LEAVES, COUNTED, CHUNK = 200_000, 400_000, 1 << 20
#: Sources of a tile; tiles held by a task; cells of a matrix of counts.
TILE, TILES, CELLS = 512, 24, 1 << 20
SCALE, SMOOTH = 10**9, 5
#: Bytes that belong to a term as they are or in lower case; all others end one.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LEAF = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
_LEAF_SQL = "lang string, term binary, docs bigint, sources array<int>, counts array<bigint>"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, of a long one in parts that end between terms."""
    text = text.translate(FOLD)
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            end = text.rfind(b" ", at, end)
            if end < 0:
                end = text.find(b" ", at + CHUNK)
        end = len(text) if end < 0 or end >= len(text) else end + 1
        yield text[at:end].split()
        at = end


def _leaves(tries: dict[str, Trie], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """All leaves, by language and bytes."""
    for lang in sorted(tries, key=str.encode):
        walk = tries[lang].walk()
        while part := list(islice(walk, rows)):
            offsets = pa.array(np.cumsum([0] + [len(node.counts) for _, node in part]), pa.int32())
            sources = pa.array(chain.from_iterable(node.counts for _, node in part), pa.int32())
            counts = pa.array(chain.from_iterable(node.counts.values() for _, node in part), pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(part), pa.string()), pa.array([term for term, _ in part], pa.binary()), pa.array([node.docs for _, node in part], pa.int64()),
                pa.ListArray.from_arrays(offsets, sources), pa.ListArray.from_arrays(offsets, counts),
            ], schema=_LEAF)


def count_terms(docs: DataFrame, groups: dict[tuple[str, str], int]) -> DataFrame:
    """(lang, term, docs, sources, counts): the leaves of every task's tries; sources are numbers of ``groups``."""
    spark = docs.sparkSession
    bound_arrow(spark)
    shared = spark.sparkContext.broadcast(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Trie] = {}
        here: dict[tuple[str, str], Counter] = {}
        holders: dict[str, Counter] = {}

        def fold() -> int:
            for lang, held in holders.items():
                own = [(shared.value[k], counter) for k, counter in here.items() if k[0] == lang]
                tries.setdefault(lang, Trie()).add(held, own)
            here.clear(), holders.clear()
            return sum(t.leaves for t in tries.values())

        gc.disable()  # nodes and counters make no cycles: collections would walk them over and over
        for batch in batches:
            cols = [batch.column(k) for k in ("lang", "source")] + [batch.column("text").cast(pa.binary())]
            for lang, source, text in zip(*(c.to_pylist() for c in cols), strict=True):
                counter, seen = here.setdefault((lang, source), Counter()), set()
                for part in terms(text):
                    counter.update(part)
                    seen.update(part)
                holders.setdefault(lang, Counter()).update(seen)
            if sum(map(len, here.values())) + sum(map(len, holders.values())) >= COUNTED and fold() >= LEAVES:
                yield from _leaves(tries)
                tries = {}
        fold()
        yield from _leaves(tries)
        tries.clear()
        gc.enable()
        release()

    return docs.mapInArrow(run, _LEAF_SQL)


def _sums(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Of leaves in order, of which runs begin at ``starts``: each run's documents, its sources and their counts."""
    docs = np.add.reduceat(table.column("docs").to_numpy(), starts)
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
    sources, counts = table.column("sources").combine_chunks(), table.column("counts").combine_chunks()
    owner = np.repeat(run, pc.list_value_length(sources).to_numpy(zero_copy_only=False))
    at, amount = pc.list_flatten(sources).to_numpy(), pc.list_flatten(counts).to_numpy()
    order = np.lexsort((at, owner))
    owner, at, amount = owner[order], at[order], amount[order]
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1])]) if len(at) else np.zeros(0, np.int64)
    offsets = np.searchsorted(owner[first], np.arange(len(starts) + 1)).astype(np.int32)
    total = np.add.reduceat(amount, first) if len(first) else amount
    return docs, [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (at[first].astype(np.int32), total.astype(np.int64))]


def merge_tries(leaves: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The leaves of the merged tries, of terms that at least ``min_docs`` documents hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def merged(table: pa.Table, starts: np.ndarray) -> pa.Table:
            docs, lists = _sums(table, starts)
            return pa.Table.from_arrays([table.column("lang").take(starts), table.column("term").take(starts), pa.array(docs), *lists], schema=_LEAF)

        def begins(table: pa.Table) -> np.ndarray:
            new = np.ones(table.num_rows, bool)
            for k in ("lang", "term"):
                c = table.column(k).combine_chunks()
                differs = pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
                new[1:] = differs if k == "lang" else new[1:] | differs
            return np.flatnonzero(new)

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from table.filter(pc.greater_equal(table.column("docs"), min_docs)).combine_chunks().to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch]).cast(_LEAF)
            table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
            if not table.num_rows:
                continue
            table = merged(table, begins(table))
            held = table.slice(table.num_rows - 1)  # the next batch may go on with this term
            yield from out(table.slice(0, table.num_rows - 1))
        if held is not None:
            yield from out(held)

    dealt = leaves.repartitionByRange(partitions(leaves.sparkSession), "lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(run, _LEAF_SQL)


def shares(count: np.ndarray, n: np.ndarray | int, v: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 5) / (n + 5 * v)), digit by digit: no step leaves 64 bits."""
    whole, rest = np.divmod(count + SMOOTH, n + SMOOTH * v)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, n + SMOOTH * v)
        whole = whole * 1000 + step
    return whole + 1


def compare(kept: DataFrame, groups: list[tuple[str, str]], of_group: list[int], of_lang: dict[str, tuple[int, int]], top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value): sums of the pairs and candidates for the terms, of every range of ``kept``.

    ``groups`` are sorted by language; ``of_group`` has each one's N, ``of_lang`` the N and V of a language.
    """
    place = {lang: [k for k, g in enumerate(groups) if g[0] == lang] for lang in of_lang}
    shared = kept.sparkSession.sparkContext.broadcast((groups, np.array(of_group, np.int64), of_lang, {k: (v[0], len(v)) for k, v in place.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, of_group, of_lang, place = shared.value
        tiles: dict[tuple[str, int, int], np.ndarray] = {}
        best: dict[int, tuple[np.ndarray, list[bytes]]] = {}

        def rows(part: str, held: list[tuple[int, str, int]]) -> pa.RecordBatch:
            lang, source = ([groups[g][k] for g, _, _ in held] for k in (0, 1))
            cols = [pa.array(x, pa.string()) for x in (lang, source, [part] * len(held), [i for _, i, _ in held])]
            return pa.RecordBatch.from_arrays([*cols, pa.array([v for _, _, v in held], pa.int64())], names=["lang", "source", "part", "item", "value"])

        def pairs() -> Iterator[pa.RecordBatch]:
            for (lang, a, b), sums in tiles.items():
                base = place[lang][0]
                for i, row in enumerate(sums.tolist()):
                    g = base + a * TILE + i
                    yield rows("pair", [(g, groups[base + b * TILE + j][1], x) for j, x in enumerate(row) if base + b * TILE + j != g])
            tiles.clear()

        def look(lang: str, names: list[bytes], matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
            base, size = place[lang]
            n, v = of_lang[lang]
            p, q = shares(matrix, of_group[base : base + size], v), shares(matrix.sum(1), n, v)
            for a in range(0, size, TILE):
                for b in range(0, size, TILE):
                    sums = tiles.setdefault((lang, a // TILE, b // TILE), np.zeros((min(TILE, size - a), min(TILE, size - b)), np.int64))
                    other = p[:, b : b + TILE]
                    for i in range(len(sums)):
                        sums[i] += np.abs(other - p[:, a + i : a + i + 1]).sum(0)
                    if len(tiles) >= TILES:
                        yield from pairs()
            above = np.where(matrix > 0, p - q[:, None], 0)
            for s in np.flatnonzero((above > 0).any(0)):
                found = np.flatnonzero(above[:, s] > 0)
                values, known = best.get(base + s, (np.zeros(0, np.int64), []))
                values, known = np.r_[values, above[found, s]], known + [names[k] for k in found]
                chosen = np.argsort(-values, kind="stable")[:top]  # terms come in order, so the first of equals stays
                best[base + s] = values[chosen], [known[k] for k in chosen]

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names, sources, counts = (batch.column(k).to_pylist() for k in ("term", "sources", "counts"))
            at = 0
            while at < len(langs):
                base, size = place[langs[at]]
                end, most = at + 1, at + max(1, CELLS // size)
                while end < len(langs) and end < most and langs[end] == langs[at]:
                    end += 1
                matrix = np.zeros((end - at, size), np.int64)
                for k in range(at, end):
                    matrix[k - at, np.array(sources[k]) - base] = counts[k]
                yield from look(langs[at], names[at:end], matrix)
                at = end
        yield from pairs()
        for g, (values, known) in best.items():
            yield rows("term", [(g, t.decode(), x) for t, x in zip(known, values.tolist(), strict=True)])
        release()

    return kept.mapInArrow(run, "lang string, source string, part string, item string, value bigint")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (language, source) group of docs."""
    rows = docs.select(*[empty_text(F.col(f"`{c}`").cast("string")).alias(k) for k, c in (("lang", lang), ("source", source), ("text", text))])
    named = Kept(rows.select("lang", "source").distinct(), "terms-groups").df
    groups = sorted(((r["lang"], r["source"]) for r in named.collect()), key=lambda g: (g[0].encode(), g[1].encode()))
    number = {g: k for k, g in enumerate(groups)}
    leaves = Kept(count_terms(rows, number), "terms-leaves")
    kept = Kept(merge_tries(leaves.df, min_docs), "terms-kept").df
    leaves.drop()
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v")).collect()  # a row a language
    per = kept.select(F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("x.sources").agg(F.sum("x.counts").alias("n")).collect()  # a row a group
    of_group = [0] * len(groups)
    for r in per:
        of_group[r["sources"]] = r["n"]
    of_lang = {r["lang"]: (sum(of_group[k] for g, k in number.items() if g[0] == r["lang"]), r["v"]) for r in sizes}
    if any(n + SMOOTH * v >= 9 * 10**15 for n, v in of_lang.values()):
        raise OverflowError("a language has more occurrences than the shares' 64 bits hold")
    found = Kept(compare(kept, groups, of_group, of_lang, top), "terms-found").df
    # every pair is part of the result, with 0 where its language keeps no term
    other = named.select(F.col("lang").alias("_lang"), F.col("source").alias("item"))
    every = named.join(other, (F.col("lang") == F.col("_lang")) & (F.col("source") != F.col("item"))).select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = found.where("part = 'pair'").select("lang", "source", "item", "value").unionByName(every)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(found.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
