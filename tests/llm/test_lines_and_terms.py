"""Line deduplication, fill-in-the-middle, source divergence: brute force and edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loglathe.llm import fill_middle, line_dedup, source_divergence
from loglathe.llm.radix_trie import Trie

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# line deduplication

def deduplicated(rows, min_chars=20, min_docs=3):
    """(id, text) rows -> (id, lines, dropped, kept text) of each."""
    low = float("-inf")
    holders = defaultdict(set)
    key = lambda line: line.translate(LOWER).strip(SPACE)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(low if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != (low if i is None else i) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return Counter(out)


def found(df, **limits):
    return Counter(tuple(r) for r in line_dedup.dedup_lines(df, **limits).select("doc_id", "n_lines", "n_dropped", "kept").collect())


A, B, C = "the first line of more than twenty", "Ein zweiter Satz, länger als zwanzig", "ÀÉ third line that is long enough"


@pytest.mark.parametrize("range_rows", [500_000, 7])
def test_lines(spark, range_rows):
    rows = [
        (1, f"{A}\nshort\n  {A.upper()} \t\n{B}"), (2, f"{A}\n\n{C}"), (3, f"x\n{A}\r\n{A}"), (4, f"{B}\n{C}\n{C.lower()}"), (5, f"{B}"), (-6, f"{B}\n"),
        (7, None), (8, ""), (9, "\n\n"), (None, f"{A}\n{C}"), (2, f"{C}\n{A}\nother text of the same id"), (3, f"x\n{A}\r\n{A}"), (10, "a" * 19 + "\n" + "a" * 20),
        (11, "a" * 20), (12, "A" * 20 + " "), (13, "a" * 19),
    ]
    clashing = "doc_id long, text string, n_lines string, kept string, rid string, slices string"
    df = spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], clashing).repartition(5)
    assert found(df, range_rows=range_rows) == deduplicated(rows)
    assert found(df, range_rows=range_rows, min_docs=2, min_chars=1) == deduplicated(rows, 1, 2)
    assert found(df.limit(0)) == Counter()
    everything = line_dedup.dedup_lines(df, carry=tuple(df.columns))
    assert everything.columns == ["doc_id", "text", "rid", "slices", "n_lines", "n_dropped", "kept"]


def test_hot_line_is_cut_into_slices(spark):
    """A line of a third of all rows is dealt to many tasks by document, and still one document keeps it."""
    rng = random.Random(5)
    rows = [(i, "\n".join([A] * rng.randint(1, 3) + [f"a line of its own, number {i} {k}" for k in range(4)] + ([C] if i % 400 == 0 else []))) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    lines = line_dedup.keyed_lines(df, "text", "doc_id", 20)
    dealt = line_dedup.sliced(lines, 100)
    hot = dealt.where("slices > 1").groupBy("range", "slice").count().collect()
    assert len(hot) > 5 and max(r["count"] for r in hot) < 600
    assert found(df, range_rows=100) == deduplicated(rows) == found(df)


@pytest.mark.parametrize("places", [[], [0], [0, 1, 2], [5], [1, 3, 5, 6, 7, 200, 20_000, 20_001, 3_000_000], list(range(0, 40_000, 2))])
def test_bitmaps(spark, places):
    df = spark.createDataFrame([(places,)], "places array<int>")
    coded = df.select(line_dedup.runs_of(F.col("places")).alias("runs")).select(line_dedup.encode_runs(F.col("runs")).alias("keep"))
    (flags, size), = coded.select(line_dedup.decode_runs(F.col("keep")), F.octet_length("keep")).collect()
    assert [i for i, kept in enumerate(flags) if not kept] == places and len(flags) == (places[-1] + 1 if places else 0)
    assert size <= 2 * len(places) + 8


def test_long_text_of_lines(spark):
    n = 60_000
    rows = [(k, "\n".join(f"a line that is repeated, number {i}" if i % 2 else f"{i}" for i in range(n))) for k in range(3)]
    out = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r[0], r[1], r[2]) for r in out} == {(0, n, n // 2), (1, n, n // 2), (2, n, 0)} and out == deduplicated(rows)


# fill-in-the-middle

def arranged(i, t, seed=7, rate=100, spm=50, marks=("<P>", "<S>", "<M>")):
    t = t or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not t or any(m in t for m in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, None, t
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    ps, ss, ms = marks
    return (n, "spm", p, m, s, ss + s + ps + p + ms + m) if h[3] % 100 < spm else (n, "psm", p, m, s, ps + p + ss + s + ms + m)


TEXTS = [None, "", "\n", "\n\n\n", "one", "one\n", "a\nb\nc", "a\r\nb\n\nc\n", "holds <P> in it", "x\n<M>", "a <S>", "<", "<\n>P>\nS>\n<", "日本\nü\U0001f600\n" * 5, "z" * 300_000, "line\n" * 50_000]


@pytest.mark.parametrize(("rate", "spm", "marks"), [(100, 50, ("<P>", "<S>", "<M>")), (40, 90, ("<pre>", "<suf>", "<mid>"))])
def test_fill_middle(spark, rate, spm, marks):
    rows = [(k * 100 + i if k else None, t, "clash", "clash") for i, t in enumerate(TEXTS) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, prefix string")
    out = fill_middle.arrange(df, carry=("doc_id", "text"), rate=rate, spm=spm, sentinels=marks)
    got = out.select("doc_id", "text", *fill_middle.RESULTS, fill_middle.restore(F.col("output"), F.col("form"), marks).alias("again")).collect()
    want = Counter((i, t, *(x[:2]), *x[2:]) for i, t, *_ in rows for x in [arranged(i, t, 7, rate, spm, marks)])
    assert Counter(tuple(r)[:-1] for r in got) == want
    assert all(r["again"] == (r["text"] or "") for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.arrange(df.limit(0)).count() == 0


def test_sentinels_must_be_told_apart(spark):
    for marks in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<<P>", "<S>", "<M>")):
        with pytest.raises(ValueError, match="sentinels"):
            fill_middle.arrange(spark.createDataFrame([(1, "x")], "doc_id long, text string"), sentinels=marks)


# source divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audited(rows, min_docs, top):
    """(text, lang, source) rows -> every row of the audit."""
    count, holders, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for t, lang, source in rows:
        t, lang, source = t or "", lang or "", source or ""
        found = TERM.findall(t.translate(LOWER))
        groups[lang].add(source)
        count[lang, source].update(found)
        holders[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in holders[lang].items() if n >= min_docs), key=str.encode)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: share(count[lang, s]) for s in sources}
        q = share(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return Counter(out)


def made(n, sources, seed):
    rng = random.Random(seed)
    words = [*("ab abc abd b ba été étage ETAGE É z zz 日本 日 \U0001f600x don't a1b").split(), *(f"w{k}" for k in range(40))]
    pick = lambda: rng.choice([" ", "\n", "-", ". "]).join(rng.choices(words, k=rng.randint(0, 25)))
    return [(pick(), rng.choice(["en", "fr", "x", None, ""]), f"s{min(rng.randrange(sources), rng.randrange(sources))}" if rng.random() < 0.9 else None) for _ in range(n)]


@pytest.mark.parametrize(("leaves", "tile", "cells"), [(200_000, 512, 1 << 20), (20, 2, 8)])
def test_source_divergence(spark, monkeypatch, leaves, tile, cells):
    monkeypatch.setattr(source_divergence, "TOP", 4)
    for name, value in (("LEAVES", leaves), ("COUNTED", leaves), ("TILE", tile), ("CELLS", cells), ("CHUNK", 64), ("TILES", 3)):
        monkeypatch.setattr(source_divergence, name, value)
    rows = [*made(300, 7, 3), (None, "en", "silent"), ("", "lone", "one"), ("...", "lone", "two"), ("rare words", "rare", "a"), ("rare", "rare", "b"), ("q" * 5000 + " ab " * 400, "en", "s1")]
    rows += rows[:40]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, item string, rank int").repartition(5)
    got = Counter(tuple(r) for r in source_divergence.audit(df, min_docs=9, top=4).collect())
    assert got == audited(rows, 9, 4)
    assert {r[2] for r in got} == {"pair", "term"} and any(r[:3] == ("lone", "one", "pair") and r[4] == 0 for r in got)
    assert source_divergence.audit(df.limit(0)).count() == 0


def test_shares_are_exact():
    import numpy as np

    for c, n, v in ((0, 0, 1), (5, 7, 3), (10**13, 10**15, 10**6), (3 * 10**12 + 1, 3 * 10**12 + 7, 2), (0, 8 * 10**15, 10**9)):
        assert source_divergence.shares(np.array([c]), n, v).tolist() == [1 + 10**9 * (c + 5) // (n + 5 * v)]


def test_tries_merge():
    rng = random.Random(1)
    words = ["".join(rng.choices("abé", k=rng.randint(1, 7))).encode() for _ in range(3000)] + [b"", b"a", b"ab"]
    whole, parts = Trie(), [Trie() for _ in range(4)]
    for k, w in enumerate(words):
        for t in (whole, parts[k % 4]):
            t.add({w: 2}, [(k % 5, {w: 1})])
    for other in parts[1:]:
        parts[0].merge(other)
    told = [[(w, node.docs, sorted(node.counts.items())) for w, node in t.walk()] for t in (whole, parts[0])]
    assert told[0] == told[1] and [w for w, *_ in told[0]] == sorted(set(words))
    want = Counter((w, k % 5) for k, w in enumerate(words))
    assert {(w, s): n for w, _, c in told[0] for s, n in c} == want and whole.leaves == len(set(words))
