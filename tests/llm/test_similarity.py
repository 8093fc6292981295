"""Embedding near-dedup, n-gram join and components against brute force; language ID by held-out accuracy."""

import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import regex
import zstandard

from loglathe.llm import embedding_dedup, language_id, ngram_join, queries, shingles
from loglathe.llm.components import components

components_module = sys.modules["loglathe.llm.components"]


def groups(pairs, nodes=()):
    root = {n: n for n in nodes}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(random.Random(1).randrange(90), random.Random(i).randrange(90)) for i in range(60)], [], [(1, 1)]])
def test_components(spark, edges):
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == groups([e for e in edges if e[0] != e[1]])


def test_files_follow_rows(spark, monkeypatch):
    files = []

    class Counting(components_module.Kept):
        def __init__(self, *args):
            super().__init__(*args)
            files.append(len(list(Path(self.path.removeprefix("file://")).glob("part-*"))))

    monkeypatch.setattr(components_module, "Kept", Counting)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
        assert {r["component_id"] for r in components(edges).collect()} == {0}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    # of the first table, no bound was given
    assert len(files) > 2 and max(files[1:]) <= spark.sparkContext.defaultParallelism


# embeddings

def near(vectors, threshold=0.9):
    links, pairs = Counter(), []
    for i, x in enumerate(vectors):
        for j, y in enumerate(vectors):
            if i != j and x is not None and y is not None and len(x) == len(y):
                x64, y64 = np.array(x, float), np.array(y, float)
                if x64 @ y64 / np.sqrt((x64 @ x64) * (y64 @ y64)) >= threshold:
                    links[i] += 1
                    pairs.append((i, j))
    return links, groups(pairs, range(len(vectors)))


@pytest.mark.parametrize("tile", [8192, 9])
@pytest.mark.parametrize("dim", [1, 3, 8, 64])
def test_embeddings(spark, monkeypatch, tile, dim):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    monkeypatch.setattr(embedding_dedup, "PAIRS", 200)
    monkeypatch.setattr(embedding_dedup, "BAND", 5)
    monkeypatch.setattr(embedding_dedup, "BROADCAST_ROWS", 3 if dim == 3 else 200_000)
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(60, dim))
    noisy = base[rng.integers(0, 12, 60)] + rng.normal(size=(60, dim)) * rng.choice([0, 0.1, 0.35, 0.5], (60, 1))
    vectors = np.vstack([base, noisy]).tolist()
    links, comp = near(vectors)
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == {i: links[i] for i in range(len(vectors))}
    assert {i: r["component_id"] for i, r in got.items()} == comp
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_vectors_are_shuffled_once(spark, monkeypatch):
    # vectors that no low-dimensional range separates, and many times more blocks than on small tables
    monkeypatch.setattr(embedding_dedup, "TILE", 128)
    vectors = np.random.default_rng(5).normal(size=(4000, 64)).astype(np.float32)
    vectors[1::400] = vectors[::400] * 2

    def shuffled():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(stages.apply, range(stages.size()))}

    df = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<float>")
    before = shuffled()
    got = embedding_dedup.near_duplicates(df).collect()
    assert sum(n for stage, n in shuffled().items() if stage not in before) < 10 * len(vectors)
    assert sorted((r["vec_id"], r["component_id"]) for r in got if r["n_links"]) == sorted((i + k, i) for i in range(0, 4000, 400) for k in (0, 1))


def test_copies_share_a_leaf():
    x = embedding_dedup.unit_rows(np.random.default_rng(6).normal(size=(501, 64)))
    space = embedding_dedup.Space(64, x.T @ x, 0.9)
    space.grow(x, 64)
    assert len(space.cut) == 63
    assert space.leaf(x).tolist() == [space.leaf(x[k : k + 1])[0] for k in range(len(x))]


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 1.0]), (6, [1.0, 2.0]), (7, [2.0, 4.0]), (8, [1.0]), (9, [-1.0]), (None, [1.0, 2.0]), (6, [1.0, 2.0]), (10, [0.0, -0.0, 1.0]), (11, [-0.0, 0.0, 1.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in got) == sorted(
        [(str(i), 0, i) for i in (0, 1, 2, 3, 4, 5, 8, 9)] + [("6", 3, 6)] * 2 + [("7", 3, 6), ("None", 3, 6), ("10", 1, 10), ("11", 1, 10)]
    )
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# n-grams

def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def joined(texts):
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return [len(s) for s in sets], groups(pairs, range(len(sets)))


def corpus(seed, n=150):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40 if seed % 2 else 3000)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice((3, 5, 6, 12, 40, 150)))] for _ in range(n // 3)]
    out = []
    for _ in range(n):
        words = list(r.choice(bases[: 3 if r.random() < 0.3 else len(bases)]))
        for _ in range(r.choice((0, 0, 1, 2, 4))):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        if r.random() < 0.3:
            words = words[: len(words) // 2] + passage + words[len(words) // 2 :]
        out.append((" " if r.random() < 0.8 else "\n\t").join(w.upper() if r.random() < 0.1 else w for w in words))
    return out + ["", None, " \n", "a b", "A B", "a  b", "ab", "é é é é É"]


def test_shingles():
    texts = corpus(1) + corpus(2) + ["x" * 5000 + " b c d e f", "a\u00a0b c d e f g", "a b c d e a b c d e a b c d e"]
    names = {}
    for array, known in ((pa.array(texts, pa.string()), texts), (pa.array(texts, pa.string()).slice(7), texts[7:])):
        for t, s in zip(known, shingles.sets(array), strict=True):
            want = frozenset(shingle_set(t))
            assert len(s) == len(want) and (s[1:] > s[:-1]).all()
            assert names.setdefault(shingles.set_id(s), want) == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join(spark, seed):
    texts = corpus(seed)
    sizes, comp = joined(texts)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n int").repartition(4)
    got = {r["doc_id"]: r for r in ngram_join.near_duplicates(df, bits=16).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert {i: got[i]["component_id"] for i in got} == comp
    left = ngram_join.one_of_each(df)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [i for i in comp if comp[i] == i]


def test_join_ids(spark):
    text = "one two three four five six seven"
    rows = [(None, text, "x"), (4, text, "x"), (4, text, "x"), (2, text + " ", "x"), (None, "other words that stand all alone here", "x"), (None, None, "x"), (8, "", "x"), (8, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tid string")
    got = sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in ngram_join.near_duplicates(df).collect())
    assert got == sorted(map(str, [(None, 3, 2), (4, 3, 2), (4, 3, 2), (2, 3, 2), (None, 3, None), (None, 0, None), (8, 0, 8), (8, 0, 8)]))
    left = ngram_join.one_of_each(df)
    assert sorted(map(str, (tuple(r) for r in left.collect()))) == sorted(map(str, [rows[3], rows[4], rows[5], rows[6], rows[7]]))
    twice = spark.createDataFrame([(1, text, "x")] * 3, "doc_id long, text string, tid string")
    assert ngram_join.one_of_each(twice).count() == 1
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0 and ngram_join.one_of_each(df.limit(0)).count() == 0


def test_one_of_each_component_whatever_its_ids(spark):
    own = lambda i: " ".join(f"{w}{i}" for w in "abcdefgh")
    rows = [(None, own(i)) for i in range(50)] + [(None, own(0)), (None, own(1) + " ")] + [(7, own(100)), (7, own(101)), (8, own(101)), (7, own(101))]
    left = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(left) == 52 and sum(r["text"] == own(101) for r in left) == 1
    assert {(r["doc_id"], r["text"].strip()) for r in left} == {(None, own(i)) for i in range(50)} | {(7, own(100)), (7, own(101))}


def test_long_near_copies(spark):
    r = random.Random(0)
    words = [f"w{r.randrange(10**6)}" for _ in range(200_000)]
    other = words[:100_000] + ["changed"] + words[100_001:]
    half = words[:120_000] + [f"v{i}" for i in range(80_000)]  # shares passages, but is not near
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((words, other, half))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()}
    assert got == {0: (199_996, 0), 1: (199_996, 0), 2: (199_996, 2)}


def test_second_round_bounds_of_long_documents(spark):
    # one shared prefix shingle each: no candidates from the first round, so the bounds alone decide
    n = 30_000_000
    found = spark.createDataFrame([(t, s, n, 2, t) for t in (0, 1) for s in (1, 2)], "token long, sid long, n int, l int, pos int")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            got = ngram_join.cross_pairs(found, spark.createDataFrame([], "sid long, root long")).collect()
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")
        assert [tuple(r) for r in got] == [(1, 2)]


def test_prefixes_keep_the_promise():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        x = np.sort(rng.choice(10**6, n, replace=False).astype(np.uint64))
        y = x.copy()
        y[rng.integers(0, n, int(rng.integers(0, max(1, n // 8))))] = rng.integers(10**6, 2 * 10**6)
        y = np.unique(y)
        common = len(np.intersect1d(x, y))
        if 100 * common < 80 * (n + len(y) - common):
            continue
        count = lambda s: (s * np.uint64(2654435761) % np.uint64(50)).astype(np.uint16)
        (p, k), (q, m) = (ngram_join.prefix(count(s), float(rng.integers(0, 40))) for s in (x, y))
        assert len(np.intersect1d(x[p], y[q])) >= min(k, m)


# language

def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_is_the_smallest_size(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(900_000, "x" * 20_000 + " le chat", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    known = language_id.fit(df)
    sizes_of = {}
    for doc, text, _ in docs:
        raw = regex.sub(r"[^\p{L}]+", " ", text.lower()).strip(" ").encode()
        sizes = {}
        for lang, words in known.items():
            sizes[lang] = 0
            for k in range(0, len(raw), 4096):
                told = zstandard.ZstdCompressionParameters.from_level(3, min_match=3, write_content_size=0, write_dict_id=0)
                dictionary = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                sizes[lang] += len(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=told).compress(raw[k : k + 4096]))
        sizes_of[doc] = sizes if raw else {}
    for r in language_id.predict(df, known).collect():
        sizes = sizes_of[r["doc_id"]]
        first, second = sorted(sizes.values())[:2] if sizes else (0, 0)
        assert sizes.get(r["lang_pred"], 0) == first
        assert r["rejected"] == (not sizes or second == first or second - first < 0.2 * first**0.5)


def test_language_edges(spark):
    rows = [(i, "the cat sat on the mat and then it slept " * 3 if i % 2 else "le chat est sur la table et puis il dort " * 3, "en" if i % 2 else "fr") for i in range(40)]
    train = spark.createDataFrame(rows + [(None, "x y z", "zz"), (99, None, "en"), (98, "abc", None)], "doc_id long, text string, lang string")
    known = language_id.fit(train)
    assert sorted(known) == ["en", "fr"]
    test = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "12 !? \U0001f600", "a"), (4, "THE CAT SAT", "a"), (5, "le chat " * 20_000, "a"), (5, "le chat " * 20_000, "a")], "doc_id long, text string, lang_pred string")
    got = sorted((r["doc_id"], r["lang_pred"]) for r in language_id.predict(test, known).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "fr"), (5, "fr")]
    assert {r["lang_pred"] for r in language_id.predict(test, {}).collect()} == {"und"} and language_id.fit(train.limit(0)) == {}
    assert language_id.predict(test.limit(0), known).count() == 0
