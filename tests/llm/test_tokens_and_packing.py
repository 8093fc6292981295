"""Encoding by atoms, piece cutting, and packing plans."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loglathe.llm import packing, queries, tokens

ODD = [
    "", " ", "  ", "a", "a ", " a", "a  b", "x\n y", "x \ny", "\n\n", "\u00e9  e\u0301 x", "it's don't'S 's", "1 23 456 %%% &&", "ΑΣ ΟΔΟΣ", "İstanbul", "\x1c x\x1cy",
    "<|endoftext|> <|startoftext|> a", "日本語 テスト 한국어", "a\t b\r\n c", "a \n  b", "x ' s", "ﬁ ½", "\U0001f600", "abc.\nDef ghi,\n\nJkl", "abc*** déf! x_y, y_ _", "'sun don'",
    "a.b.c, d's. e's'", "end.\n", "\nstart", "a\u00a0 b", "\u00a0", "x\u3000\ny", "tail\u0085", "\x01 a \x01b", "=\u0338 a", "n\u2003.",
]


@pytest.fixture(scope="module", params=[("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def encoder(request):
    return tokens.Encoder(queries.tokenizer(request.param[0]), request.param[1])


def whole(encoder, texts):
    return [x.ids for x in encoder.tok.encode_batch(texts, add_special_tokens=False)]


def split(encoder, texts):
    ids, lens = encoder.encode(texts)
    return [part.tolist() for part in np.split(ids, np.cumsum(lens)[:-1])]


def test_odd_texts(encoder):
    assert split(encoder, ODD) == whole(encoder, ODD)
    assert [split(encoder, [t])[0] for t in ODD] == whole(encoder, ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'abcdeABs*12\u00a0é\u0301"), st.characters(exclude_categories=("Cs",))), max_size=40), min_size=1, max_size=6))
def test_any_text(encoder, texts):
    assert split(encoder, texts) == whole(encoder, texts)


def test_added_tokens_as_in_the_library(encoder):
    fresh = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json" if encoder.spaces else "word_bpe_49k.json"))
    texts = ["Hello <|endoftext|> world", "plain, between", "<|startoftext|>", "a<|endoftext|><|endoftext|>\n b", "", "<|ENDOFTEXT|> <|endoftext |>", "Last. one\u00a0<|endoftext|>", *ODD]
    assert split(encoder, texts) == [x.ids for x in fresh.encode_batch(texts, add_special_tokens=False)]
    assert split(encoder, texts[:1]) == [[15496, 220, 50256, 995] if encoder.spaces else [3306, 49407, 1002]]


def test_small_cache(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ATOMS", 50)
    fresh = tokens.Encoder(queries.tokenizer("word_bpe_49k.json" if not encoder.spaces else "byte_bpe_50k.json"), encoder.spaces)
    for k in range(20):
        texts = [f"word{k} other{j} and the Same, again." for j in range(10)]
        assert split(fresh, texts) == whole(fresh, texts)


def verify(histogram, placed, n, capacity):
    sequences, ranks = defaultdict(list), defaultdict(list)
    for x, first, bins, per, seq, offset in placed:
        ranks[x].append((first, first + bins * per))
        for b in range(bins):
            sequences[seq + b] += [(offset + j * x, x) for j in range(per)]
    for x, count in histogram.items():
        own = sorted(ranks[x])
        assert own[0][0] == 0 and own[-1][1] == count and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
    assert sorted(sequences) == list(range(n))
    for parts in sequences.values():
        at = 0
        for offset, x in sorted(parts):
            assert offset == at
            at += x
        assert at <= capacity


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=300), st.sampled_from([0, 2, 5]))
def test_plans(lengths, groups):
    histogram = dict(Counter(lengths))
    placed, n = packing.plan(histogram, 64, groups)
    verify(histogram, placed, n, 64)
    assert n <= 1.7 * -(-sum(lengths) // 64) + 2


def test_plans_are_near_the_least():
    rng = np.random.default_rng(0)
    for lengths in (np.clip(rng.lognormal(6.3, 1.0, 20000).astype(int), 1, 4096), rng.integers(1300, 1450, 5000), rng.integers(600, 4096, 5000)):
        histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
        best = packing.best_plan(histogram)
        n = 1 + max(p[4] + p[2] - 1 for p in best)
        verify(histogram, best, n, 4096)
        greedy = packing.plan(histogram, 4096, 0)[1]
        assert -(-int(lengths.sum()) // 4096) <= n <= greedy
    assert packing.best_plan({}) == []


def test_pack_documents(spark):
    path = queries.tokenizer("word_bpe_49k.json")
    texts = [None, "", "the same words here"] + ["one two three " * 3000, "the same words here"] + [f"document {i} with some words " * (i % 9) for i in range(200)]
    rows = [(i if i != 7 else None, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack_documents(df, path).collect()
    enc = tokens.Encoder(path, False)
    want = Counter()
    for i, t, _ in rows:
        ids = enc.tok.encode(t or "", add_special_tokens=False).ids + [1]
        for p, s in enumerate(range(0, len(ids), 4096)):
            want[i, p, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(by) <= -(-sum(r["length"] for r in got) // 4096) + 1
    assert packing.pack_documents(df.limit(0), path).count() == 0


def test_words_by_the_model_alone(encoder):
    """Letters of both cases in and outside ASCII, signs between them, marks behind them: the ids are those of the whole library."""
    rng = random.Random(4)
    parts = ["é", "É", "ß", "a", "B", " ", "\n", "ÿ", "Ÿ", "×", "÷", "²", "Ā", "ɏ", "'s", "'", " l'été", "1", "_", "ǅ", "e\u0301", "ª", "İ", " the", " Word"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(800)]
    assert encoder.words is not None and split(encoder, texts) == whole(encoder, texts)
