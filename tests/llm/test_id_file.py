"""The token-id file: format round trips, and the write-read query against direct encoding."""

import io
import zlib

import numpy as np
import pytest

from loglathe.llm import id_file, queries, token_output, tokens


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 300_000])
@pytest.mark.parametrize("high", [1, 2, 50257, 2**32])
def test_round_trip(n, high):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    if n > 10:
        ids[::97] = 2**32 - 1  # outliers for the exception lists
    out = io.BytesIO()
    writer = id_file.Writer(out)
    docs, at = [], 0
    for i, cut in enumerate([*np.sort(rng.integers(0, n + 1, 20)).tolist(), n]):
        docs.append((None if i == 3 else i - 5, ids[at:cut]))
        writer.add(*docs[-1])
        at = cut
    writer.finish()
    reader = id_file.Reader(out)
    got = list(reader.documents())
    assert [(d, x.tolist()) for d, _, x in got] == [(d, x.tolist()) for d, x in docs]
    assert reader.ids(n // 3, n // 2).tolist() == ids[n // 3 : n // 2].tolist()


def test_outliers_do_not_widen_blocks():
    ids = np.arange(100_000, dtype=np.uint32) % 256
    plain = sum(map(len, id_file.encode_blocks(ids)))
    ids[::1000] = 2**31
    assert sum(map(len, id_file.encode_blocks(ids))) < 1.05 * plain < 1.2 * 100_000


def test_damage_is_found():
    out = io.BytesIO()
    writer = id_file.Writer(out)
    writer.add(1, np.arange(10, dtype=np.uint32))
    writer.finish()
    raw = bytearray(out.getvalue())
    raw[-45] ^= 1
    with pytest.raises(ValueError):
        id_file.Reader(io.BytesIO(bytes(raw)))
    with pytest.raises(ValueError):
        id_file.Reader(io.BytesIO(b"other" + bytes(raw)))


def test_damaged_blocks_are_found_and_parts_are_read_alone():
    out = io.BytesIO()
    writer = id_file.Writer(out)
    docs = [(i, np.arange(i * 37, dtype=np.uint32)) for i in range(1, 200)]
    for d, ids in docs:
        writer.add(d, ids)
    writer.finish()
    tokens_n = sum(len(x) for _, x in docs)
    for step in (1, 5000, 100_000, tokens_n):
        got = [d for low in range(0, tokens_n, step * 700 if step == 1 else step) for d in id_file.Reader(out).documents(low, low + (700 if step == 1 else step))]
        assert [(d, x.tolist()) for d, _, x in got] == [(d, x.tolist()) for d, x in docs]
    raw = bytearray(out.getvalue())
    raw[len(raw) // 3] ^= 1
    with pytest.raises(ValueError, match="damaged block"):
        list(id_file.Reader(io.BytesIO(bytes(raw))).documents())


def test_query(spark, monkeypatch):
    monkeypatch.setattr(token_output, "FILE_BYTES", 20_000)
    path = queries.tokenizer("byte_bpe_50k.json")
    rows = [(i * 7 % 101, f"Text {i}, with words.\nAnd  more " * (i % 5)) for i in range(101)] + [(200, None), (None, "none"), (5, "twice"), (5, "twice"), (300, "long word " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = token_output.round_trip(df, path).orderBy("start").collect()
    tok = tokens.Encoder(path, True).tok
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    start = 0
    known = {}
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        known.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert r["start"] == start and (r["n_tokens"], r["ids_crc32"]) in known[r["doc_id"]]
        start += r["n_tokens"]
    assert token_output.round_trip(df.limit(0), path).count() == 0
