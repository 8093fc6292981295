"""Golden values and properties of the scalar functions."""

import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loglathe.functions import endpoint, text
from loglathe.functions.entropy import shannon_entropy

#: input, class, levels 1 to 4
MASKS = [
    ("192.168.2.23", 0, "192.168.2.xx", "192.168.x.xx", "192.xxx.x.xx", "xxx.xxx.x.xx"),
    ("10.0.0.1:8080", 0, "10.0.0.x:8080", "10.0.x.x:8080", "10.x.x.x:8080", "xx.x.x.x:8080"),
    ("[10.0.0.1]:80", 0, "[10.0.0.x]:80", "[10.0.x.x]:80", "[10.x.x.x]:80", "[xx.x.x.x]:80"),
    ("1.2.3.4%eth0", 0, "1.2.3.x%eth0", "1.2.x.x%eth0", "1.x.x.x%eth0", "x.x.x.x%eth0"),
    ("10.0.0.0/24", -1, *["10.0.0.0/24"] * 4),
    ("2001:db8:85a3:0:0:8a2e:370:7334", 1, "2001:db8:85a3:0:0:8a2e:xxx:xxxx", "2001:db8:85a3:0:x:xxxx:xxx:xxxx", "2001:db8:xxxx:x:x:xxxx:xxx:xxxx", "xxxx:xxx:xxxx:x:x:xxxx:xxx:xxxx"),
    ("2001:db8::1", 1, "2001:db8::x", "2001:db8::x", "2001:db8::x", "xxxx:xxx::x"),
    ("::1", 1, *["::x"] * 4),
    ("fe80::1%eth0", 1, "fe80::x%eth0", "fe80::x%eth0", "fe80::x%eth0", "xxxx::x%eth0"),
    ("[2001:db8::1]:443", 1, "[2001:db8::x]:443", "[2001:db8::x]:443", "[2001:db8::x]:443", "[xxxx:xxx::x]:443"),
    ("::ffff:192.168.1.1", 1, *["::xxxx:xxx.xxx.x.x"] * 4),
    ("1::2::3", 1, *["1::2::3"] * 4),
    ("1:2:3:4:5:6:7::", 1, "1:2:3:4:5:6:7::", "1:2:3:4:5:x:x::", "1:2:3:x:x:x:x::", "1:x:x:x:x:x:x::"),
    ("2001:db8:0:0:0:0:0:1:443", 1, "2001:db8:0:0:0:0:0:x:xxx", "2001:db8:0:0:0:x:x:x:xxx", "2001:db8:0:x:x:x:x:x:xxx", "2001:xxx:x:x:x:x:x:x:xxx"),
    ("[fe80::1]/64", 1, "[fe80::x]/64", "[fe80::x]/64", "[fe80::x]/64", "[xxxx::x]/64"),
    ("fe80::1/64", -1, *["fe80::1/64"] * 4),
    ("www.example.com", -1, *["www.example.com"] * 4),
    ("face:80", 1, *["xxxx:xx"] * 4),
    ("999.1.1.1", 0, "999.1.1.x", "999.1.x.x", "999.x.x.x", "xxx.x.x.x"),
    ("", -1, *[""] * 4),
    ("1.2.3.4%", -1, *["1.2.3.4%"] * 4),
    ("1.2.3.4%__", -1, *["1.2.3.4%__"] * 4),
    (None, -1, *[""] * 4),
]


def _one(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(column(F.col("v")).alias("r"), "i").orderBy("i").select("r").collect()]


def test_masks(spark):
    values = [m[0] for m in MASKS]
    assert _one(spark, values, endpoint.classify_ip) == [m[1] for m in MASKS]
    for level in range(1, 5):
        assert _one(spark, values, lambda c, k=level: endpoint.anon_ip(c, k)) == [m[1 + level] for m in MASKS]
    assert _one(spark, values, lambda c: endpoint.anon_ip(c, 0)) == [m[0] or "" for m in MASKS]


def test_mask_options(spark):
    assert _one(spark, ["10.0.0.10/24", "fe80::1/64", "x/24"], lambda c: endpoint.anon_ip(c, 1, strict=True)) == ["10.0.0.xx/24", "fe80::x/64", "x/24"]
    assert _one(spark, ["192.168.2.23"], lambda c: endpoint.anon_ip(c, 1, collapse=True)) == ["192.168.2.x"]


def _offset_mask(address, level):
    """Masking of an IPv6 address by hextet places rather than by tokens."""
    tokens = address.split(":")
    u = min(2 * level, 8)
    if "::" not in address:
        return ":".join("x" * len(t) if i >= len(tokens) - min(u, len(tokens)) else t for i, t in enumerate(tokens))
    left, right = ([] if s == "" else s.split(":") for s in address.split("::"))
    full = left + [None] * (8 - len(left) - len(right)) + right
    out = ["x" * len(t) if t is not None and i >= 8 - u else t for i, t in enumerate(full)]
    return ":".join(out[: len(left)]) + "::" + ":".join(out[len(full) - len(right) :] if right else [])


def test_mask_by_places(spark):
    import random

    r = random.Random(3)
    hextet = lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4)))
    values = []
    for _ in range(400):
        n = r.randint(0, 6)
        a = r.randint(0, n)
        values.append(":".join(hextet() for _ in range(a)) + "::" + ":".join(hextet() for _ in range(n - a)) if r.random() < 0.8 else ":".join(hextet() for _ in range(8)))
    values = [v for v in values if v.count(":") > 1]
    for level in range(1, 5):
        got = _one(spark, values, lambda c, k=level: endpoint.anon_ip(c, k))
        assert got == [_offset_mask(v, level) for v in values]
        assert list(map(len, got)) == list(map(len, values))


def test_resource(spark):
    values = ["/a?b=1", "/a?b?c\nd", "", None, "x" * 562, "y" * 80 + "m" * 200 + "z" * 479, "é" * 400]
    got = _one(spark, values, text.normalize_resource)
    assert got[:5] == ["/a?", "/a?", "NULL", "NULL", "x" * 562]
    assert got[5] == "y" * 80 + "..." + "z" * 479
    raw = ("é" * 400).encode()
    assert got[6] == "é" * 40 + "..." + raw[-479:].decode(errors="replace")
    assert _one(spark, ["x" * 563], lambda c: text.truncate_middle(c, "char")) == ["x" * 80 + "..." + "x" * 479]


def test_clip(spark):
    assert _one(spark, ["a" * 100, "é" * 40, None, "b"], text.clip_endpoint) == ["a" * 79, "é" * 39 + "\ufffd", "", "b"]


def test_timestamp(spark):
    values = [13400000000123456, 1780008801123456, 11644473600000000, 11644473599999999, 11644473600000000 + 86_400_000_000 * 20_000 - 1]
    assert _one(spark, values, text.format_ts, "long") == ["2025-08-18T14:13:20.123456Z", "NULL", "1970-01-01T00:00:00.000000Z", "NULL", "2024-10-03T23:59:59.999999Z"]
    assert _one(spark, [1780008801123456], lambda c: text.format_ts(c, "unix"), "long") == ["2026-05-28T22:53:21.123456Z"]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert _one(spark, values[:1], text.format_ts, "long") == ["2025-08-18T14:13:20.123456Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_codes(spark):
    assert _one(spark, [1, 38, 39, 0], text.verb_name, "int") == ["GET", "UPDATE-REDIRECT-REF", "39", "UNKNOWN"]
    assert _one(spark, [65736, 200, 65535], text.narrow_u16, "long") == [200, 200, 65535]
    assert _one(spark, [0xC0A80217, 0], text.dotted_quad, "long") == ["192.168.2.23", "0.0.0.0"]


def test_line(spark):
    df = spark.range(1).select(text.format_line(
        F.lit(31), F.lit("2024-02-29T23:59:59.000001Z"), F.lit("/shop/item?"), F.lit("host7.example.net"), F.lit(404),
        F.lit("PATCH"), F.lit(12), F.lit(3), F.lit(129),
    ))
    assert df.first()[0] == "[31] [2024-02-29T23:59:59.000001Z] [/shop/item?] [host7.example.net] [404] [PATCH] [12ms] [3b] [129]"


def test_entropy(spark):
    values = ["", None, "aaaa", "abcd", "héé", "http://example.org/a?b=1"]

    def h(s):
        raw = s.encode()
        return sum(-n / len(raw) * math.log2(n / len(raw)) for n in Counter(raw).values())

    for got, v in zip(_one(spark, values, shannon_entropy), values, strict=True):
        assert got is None if v is None else got == pytest.approx(h(v), abs=1e-9)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="0123456789abcdef.:%[]/x", max_size=24), min_size=5, max_size=40))
def test_masking_keeps_lengths(spark, values):
    for level in (1, 4):
        for before, after in zip(values, _one(spark, values, lambda c, k=level: endpoint.anon_ip(c, k)), strict=True):
            assert len(after) == len(before)
            assert all(a in (b, "x") for a, b in zip(after, before, strict=True))


def test_masks_take_each_step_once(spark):
    """Steps that are written out at every place of use multiply, and code of that size runs uncompiled."""
    rows = spark.range(1).select(F.col("id").cast("string").alias("s"))
    for level in range(1, 5):
        plan = rows.select(endpoint.anon_ip(F.col("s"), level).alias("m"))._jdf.queryExecution().optimizedPlan().toString().lower()
        assert plan.count("rlike") == 1 and len(plan) < 8_000
