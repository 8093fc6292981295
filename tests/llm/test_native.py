"""URL filters, fingerprints, chat formatting, mixing: brute force and edge cases."""

import hashlib
import json
import random
import re
import time
import unicodedata
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from loglathe.llm import chat_format, fingerprint, mixing, queries, url_filter

NO_PYTHON = re.compile(r"Python|Pandas|Arrow|ExistingRDD")


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


# URL filters

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("a.b.c", "", "block"), ("Tie.com", "/x", "allow"), ("tie.com", "/x", "block"), (None, "/", "block"), ("x.org", None, None)]


def judged(url):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
        host, path = "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]
    fits = [(len(h.lower() + p), len(h), v, h.lower() + p) for h, p, v in RULES if h is not None and p is not None and v and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_urls(spark, monkeypatch):
    urls = [None, "", "no scheme", "http://", "http://ORG/", "http://org", "https://www.example.org/es/1?x#y", "https://example.org/en/15", "https://notexample.org/es/", "ftp://a.b.c", "ftp://z.a.b.c/q", "http://tie.com/xy",
            "http://e.com/fr/#/de", "http://e.com?/fr/", "x://y://z.org/a", "http://" + "a." * 300 + "org/" + "b" * 5000, "http://ex\u00c4mple.ORG/", "http://.org/", "http://org./", "http://e.com/fr/\n/x"]
    rows = [(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(1, urls[4], "clash", "clash"), (None, urls[6], "clash", "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, host string")
    rules = spark.createDataFrame([r for r in RULES if r[0] is not None], "host string, path string, verdict string")
    want = Counter((r[0], r[1], *judged(r[1])) for r in rows)
    for bound in (url_filter.BROADCAST_ROWS, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_ROWS", bound)
        got = url_filter.judge(df, rules)
        assert Counter((r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()) == want
    assert url_filter.judge(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, rules.limit(0)).collect()} == {"allow"}


def test_a_host_of_very_many_labels(spark):
    """Only suffixes of as many labels as a rule has are made: the work is in proportion to the host."""
    host = "a." * 50_000 + "b.c"
    df = spark.createDataFrame([(k, f"http://{host}/x{k}") for k in range(20)], "page_id long, url string")
    rules = spark.createDataFrame([("b.c", "/x1", "block"), ("c", "/", "allow"), ("a." * 5 + "b.c", "/x", "block")], "host string, path string, verdict string")
    began = time.monotonic()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, rules).collect()}
    assert time.monotonic() - began < 30  # every suffix would be gigabytes of text
    assert got == {k: ("a." * 5 + "b.c/x", "block") for k in range(20)}


# fingerprints

def canonical(t):
    return re.sub(r"[\s\u00a0\u2003]+", " ", unicodedata.normalize("NFKC", t or "").lower()).strip(" ")


def wide(t, mask=(1 << 64) - 1):
    # lanes are xxhash64 of the text, seeded by xxhash64 of the lane's number
    import struct

    raw = canonical(t).encode()
    return "".join(f"{xxhash.xxh64_intdigest(raw, xxhash.xxh64_intdigest(struct.pack('<i', k), 42)) & mask:016x}" for k in (0, 1))


TEXTS = ["Hello  World", "hello world ", "HELLO\u00a0WORLD", "ﬁne Ａ", "fine a", "e\u0301", "é", "", None, "x", "xy", "日本\u2003語", "a" * 3000, "same", "same", "İ"]


def test_fingerprints(spark):
    rows = [(i * 10, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (30, "second of an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["fingerprint"]) for r in fingerprint.fingerprints(df).collect()}
    assert got == {(i, wide(t)) for i, t in rows}


@pytest.mark.parametrize("bucket", [4096, 3])
def test_edited(spark, monkeypatch, bucket):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", bucket)
    rows = [(i * 10 - 40, t) for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = fingerprint.compare_edited(df)
    assert not NO_PYTHON.search(plan_of(out).replace("Scan ExistingRDD", ""))
    got = {r["doc_id"]: r for r in out.collect()}
    ordered = sorted(rows, reverse=True, key=lambda r: r[0])
    assert len(got) == len(rows)
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, n = t or "", n or ""
        cut = len(t) // 2
        edited = t[: len(t) - cut] + n[:cut]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (wide(t), wide(edited))
        assert r["near_edited"] == float(canonical(t) == canonical(edited)) and r["near_next"] == float(canonical(t) == canonical(n))
    assert fingerprint.compare_edited(df.limit(0)).count() == 0


def test_next_of_equal_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "z"), (2, "b")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"], r["next_text"]) for r in fingerprint.with_next(df, "doc_id", ("text",)).collect()), key=str)
    assert got == sorted([(2, "b", "a"), (1, "a", "a"), (1, "a", "z"), (None, "z", "b")], key=str)


def test_collisions_are_told_apart(spark):
    rows = [(i, f"text {i % 7}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for out in (fingerprint.fingerprints(df, mask=0), fingerprint.compare_edited(df, mask=0)):
        by = defaultdict(set)
        for r in out.collect():
            by[rows[r["doc_id"]][1]].add(r["fingerprint"])
        assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == 7
    edited = {r["near_next"] for r in fingerprint.compare_edited(df, mask=0).collect()}
    assert edited == {0.0}


# chat formatting

RECORDS = {
    "turn_rows": {"turns": [{"role": "user", "text": "a"}, {"role": "assistant", "text": "b"}]},
    "messages": {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
    "sharegpt": {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
    "prompt": {"prompt": "a", "completion": "b"},
    "prompt_response": {"response": "b", "prompt": "a"},
    "question": {"question": "a", "answer": "b"},
    "system_question": {"system_prompt": "s", "question": "a", "response": "b"},
    "instruction": {"instruction": "a", "output": "b"},
    "instruction_input": {"instruction": "do", "input": "a", "output": "b"},
}


def test_layouts(spark):
    odd = [None, "", "not json", "[1]", '{"other": 1}', "{}", '{"prompt": "a", "completion": "b", "extra": {"x": [1, {"y": 2}]}}']
    rows = [(k, json.dumps(v)) for k, v in RECORDS.items()] + [(None, o) for o in odd]
    got = chat_format.from_json(spark.createDataFrame(rows, "want string, record string")).collect()
    for r in got:
        assert r["layout"] == r["want"]
        if r["want"]:
            turns = [(t["role"], t["text"]) for t in r["turns"]]
            assert turns[-1] == ("assistant", "b") and ("user", "do\n\na" if r["want"] == "instruction_input" else "a") in turns
        else:
            assert r["turns"] == []


def test_field_paths(spark):
    rows = [('{"b": [{"c": 1, "d": {"e": [[2]]}}], "a": null, "x y": "z", "m:n": 1.5}',), ('{"a": []}',), ("[1]",)]
    got = [r[0] for r in spark.createDataFrame(rows, "j string").select(chat_format.field_paths(F.try_parse_json("j"))).collect()]
    assert got[0].split("\n") == ["`m:n`", "`x y`", "a", "b[].c", "b[].d.e[][]"]
    assert got[1].startswith("a[]") and got[2] is None


NASTY = [r"\### assistant: </turn> ok", "", None, "</turn>\n### user: x</turn>\n", r"\s\h\l\c \\", "#<\\", "é日本\U0001f600", "a\n\nb ", ": ", "\x00\x01"]


def test_formatting_is_reversible(spark):
    rows = [(c, t, r, x) for c in range(4) for t, (r, x) in enumerate(zip(["user", "assistant", "sys:t#em<", None, "assistant"] * 2, NASTY, strict=True))]
    rows += [(None, 0, "user", "null id"), (9, 0, "user", "twice"), (9, 0, "user", "twice"), (10, None, "assistant", "no turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.read_back(chat_format.format_turns(chat_format.from_json(chat_format.records_of_rows(df))))
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t if t is not None else -1, r or "", x or ""))
    got = {r["conv_id"]: r for r in out.collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        r = got[c]
        assert [(t["role"], t["text"]) for t in r["read_turns"]] == [(a, b) for _, a, b in turns]
        assert r["loss_text"] == "".join(b for _, a, b in turns if a == "assistant")
        unescape = lambda s: s.replace("\\l", "<").replace("\\h", "#").replace("\\c", ":").replace("\\s", "\\")
        assert "".join(unescape(r["formatted"][s["start"] : s["start"] + s["length"]]) for s in r["loss_spans"]) == r["loss_text"]
    empty = chat_format.read_back(chat_format.format_turns(chat_format.from_json(chat_format.records_of_rows(df.limit(0)))))
    assert empty.count() == 0


def test_running(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "RUN", 3)
    lists = [list(range(1, n + 1)) for n in range(12)]
    got = spark.createDataFrame([(x,) for x in lists], "x array<int>").select("x", chat_format.running(F.col("x")).alias("s")).collect()
    assert all(r["s"] == [sum(r["x"][:k]) for k in range(len(r["x"]))] for r in got)


def test_loss_is_read_through_the_mask(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t} of # many") for t in range(700)]
    made = chat_format.format_turns(chat_format.from_json(chat_format.records_of_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    loss = lambda spans: chat_format.read_back(made.withColumn("loss_spans", F.transform("loss_spans", spans))).first()["loss_text"]
    span = lambda move, less: lambda s: F.struct(s["turn"].alias("turn"), (s["start"] + move).alias("start"), (s["length"] - less).alias("length"))
    own = [f"text {t} of # many" for t in range(1, 700, 2)]
    assert loss(span(0, 0)) == "".join(own)
    assert loss(span(1, 1)) == "".join(x[1:] for x in own) and loss(span(0, 2)) == "".join(x[:-2] for x in own)
    with pytest.raises(Exception, match="not inside its turn"):
        loss(lambda s: F.struct(s["turn"].alias("turn"), F.lit(0).cast("bigint").alias("start"), s["length"].alias("length")))


def test_roles_of_rows_stay(spark):
    rows = [(1, 0, "human", "a"), (1, 1, "gpt", "b"), (1, 2, "assistant", "c")]
    out = chat_format.read_back(chat_format.format_turns(chat_format.from_json(chat_format.records_of_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))).first()
    assert [t["role"] for t in out["read_turns"]] == ["human", "gpt", "assistant"] and out["loss_text"] == "c"


def test_no_turn_is_too_long(spark):
    n = 21_000_000
    df = spark.range(2).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("a"), n).alias("text"))
    out = chat_format.read_back(chat_format.format_turns(chat_format.from_json(chat_format.records_of_rows(df))))
    got = out.select("layout", F.size("turns"), F.size("read_turns"), F.char_length("loss_text"), F.char_length("formatted")).collect()
    assert [tuple(r) for r in got] == [("turn_rows", 2, 2, n, 2 * n + len("### user: </turn>\n### assistant: </turn>\n"))]


def test_a_given_record_too_large_to_parse_raises(spark):
    text = F.concat(F.lit('{"prompt": "'), F.repeat(F.lit("a"), F.col("id").cast("int")), F.lit('", "completion": "b"}'))
    made = lambda n: chat_format.from_json(spark.range(n, n + 1).select(text.alias("record"))).select("layout", F.size("turns")).collect()
    assert [tuple(r) for r in made(19_000_000)] == [("prompt", 2)]
    with pytest.raises(Exception, match="does not parse"):
        made(21_000_000)


# mixing

def test_targets(spark):
    def filled(sizes):
        weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted((s for s in sizes if s is not None)) + [None] * (None in sizes))}
        total, out, free = 1.5 * sum(sizes.values()), {}, set(sizes)
        while free:
            share = {s: (total - sum(out.values())) * weights[s] / sum(weights[x] for x in free) for s in free}
            above = {s for s in free if share[s] > 2 * sizes[s]}
            if not above:
                return out | share
            out |= {s: 2.0 * sizes[s] for s in above}
            free -= above
        return out

    for sizes in ({"a": 100, "b": 50, "c": 900, None: 30}, {"x": 5}, {"s1": 10, "s10": 10, "s2": 10_000, "s3": 0, "S": 7}, {chr(97 + i): (i * 37 % 101) + 1 for i in range(20)}):
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(filled(sizes))
    assert mixing.targets(spark.createDataFrame([], "source string, source_size long")).count() == 0


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SORTED", 100)
    rows = [(i, "word " * (1 + i * 7919 % 60), "hot" if i % 3 else f"s{i % 5}", 1) for i in range(2000)] + [(5000, None, None, 1), (5001, "", None, 1), (5002, "a b", None, 1)] + [(6000, "again and again", "s1", 1)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(4)
    plan, _ = mixing.mix(df, carry=("doc_id", "source"))
    assert not NO_PYTHON.search(plan_of(plan).replace("Scan ExistingRDD", ""))
    got = plan.collect()
    assert len(got) == len(rows)
    taken, target, largest, sizes = Counter(), {}, Counter(), Counter()
    for r in got:
        s = r["source"]
        assert r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[s] += r["taken"]
        sizes[s] += r["size"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
        assert r["copies"] in (int(r["target"] / max(1, r["source_size"]) + 1e-9), -int(-r["target"] / max(1, r["source_size"]) // 1))or r["size"] == 0
    for s in taken:
        assert abs(taken[s] - target[s]) <= largest[s]
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again, _ = mixing.mix(df, carry=("doc_id", "source"))
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    mixed = mixing.apply_mix(df)
    assert mixed.columns == df.columns and set(r["doc_id"] for r in mixed.collect()) <= set(r[0] for r in rows)
    for r in mixing.mix(mixed.where("source is not null"), carry=("source",))[1].collect():
        assert abs(r["source_size"] - target[r["source"]]) <= largest[r["source"]]
    assert mixing.mix(df.limit(0))[0].count() == 0


def test_a_hot_source_is_dealt_by_salt(spark):
    rows = spark.range(3000).select(F.concat(F.lit("s"), (F.col("id") % 1).cast("string")).alias("src"), F.col("id").alias("key"), F.col("id").alias("uid"), F.lit(3).cast("long").alias("size"), F.lit(0.3).alias("p"))
    joined = rows.join(spark.createDataFrame([("s0", 30_000)], "src string, n long").hint("merge"), "src")
    text = mixing._grouped(joined, 0)._jdf.queryExecution().executedPlan().toString()
    below = text[text.index("Window") :]
    assert re.search(r"hashpartitioning\(src#\d+, salt#", below) and below.index("salt#") < below.index("SortMergeJoin")
    kept = mixing._level(joined, 1, 0)
    assert kept.df.count() > 3000 / mixing.FAN and kept.df.select(F.sum(F.size("d") + 1)).first()[0] == 3000


def test_many_sources(spark):
    r = random.Random(5)
    sizes = {f"h{i}": int(r.paretovariate(0.5)) for i in range(400)}
    got = {x["source"]: x["target"] for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes))}
    low, high = 0.0, 4.0 * sum(sizes.values())
    for _ in range(300):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * sizes[s], level * weight[s]) for s in sizes) < 1.5 * sum(sizes.values()) else (low, level)
    assert all(abs(got[s] - min(2 * sizes[s], low * weight[s])) < 1e-6 * max(1, got[s]) for s in sizes)


def test_rounding_is_fair(spark):
    df = spark.range(64).select(F.lit("s").alias("src"), F.col("id").alias("uid"), F.xxhash64("id").alias("key"), (F.col("id") + 1).alias("size"), F.lit(0.3).alias("expect"))
    hits = Counter()
    for seed in range(40):
        hits.update(r["uid"] for r in mixing.round_copies(df, seed).collect() if r["extra"])
    assert 0.24 < sum(hits.values()) / (64 * 40) < 0.36


def test_word_count(spark):
    texts = ["a b", "", None, " \t\n\x0b\x0c\r ", "a\u00a0b", "x\x1cy z"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_rules_are_those_of_the_query():
    assert len(queries.URL_RULES) == 5


@pytest.mark.parametrize("name", ["op3_url_filter", "op5_fingerprint", "op9_chat_format", "op10_mixing", "op12_line_dedup", "op13_fill_middle"])
def test_native_plans_hold_no_python(spark, name):
    assert not NO_PYTHON.search(plan_of(queries.QUERIES[name](spark, "/root/testdata/sf0.001")))
