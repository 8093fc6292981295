"""Kept dictionaries, merged order, sketches, throughput, live telemetry, producers' state."""

import json
import os
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loglathe.operators import batching, kept_dictionary, merge_order, sketches, throughput
from loglathe.schema import EPOCH_1601_US
from loglathe.sources import shard
from loglathe.streaming import producers, telemetry

STORED = "sequence long, timestamp_us long, resource string, endpoint string, http_code int, duration_ms int, response_size int, http_verb short, flags short"


def stored(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [(k + 1, EPOCH_1601_US + 10**15 + k * 300_000, f"/r{min(rng.randrange(90), rng.randrange(90))}", f"10.0.0.{rng.randrange(200)}", rng.choice([200, 404]), rng.randrange(9), 1, 1, 0) for k in range(n)]
    return spark.createDataFrame(rows, STORED)


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


# kept dictionaries

def ids(kept):
    return {(r["kind"], r["value"]): r["id"] for r in kept.entries().collect()}


def test_ids_stay_over_loads(spark, tmp_path):
    rows = stored(spark).unionByName(spark.createDataFrame([(601, None, None, None, None, None, None, None, None)], STORED))
    told = []
    for dealt in (3, 7):  # the same loads, dealt otherwise
        kept = kept_dictionary.KeptDictionary(spark, f"file://{tmp_path}/d{dealt}")
        assert ids(kept) == {} and kept.version().number == 0
        assert kept.insert(rows.limit(0)).number == 0
        assert kept.insert(rows.where("sequence % 3 = 0").repartition(dealt)).number == 1
        first = ids(kept)
        assert kept.insert(rows.repartition(dealt)).number == 2
        again = ids(kept)
        assert first.items() <= again.items() and len(again) > len(first)
        for kind in ("resource", "endpoint"):
            mine = [v for (k, _), v in again.items() if k == kind]
            assert sorted(mine) == list(range(len(mine))) and kept.version().next_ids[kind] == len(mine)
        assert kept.insert(rows).number == 2  # nothing new: no version
        told.append(again)
    assert told[0] == told[1]
    values = {k: sorted(v for kind, v in told[0] if kind == k) for k in ("resource", "endpoint")}
    assert set(values["resource"]) == {r[0] for r in rows.select("resource").distinct().collect()} - {None}


@pytest.mark.parametrize("most", [200_000, 0])
def test_encode_and_decode(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(kept_dictionary, "BROADCAST_ENTRIES", most)
    rows = stored(spark)
    kept = kept_dictionary.KeptDictionary(spark, f"file://{tmp_path}/d")
    kept.insert(rows)
    pick = lambda d: sorted(map(tuple, d.select("sequence", "resource", "endpoint").collect()))
    coded = kept.encode(rows)
    assert pick(kept.decode(coded)) == pick(rows)
    odd = kept.encode(rows.limit(1).withColumn("resource", F.lit("/new")).withColumn("endpoint", F.lit(None).cast("string"))).first()
    assert odd["url_idx"] is None and odd["ip_idx"] is None
    assert kept.decode(coded.limit(1).withColumn("url_idx", F.lit(10**6).cast("long"))).first()["resource"] == "NOT_FOUND"


def test_the_second_of_two_loads_goes_again(spark, tmp_path, monkeypatch):
    """Both begin at version 1; the one that publishes second finds its number taken and gives no id twice."""
    path = f"file://{tmp_path}/d"
    one, two = (kept_dictionary.KeptDictionary(spark, path) for _ in range(2))
    one.insert(stored(spark, 50))
    rival, real = stored(spark, 300, seed=2), kept_dictionary.write_whole
    rivals = iter([rival])

    def write_whole(uri, name, content):
        for rows in rivals:
            one.insert(rows)
        return real(uri, name, content)

    monkeypatch.setattr(kept_dictionary, "write_whole", write_whole)
    assert two.insert(stored(spark, 300, seed=3)).number == 3
    got = ids(two)
    assert len({(k, i) for (k, _), i in got.items()}) == len(got) == sum(two.version().next_ids.values())
    assert len([f for f in os.listdir(tmp_path / "d") if f.startswith("entries-")]) == 3


def test_dense_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(9)
    got = batching.dense_numbers(df, "v").collect()
    assert all(r["v"] == r["number"] for r in got) and len(got) == 1000
    assert batching.dense_numbers(df.limit(0), "v").count() == 0


# merged order

@pytest.mark.parametrize("rows", [10**6, 100])
def test_blocks_merge_without_a_sort_of_events(spark, tmp_path, rows):
    shard.register(spark)
    events = stored(spark, 1500)
    twice = events.unionByName(events.where("sequence % 500 = 0"))  # sequences that are there twice
    path = f"file://{tmp_path}/blocks"
    twice.repartition(6).write.format(shard.FORMAT).options(path=path, rows_per_batch="40", flush_per_file="3").mode("append").save()
    out = merge_order.merged_order(spark, path, rows)
    if rows == 100:
        assert out.rdd.getNumPartitions() > 5
    got = [r["sequence"] for r in out.collect()]
    assert got == sorted(r["sequence"] for r in twice.collect())
    events_in_order = [tuple(r) for r in out.select(*STORED.replace(",", "").split()[::2]).collect()]
    assert len(set(events_in_order)) == 1500 and set(events_in_order) == set(map(tuple, events.collect()))
    before, _, after = plan_of(out).partition("MapInArrow")
    assert "Sort" not in before and "bloom" not in after  # what is sorted is the list of blocks


def test_blocks_that_reach_far_are_read_once(spark, tmp_path):
    """Blocks in order beside blocks whose rows lie anywhere: no block is read in many ranges, and equal sequences keep their order."""
    shard.register(spark)
    events, path = stored(spark, 3000), f"file://{tmp_path}/blocks"
    for part in (events.repartition(1).sortWithinPartitions("sequence"), events.where("sequence % 3 = 0").repartition(3), events.where("sequence <= 40 or sequence > 2960").repartition(1)):
        part.write.format(shard.FORMAT).options(path=path, rows_per_batch="40", flush_per_file="3").mode("append").save()
    rows = [(r["sequence"], r["file"], r["block"], r["pos"]) for r in spark.read.format(shard.FORMAT).option("path", path).load().collect()]
    low = {}
    for sequence, file, block, _ in rows:
        low[file, block] = min(sequence, low.get((file, block), sequence))
    out = merge_order.merged_order(spark, path, 100)
    got = [(r["sequence"], r["file"], r["block"], r["pos"]) for r in out.collect()]
    assert got == sorted(rows, key=lambda r: (r[0], low[r[1:3]], *r[1:])) and len(got) == 4080
    merging = out._jdf.queryExecution().optimizedPlan()
    while "MapInArrow" not in merging.nodeName():
        merging = merging.children().head()
    into = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, merging.children().head())
    assert 75 <= into.filter("start is not null").count() <= 2 * len(low)


# sketches

def test_sketches_merge(spark):
    rows = spark.range(60_000).select((F.col("id") % 12).alias("batch_id"), F.concat(F.lit("/"), F.col("id") % 30_011).alias("resource"), (F.col("id") % 40).cast("string").alias("endpoint"))
    parts = sketches.batch_sketches(rows)
    (whole,) = sketches.estimates(sketches.union(parts)).collect()
    (direct,) = sketches.estimates(sketches.batch_sketches(rows.withColumn("batch_id", F.lit(0)))).collect()
    assert (whole["resource_count"], whole["endpoint_count"], whole["rows"]) == (direct["resource_count"], direct["endpoint_count"], 60_000)
    assert abs(whole["resource_count"] - 30_011) <= sketches.error() * 30_011 and whole["endpoint_count"] == 40
    few = sketches.estimates(sketches.union(parts, F.floor(F.col("batch_id") / 5))).collect()
    assert {r["run"]: r["rows"] for r in few} == {0: 25_000, 1: 25_000, 2: 10_000}
    assert sketches.estimates(sketches.union(parts.limit(0))).first()["resource_count"] in (0, None)


# throughput

def test_throughput_on_tables_and_streams(spark, tmp_path):
    rows = stored(spark, 100).unionByName(stored(spark, 1).withColumn("timestamp_us", F.lit(None).cast("long")))
    at = [10**15 + k * 300_000 for k in range(100)]
    want = {}
    for t in at:
        for start in (t // 10**6 * 10**6, t // 10**6 * 10**6 - 10**6):
            want[start] = want.get(start, 0) + 1
    windows = throughput.rows_per_window(rows)
    assert {r["start_us"]: r["rows"] for r in windows.collect()} == want
    row = throughput.peak(windows).first()
    assert row["peak_per_sec"] == max(want.values()) / 2 and row["peak_start_us"] == min(k for k, v in want.items() if v == max(want.values()))
    rows.repartition(3).write.parquet(f"file://{tmp_path}/in")
    live = throughput.rows_per_window(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"), late="1 second")
    query = live.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["start_us"]: r["rows"] for r in spark.table("windows").collect()} == want


# live telemetry

def test_counters_of_a_stream_equal_those_of_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(telemetry, "SKETCHES", 2)
    rows = stored(spark, 500)
    rows.repartition(5).write.parquet(f"file://{tmp_path}/in")
    told = telemetry.Telemetry(spark)
    spark.streams.addListener(told)
    try:
        live = telemetry.watched(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"))
        live.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(told)
    whole = rows.agg(*telemetry.counters(), *[F.hll_sketch_estimate(F.hll_sketch_agg(k, sketches.PRECISION)).alias(f"{k}_count") for k in ("resource", "endpoint")]).first().asDict()
    known = told.counts()
    assert {k: known[k] for k in known if k in whole} == {k: whole[k] for k in known if k in whole}
    assert known["batch_flushed_total"] == 5 and known["lost_logs_total"] == 0 and len(told.sketches["resource"]) == 1
    assert told.counts() == known and json.loads(told.as_json()).keys() == {*known, "throughput_sec"}
    assert telemetry.Telemetry(spark).counts()["resource_count"] == 0


# producers' state

def test_open_batches_outlive_restarts_and_leave_when_silent(spark, tmp_path):
    rows = spark.range(1, 61).select(F.col("id").alias("sequence"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("p"), F.col("id") % 3)).alias("producer"), F.lit("kept").alias("_x"))
    source, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "cp"))
    stage = lambda: {(r["producer"], r["batch_id"]): r["n"] for r in spark.read.schema(schema).parquet(out).groupBy("producer", "batch_id").agg(F.count("*").alias("n")).collect()}
    schema = "sequence long, producer string, _x string, batch_id long"
    for k, (low, high) in enumerate(((1, 25), (25, 50), (50, 61))):
        rows.where(f"sequence >= {low} and sequence < {high}").repartition(2).write.mode("append").parquet(source)
        live = spark.readStream.schema(rows.schema).parquet(source)
        query = producers.start(producers.producer_batches(live, "producer", 7, idle_ms=600_000 if k < 2 else 300), out, checkpoint, "0 seconds")
        if k < 2:
            producers.caught_up(query)
            query.stop()
            full = (high - 1) // 3 // 7  # of each of three producers
            assert stage() == {(p, b): 7 for p in (None, "p1", "p2") for b in range(full)}
        else:
            producers.drain(query, 300)
    got = spark.read.schema(schema).parquet(out).collect()
    assert stage() == {(p, b): 7 if b < 2 else 6 for p in (None, "p1", "p2") for b in range(3)}
    for p in (None, "p1", "p2"):
        mine = sorted(r["sequence"] for r in got if r["producer"] == p)
        assert {r["sequence"]: r["batch_id"] for r in got if r["producer"] == p} == {s: i // 7 for i, s in enumerate(mine)}


def test_many_batches_leave_at_a_time(monkeypatch):
    """What is handed over grows with the rows, not with the batches; numbers go on from the open batch and over a cut."""
    monkeypatch.setattr(producers, "LEAVE_ROWS", 3000, raising=False)

    class Kept:
        def __init__(self, *_):
            self.value, self.rows = None, []

        exists, get = lambda self: self.value is not None, lambda self: self.value or iter(self.rows)
        update, appendList, clear = lambda self, v: setattr(self, "value", v), lambda self, more: self.rows.extend(more), lambda self: self.rows.clear()

    handle = SimpleNamespace(getValueState=Kept, getListState=Kept, listTimers=lambda: iter(()), registerTimer=lambda at: None)
    schema, now = StructType([StructField("c0", LongType()), StructField("c1", StringType())]), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 0)
    one = producers.ProducerBatches(schema, 7, "c0", 1000, None)
    one.init(handle)
    frames = []
    for low, high in ((0, 5), (5, 10_004), (10_004, 10_011)):
        part = pd.DataFrame({"c0": range(low, high), "c1": "x"})
        frames.append(list(one.handleInputRows(("p",), iter([part[::-2], part[-2::-2]]), now)))
    frames.append(list(one.handleExpiredTimer(("p",), now, None)))
    assert [len(f) for f in frames] == [0, 4, 1, 1]
    whole = pd.concat([x for f in frames for x in f])
    assert whole["c0"].tolist() == list(range(10_011)) and whole["batch"].tolist() == [k // 7 for k in range(10_011)]
