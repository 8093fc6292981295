"""Batching, dictionaries, telemetry, export, configuration."""

import json

from pyspark.sql import functions as F

from loglathe.operators import batching, dictionary, export, telemetry
from loglathe.operators.normalize import normalize
from loglathe.schema import BATCH_BYTES, Config, Status, rows_per_batch
from loglathe.sources import generator, lines


def test_rows_per_batch():
    known = {"500KB": 15_500, "1MB": 31_744, "2MB": 63_488, "4MB": 126_976, "8MB": 253_952, "16MB": 507_904, "32MB": 1_015_808, "64MB": 2_031_616, "128MB": 4_063_232, "256MB": 8_126_464, "512MB": 16_252_928}
    assert {k: rows_per_batch(k) for k in BATCH_BYTES} == known


def test_config():
    assert Config().check() == Config(path="NUL").check() == Status.MISSING_PARAMETER == 15
    assert Config(path="/x").check() == Status.OK
    c = Config(path="/x", level=9, files=100, compression="best", batch="3MB", dictionary="1", error_path="")
    assert c.check() == Status.INVALID_PARAMETER == 16
    assert (c.level, c.files, c.compression, c.batch, c.dictionary, c.error_path) == (0, 512, "balanced", "8MB", "256K", "error")
    assert Config(path="/x", batch="512MB", dictionary="16K").rows_per_batch == 16384 - 512


def test_sequence_with_ties_and_nulls(spark):
    rows = [(None, 1), (5, 2), (5, 1), (3, 9), (None, 0)] + [(7, i) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, t long").repartition(5)
    got = batching.assign_sequence(df, "k", ("t",), rows=7).orderBy("sequence").collect()
    assert [r["sequence"] for r in got] == list(range(1, len(rows) + 1))
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r["k"], r["t"]) for r in got] == want
    assert batching.assign_sequence(df.limit(0), "k").count() == 0


def test_batches_of_a_hot_producer(spark):
    df = spark.range(900).selectExpr("id * 7 % 900 as id", "case when id % 10 = 0 then null when id % 10 = 1 then 'a' else 'hot' end as p")
    got = batching.assign_batches(df, 10, "id", "p", range_rows=50)
    assert "_range" in got._jdf.queryExecution().optimizedPlan().toString()
    for p in (None, "a", "hot"):
        rows = sorted((r for r in got.collect() if r["p"] == p), key=lambda r: r["id"])
        assert [r["batch_id"] for r in rows] == [k // 10 for k in range(len(rows))]


def test_batches(spark):
    df = spark.range(1, 101).withColumn("p", F.col("id") % 3)
    per = batching.assign_batches(df, 10, "id", "p").groupBy("p", "batch_id").count().collect()
    assert all(r["count"] <= 10 for r in per) and sum(r["count"] for r in per) == 100
    assert {r["batch_id"]: r["count"] for r in batching.assign_batches(df, 30, "id").groupBy("batch_id").count().collect()} == {0: 30, 1: 30, 2: 30, 3: 10}


def _some(spark, n=500):
    rows = generator.generate(spark, n, resources=20, endpoints=30).withColumn("sequence", F.monotonically_increasing_id())
    return batching.assign_batches(batching.assign_sequence(normalize(rows.drop("sequence"), Config(level=1)), "timestamp_us", rows=100), 64)


def test_dictionary_round_trip(spark):
    rows = _some(spark).cache()
    known = dictionary.build(rows).cache()
    back = dictionary.decode(dictionary.encode(rows, known), known)
    pick = lambda d: sorted(map(tuple, d.select("sequence", "resource", "endpoint").collect()))
    assert pick(back) == pick(rows)
    firsts = known.groupBy("batch_id", "kind").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).collect()
    assert all(r["a"] == 0 and r["b"] == r["n"] - 1 for r in firsts)
    twice = known.unionByName(known)  # repeated ids multiply no rows
    assert pick(dictionary.decode(dictionary.encode(rows, known), twice)) == pick(rows)
    assert {r["resource"] for r in dictionary.decode(dictionary.encode(rows, known), known.limit(0)).collect()} == {"NOT_FOUND"}


def test_telemetry(spark):
    rows = _some(spark).cache()
    row = telemetry.telemetry(rows, spark.createDataFrame([(100, 50), (1000, 333)], "raw_bytes int, stored_bytes int"), 2.0)
    got = json.loads(telemetry.as_json(row).first()[0])
    assert got["log_processed_total"] == 500 and got["batch_flushed_total"] == 8
    assert got["compression_lz4_ratio_avg"] == (5000 + 3330) / 2 / 10000
    assert got["throughput_sec"] == 500 / 2 / 1e6
    assert got["dictionary_hits_resource"] == 500 - sum(r["resource_count"] for r in dictionary.counts(rows).collect())
    empty = telemetry.telemetry(rows.limit(0)).first()
    assert empty["log_processed_total"] == 0 and empty["hit_pct_resource"] == 0
    watched, seen = telemetry.observed(rows)
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 500


def test_filter_is_pushed_down(spark, tmp_path):
    path = f"file://{tmp_path}/events"
    _some(spark).write.parquet(path)
    plan = export.filtered(spark.read.parquet(path), "http_code >= 400").select("sequence")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "GreaterThanOrEqual(http_code,400)" in plan
    assert "resource" not in plan and "ReadSchema" in plan


def test_lines(spark):
    raw = ['  "a" ', '"b",', "c,", "", "   ", '"', "x,,", '""', "\t d\r"]
    df = spark.createDataFrame([(v,) for v in raw], "value string")
    assert [r[0] for r in lines.clean_lines(df).collect()] == ["a", '"b"', "c", '"', "x,", "d"]
