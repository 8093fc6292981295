"""The block format: round trips, corruption, filters, rotation, failover, streaming."""

import io
import json
import os
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loglathe import schema
from loglathe.operators import export
from loglathe.operators.normalize import normalize
from loglathe.schema import Config
from loglathe.sources import block_stats, codec, generator, manifest, shard, sinks
from loglathe.streaming import ingest

FIELDS = ["sequence", "timestamp_us", "resource", "endpoint", "http_code", "duration_ms", "response_size", "http_verb", "flags"]


def records(n):
    out = np.zeros(n, codec.RECORD)
    out["sequence"] = np.arange(1, n + 1)
    out["url_idx"] = np.arange(n) % 2
    return out


def block(n=4, urls=((0, b"/a"), (1, b"/b")), ips=((0, b"10.0.0.1"),), compress=True, **change):
    raw = codec.payload(records(n), list(urls), list(ips))
    for old, new in change.get("replace", ()):
        raw = raw.replace(old, new)
    return codec.frame(raw, compress)


def decode(data):
    return [b.to_pylist() for b in shard.decode_file("f.bin", io.BytesIO(data))]


def test_good_blocks():
    for compress in (True, False):
        (rows,) = decode(block(compress=compress))
        assert [r["resource"] for r in rows] == ["/a", "/b", "/a", "/b"]
        assert {r["endpoint"] for r in rows} == {"10.0.0.1"} and [r["pos"] for r in rows] == [0, 1, 2, 3]
    stored, raw = struct.unpack("<II", block(compress=False)[:8])
    assert stored == raw
    assert [r[0]["block"] for r in decode(block() + block(3))] == [0, 1]


def test_ends_of_files():
    good = block()
    assert len(decode(good + good[:5])) == len(decode(good + good[:-3])) == len(decode(good + b"\0" * 8 + good)) == 1
    assert decode(b"") == []


def test_corrupt_blocks():
    for bad, reason in (
        (block(replace=[(codec.BEGIN, b"\0" * 8)]), "no begin mark"),
        (block(replace=[(codec.END, b"\0" * 8)]), "no end mark"),
        (codec.frame(b"x" * 7 + codec.payload(records(1), [], [])), "records are no multiple of 32 bytes"),
        (codec.frame(records(1).tobytes() + codec.BEGIN + struct.pack("<I", 1 << 29)), "resources: too many entries"),
        (codec.frame(records(1).tobytes() + codec.BEGIN), "resources: no count"),
        (codec.HEADER.pack(9, 5000) + b"not lz4!!", "decompression failed"),
    ):
        first, second = decode(bad + block())
        assert [r["corrupt_reason"] for r in first] == [reason]
        assert second[0]["block"] == 1 and second[0]["resource"] == "/a"


def test_odd_dictionaries():
    (rows,) = decode(block(urls=[(0, b"/a")]))
    assert [r["resource"] for r in rows] == ["/a", "NOT_FOUND", "/a", "NOT_FOUND"]
    (rows,) = decode(block(urls=[(0, b"/a"), (0, b"/z"), (1, b"")]))
    assert [r["resource"] for r in rows] == ["/a", "", "/a", ""]
    raw = records(1).tobytes() + codec.BEGIN + codec.dictionary_bytes([(0, b"/a")], False) + codec.dictionary_bytes([(0, b"ip")], True) + codec.END
    (rows,) = decode(codec.frame(raw))
    assert (rows[0]["resource"], rows[0]["endpoint"]) == ("/a", "ip")


def test_encode_batch_nulls():
    batch = pa.RecordBatch.from_pydict({"resource": ["/a", None, "/a"], "endpoint": [None, "x", ""], "sequence": [1, 2, None], "http_code": [70000, 1, 2]})
    (rows,) = decode(codec.encode_batch(batch))
    assert [(r["resource"], r["endpoint"], r["sequence"], r["http_code"]) for r in rows] == [("/a", "", 1, 70000 % 65536), ("NULL", "x", 2, 1), ("/a", "", 0, 2)]


@pytest.fixture()
def stored(spark):
    raw = generator.generate(spark, 1000, resources=50, endpoints=40).withColumn("sequence", F.col("timestamp_us") - 13_344_473_600_000_000 + 1)
    return normalize(raw.repartition(3), Config(level=1)).cache()


def test_round_trip_and_filters(spark, stored, tmp_path):
    shard.register(spark)
    path = f"file://{tmp_path}/shards"
    stored.write.format(shard.FORMAT).option("path", path).option("rows_per_batch", 64).option("flush_per_file", 2).mode("append").save()
    made = sorted(f for f in os.listdir(tmp_path / "shards") if f != manifest.FOLDER)
    assert len(made) > 6 and all(re.fullmatch(r"shard_\d{18}_[0-9a-f]{12}_\d+\.bin(\.idx)?", f) for f in made)
    assert [f + ".idx" for f in made[::2]] == made[1::2]
    pick = lambda d: sorted(map(tuple, d.select(FIELDS).collect()))
    back = spark.read.format(shard.FORMAT).option("path", path).load()
    assert pick(back) == pick(stored) == pick(shard.read_shards(spark, path))
    assert pick(back.where("http_code >= 400 and sequence < 500")) == pick(stored.where("http_code >= 400 and sequence < 500"))
    some = spark.read.format(shard.FORMAT).option("path", path).option("filters", "http_code>=400, sequence<500").load()
    assert pick(some) == pick(stored.where("http_code >= 400 and sequence < 500"))
    part = spark.read.format(shard.FORMAT).option("path", path).option("columns", "resource").load()
    assert part.where("endpoint is not null").count() == 0 and part.where("resource is null").count() == 0
    assert [r[0] for r in export.absolute_order(back).select("sequence").collect()] == list(range(1, 1001))
    text = [r[0] for r in export.text_export(back).collect()]
    assert sum(t.startswith("\n=== BLOCK") for t in text) == back.select("file", "block").distinct().count() and len(text) > 1000


def test_parts_of_a_file_hold_each_block_once(spark, tmp_path):
    raw = b"".join(block(n) for n in (3, 1, 2)) + block(replace=[(codec.BEGIN, b"\0" * 8)]) + block(5)
    (tmp_path / "a.bin").write_bytes(raw)
    shard.register(spark)
    whole = sorted(map(str, shard.read_shards(spark, f"file://{tmp_path}").collect()))
    for split in (1, 50, 133, len(raw), 10 * len(raw)):
        if split > 1 or len(raw) < 2000:
            df = spark.read.format(shard.FORMAT).option("path", str(tmp_path)).option("split_bytes", split).load()
            assert sorted(map(str, df.collect())) == whole


def events(n, first=1, seed=0):
    rng = random.Random(seed)
    return pa.RecordBatch.from_pydict({
        "sequence": list(range(first, first + n)), "timestamp_us": [10**16 + k for k in range(n)], "resource": [f"/r{(first + k) // 50}" for k in range(n)],
        "endpoint": [f"10.0.0.{rng.randrange(9)}" for _ in range(n)], "http_code": [rng.choice([200, 404]) if k < n // 2 else 200 for k in range(n)],
        "duration_ms": [k % 7 for k in range(n)], "response_size": [1] * n, "http_verb": [1] * n, "flags": [0] * n,
    })


def put(folder, *batches, **options):
    """Blocks of 40 rows in files of 3 blocks, published."""
    o = {"path": str(folder), "rows_per_batch": "40", "flush_per_file": "3", **options}
    message = shard.write_blocks(o, iter(batches))
    shard.ShardWriter(o).commit([message, None])
    return json.loads(message.entries)


def got(folder, **options):
    reader = shard.ShardReader({"path": str(folder), **options})
    return [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]


def test_only_blocks_that_may_hold_a_row_are_read(tmp_path, monkeypatch):
    rows = events(1000)
    files = put(tmp_path, rows)
    assert [f["blocks"] for f in files] == [3] * 8 + [1] and files[1]["ranges"]["sequence"] == [121, 240]
    read, opened = [], []
    real, walk = codec.block_at, shard.ShardPart.blocks
    monkeypatch.setattr(codec, "block_at", lambda file, at: read.append(at) or real(file, at))
    monkeypatch.setattr(shard.ShardPart, "blocks", lambda part, wanted: opened.append(part.file) or walk(part, wanted))
    for options, test, most_blocks, most_files in (
        ({"filters": "sequence>=300,sequence<330"}, lambda r: 300 <= r["sequence"] < 330, 2, 1),
        ({"filters": "http_code=404"}, lambda r: r["http_code"] == 404, 13, 5),
        ({"filters": "http_code=404,sequence>400", "columns": "endpoint"}, lambda r: r["http_code"] == 404 and r["sequence"] > 400, 4, 2),
        ({"filters": "flags>0"}, lambda r: False, 0, 0),
        ({"resource": "/r7"}, lambda r: r["resource"] == "/r7", 3, 9),
        ({"resource": "/nowhere"}, lambda r: False, 1, 9),
        ({"resource": "/r7", "endpoint": "10.0.0.1", "filters": "sequence<=360"}, lambda r: r["resource"] == "/r7" and r["endpoint"] == "10.0.0.1" and r["sequence"] <= 360, 3, 3),
        ({}, lambda r: True, 25, 9),
    ):
        read.clear(), opened.clear()
        assert [r["sequence"] for r in got(tmp_path, **options)] == [r["sequence"] for r in rows.to_pylist() if test(r)]
        assert len(read) <= most_blocks and len(opened) - (not most_files) <= most_files
    (part,) = {r["resource"] for r in got(tmp_path, filters="sequence=3", columns="endpoint")}
    assert part is None
    with pytest.raises(ValueError, match="not a comparison"):
        shard.ShardReader({"path": str(tmp_path), "filters": "resource=/r7"})


def test_bloom_filters():
    rng = random.Random(2)
    held, others = [f"/{rng.random()}" for _ in range(2000)], [f"/{rng.random()}" for _ in range(2000)]
    made = block_stats.bloom(held)
    assert all(block_stats.may_hold(made, v) for v in held) and sum(block_stats.may_hold(made, v) for v in others) < 40
    assert len(made) == 2500 and not block_stats.may_hold(block_stats.bloom([]), "x")


def test_what_no_list_names_is_not_there(tmp_path):
    files = put(tmp_path, events(100))
    (tmp_path / "shard_of_a_lost_task.bin").write_bytes(block())
    with (tmp_path / files[0]["file"]).open("ab") as f:
        f.write(block()[:-3])  # and what was half written behind the last whole block
    assert [r["sequence"] for r in got(tmp_path)] == list(range(1, 101))
    o = {"path": str(tmp_path), "rows_per_batch": "40"}
    again = [shard.write_blocks(o, iter([events(10, 101)])) for _ in range(2)]
    sink = shard.ShardStreamWriter(o)
    sink.commit(again[:1], 5)
    sink.commit(again[1:], 5)  # the micro-batch was run again after its list was published
    assert [r["sequence"] for r in got(tmp_path)] == list(range(1, 111))
    lost = shard.write_blocks(o, iter([events(10, 201)]))
    sink.abort([lost, None], 6)
    name = json.loads(lost.entries)[0]["file"]
    assert not (tmp_path / name).exists() and len(got(tmp_path)) == 110


class Failing:
    """A store whose files take so many bytes; the last write leaves half of its bytes."""

    def __init__(self, store, most):
        self.store, self.most = store, most

    def __getattr__(self, name):
        return getattr(self.store, name)

    def open_output_stream(self, path):
        store, stream = self, self.store.open_output_stream(path)

        class Stream:
            def write(self, data):
                if store.most < len(data):
                    stream.write(data[: len(data) // 2])
                    raise OSError(28, "No space left on device")
                store.most -= len(data)
                stream.write(data)

            def close(self):
                stream.close()

            __enter__ = lambda self: self
            __exit__ = lambda self, *a: stream.close()

        return Stream()


@pytest.mark.parametrize("most", [0, 10, 1500, 4000, 9000])
def test_a_task_goes_on_in_the_second_folder(tmp_path, monkeypatch, most):
    """The first folder is full somewhere, in a block or between: no row is lost or stored twice."""
    first, second = tmp_path / "first", tmp_path / "second"
    real, full = manifest.store_of, {}

    def store_of(uri):
        store, path = real(uri)
        return (full.setdefault(str(first), Failing(store, most)) if path.startswith(str(first)) else store), path

    monkeypatch.setattr(manifest, "store_of", store_of)
    files = put(first, events(500), backup_path=str(second))
    assert {f["folder"] for f in files} == ({str(second)} if most < 1500 else {str(first), str(second)})
    monkeypatch.setattr(manifest, "store_of", real)
    assert sorted(r["sequence"] for r in got(first, backup_path=str(second))) == list(range(1, 501))
    some = got(first, backup_path=str(second), filters="sequence<=60")
    assert sorted(r["sequence"] for r in some) == list(range(1, 61))
    small = Failing(real(str(first))[0], 3000)
    monkeypatch.setattr(manifest, "store_of", lambda uri: (small, real(uri)[1]))
    with pytest.raises(OSError, match="No space"):
        shard.write_blocks({"path": str(tmp_path / "third"), "rows_per_batch": "40", "flush_per_file": "3"}, iter([events(500)]))
    monkeypatch.setattr(manifest, "store_of", real)
    assert not [f for f in os.listdir(tmp_path / "third") if f.endswith(".bin")]


def test_failover_in_spark(spark, stored, tmp_path):
    shard.register(spark)
    (tmp_path / "file").write_text("in the way")
    o = {"path": f"file://{tmp_path}/file/below", "backup_path": f"file://{tmp_path}/spare", "rows_per_batch": "64"}
    stored.write.format(shard.FORMAT).options(**o).mode("append").save()
    back = spark.read.format(shard.FORMAT).option("path", o["backup_path"]).load()
    assert sorted(map(tuple, back.select(FIELDS).collect())) == sorted(map(tuple, stored.select(FIELDS).collect()))


def test_parts_of_a_growing_file(tmp_path):
    """Whatever the bytes at which a file was seen, each block is read once, when its last byte is there."""
    raw = b"".join(block(n) for n in (3, 1, 2)) + block(replace=[(codec.BEGIN, b"\0" * 8)]) + block(5)
    whole = [(n, s) for n, s, _ in codec.blocks(io.BytesIO(raw))]
    rng = random.Random(1)
    for _ in range(30):
        cuts = [0, *sorted(rng.sample(range(1, len(raw)), 6)), len(raw)]
        assert [(n, s) for a, b in zip(cuts, cuts[1:]) for n, s, _ in codec.blocks_ending(io.BytesIO(raw[:b]), a, b)] == whole
    assert list(codec.blocks_ending(io.BytesIO(b"\0" * 30), 0, 30)) == []


def test_stream_of_blocks_over_restarts(spark, tmp_path):
    """Files that come and grow between runs of a stream, parts of a few hundred bytes: its sink holds every row once."""
    shard.register(spark)
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    pieces = [codec.encode_batch(events(40, 40 * k + 1)) for k in range(12)]

    def run():
        live = spark.readStream.format(shard.FORMAT).options(path=f"file://{source}", log_path=f"file://{tmp_path}/log", max_bytes_per_trigger="700").load()
        writer = live.drop("file", "block", "pos", "corrupt_reason").writeStream.format(shard.FORMAT).options(path=f"file://{out}", rows_per_batch="25")
        query = writer.option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        return sorted(r["sequence"] for r in got(out))

    (source / "b.bin").write_bytes(b"".join(pieces[:3]) + pieces[3][:20])
    assert run() == list(range(1, 121))
    (source / "a.bin").write_bytes(b"".join(pieces[5:7]))
    with (source / "b.bin").open("ab") as f:
        f.write(pieces[3][20:] + pieces[4])
    assert run() == list(range(1, 281))
    assert run() == list(range(1, 281))
    (source / "c.bin").write_bytes(b"".join(pieces[7:]))
    assert run() == list(range(1, 481))
    assert len(os.listdir(out / manifest.FOLDER)) > 4


def test_log_of_a_stream_is_put_together(tmp_path, monkeypatch):
    monkeypatch.setattr(shard, "COMPACT", 3)
    folder, log = tmp_path / "in", str(tmp_path / "log")
    folder.mkdir()
    o = {"path": str(folder), "log_path": log}
    reader, seen = shard.ShardStreamReader(o), []
    at = reader.initialOffset()
    for k in range(12):
        (folder / f"{k}.bin").write_bytes(codec.encode_batch(events(5, 5 * k + 1)))
        to = reader.latestOffset()
        assert to == {"entry": k + 1} == reader.latestOffset()
        for part in reader.partitions(at, to):
            seen += [r["sequence"] for b in reader.read(part) for r in b.to_pylist()]
        reader.commit(to)
        at = to
        if k % 4 == 3:  # a restart, which may ask for the last parts again
            reader = shard.ShardStreamReader(o)
            assert len(reader.partitions({"entry": k}, {"entry": k + 1})) == 1
    assert seen == list(range(1, 61)) and len(os.listdir(log)) <= 5
    with pytest.raises(ValueError, match="log_path"):
        shard.ShardStreamReader({"path": str(folder)})


def test_corrupt_rows_in_spark(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(block() + block(replace=[(codec.BEGIN, b"\0" * 8)]) + block(2))
    df = shard.read_shards(spark, f"file://{tmp_path}")
    assert [tuple(r) for r in export.corrupt_blocks(df).collect()] == [("a.bin", 1, "no begin mark")]
    assert df.where("corrupt_reason is null").count() == 6
    assert "\n=== BLOCK 1 FAILED ===" in [r[0] for r in export.text_export(df).collect()]


def test_parquet_rotation_and_failover(spark, stored, tmp_path):
    log = sinks.ErrorLog(spark, f"file://{tmp_path}/errors")
    (tmp_path / "file").write_text("in the way")
    config = Config(path=f"file://{tmp_path}/file/below", backup_path=f"file://{tmp_path}/backup", compression="fast", batch="500KB", files=1)
    assert sinks.write_events(stored.coalesce(1), config, log).endswith("/backup")
    assert spark.read.parquet(config.backup_path).count() == 1000
    assert any(f.startswith("_error_") for f in os.listdir(tmp_path / "errors"))
    with pytest.raises(ValueError):
        sinks.write_events(stored, Config())


def test_stream_equals_batch(spark, stored, tmp_path):
    raw = generator.generate(spark, 300).repartition(4)
    raw.write.parquet(f"file://{tmp_path}/in")
    config = Config(path=f"file://{tmp_path}/out", level=2)
    live = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = ingest.ingest(live, config, f"file://{tmp_path}/checkpoint")
    query.awaitTermination()
    seen = []
    ingest.each_progress(query, seen.append)
    assert sum(s["rows"] for s in seen) == 300
    got, want = spark.read.parquet(config.path).drop("batch"), normalize(raw, Config(level=2))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    again = ingest.ingest(live, config, f"file://{tmp_path}/checkpoint")  # nothing new: nothing is stored twice
    again.awaitTermination()
    assert spark.read.parquet(config.path).count() == 300


def test_numbered_batches_on_a_stream(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 2).alias("producer"), "id")
    for k in range(2):
        rows.where(F.floor(F.col("id") % 4 / 2) == k).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = (
        ingest.numbered_batches(live, "producer", 7).writeStream.format("parquet").option("path", f"file://{tmp_path}/out")
        .option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {(r["producer"], r["batch_id"]): r["count"] for r in spark.read.parquet(f"file://{tmp_path}/out").groupBy("producer", "batch_id").count().collect()}
    assert got == {(p, b): 7 if b < 2 else 6 for p in (0, 1) for b in range(3)}


def test_sequence_off_and_error_path(spark, tmp_path):
    raw = spark.createDataFrame([(1, "/a", 200, "h", 1, 1, 1, 5)], schema.RAW_EVENT)
    assert normalize(raw, schema.Config(sequence=False)).first()["sequence"] == 0 and "sequence" not in normalize(raw).columns
    (tmp_path / "file").write_text("no folder")
    config = schema.Config(path=f"file://{tmp_path}/file/below", backup_path=f"file://{tmp_path}/spare", error_path=f"file://{tmp_path}/errors")
    assert sinks.write_events(normalize(raw), config).endswith("/spare")
    assert len(list((tmp_path / "errors").glob("_error_*.txt"))) == 1


def test_limits(spark, tmp_path):
    raw = spark.range(40).selectExpr("id", "id % 2 as producer", "40 - id as at")
    raw.repartition(8).write.parquet(f"file://{tmp_path}/in")
    told = ingest.Counters()
    spark.streams.addListener(told)
    try:
        live = ingest.limited(spark.readStream.schema(raw.schema), "parquet", files=2).parquet(f"file://{tmp_path}/in")
        numbered = ingest.numbered_batches(live, "producer", 7, "at")
        query = numbered.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
        query.awaitTermination()
        assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        assert told.rows == 40 and told.batches >= 4 and told.failed == 0
    finally:
        spark.streams.removeListener(told)
    with pytest.raises(ValueError):
        ingest.limited(spark.readStream, "parquet", rows=5)
    # rows of one micro-batch are numbered in order
    once = ingest.numbered_batches(spark.readStream.schema(raw.schema).parquet(f"file://{tmp_path}/in"), "producer", 7, "at")
    once.writeStream.format("parquet").option("path", f"file://{tmp_path}/out2").option("checkpointLocation", f"file://{tmp_path}/ck2").trigger(availableNow=True).start().awaitTermination()
    for p in (0, 1):
        rows = sorted(spark.read.parquet(f"file://{tmp_path}/out2").where(f"producer = {p}").collect(), key=lambda r: r["at"])
        assert [r["batch_id"] for r in rows] == [k // 7 for k in range(20)]
