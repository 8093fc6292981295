"""The registered queries of the log engine, and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import endpoint as ip
from ..functions import text
from ..functions.entropy import shannon_entropy
from ..operators import batching, dictionary, export, merge_order, saturation, sketches, telemetry, throughput
from ..operators.kept_dictionary import KeptDictionary
from ..operators.normalize import normalize
from ..schema import Config
from ..sources import generator, lines, scratch, shard, sinks
from ..streaming import ingest, producers
from ..streaming import telemetry as live_telemetry
from .log_view import log_view, traffic_report

#: An address, its class, and what levels 1 to 4 leave of it.
FORMS = (
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
)

#: Rows of a batch in the queries below, small enough for the test tables to have many.
ROWS = 640
#: Distinct values of a batch's dictionary in the queries of batches that close on these.
SLOTS = 400


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stored(spark: SparkSession, sf_dir: str, level: int = 0) -> DataFrame:
    return normalize(log_view(spark, sf_dir), Config(level=level))


def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.assign_batches(_stored(spark, sf_dir), ROWS)


def flagship(spark, sf_dir):
    return traffic_report(log_view(spark, sf_dir))


def strip_params(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.strip_params(F.col("url")).alias("resource"))


def truncate_middle(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.truncate_middle(F.col("text"), "char").alias("resource"))


def truncate_middle_bytes(spark, sf_dir):
    ascii_only = F.regexp_replace("text", r"[^\x00-\x7F]", "??")
    return _table(spark, sf_dir, "documents").select("doc_id", text.truncate_middle(ascii_only).alias("resource"))


def null_resource(spark, sf_dir):
    empty = F.when(F.col("event_id") % 3 == 0, F.lit("")).when(F.col("event_id") % 3 == 1, F.col("event_type"))
    return _table(spark, sf_dir, "events").select("event_id", text.null_resource(empty).alias("resource"))


def clip_endpoint(spark, sf_dir):
    long = F.when(F.col("event_id") % 4 > 0, F.repeat(F.col("event_type"), (F.col("event_id") % 30).cast("int")))
    return _table(spark, sf_dir, "events").select("event_id", text.clip_endpoint(long).alias("endpoint"))


def classify_ip(spark, sf_dir):
    return log_view(spark, sf_dir).select("sequence", ip.classify_ip(F.col("endpoint")).alias("class"))


def anon_ip(level):
    return lambda spark, sf_dir: log_view(spark, sf_dir).select("sequence", ip.anon_ip(F.col("endpoint"), level).alias("endpoint"))


def anon_ip_forms(spark, sf_dir):
    """Every form of address that the masking rules tell apart, one an event in turn, at every level."""
    form = F.pmod("event_id", F.lit(len(FORMS))).cast("int")
    rows = _table(spark, sf_dir, "events").select("event_id", form.alias("form"), F.get(F.array(*[F.lit(f[0]) for f in FORMS]), form).alias("address"))
    return rows.select("event_id", "form", ip.classify_ip(F.col("address")).alias("class"), *[ip.anon_ip(F.col("address"), k).alias(f"level_{k}") for k in range(1, 5)])


def format_timestamp(spark, sf_dir):
    return log_view(spark, sf_dir).select("sequence", text.format_ts(F.col("timestamp_us")).alias("ts"))


def verb_decode(spark, sf_dir):
    code = F.pmod("event_id", F.lit(45))
    return _table(spark, sf_dir, "events").select("event_id", text.verb_name(code).alias("verb"))


def narrow_status(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", text.narrow_u16(F.col("event_id") * 37 + 65000).alias("http_code"))


def dotted_quad(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", text.dotted_quad(F.pmod(F.col("event_id") * 2654435761, F.lit(4294967296))).alias("address"))


def sequence(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").withColumn("us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))"))
    return batching.assign_sequence(rows, "us", ("event_id",), rows=1000).select("event_id", "sequence")


def batch_assign(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id")
    return batching.assign_batches(rows, 16, "event_id", "user_id")


def batch_dynamic(spark, sf_dir):
    """Batches of 640 rows or 400 values of a dictionary, whichever comes first."""
    return saturation.dynamic_batches(_stored(spark, sf_dir), ROWS, SLOTS, range_rows=2 * ROWS).select("sequence", "batch_id")


def batch_saturated(spark, sf_dir):
    """The same of each producer, whose batches shrink once a dictionary was full."""
    rows = log_view(spark, sf_dir).withColumn("producer", F.pmod("data_size_bucket", F.lit(3)))
    return saturation.dynamic_batches(rows, ROWS, SLOTS, producer="producer", shrink=True, range_rows=2 * ROWS).select("sequence", "producer", "batch_id")


def dict_build(spark, sf_dir):
    return dictionary.build(_batched(spark, sf_dir))


def dict_counts(spark, sf_dir):
    return dictionary.counts(_batched(spark, sf_dir))


def dict_encode(spark, sf_dir):
    rows = _batched(spark, sf_dir)
    return dictionary.encode(rows, dictionary.build(rows)).select("sequence", "batch_id", "url_idx", "ip_idx")


def dict_decode(spark, sf_dir):
    rows = _batched(spark, sf_dir)
    known = dictionary.build(rows)
    return dictionary.decode(dictionary.encode(rows, known), known).select("sequence", "batch_id", "resource", "endpoint")


def dict_decode_missing(spark, sf_dir):
    rows = _batched(spark, sf_dir)
    known = dictionary.build(rows)
    return dictionary.decode(dictionary.encode(rows, known), known.where("id % 3 <> 0")).select("sequence", "resource", "endpoint")


def roundtrip(spark, sf_dir):
    rows = batching.assign_batches(_stored(spark, sf_dir, 2), ROWS)
    known = dictionary.build(rows)
    return dictionary.decode(dictionary.encode(rows, known), known).select(
        "sequence", "timestamp_us", "resource", "endpoint", "http_code", "duration_ms", "response_size", "http_verb", "flags"
    )


def format_line(spark, sf_dir):
    return export.lines(_stored(spark, sf_dir)).select("sequence", "line")


def filtered_decode(spark, sf_dir):
    return export.filtered(_stored(spark, sf_dir), "http_code >= 400").select("sequence", "resource", "endpoint", "http_code")


def json_export(spark, sf_dir):
    return export.json_lines(_stored(spark, sf_dir).select("sequence", "http_code", "endpoint"))


def telemetry_counters(spark, sf_dir):
    return telemetry.telemetry(_batched(spark, sf_dir))


def compression_ratio(spark, sf_dir):
    blocks = _table(spark, sf_dir, "events").select((F.col("event_id") % 977 + 1000).alias("raw_bytes"), (F.col("event_id") % 611 + 300).alias("stored_bytes"))
    return blocks.agg(F.round(telemetry.compression_ratio(), 6).alias("ratio"))


def entropy_per_row(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.round(shannon_entropy(F.col("url")), 6).alias("entropy"))


def entropy_mean(spark, sf_dir):
    return _table(spark, sf_dir, "pages").agg(F.round(F.avg(F.round(shannon_entropy(F.col("url")), 9)), 5).alias("entropy"))


def global_order(spark, sf_dir):
    return export.absolute_order(_stored(spark, sf_dir)).select("sequence", "timestamp_us", "resource")


def line_load(spark, sf_dir):
    each = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    odd = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('  "'), F.col("value"), F.lit('"'))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('"'), F.col("value"), F.lit('", '))).otherwise(F.col("value"))
    return lines.clean_lines(each.withColumn("value", odd)).select("doc_id", "value")


def generated(spark, sf_dir):
    """A synthetic event for every event of the table."""
    return normalize(generator.events(_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))), Config(level=2))


def _shards(spark, sf_dir) -> str:
    shard.register(spark)
    path = scratch.folder(spark, "shards")
    _stored(spark, sf_dir).write.format(shard.FORMAT).option("path", path).option("rows_per_batch", ROWS).option("flush_per_file", 4).mode("append").save()
    return path


def block_roundtrip(spark, sf_dir):
    got = spark.read.format(shard.FORMAT).option("path", _shards(spark, sf_dir)).load()
    return got.select("sequence", "timestamp_us", "resource", "endpoint", "http_code", "duration_ms", "response_size", "http_verb", "flags")


def block_files(spark, sf_dir):
    return shard.read_shards(spark, _shards(spark, sf_dir)).select("sequence", "resource", "endpoint")


def text_export(spark, sf_dir):
    return export.text_export(shard.read_shards(spark, _shards(spark, sf_dir)), headers=False)


def rotation(spark, sf_dir):
    path = scratch.folder(spark, "rotated")
    config = Config(path=path, files=1, batch="500KB", compression="fast")
    sinks.write_events(_stored(spark, sf_dir), config)
    return spark.read.parquet(path).select("sequence", "resource", "endpoint", "http_code")


def _grouped(rows: DataFrame, n: int) -> DataFrame:
    """Dealt to tasks by runs of n of the sequence, in their order: every task has whole runs, but for the last run of all."""
    return rows.repartition(F.floor((F.col("sequence") - 1) / n)).sortWithinPartitions("sequence")


def rotation_files(spark, sf_dir):
    """Four copies of the events in files of 15,500 rows: the rows of each file."""
    path = scratch.folder(spark, "rotated")
    config = Config(path=path, files=1, batch="500KB", compression="fast")
    rows = _stored(spark, sf_dir)
    copies = rows.withColumn("sequence", F.explode(F.sequence(F.col("sequence"), F.col("sequence") + 3 * rows.count(), F.lit(rows.count()))))
    sinks.write_events(_grouped(copies, config.rows_per_file), config)
    per = spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"), F.min("sequence").alias("first"))
    return per.select((F.floor((F.col("first") - 1) / config.rows_per_file) + 1).cast("int").alias("place"), "rows")


#: Blocks of a file in the queries below.
FILE_BLOCKS = 4


def _blocks(spark, sf_dir, **options: str) -> str:
    """A folder of files of four blocks, which hold the events by runs of their sequence."""
    shard.register(spark)
    path = scratch.folder(spark, "blocks")
    rows = _grouped(_stored(spark, sf_dir), FILE_BLOCKS * ROWS)
    rows.write.format(shard.FORMAT).option("path", path).option("rows_per_batch", ROWS).option("flush_per_file", FILE_BLOCKS).options(**options).mode("append").save()
    return path


def text_export_headers(spark, sf_dir):
    """Headers of blocks and the marker of a damaged one, which is added at the end of every file."""
    damaged = F.to_binary(F.lit("1000000010000000" + "78" * 16), F.lit("hex"))
    files = shard.binary_files(spark, _blocks(spark, sf_dir)).select("path", F.concat("content", damaged).alias("content"))
    return export.text_export(shard.decode_files(files))


def block_sizes(spark, sf_dir):
    sizes = shard.block_sizes(shard.binary_files(spark, _blocks(spark, sf_dir)))
    return sizes.select("block", "raw_bytes", (F.col("stored_bytes") < F.col("raw_bytes")).alias("compressed"))


def block_ratio(spark, sf_dir):
    """The mean ratio of blocks as they lie in files: compressed, which no other engine does alike, and as they are."""
    out = None
    for how in ("balanced", "none"):
        blocks = shard.block_sizes(shard.binary_files(spark, _blocks(spark, sf_dir, compression=how)))
        ratio = telemetry.compression_ratio()
        row = blocks.agg(F.lit(how).alias("compression"), F.count("*").alias("blocks"), F.sum("raw_bytes").alias("raw_bytes"), ((ratio > 0) & (ratio < 1)).alias("smaller"), (ratio == 1).alias("as_is"))
        out = row if out is None else out.unionByName(row)
    return out


def telemetry_blocks(spark, sf_dir):
    """Counters as JSON, with those of real blocks; without the ratio, which no other engine has."""
    row = telemetry.telemetry(_batched(spark, sf_dir), shard.block_sizes(shard.binary_files(spark, _blocks(spark, sf_dir))))
    return telemetry.as_json(row.select(
        "log_processed_total", "batch_flushed_total", "batch_compressed_total", "batch_written_total", "log_rotation", "compression_failure_total",
        "lost_logs_total", "log_refused_total", "backpressure_count",
    ))


def block_statistics(spark, sf_dir):
    known = shard.statistics(spark, _blocks(spark, sf_dir))
    batch = F.floor((F.col("min_sequence") - 1) / ROWS).cast("bigint").alias("batch_id")
    return known.select(batch, "block", "rows", *[f"{end}_{c}" for c in ("sequence", "timestamp_us", "http_code", "duration_ms", "flags") for end in ("min", "max")])


def block_skipping(spark, sf_dir):
    """Decodes only blocks whose ranges may hold rows from 201 to 900 with errors; the others are not read."""
    reader = spark.read.format(shard.FORMAT).option("path", _blocks(spark, sf_dir)).option("filters", "sequence>200,sequence<=900,http_code>=400")
    return reader.load().select("sequence", "resource", "endpoint", "http_code")


def block_skipping_string(spark, sf_dir):
    """Decodes only blocks whose filter of resources may hold that of page 7."""
    wanted = _table(spark, sf_dir, "pages").where("page_id = 7").select(text.normalize_resource(F.col("url"))).first()[0]
    reader = spark.read.format(shard.FORMAT).option("path", _blocks(spark, sf_dir)).option("resource", wanted)
    return reader.load().select("sequence", "resource", "endpoint")


def stream_blocks(spark, sf_dir):
    """Blocks read as a stream, a part at a time, and written as blocks by the streaming sink."""
    out = scratch.folder(spark, "blocks-out")
    reader = spark.readStream.format(shard.FORMAT).option("path", _blocks(spark, sf_dir)).option("log_path", scratch.folder(spark, "blocks-log"))
    live = reader.load().drop("file", "block", "pos", "corrupt_reason")
    writer = live.writeStream.format(shard.FORMAT).option("path", out).option("rows_per_batch", ROWS).option("checkpointLocation", scratch.folder(spark, "checkpoint"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.format(shard.FORMAT).option("path", out).load().select("sequence", "timestamp_us", "resource", "endpoint", "http_code", "duration_ms", "response_size", "http_verb", "flags")


def stream_equals_batch(spark, sf_dir):
    source, path = scratch.folder(spark, "source"), scratch.folder(spark, "stream")
    raw = log_view(spark, sf_dir)
    raw.write.parquet(source)
    live = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 2).parquet(source)
    ingest.ingest(live, Config(path=path, level=2), scratch.folder(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(path).select("sequence", "resource", "endpoint", "http_code")


def _kept(spark, sf_dir) -> tuple[KeptDictionary, DataFrame]:
    """A dictionary after two loads: of two fifths of the events, then of all."""
    kept, rows = KeptDictionary(spark, scratch.folder(spark, "dictionary")), _stored(spark, sf_dir)
    kept.insert(rows.where("sequence % 5 < 2"))
    kept.insert(rows)
    return kept, rows


def dict_kept(spark, sf_dir):
    return _kept(spark, sf_dir)[0].entries()


def dict_kept_encode(spark, sf_dir):
    kept, rows = _kept(spark, sf_dir)
    return kept.encode(rows).select("sequence", "url_idx", "ip_idx")


def merged_order(spark, sf_dir):
    return merge_order.merged_order(spark, _shards(spark, sf_dir), 4 * ROWS).select("sequence", "timestamp_us", "resource")


def distinct_sketches(spark, sf_dir):
    """Sketches stored a batch, united over runs of four batches, beside exact counts of these."""
    stored = scratch.written(sketches.batch_sketches(_batched(spark, sf_dir)), "sketches")
    run = F.floor(F.col("batch_id") / 4)
    told = sketches.estimates(sketches.union(stored, run))
    exact = _batched(spark, sf_dir).groupBy(run.alias("run")).agg(*[F.count_distinct(k).alias(f"{k}_exact") for k in dictionary.KINDS])
    within = [(F.abs(F.col(f"{k}_count") - F.col(f"{k}_exact")) <= sketches.error() * F.col(f"{k}_exact")).alias(f"{k}_within") for k in dictionary.KINDS]
    return told.join(exact, "run").select("run", "rows", *[f"{k}_exact" for k in dictionary.KINDS], *within)


#: Seconds of a window and of its steps in the queries of throughput; the events are minutes apart.
WINDOW, STEP = 7200.0, 3600.0


def throughput_windows(spark, sf_dir):
    return throughput.rows_per_window(_stored(spark, sf_dir), WINDOW, STEP).select("start_us", "rows")


def throughput_peak(spark, sf_dir):
    row = throughput.peak(throughput.rows_per_window(_stored(spark, sf_dir), WINDOW, STEP))
    return row.select(F.round(F.col("peak_per_sec") * WINDOW).cast("long").alias("peak_rows"), "peak_start_us", F.round(F.col("mean_per_sec") * WINDOW, 4).alias("mean_rows"))


def _source(spark, rows: DataFrame, parts: int, files: int = 1) -> DataFrame:
    """A stream of files of rows, dealt by sequence; so many files a micro-batch."""
    path = scratch.folder(spark, "source")
    rows.repartition(parts, F.col("sequence")).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def throughput_stream(spark, sf_dir):
    """The windows as a stream tells them: the last word on each."""
    path = scratch.folder(spark, "windows")
    windows = throughput.rows_per_window(_source(spark, _stored(spark, sf_dir), 4), WINDOW, STEP, late="3650 days")
    put = lambda batch, number: batch.withColumn("told", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")
    writer = windows.writeStream.outputMode("update").option("checkpointLocation", scratch.folder(spark, "checkpoint")).foreachBatch(put)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).groupBy("start_us").agg(F.max_by("rows", "told").alias("rows"))


def stream_telemetry(spark, sf_dir):
    """Counters that a listener merged over the micro-batches of a stream."""
    told = live_telemetry.Telemetry(spark)
    spark.streams.addListener(told)
    try:
        live = live_telemetry.watched(_source(spark, _stored(spark, sf_dir), 5))
        writer = live.writeStream.format("noop").option("checkpointLocation", scratch.folder(spark, "checkpoint"))
        writer.trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(told)
    known = told.counts()
    keys = (*live_telemetry.SUMS, "timestamp_min", "timestamp_max", "lost_logs_total", "log_refused_total")
    return spark.createDataFrame([tuple(known[k] for k in keys)], ", ".join(f"{k} long" for k in keys))


def stream_producers(spark, sf_dir):
    """Three runs of a stream on one checkpoint: batches of each producer as they close, those left open at the end."""
    rows = _stored(spark, sf_dir).withColumn("producer", F.pmod("response_size", F.lit(3)))
    source, out, checkpoint = (scratch.folder(spark, n) for n in ("source", "batches", "checkpoint"))
    n = rows.count()
    for k in range(3):
        rows.where(f"sequence > {n * k // 3} and sequence <= {n * (k + 1) // 3}").write.mode("append").parquet(source)
        live, idle = spark.readStream.schema(rows.schema).parquet(source), 600_000 if k < 2 else 500
        query = producers.start(producers.producer_batches(live, "producer", ROWS, idle_ms=idle), out, checkpoint, "0 seconds")
        if k < 2:
            producers.caught_up(query)
            query.stop()
        else:
            producers.drain(query, idle)
    return spark.read.parquet(out).select("sequence", "producer", "batch_id")


QUERIES = {
    "flagship": flagship, "strip_params": strip_params, "truncate_middle": truncate_middle, "null_resource": null_resource, "clip_endpoint": clip_endpoint,
    "classify_ip": classify_ip, **{f"anon_ip_l{k}": anon_ip(k) for k in range(1, 5)}, "format_timestamp": format_timestamp, "verb_decode": verb_decode,
    "narrow_status": narrow_status, "dotted_quad": dotted_quad, "sequence": sequence, "batch_assign": batch_assign, "batch_dynamic": batch_dynamic, "batch_saturated": batch_saturated, "dict_build": dict_build,
    "dict_counts": dict_counts, "dict_encode": dict_encode, "dict_decode": dict_decode, "dict_decode_missing": dict_decode_missing, "roundtrip": roundtrip,
    "format_line": format_line, "filtered_decode": filtered_decode, "json_export": json_export, "telemetry": telemetry_counters,
    "compression_ratio": compression_ratio, "entropy_per_row": entropy_per_row, "entropy_mean": entropy_mean, "global_order": global_order,
    "line_load": line_load, "generated": generated, "block_roundtrip": block_roundtrip, "block_files": block_files, "text_export": text_export,
    "rotation": rotation, "rotation_files": rotation_files, "text_export_headers": text_export_headers, "block_sizes": block_sizes,
    "telemetry_blocks": telemetry_blocks, "block_ratio": block_ratio, "block_statistics": block_statistics, "block_skipping": block_skipping,
    "block_skipping_string": block_skipping_string, "stream_blocks": stream_blocks, "dict_kept": dict_kept, "dict_kept_encode": dict_kept_encode,
    "merged_order": merged_order, "distinct_sketches": distinct_sketches, "throughput_windows": throughput_windows, "throughput_peak": throughput_peak,
    "throughput_stream": throughput_stream, "stream_telemetry": stream_telemetry, "stream_producers": stream_producers, "truncate_middle_bytes": truncate_middle_bytes, "anon_ip_forms": anon_ip_forms, "stream_equals_batch": stream_equals_batch,
}

_VIEW = """with recursive_free as (select 1), log_view as (
    select event_id + 1 as sequence, epoch_us(ts) + 11644473600000000 as timestamp_us, url as resource,
    case user_id % 5 when 0 then '2001:db8::' || (user_id % 100) when 1 then '10.' || (user_id % 256) || '.7.' || (event_id % 250) || ':8080'
        when 2 then 'host' || user_id || '.example.net' else '192.168.' || (user_id % 256) || '.' || (event_id % 256) end as endpoint,
    case event_type when 'error' then 500 when 'signup' then 201 else 200 end::bigint as status_code,
    case when event_type in ('view', 'click') then 1 when event_type = 'purchase' then 2 when event_type = 'signup' then 3 else 0 end::smallint as operation_id,
    floor(value)::int as duration_ms, (user_id % 64)::int as data_size_bucket, (event_id % 256)::smallint as flags
    from events left join pages on page_id = event_id % (select count(*) from pages)),
stored as (select sequence, timestamp_us, coalesce(nullif(regexp_replace(resource, '[?].*$', '?', 's'), ''), 'NULL') as resource, coalesce(left(endpoint, 79), '') as endpoint,
    (status_code % 65536)::int as http_code, duration_ms, data_size_bucket as response_size, operation_id as http_verb, flags from log_view),
batched as (select *, (sequence - 1) // 640 as batch_id from stored),
dict as (select batch_id, kind, row_number() over (partition by batch_id, kind order by first, value) - 1 as id, value from (
    select batch_id, 'resource' as kind, resource as value, min(sequence) as first from batched group by all
    union all select batch_id, 'endpoint', endpoint, min(sequence) from batched group by all))
""".replace("recursive_free as (select 1), ", "")



def _cut(source: str) -> str:
    """Begins of batches one after another, from rows (producer, place from 0, resource, endpoint)."""
    ordered = "(partition by producer, {} order by place rows between unbounded preceding and 1 preceding)"
    return f""", marked as materialized (select producer, place, coalesce(max(place) over {ordered.format('resource')}, -1) as last_resource,
        coalesce(max(place) over {ordered.format('endpoint')}, -1) as last_endpoint from {source}),
    cuts as (select distinct producer, 0::bigint as begin, 0::bigint as batch_id, false as was_full from marked
        union all select producer, coalesce(min(place) filter (r > {SLOTS} or e > {SLOTS}), max(place) + 1), batch_id + 1, count(*) filter (r > {SLOTS} or e > {SLOTS}) > 0
        from (select c.producer, c.batch_id, m.place, sum((last_resource < c.begin)::int) over (partition by c.producer, c.batch_id order by place) as r,
                sum((last_endpoint < c.begin)::int) over (partition by c.producer, c.batch_id order by place) as e
            from cuts c join marked m on m.producer = c.producer and m.place between c.begin and c.begin + {ROWS - 1}) group by producer, batch_id)"""


_KEPT = """, kept as (select kind, row_number() over (partition by kind order by not early, value) - 1 as id, value from (
    select kind, value, bool_or(sequence % 5 < 2) as early from (
        select 'resource' as kind, resource as value, sequence from stored union all select 'endpoint', endpoint, sequence from stored) group by all))
"""
_WINDOWS = """, windows as (select start_us, count(*) as rows from (select unnest([u // 3600000000 * 3600000000, u // 3600000000 * 3600000000 - 3600000000]) as start_us
    from (select timestamp_us - 11644473600000000 as u from stored)) group by all)
"""

_VERBS = " ".join(f"when {k} then '{v}'" for k, v in enumerate(text.VERBS))


def _masked(level: int) -> str:
    """Masking of the endpoints that the view has: dotted quads with an optional port, and 2001:db8::n."""
    u = min(2 * level, 8)
    v4 = (
        f"array_to_string(list_transform(string_split(split_part(endpoint, ':', 1), '.'), lambda x, i: case when i > {4 - level} then repeat('x', length(x)) else x end), '.')"
        " || case when contains(endpoint, ':') then ':' || split_part(endpoint, ':', 2) else '' end"
    )
    # four tokens, the empty one stands for five zeros, one token behind it
    keep = 2 if u <= 6 else 2 - (u - 6)
    v6 = f"array_to_string(list_transform(string_split(endpoint, ':'), lambda x, i: case when i > {keep} then repeat('x', length(x)) else x end), ':')"
    return f"case when endpoint like '2001%' then {v6} when endpoint like 'host%' then endpoint else {v4} end"


_LINE = (
    "'[' || sequence || '] [' || strftime(make_timestamp(timestamp_us - 11644473600000000), '%Y-%m-%dT%H:%M:%S.%fZ') || '] [' || resource || '] [' || endpoint || '] [' || http_code || '] ['"
    f" || case http_verb {_VERBS} end || '] [' || duration_ms || 'ms] [' || response_size || 'b] [' || flags || ']'"
)
_ENTROPY = """e as (select page_id, sum(-(n / t) * log2(n / t)) as h from (select page_id, c, count(*)::double as n, sum(count(*)) over (partition by page_id) as t
    from (select page_id, unnest(string_split(url, '')) as c from pages) group by page_id, c) group by page_id)"""

ORACLE = {
    "flagship": _VIEW + f"""select {_masked(2)} as endpoint, resource, count(*) as requests, sum((http_code >= 400)::int)::bigint as errors,
        sum(duration_ms)::bigint as total_ms, max(duration_ms) as max_ms from stored group by 1, 2""",
    "strip_params": "select page_id, regexp_replace(url, '[?].*$', '?', 's') as resource from pages",
    "truncate_middle": "select doc_id, case when strlen(text) < 563 then text else left(text, 80) || '...' || right(text, 479) end as resource from documents",
    "truncate_middle_bytes": """select doc_id, case when length(t) < 563 then t else left(t, 80) || '...' || right(t, 479) end as resource
        from (select doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '??', 'g') as t from documents)""",
    "null_resource": "select event_id, coalesce(nullif(case event_id % 3 when 0 then '' when 1 then event_type end, ''), 'NULL') as resource from events",
    "clip_endpoint": "select event_id, coalesce(left(case when event_id % 4 > 0 then repeat(event_type, event_id % 30) end, 79), '') as endpoint from events",
    "classify_ip": _VIEW + "select sequence, case when endpoint like '2001%' then 1 when endpoint like 'host%' then -1 else 0 end as class from log_view",
    **{f"anon_ip_l{k}": _VIEW + f"select sequence, {_masked(k)} as endpoint from log_view" for k in range(1, 5)},
    "anon_ip_forms": "select event_id, t.* from (values " + ", ".join(f"({k}, {f[1]}, " + ", ".join(f"'{x}'" for x in f[2:]) + ")" for k, f in enumerate(FORMS)) + ") t(form, class, level_1, level_2, level_3, level_4) join events on event_id % {} = form".format(len(FORMS)),
    "format_timestamp": "select event_id + 1 as sequence, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as ts from events",
    "verb_decode": f"select event_id, case event_id % 45 {_VERBS} else (event_id % 45)::varchar end as verb from events",
    "narrow_status": "select event_id, ((event_id * 37 + 65000) % 65536)::int as http_code from events",
    "dotted_quad": """select event_id, (a >> 24) || '.' || ((a >> 16) & 255) || '.' || ((a >> 8) & 255) || '.' || (a & 255) as address
        from (select event_id, (event_id * 2654435761) % 4294967296 as a from events)""",
    "sequence": "select event_id, row_number() over (order by ts, event_id) as sequence from events",
    "batch_assign": "select event_id, user_id, (row_number() over (partition by user_id order by event_id) - 1) // 16 as batch_id from events",
    "batch_dynamic": _VIEW.replace("with", "with recursive", 1) + ", placed as (select 0 as producer, sequence - 1 as place, resource, endpoint from stored)" + _cut("placed")
    + " select sequence, batch_id from stored asof join cuts on sequence - 1 >= begin",
    "batch_saturated": _VIEW.replace("with", "with recursive", 1)
    + ", placed as (select data_size_bucket % 3 as producer, sequence, row_number() over (partition by data_size_bucket % 3 order by sequence) - 1 as place, resource, endpoint from log_view)"
    + _cut("placed") + f""", first as (select producer, min(begin) as cut from cuts where was_full group by producer),
    ids as (select f.producer, cut, batch_id from first f join cuts c on c.producer = f.producer and c.begin = f.cut)
    select sequence, p.producer, case when place >= cut then i.batch_id + (place - cut) // {SLOTS - SLOTS // 32} else c.batch_id end as batch_id
    from placed p asof join cuts c on p.producer = c.producer and p.place >= c.begin left join ids i on i.producer = p.producer""",
    "dict_build": _VIEW + "select * from dict",
    "dict_counts": _VIEW + "select batch_id, count(*) as rows, count(distinct resource) as resource_count, count(distinct endpoint) as endpoint_count from batched group by 1",
    "dict_encode": _VIEW + """select sequence, b.batch_id, u.id as url_idx, i.id as ip_idx from batched b
        join dict u on u.batch_id = b.batch_id and u.kind = 'resource' and u.value = resource join dict i on i.batch_id = b.batch_id and i.kind = 'endpoint' and i.value = endpoint""",
    "dict_decode": _VIEW + "select sequence, batch_id, resource, endpoint from batched",
    "dict_decode_missing": _VIEW + """select sequence, case when u.id % 3 = 0 then 'NOT_FOUND' else resource end as resource, case when i.id % 3 = 0 then 'NOT_FOUND' else endpoint end as endpoint
        from batched b join dict u on u.batch_id = b.batch_id and u.kind = 'resource' and u.value = resource join dict i on i.batch_id = b.batch_id and i.kind = 'endpoint' and i.value = endpoint""",
    "roundtrip": _VIEW + f"select sequence, timestamp_us, resource, {_masked(2)} as endpoint, http_code, duration_ms, response_size, http_verb, flags from stored",
    "format_line": _VIEW + f"select sequence, {_LINE} as line from stored",
    "filtered_decode": _VIEW + "select sequence, resource, endpoint, http_code from stored where http_code >= 400",
    "json_export": _VIEW + "select to_json({'sequence': sequence, 'http_code': http_code, 'endpoint': endpoint})::varchar as value from stored",
    "telemetry": _VIEW + """select sum(n)::bigint as log_processed_total, count(*) as batch_flushed_total, sum(n - u)::bigint as dictionary_hits_resource,
        sum(n - i)::bigint as dictionary_hits_endpoint, max(u) as resource_count_max, max(i) as endpoint_count_max, round(100 * sum(n - u) / sum(n), 4) as hit_pct_resource,
        round(100 * sum(n - i) / sum(n), 4) as hit_pct_endpoint, 0::bigint as lost_logs_total, 0::bigint as log_refused_total
        from (select count(*) as n, count(distinct resource) as u, count(distinct endpoint) as i from batched group by batch_id)""",
    "compression_ratio": "select round(avg((event_id % 611 + 300) * 10000 // (event_id % 977 + 1000)) / 10000, 6) as ratio from events",
    "entropy_per_row": f"with {_ENTROPY} select page_id, round(h, 6) as entropy from e",
    "entropy_mean": f"with {_ENTROPY} select round(avg(round(h, 9)), 5) as entropy from e",
    "global_order": _VIEW + "select sequence, timestamp_us, resource from stored order by sequence",
    "line_load": r"""with s as (select doc_id, trim(case doc_id % 3 when 0 then '  "' || v || '"' when 1 then '"' || v || '", ' else v end, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as v
            from (select doc_id, unnest(string_split(text, chr(10))) as v from documents)),
        q as (select doc_id, case when length(v) >= 2 and v[1] = '"' and v[-1] = '"' then v[2:-2] else v end as v from s)
        select doc_id, case when v[-1] = ',' then v[:-2] else v end as value from q where (case when v[-1] = ',' then v[:-2] else v end) <> ''""",
    "block_roundtrip": _VIEW + "select sequence, timestamp_us, resource, endpoint, http_code, duration_ms, response_size, http_verb, flags from stored",
    "block_files": _VIEW + "select sequence, resource, endpoint from stored",
    "text_export": _VIEW + f"select {_LINE} as value from stored",
    "rotation": _VIEW + "select sequence, resource, endpoint, http_code from stored",
    "rotation_files": "select (i + 1)::int as place, least(15500, n - i * 15500) as rows from (select unnest(range((n + 15499) // 15500)) as i, n from (select 4 * count(*) as n from events))",
    "text_export_headers": _VIEW + f"""select {_LINE} as value from stored union all
        select chr(10) || '=== BLOCK ' || batch_id % 4 || ' === (' || count(*) || ' entries)' from batched group by batch_id union all
        select chr(10) || '=== BLOCK ' || count(distinct batch_id) || ' FAILED ===' from batched group by batch_id // 4""",
    "block_sizes": _VIEW + """, names as (select batch_id, sum(strlen(value) + 6 + (kind = 'resource')::int) as bytes from dict group by batch_id)
        select b.batch_id % 4 as block, (32 * count(*) + 24 + any_value(bytes))::bigint as raw_bytes, true as compressed from batched b join names using (batch_id) group by b.batch_id""",
    "block_ratio": _VIEW + """, names as (select sum(strlen(value) + 6 + (kind = 'resource')::int) as bytes from dict)
        select compression, count(distinct batch_id) as blocks, (32 * count(*) + 24 * count(distinct batch_id) + any_value(bytes))::bigint as raw_bytes, compression = 'balanced' as smaller,
            compression = 'none' as as_is from batched, names, (values ('balanced'), ('none')) c(compression) group by compression""",
    "telemetry_blocks": _VIEW + """select to_json({'log_processed_total': count(*), 'batch_flushed_total': count(distinct batch_id), 'batch_compressed_total': count(distinct batch_id),
        'batch_written_total': count(distinct batch_id), 'log_rotation': count(distinct batch_id // 4) - 1, 'compression_failure_total': 0, 'lost_logs_total': 0, 'log_refused_total': 0,
        'backpressure_count': 0})::varchar as telemetry from batched""",
    "block_statistics": _VIEW + "select batch_id, batch_id % 4 as block, count(*) as rows, "
    + ", ".join(f"{e}({c})::bigint as {e}_{c}" for c in ("sequence", "timestamp_us", "http_code", "duration_ms", "flags") for e in ("min", "max")) + " from batched group by batch_id",
    "block_skipping": _VIEW + "select sequence, resource, endpoint, http_code from stored where sequence > 200 and sequence <= 900 and http_code >= 400",
    "block_skipping_string": _VIEW + "select sequence, resource, endpoint from stored where resource = (select regexp_replace(url, '[?].*$', '?', 's') from pages where page_id = 7)",
    "dict_kept": _VIEW + _KEPT + "select * from kept",
    "dict_kept_encode": _VIEW + _KEPT + """select sequence, u.id as url_idx, i.id as ip_idx from stored
        join kept u on u.kind = 'resource' and u.value = resource join kept i on i.kind = 'endpoint' and i.value = endpoint""",
    "merged_order": _VIEW + "select sequence, timestamp_us, resource from stored order by sequence",
    "distinct_sketches": _VIEW + """select batch_id // 4 as run, count(*) as rows, count(distinct resource) as resource_exact, count(distinct endpoint) as endpoint_exact,
        true as resource_within, true as endpoint_within from batched group by 1""",
    "throughput_windows": _VIEW + _WINDOWS + "select start_us, rows from windows",
    "throughput_peak": _VIEW + _WINDOWS + "select max(rows) as peak_rows, min(start_us) filter (rows = most) as peak_start_us, round(avg(rows), 4) as mean_rows from windows, (select max(rows) as most from windows)",
    "throughput_stream": _VIEW + _WINDOWS + "select start_us, rows from windows",
    "stream_telemetry": _VIEW + """select count(*) as log_processed_total, count(*) filter (http_code >= 400) as errors_total, sum(strlen(resource) + strlen(endpoint))::bigint as text_bytes_total,
        sum(duration_ms)::bigint as duration_ms_total, min(timestamp_us) as timestamp_min, max(timestamp_us) as timestamp_max, 0::bigint as lost_logs_total, 0::bigint as log_refused_total from stored""",
    "stream_producers": _VIEW + """select sequence, response_size % 3 as producer, (row_number() over (partition by response_size % 3 order by sequence) - 1) // 640 as batch_id from stored""",
    "stream_blocks": _VIEW + "select sequence, timestamp_us, resource, endpoint, http_code, duration_ms, response_size, http_verb, flags from stored",
    "stream_equals_batch": _VIEW + f"select sequence, resource, {_masked(2)} as endpoint, http_code from stored",
}
