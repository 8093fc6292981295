"""Token-id output: whole texts encoded, appended to files of ``id_file`` in ascending id order.

Documents are dealt to ranges of ids, sorted, encoded and written by one task a range, so concatenating
the files in order gives all ids in order.  A task writes under a name of its own attempt and renames
when it is done: a repeated task replaces the file by an equal one.

Defined results: a null text is empty (the end id alone); null ids come first; equal ids are ordered by
text hash, then by text, and are written each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow, empty_text, new_path, partitions, release

#: Bytes of text a file aims at, where that makes more files than Spark makes shuffle partitions; ids that one task reads back.
FILE_BYTES, READ_IDS, READ_DOCS = 256 << 20, 16 << 20, 4000


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, spaces: bool = True, id_col: str = "doc_id", text: str = "text") -> list[tuple[int, str, int, int]]:
    """Writes the files; returns (part, path, documents, tokens) of each in order, a row a file."""
    spark = docs.sparkSession
    bound_arrow(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), empty_text(F.col(f"`{text}`")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t").cast("bigint"))).first()[0] or 0
    rows = rows.withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange(max(partitions(spark), -(-size // FILE_BYTES)), "id", "h").sortWithinPartitions("id", "h", "t").select("id", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        from .id_file import Writer
        from .tokens import batches as runs
        from .tokens import encoder

        part = TaskContext.get().partitionId()
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        own, final = f"{path}/.{part}-{uuid.uuid4().hex}", f"{path}/part-{part:06d}.llid"
        enc, docs_n = encoder(tokenizer, spaces), 0
        with store.open_output_stream(own) as out:
            writer = Writer(out)
            for batch in batches:
                texts, ids = batch.column("t"), batch.column("id").to_pylist()
                for first, last in runs(texts):
                    flat, lens = enc.encode(texts.slice(first, last - first))
                    at = 0
                    for doc, n in zip(ids[first:last], lens.tolist(), strict=True):
                        writer.add(doc, np.append(flat[at : at + n], np.uint32(end_id)))
                        at += n
                docs_n += len(ids)
            writer.finish()
        release()
        if not docs_n:
            store.delete_file(own)
            return
        store.move(own, final)
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [final], "docs": [docs_n], "tokens": [writer.tokens]})

    made = rows.mapInArrow(write, "part long, path string, docs long, tokens long")
    return sorted((r["part"], r["path"], r["docs"], r["tokens"]) for r in made.collect())


def read_documents(spark, folder: str, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """One row a document from the files alone: doc_id, start, n_tokens, ids_crc32 over the ids as read."""
    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    pieces, base = [], 0
    for _, path, _, tokens in files:
        pieces += [(path, base, low, low + READ_IDS) for low in range(0, tokens, READ_IDS)]
        base += tokens
    known = spark.sparkContext.broadcast(pieces)  # one for READ_IDS ids and a file at most

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        from .id_file import Reader

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                path, base, low, high = known.value[k]
                with store.open_input_file(path) as file:
                    found = Reader(file).documents(low, high)
                    told = ((doc, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, at, ids in found)
                    while out := list(islice(told, READ_DOCS)):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                        )

    n = len(pieces)
    return spark.range(0, n, 1, n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    spark = docs.sparkSession
    folder = new_path(spark, "ids")
    return read_documents(spark, folder, write_ids(docs, folder, tokenizer, end_id, True, id_col, text))
