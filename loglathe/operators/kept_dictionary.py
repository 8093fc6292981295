"""A dictionary that is kept over loads: a value gets its id once, ids of a kind are dense from 0 and never change.

On disk a dictionary is a row of versions.  A version is a folder of the entries that it added and a small file that names
all folders up to it and the next free ids; that file is made whole by a rename, and nobody's entries count before.  Two
loads that extend the same version at the same time: the second to finish finds its version taken, and goes again from
the new one, so no id is ever given twice.

``insert`` takes the distinct values of a load, pre-aggregated in each task, without those known (an anti-join), and
numbers what is left in the order of the values, by ranges and an offset a range.  So ids hang on the loads alone, not on
how their rows were dealt to tasks.

Defined results: a null is no value, and has no id; a load without new values makes no version; unknown values are
encoded as null, unknown ids decoded as ``NOT_FOUND``; an empty dictionary is one of no entries.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.manifest import store_of, write_whole
from ..sources.scratch import written
from .batching import dense_numbers
from .dictionary import KINDS, NOT_FOUND

ENTRY = "kind string, id bigint, value string"
#: Entries up to which the dictionary is broadcast for encoding and decoding.
BROADCAST_ENTRIES = 200_000


@dataclass
class Version:
    number: int
    folders: list[str]
    next_ids: dict[str, int]


class KeptDictionary:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> Version:
        store, folder = store_of(f"{self.path}/versions")
        names = [i.base_name for i in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.base_name.endswith(".json") and not i.base_name.startswith(".")]
        if not names:
            return Version(0, [], dict.fromkeys(KINDS, 0))
        with store.open_input_stream(f"{folder}/{max(names)}") as file:
            return Version(**json.loads(file.read()))

    def entries(self, version: Version | None = None) -> DataFrame:
        """(kind, id, value) of all values."""
        v = version or self.version()
        if not v.folders:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(*[f"{self.path}/{f}" for f in v.folders])

    def insert(self, rows: DataFrame) -> Version:
        """Gives ids to the values of a load that have none yet."""
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in KINDS]))
        values = written(rows.select(pairs.alias("p")).select("p.kind", "p.value").where("value is not null").distinct(), "dictionary-values")
        while True:
            now = self.version()
            new = values.join(self.entries(now).select("kind", "value"), ["kind", "value"], "left_anti")
            numbered = written(dense_numbers(new, "kind", "value", name="n"), "dictionary-new")
            told = {r["kind"]: (r["first"], r["n"]) for r in numbered.groupBy("kind").agg(F.min("n").alias("first"), F.count("*").alias("n")).collect()}  # a row a kind
            if not told:
                return now
            base = F.lit(None).cast("bigint")
            for kind, (first, _) in told.items():
                base = F.when(F.col("kind") == kind, F.lit(now.next_ids[kind] - first)).otherwise(base)
            folder = f"entries-{uuid.uuid4().hex}"
            numbered.select("kind", (F.col("n") + base).alias("id"), "value").write.parquet(f"{self.path}/{folder}")
            then = Version(now.number + 1, [*now.folders, folder], {k: now.next_ids[k] + told.get(k, (0, 0))[1] for k in KINDS})
            if write_whole(f"{self.path}/versions", f"{then.number:012d}.json", json.dumps(then.__dict__).encode()):
                return then
            store, top = store_of(self.path)  # another load was first
            store.delete_dir(f"{top}/{folder}")

    def _side(self, version: Version, kind: str, idx: str) -> DataFrame:
        side = self.entries(version).where(F.col("kind") == kind).select(F.col("id").alias(idx), F.col("value").alias(kind))
        return F.broadcast(side) if version.next_ids[kind] <= BROADCAST_ENTRIES else side

    def encode(self, rows: DataFrame) -> DataFrame:
        """Both strings replaced by their ids (url_idx, ip_idx)."""
        version = self.version()
        for kind, idx in zip(KINDS, ("url_idx", "ip_idx"), strict=True):
            rows = rows.join(self._side(version, kind, idx), kind, "left").drop(kind)
        return rows

    def decode(self, records: DataFrame) -> DataFrame:
        version = self.version()
        for kind, idx in zip(KINDS, ("url_idx", "ip_idx"), strict=True):
            joined = records.join(self._side(version, kind, idx), idx, "left")
            records = joined.withColumn(kind, F.coalesce(F.col(kind), F.when(F.col(idx).isNotNull(), NOT_FOUND))).drop(idx)
        return records
