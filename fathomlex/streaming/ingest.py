"""Continuous ingest: each micro-batch replaces or deletes the documents that it holds.

The store is a folder of tables of changes and a state that names those that
count.  A batch is written as a table of its own before a state that names it,
so a reader never sees half of one, a batch that is repeated after a failure
counts once, and the work of a batch follows its own size; from time to time the
tables are merged into one.  Deletes stay as rows, with their clock, so that a
write that comes late with a lesser clock doesn't bring a document back.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index as ix
from ..plans.schema import Schema
from ..sources import extract

DOCS = "index string, doc_id string, fields map<string,string>, key_clock bigint"
CHANGES = f"{DOCS}, deleted boolean"
#: Tables that lie side by side before they are merged.
FANOUT = 8


def changes(objects: DataFrame, schema: Schema, extractors: extract.Own | Mapping[str, extract.Own] | None = None) -> DataFrame:
    """What a hook on an object store hands on: (doc_id, fields, key_clock, deleted) of objects (bucket, key, content_type, value, key_clock, deleted).

    Each object is read by the extractor of its bucket or content type; one that
    is deleted, or has no value, deletes its document; the last of a key by
    clock counts.  An object that gives no fields is a document without any.
    """
    rank = ix.last_docs(objects.where("key IS NOT NULL").select(F.lit(schema.name).alias("index"), F.col("key").cast("string").alias("doc_id"), F.map_from_arrays(F.array(F.lit("v")), F.array(F.col("value").cast("string"))).alias("fields"), F.col("key_clock").cast("long").alias("key_clock"), (F.coalesce("deleted", F.lit(False)) | F.col("value").isNull()).alias("deleted"), *(c for c in ("bucket", "content_type", "value") if c in objects.columns)))
    live = rank.where("NOT deleted").withColumnRenamed("doc_id", "key")
    fields = ix.from_fields(extract.extracted(live, schema.default_field, extractors), schema.name).select("doc_id", F.col("fields").alias("_f"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return rank.select("doc_id", "key_clock", "deleted").join(fields, "doc_id", "left").select("doc_id", F.coalesce("_f", none).alias("fields"), "key_clock", "deleted")


@dataclass
class Store:
    """The documents of an index at ``path``, of which postings follow."""

    spark: SparkSession
    path: str
    schema: Schema
    fanout: int = FANOUT

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def state(self) -> dict:
        """{"version", "tables", "applied"} of the newest complete version; applied: the last batch of each stream."""
        fs, path = self._fs()
        folder = path(f"{self.path}/state")
        done = [n for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.endswith(".done")] if fs.exists(folder) else []
        if not done:
            return {"version": -1, "tables": [], "applied": {}}
        stream = fs.open(path(f"{self.path}/state/{max(done)}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _save(self, state: dict) -> None:
        fs, path = self._fs()
        name = f"{self.path}/state/{state['version']:012d}"
        part = f"{name}.{uuid.uuid4().hex}.part"
        out = fs.create(path(part), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(path(name + ".done")) or not fs.rename(path(part), path(name + ".done")):
            raise RuntimeError(f"version {state['version']} was written by another writer")

    def version(self) -> int:
        """The newest complete version, -1 for none."""
        return self.state()["version"]

    def _changes(self, tables: list[str]) -> DataFrame:
        return self.spark.read.schema(CHANGES).parquet(*(f"{self.path}/{t}" for t in tables)) if tables else self.spark.createDataFrame([], CHANGES)

    def docs(self) -> DataFrame:
        """The last of each document by clock, but those that were deleted."""
        return ix.last_docs(self._changes(self.state()["tables"])).where("NOT deleted").drop("deleted")

    def postings(self) -> DataFrame:
        return ix.postings(self.docs(), self.schema, clock=F.col("key_clock"))

    def apply(self, batch: DataFrame, batch_id: int, stream: str = "") -> None:
        """Upserts and deletes of (doc_id, fields, key_clock, deleted): the last of each document by clock wins, also against what is stored.

        A batch of a stream that was applied before changes nothing; another
        stream has batches of its own.
        """
        state = self.state()
        if state["applied"].get(stream, -1) >= batch_id:
            return
        new = batch.select(F.lit(self.schema.name).alias("index"), F.col("doc_id").cast("string").alias("doc_id"), "fields", F.col("key_clock").cast("long").alias("key_clock"), F.coalesce("deleted", F.lit(False)).alias("deleted")).where("doc_id IS NOT NULL")
        table = f"changes-{uuid.uuid4().hex}"
        ix.last_docs(new).write.parquet(f"{self.path}/{table}")
        tables = [*state["tables"], table]
        if len(tables) > self.fanout:
            merged = f"merged-{uuid.uuid4().hex}"
            ix.last_docs(self._changes(tables)).write.parquet(f"{self.path}/{merged}")
            tables = [merged]
        self._save({"version": state["version"] + 1, "tables": tables, "applied": {**state["applied"], stream: batch_id}})

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Apply every micro-batch of a stream; it is known by its query's id, which the checkpoint keeps."""

        def one(batch: DataFrame, batch_id: int) -> None:
            self.apply(batch, batch_id, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint)

        return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
