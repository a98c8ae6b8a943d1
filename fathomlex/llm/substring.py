"""Substring dedup over a log-structured index of window fingerprints.

The unit is the window of ``SPAN`` words.  Of the ``K_WORDS``-word grams inside
a window the least is its fingerprint, so equal windows have equal fingerprints
and neighbouring windows mostly share theirs.  The index keeps the fingerprints
of all batches so far in immutable runs, sorted by fingerprint.  A new batch is
merge-joined with the runs and with itself; windows of the fingerprints that
occur in more than one document are read again from the texts and compared
whole, under a second and independent hash.  Then the batch becomes a run of
its own, and runs of one level are merged into one of the next.  A run is a
bucketed table, sorted in each bucket: only the new batch's fingerprints move
to meet it, run by run, and merging runs moves nothing.  Of the history's texts
none but those of documents that share a fingerprint are looked into.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bitmap
from . import kernels as K
from .common import col, documents, drop, ints, map_chunks, map_gather, n_parts, new_path, spread, unblobbed, written

SPAN = 50
K_WORDS = 25
_W = SPAN - K_WORDS + 1
_LOW = np.uint64((1 << 28) - 1)
_ROW = np.dtype([("w", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("new", "u1")])


def _windows(texts: pa.Array) -> tuple[K.Words, np.ndarray, np.ndarray]:
    """Words of a chunk, the places of all windows, and the place of each one's fingerprint gram."""
    x = K.words(texts)
    g = K.grams(x.hash, K_WORDS)
    place = np.flatnonzero(K.inside(x.doc, SPAN))
    if not len(place):
        return x, place, place
    key = (g & ~_LOW) | (_LOW - np.arange(len(g), dtype=np.uint64))
    return x, place, (_LOW - (K.sliding_min(key, _W)[place] & _LOW)).astype(np.int64)


def _prints(c: pa.RecordBatch) -> pa.RecordBatch:
    x, _, at = _windows(col(c, "text"))
    at = np.unique(at)
    fp = K.grams(x.hash, K_WORDS)[at] if len(at) else np.zeros(0, np.uint64)
    return pa.record_batch([pa.array(fp.view(np.int64)), pa.array(ints(c, "doc_id")[x.doc[at]] if len(at) else np.zeros(0, np.int64), pa.int64())], ["fp", "doc_id"])


class Index:
    """Runs of (fp, doc_id) in a folder; the manifest that names them is replaced as a whole, after all that it names is written."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 2) -> None:
        self.spark, self.path, self.fanout = spark, path, fanout

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def manifest(self) -> dict:
        """{"version", "batches", "runs": [[level, path], ...]} of the newest complete version."""
        fs, jvm = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        done = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        done = [n for n in done if n.endswith(".done")]
        if not done:
            return {"version": 0, "batches": [], "runs": []}
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/{max(done)}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, m: dict) -> None:
        """Write a manifest under a name of its own, then give it its version; an error if another writer has that."""
        fs, jvm = self._fs()
        name = f"{self.path}/manifest/{m['version']:09d}"
        part = f"{name}.{uuid.uuid4().hex}.part"
        out = fs.create(jvm.org.apache.hadoop.fs.Path(part), True)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        done = jvm.org.apache.hadoop.fs.Path(name + ".done")
        if fs.exists(done) or not fs.rename(jvm.org.apache.hadoop.fs.Path(part), done):
            raise RuntimeError(f"version {m['version']} was committed by another writer")

    def run(self, r: list) -> DataFrame:
        """A run as a table whose buckets Spark knows."""
        _, path, buckets = r
        name = "run_" + hashlib.sha1(path.encode()).hexdigest()
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (fp BIGINT, doc_id BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp, doc_id) INTO {buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def history(self, m: dict) -> DataFrame:
        return reduce(DataFrame.unionByName, (self.run(r) for r in m["runs"]), self.spark.createDataFrame([], "fp long, doc_id long"))

    def _run(self, prints: DataFrame, level: int, buckets: int) -> list:
        tag = uuid.uuid4().hex
        to = f"{self.path}/run-{level}-{tag}"
        name = "run_" + hashlib.sha1(to.encode()).hexdigest()
        prints.repartition(buckets, "fp").write.format("parquet").option("path", to).bucketBy(buckets, "fp").sortBy("fp", "doc_id").saveAsTable(name)
        return [level, to, buckets]

    def _forget(self, r: list) -> None:
        fs, jvm = self._fs()
        self.spark.sql(f"DROP TABLE IF EXISTS run_{hashlib.sha1(r[1].encode()).hexdigest()}")
        fs.delete(jvm.org.apache.hadoop.fs.Path(r[1]), True)

    def add(self, batch_id: str, prints: DataFrame, buckets: int) -> None:
        """Append a batch's fingerprints as a run of so many buckets and compact; a batch id that is already there changes nothing.

        Runs that were merged are deleted once no manifest to come names them: a
        reader works on the newest manifest.
        """
        m = self.manifest()
        if batch_id in m["batches"]:
            return
        runs, gone = [*m["runs"], self._run(prints, 0, buckets)], []
        level = 0
        while len(same := [r for r in runs if r[0] == level]) > self.fanout:
            merged = self.history({"runs": same})
            runs = [*(r for r in runs if r[0] != level), self._run(merged, level + 1, max(r[2] for r in same))]
            gone += same
            level += 1
        self._commit({"version": m["version"] + 1, "batches": [*m["batches"], batch_id], "runs": runs})
        for r in gone:
            self._forget(r)


def ingest(index: Index, batch_id: str, batch: DataFrame, history: DataFrame) -> DataFrame:
    """Add a batch to the index; the spans of its documents that earlier ones have: (doc_id, start_word, n_words, first_doc).

    ``history``: the documents of all batches so far, from which the windows in
    question are read again.  A window is repeated if a document of the history
    has it, or one of the batch with a lesser doc_id; overlapping and adjoining
    repeated windows of a document are one span; first_doc is the least id among
    the windows' first documents.  Rows without id or text and texts of fewer
    than ``SPAN`` words have no spans.  Rows that share an id count as one
    document, never as a repeat of each other.  Texts of any length are taken
    whole; an empty batch has no spans.
    """
    spark = batch.sparkSession
    batch, history = documents(batch), documents(history)
    parts = 2 * n_parts(history.unionByName(batch))  # each part is sorted in memory
    new = written(map_chunks(batch, _prints, "fp long, doc_id long").distinct(), "prints")
    m = index.manifest()
    if batch_id in m["batches"]:
        raise ValueError(f"batch {batch_id} is in the index")
    runs = [index.run(r) for r in m["runs"]]
    own = new.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    found = [own.where("lo <> hi").select("fp"), *(own.select("fp").join(r, "fp", "left_semi") for r in runs)]
    shared = written(reduce(DataFrame.unionByName, found).distinct(), "shared")
    hot = spark.sparkContext.broadcast(bitmap.of(shared, "fp"))
    homes = reduce(DataFrame.unionByName, (x.join(shared, "fp", "left_semi").select("doc_id") for x in (new, *runs)))
    at_home = spark.sparkContext.broadcast(bitmap.of(homes, "doc_id"))

    def windows(c: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x, place, gram = _windows(col(c, "text"))
        if not len(place):
            return np.zeros(0, np.int64), np.zeros(0, _ROW)
        fp = K.grams(x.hash, K_WORDS)[gram]
        ok = bitmap.has(hot.value, fp.view(np.int64))
        place, fp = place[ok], fp[ok]
        out = np.empty(len(place), _ROW)
        out["w"] = K.grams(K.span_hash(x.data, x.start, x.end, True), SPAN)[place]
        doc = x.doc[place]
        out["doc"], out["at"], out["new"] = ints(c, "doc_id")[doc], place - x.offsets[doc], ints(c, "new")[doc]
        return spread(fp, parts), out

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(bitmap.has(at_home.value, ints(b, "doc_id"))))

    texts = history.withColumn("new", F.lit(0)).unionByName(batch.withColumn("new", F.lit(1)))
    texts = texts.mapInArrow(filtered, "doc_id long, text string, new int")

    def repeated(table: pa.Table) -> pa.Table:
        r = unblobbed(table, _ROW)
        r = r[np.lexsort((r["at"], r["doc"], r["new"], r["w"]))]
        first = np.flatnonzero(np.r_[True, r["w"][1:] != r["w"][:-1]])
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(r)]))
        lead = r[first[group]]
        ok = (r["new"] == 1) & ((lead["new"] == 0) | (lead["doc"] < r["doc"]))
        doc, at, src = r["doc"][ok], r["at"][ok].astype(np.int64), lead["doc"][ok]
        # windows side by side in this part become one row
        order = np.lexsort((at, doc))
        doc, at, src = doc[order], at[order], src[order]
        if not len(doc):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64())], ["doc_id", "lo", "hi", "src"])
        start = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)])
        end = np.r_[start[1:], len(doc)] - 1
        return pa.table([pa.array(doc[start]), pa.array(at[start].astype(np.int32)), pa.array((at[end] + 1).astype(np.int32)), pa.array(np.minimum.reduceat(src, start))], ["doc_id", "lo", "hi", "src"])

    runs = map_gather(texts, windows, parts).groupBy("part").applyInArrow(repeated, "doc_id long, lo int, hi int, src long")
    by_doc = Window.partitionBy("doc_id").orderBy("lo", "hi")
    fresh = F.coalesce(F.col("lo") > F.max("hi").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    island = runs.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(by_doc))
    spans = island.groupBy("doc_id", "island").agg(F.min("lo").alias("start_word"), (F.max("hi") - F.min("lo") + (SPAN - 1)).alias("n_words"), F.min("src").alias("first_doc"))
    result = written(spans.select("doc_id", "start_word", "n_words", "first_doc"), "spans")
    index.add(batch_id, new, max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    drop(new)
    drop(shared)
    return result


def find_repeated_spans(docs: DataFrame, n_batches: int = 3, path: str | None = None) -> DataFrame:
    """The spans of all documents that documents of lesser id have, by ingesting ``docs`` batch by batch in the order of their ids.

    The result doesn't depend on ``n_batches``: (doc_id, start_word, n_words, first_doc).
    An empty table has none; nulls, short texts and repeated rows are as in ``ingest``.
    """
    spark = docs.sparkSession
    docs = documents(docs)
    index = Index(spark, path or new_path(spark, "index"))
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    out = spark.createDataFrame([], "doc_id long, start_word int, n_words int, first_doc long")
    if lo is None:
        return out
    cut = [lo + (hi + 1 - lo) * i // n_batches for i in range(n_batches + 1)]
    for i in range(n_batches):
        to = F.col("doc_id") < cut[i + 1] if i + 1 < n_batches else F.lit(True)  # hi + 1 may be no long
        batch = docs.where((F.col("doc_id") >= cut[i]) & to)
        out = out.unionByName(ingest(index, f"{i}", batch, docs.where(F.col("doc_id") < cut[i])))
    return out
