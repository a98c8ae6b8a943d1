"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes - inserts, deletes, revised counts - becomes at most two
signed rows a change and is added up to one small table of deltas, which is
written to a folder named by the batch before a marker commits it.  Totals are
the sum of all committed deltas, so they never need the documents again; a
batch that is committed twice counts once; deltas that have piled up are merged
into one.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import col, new_path, small_batches, written

FOLDER = os.environ.get("FATHOMLEX_TOKENIZERS", "/opt/tokenizers")
#: Splits a text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ("source", "lang", "tokenizer")
SUMS = ("docs", "tokens", "chars")
DELTA = "source string, lang string, tokenizer string, docs long, tokens long, chars long"
#: Deltas that may lie side by side before they are merged.
FANOUT = 8

Counter = Callable[[pa.Array], np.ndarray]


class WordCounter:
    """Words as ``kernels`` defines them."""

    def __call__(self, texts: pa.Array) -> np.ndarray:
        return np.diff(K.words(texts).offsets)


class RankCounter:
    """Tokens of a byte-level BPE rank file, which is read where this is made, on the driver; long texts are counted whole."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.data = f.read()
        self.encoding = None

    def __getstate__(self) -> dict:
        return {"data": self.data, "encoding": None}

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if self.encoding is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.data.splitlines())}
            self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return np.array([len(self.encoding.encode_ordinary(t)) if t else 0 for t in texts.to_pylist()], np.int64)


#: Makers of counters by tokenizer version; a version, once used, keeps its meaning.
TOKENIZERS: dict[str, Callable[[], Counter]] = {
    "words-1": WordCounter,
    "byte_bpe_50k-1": lambda: RankCounter(os.path.join(FOLDER, "byte_bpe_50k.tiktoken")),
    "byte_bpe_multi_50k-1": lambda: RankCounter(os.path.join(FOLDER, "byte_bpe_multi_50k.tiktoken")),
}


def counted(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens, chars, digest) of every row of ``docs``; a null text counts 0 of both and has no digest."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(TOKENIZERS[tokenizer]())

    def run(batches):
        count = shared.value
        for b in batches:
            for c in K.chunks(b):
                yield pa.record_batch([*(col(c, n) for n in ("doc_id", "source", "lang", "chars", "digest")), pa.array(count(col(c, "text")).astype(np.int64))], ["doc_id", "source", "lang", "chars", "digest", "tokens"])

    chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    d = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), chars.alias("chars"), F.unhex(F.md5("text")).alias("digest"), "text")
    out = d.mapInArrow(run, "doc_id long, source string, lang string, chars long, digest binary, tokens long")
    return out.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), "tokens", "chars", "digest")


def inserts(rows: DataFrame) -> DataFrame:
    """Signed rows that add counted documents."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("docs"), "tokens", "chars")


def deletes(rows: DataFrame) -> DataFrame:
    """Signed rows that take counted documents away again."""
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"), (-F.col("chars")).alias("chars"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that replace counts by others; the keys may change too."""
    return deletes(old).unionByName(inserts(new))


def without_copies(rows: DataFrame) -> DataFrame:
    """Signed rows that leave one of each text and tokenizer: all of them out, and that of the least doc_id (nulls last; then the least source and language) in again. No text's rows meet in one place."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "source", "lang", "tokens", "chars")
    one = rows.where("digest IS NOT NULL").groupBy("tokenizer", "digest").agg(F.min(order).alias("o")).select("tokenizer", "o.*")
    return deletes(rows.where("digest IS NOT NULL")).unionByName(inserts(one))


class Rollup:
    """Additive totals in a folder: one committed delta table a batch, and merged ones."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.fanout = spark, path or new_path(spark, "rollup"), fanout

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        return jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _state(self) -> dict:
        """{"version", "batches", "deltas"} of the newest complete version."""
        fs, path = self._fs()
        folder = path(f"{self.path}/state")
        done = [n for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.endswith(".done")] if fs.exists(folder) else []
        if not done:
            return {"version": 0, "batches": [], "deltas": []}
        stream = fs.open(path(f"{self.path}/state/{max(done)}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _save(self, state: dict) -> None:
        fs, path = self._fs()
        name = f"{self.path}/state/{state['version']:09d}"
        part = f"{name}.{uuid.uuid4().hex}.part"
        out = fs.create(path(part), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(path(name + ".done")) or not fs.rename(path(part), path(name + ".done")):
            raise RuntimeError(f"version {state['version']} was committed by another writer")

    def _read(self, deltas: list[str]) -> DataFrame:
        if not deltas:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).parquet(*(f"{self.path}/{d}" for d in deltas))

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of signed rows; False if the batch is committed already, and then nothing changes."""
        state = self._state()
        if batch_id in state["batches"]:
            return False
        delta = f"delta-{hashlib.sha1(batch_id.encode()).hexdigest()[:16]}-{uuid.uuid4().hex[:8]}"
        self._summed(changes).write.parquet(f"{self.path}/{delta}")
        deltas = [*state["deltas"], delta]
        if len(deltas) > self.fanout:
            merged = f"merged-{uuid.uuid4().hex}"
            self._summed(self._read(deltas)).write.parquet(f"{self.path}/{merged}")
            deltas = [merged]
        self._save({"version": state["version"] + 1, "batches": [*state["batches"], batch_id], "deltas": deltas})
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens, chars); keys that no document is left of are left out."""
        return self._summed(self._read(self._state()["deltas"])).where("docs <> 0 OR tokens <> 0 OR chars <> 0")


def estimates(rows: DataFrame) -> DataFrame:
    """What documents count before a tokenizer has read them: a token for every four characters begun."""
    return rows.withColumn("tokenizer", F.lit("estimate-1")).withColumn("tokens", F.ceil(F.col("chars") / 4).cast("long"))


def maintain(docs: DataFrame, tokenizer: str = "byte_bpe_50k-1", path: str | None = None) -> DataFrame:
    """Totals after the changes that a corpus goes through: documents come in as estimates, their counts are revised by a tokenizer, copies are deleted.

    docs: doc_id, text, source, lang.  Of rows with one text, all but one of the
    least doc_id (nulls last; then the least source and language) are deleted.
    (source, lang, tokenizer, docs, tokens, chars), a row for each source and
    language that has documents left, null ones too; estimates cancel out.  An
    empty table gives no rows; null texts are no copies of each other and count
    no tokens; repeated rows are copies.
    """
    spark = docs.sparkSession
    rollup = Rollup(spark, path)
    rows = written(counted(docs, tokenizer), "counted")
    for batch, changes in (("load", inserts(estimates(rows))), ("recount", revisions(estimates(rows), rows)), ("load", inserts(estimates(rows))), ("copies", without_copies(rows))):
        rollup.commit(batch, changes)  # the second "load" is a retry and changes nothing
    return rollup.totals()


def totals(docs: DataFrame, tokenizers: Sequence[str] = tuple(TOKENIZERS), path: str | None = None) -> DataFrame:
    """Totals of all rows of ``docs``, copies too, for each tokenizer version: (source, lang, tokenizer, docs, tokens, chars).

    Documents come in as estimates, which the counts of the first version
    replace; those of the others are added.  Copies, as in ``maintain``, are
    deleted and come back, which nets out.  Null texts count no tokens; an empty
    table gives no rows.
    """
    rollup = Rollup(docs.sparkSession, path)
    rows = written(reduce(DataFrame.unionByName, (counted(docs, t) for t in tokenizers)), "counted")
    first, others = (rows.where(F.col("tokenizer") == tokenizers[0]), rows.where(F.col("tokenizer") != tokenizers[0]))
    copies = without_copies(rows)
    back = copies.select(*KEYS, *((-F.col(c)).alias(c) for c in SUMS))
    load = inserts(estimates(first))
    for batch, changes in (("load", load), ("recount", revisions(estimates(first), first)), ("load", load), ("others", inserts(others)), ("copies", copies), ("copies back", back)):
        rollup.commit(batch, changes)  # the second "load" is a retry and changes nothing
    return rollup.totals()
