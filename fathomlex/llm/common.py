"""Spark plumbing shared by the operators: shared storage, Arrow maps, byte-blob exchanges."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K


RECORDS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where that is unset and Spark is local (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="fathomlex-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: what was computed outlives the loss of any executor and is not computed again.

    The table goes when the application ends, or before with ``drop``.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    where, fs = _file_system(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(df: DataFrame) -> None:
    """Delete a table that ``written`` made, when all that was to come of it is there."""
    where, fs = _file_system(df.sparkSession, df._written)
    fs.delete(where, True)


#: Estimated bytes of input to one part of a blob exchange.
PART_BYTES = 2 << 20


def n_parts(df: DataFrame) -> int:
    """Parts of a blob exchange over ``df``: in proportion to the bytes that Spark expects of it, whatever the shuffle partitions; those alone if it can't tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 50:  # not from files
        return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(48, -(-size // PART_BYTES))


def give_back() -> None:
    """Return a worker's freed memory to the system: workers live on, and what one step freed would add to the next one's peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not this C library


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``RECORDS`` rows where the session has Spark's default, so that a batch of texts is a few MB on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, RECORDS)


def map_chunks(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", most: int = K.CHUNK_BYTES) -> DataFrame:
    """``fn`` over slices of about ``most`` bytes of text; nothing else is held in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch, column, most):
                out = fn(chunk)
                if out is not None and out.num_rows:
                    yield out
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def col(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    c = batch.column(batch.schema.get_field_index(name))
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def ints(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    """A column of integers without nulls."""
    return col(batch, name).to_numpy(zero_copy_only=False)


def blobs(part: np.ndarray, rows: np.ndarray, parts: int) -> pa.RecordBatch:
    """One (part, blob) row for each part: the structured ``rows`` that belong there, plain numbers in ascending order.

    A blob has the first bytes of all its rows, then the second bytes and so
    on: bytes that are mostly alike lie together and compress away.
    """
    if rows.dtype == np.uint32:  # sorted as one number with the part: no index is held
        both = part.astype(np.uint64) << np.uint64(32)
        both |= rows
        both.sort()
        rows = both.astype(np.uint32)
        cut = np.searchsorted(both, np.arange(parts + 1).astype(np.uint64) << np.uint64(32))
        del both
    else:
        order = np.argsort(part.astype(np.int16 if parts <= 1 << 15 else np.int64), kind="stable") if rows.dtype.names else np.lexsort((rows, part))
        rows = rows[order]
        cut = np.searchsorted(part[order], np.arange(parts + 1))
    have = np.flatnonzero(cut[1:] > cut[:-1])
    size = rows.dtype.itemsize
    offsets = np.r_[cut[have], cut[-1:] if len(have) else [0]].astype(np.int64) * size
    flat = np.ascontiguousarray(rows).view(np.uint8).reshape(-1, size)
    out = np.empty(flat.size, np.uint8)
    for a, b in zip(cut[have].tolist(), cut[have + 1].tolist()):
        out[a * size : b * size].reshape(size, b - a)[:] = flat[a:b].T
    data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(have), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.binary())
    return pa.record_batch([pa.array(have.astype(np.int32)), data], ["part", "blob"])


def unblobbed(table: pa.Table, dtype: np.dtype) -> np.ndarray:
    """All rows of the blobs of a group."""
    sizes = [len(b.as_buffer()) // dtype.itemsize for b in table.column("blob")]
    out = np.empty((sum(sizes), dtype.itemsize), np.uint8)
    at = 0
    for n, b in zip(sizes, table.column("blob")):
        out[at : at + n] = np.frombuffer(b.as_buffer(), np.uint8).reshape(dtype.itemsize, n).T
        at += n
    return out.reshape(-1).view(dtype)


def in_batches(table: pa.Table, rows: int = 1 << 16) -> pa.Table:
    """The same rows in small batches, so that a large group's result is sent piece by piece."""
    return pa.Table.from_batches(table.to_batches(max_chunksize=rows), table.schema)


def spread(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of each 64-bit hash."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Gather:
    """Collects rows of many chunks, so that an exchange has few and large blobs: about ``most`` bytes are held."""

    def __init__(self, parts: int, most: int = 12 << 20):
        self.parts, self.most, self.size, self.held = parts, most, 0, []

    def add(self, part: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows):
            self.held.append((part, rows))
            self.size += rows.nbytes
        if self.size > self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            part, rows = (np.concatenate(x) for x in zip(*self.held))
            self.held, self.size = [], 0
            yield blobs(part, rows, self.parts)


def map_gather(df: DataFrame, fn: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray] | None], parts: int, column: str = "text") -> DataFrame:
    """``fn`` gives (part, structured row) arrays for a chunk; the result has columns part and blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gather(parts)
        for batch in batches:
            for chunk in K.chunks(batch, column):
                if (out := fn(chunk)) is not None:
                    yield from held.add(*out)
        yield from held.flush()
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, "part int, blob binary")


def reduce_parts(df: DataFrame, dtype: np.dtype, fn: Callable[[np.ndarray], pa.RecordBatch | pa.Table | None], schema: str) -> DataFrame:
    """``fn`` over all rows of each part, as one structured array."""
    names = pa_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        out = fn(unblobbed(table, dtype))
        give_back()
        if out is None:
            return names.empty_table()
        return pa.Table.from_batches([out]) if isinstance(out, pa.RecordBatch) else out

    return df.groupBy("part").applyInArrow(run, schema)


def pa_schema(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(","))])


def documents(df: DataFrame, columns: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """The columns an operator uses and rows that have an id and a text; other columns, whatever their names, stay out."""
    small_batches(df.sparkSession)
    return df.select(*columns).where(F.col(columns[0]).isNotNull() & F.col("text").isNotNull())


def row_key(docs: DataFrame) -> Column:
    """The id of a row that has a text; if that is null, a number beyond all usual ids that stands for the text."""
    of_text = F.xxhash64(docs["text"]).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return F.when(docs["text"].isNotNull(), F.coalesce(docs["doc_id"].cast("long"), of_text))


def multi_range(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+count[0]-1, start[1] .. and so on, end to end."""
    count = count.astype(np.int64)
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count)
    return base + np.arange(total)
