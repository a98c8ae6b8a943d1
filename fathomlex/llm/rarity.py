"""A global order of tokens, rare before frequent, from counts over all rows in a table of fixed size.

Each token hash falls into one of ``SLOTS`` counters.  The counters are added up
by a small exchange, so nothing here grows with the vocabulary: what is
broadcast is always ``SLOTS`` bytes.  A token's place in the order is
(class of its counter, hash).  Tokens that share a counter only share a class;
any such order is a valid one for the prefix filters that use it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 20
BLOCKS = 64
_SHIFT = np.uint64(44)


class Counter:
    """Counts tokens of one task; ``rows()`` are its (part, blob) rows, one a block of counters."""

    def __init__(self) -> None:
        self.n = np.zeros(SLOTS, np.uint32)

    def add(self, tokens: np.ndarray) -> None:
        self.n += np.bincount((tokens >> _SHIFT).astype(np.int64), minlength=SLOTS).astype(np.uint32)

    def rows(self) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array([x.tobytes() for x in self.n.reshape(BLOCKS, -1)], pa.binary())], ["part", "blob"])


def added_up(rows: DataFrame) -> np.ndarray:
    """All counters, from the rows of all tasks: ``BLOCKS`` sums, a fixed 8 MB at the driver."""

    def run(t: pa.Table) -> pa.Table:
        total = np.zeros(SLOTS // BLOCKS, np.int64)
        for b in t.column("blob"):
            total += np.frombuffer(b.as_buffer(), np.uint32)
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "blob": pa.array([total.tobytes()], pa.binary())})

    def some(t: pa.Table) -> pa.Table:
        total = np.zeros(SLOTS // BLOCKS, np.int64)
        for b in t.column("blob"):
            total += np.frombuffer(b.as_buffer(), np.uint32)
        return pa.table({"part": t.column("part")[:1], "blob": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())})

    # in two steps, so that no task adds up the counters of all tasks
    rows = rows.withColumn("some", F.shiftright(F.spark_partition_id(), 7)).groupBy("part", "some").applyInArrow(some, "part int, blob binary")
    n = np.zeros((BLOCKS, SLOTS // BLOCKS), np.int64)
    for r in rows.groupBy("part").applyInArrow(run, "part int, blob binary").collect():
        n[r["part"]] = np.frombuffer(r["blob"], np.int64)
    return n.reshape(-1)


def classes(counts: np.ndarray) -> np.ndarray:
    """Rarity class of each slot: four to an octave of its count."""
    return np.minimum(4 * np.log2(counts.astype(np.float64) + 1), 255).astype(np.uint8)


def ordered(tokens: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Tokens as numbers that ascend with the global order: class in the upper 8 bits, 56 bits of the hash below."""
    return (cls[(tokens >> _SHIFT).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (tokens & np.uint64((1 << 56) - 1))


def class_of(places: np.ndarray) -> np.ndarray:
    return (places >> np.uint64(56)).astype(np.int64)


def class_at(count: int) -> int:
    """The class of a counter that stands at ``count``."""
    return int(min(4 * np.log2(count + 1), 255))
