"""Set membership in a bitmap of fixed size, made on the executors: a filter before a join, never instead of one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ints

#: Bits are two to this power, if no other is given.
POWER = 25
BLOCKS = 64


def _slot(x: np.ndarray, power: int) -> np.ndarray:
    from .kernels import mix

    return (mix(x.view(np.uint64) if x.dtype == np.int64 else x) >> np.uint64(64 - power)).astype(np.int64)


def of(df: DataFrame, column: str, power: int = POWER) -> np.ndarray:
    """A bitmap in which the slot of each value of a bigint column is set: 4 MB (2**power bits), whatever the rows."""
    per = (1 << power) // BLOCKS

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = np.unique(_slot(ints(b, column), power))
            cut = np.searchsorted(slot, np.arange(BLOCKS + 1) * per)
            low = (slot % per).astype(np.uint32)
            yield pa.record_batch([pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array([low[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())], ["part", "blob"])

    def together(t: pa.Table) -> pa.Table:
        m = np.zeros(per, bool)
        for b in t.column("blob"):
            m[np.frombuffer(b.as_buffer(), np.uint32)] = True
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "blob": pa.array([np.packbits(m).tobytes()], pa.binary())})

    out = np.zeros((BLOCKS, per // 8), np.uint8)
    marked = df.select(column).mapInArrow(marks, "part int, blob binary").where(F.octet_length("blob") > 0)
    for r in marked.groupBy("part").applyInArrow(together, "part int, blob binary").collect():
        out[r["part"]] = np.frombuffer(r["blob"], np.uint8)
    return out.reshape(-1)


def has(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """False only for values that are not in the set."""
    s = _slot(x, len(bits).bit_length() + 2)
    return (bits[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 > 0
