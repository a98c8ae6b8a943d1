"""Benchmark decontamination by winnowing.

Texts are sequences of words.  Of the hashes of all k-word grams, winnowing
keeps the least in each window of w; a span of k + w - 1 words that a document
shares with a benchmark item therefore shares a kept gram.  Kept grams of both
sides are joined, and each hit is extended word by word to the longest span
that agrees.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import col, documents, ints, map_chunks, multi_range, row_key

SCHEMA = "doc_id long, item_id long, doc_word int, item_word int, n_words int"
#: Bytes of benchmark text that are broadcast; beyond them the fingerprints are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


@dataclass
class Index:
    """Winnowed grams of the items in ascending order, and the items' word hashes end to end."""

    fp: np.ndarray
    item: np.ndarray
    at: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    last: np.ndarray
    item_id: np.ndarray


def build(item_ids: np.ndarray, texts: pa.Array, k: int, w: int) -> Index:
    x = K.words(texts)
    g, doc, at = _fingerprints(x, k, w)
    order = np.argsort(g, kind="stable")
    return Index(g[order], doc[order], at[order], x.hash, x.offsets[:-1][doc[order]], x.offsets[1:][doc[order]], item_ids)


def _fingerprints(x: K.Words, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g = K.grams(x.hash, k)
    place = np.flatnonzero(K.inside(x.doc, k))
    kept = place[K.winnow(g[place], x.doc[place], w)]
    return g[kept], x.doc[kept], kept


def extend(a: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, b: np.ndarray, q: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words by which each hit a[p] = b[q] grows to the left, and to the right with the hit's own, within [lo, hi) and [blo, bhi)."""
    out = []
    for step in (-1, 1):
        n = np.zeros(len(p), np.int64)
        todo = np.arange(len(p))
        i, j = (p - 1, q - 1) if step < 0 else (p.copy(), q.copy())
        while len(todo):
            ok = (i >= lo[todo]) & (j >= blo[todo]) if step < 0 else (i < hi[todo]) & (j < bhi[todo])
            todo, i, j = todo[ok], i[ok], j[ok]
            same = a[i] == b[j]
            todo, i, j = todo[same], i[same] + step, j[same] + step
            n[todo] += 1
        out.append(n)
    return out[0], out[1]


def matches(chunk_ids: np.ndarray, texts: pa.Array, index: Index, k: int, w: int, least: int) -> pa.RecordBatch:
    x = K.words(texts)
    g, doc, at = _fingerprints(x, k, w)
    lo, hi = np.searchsorted(index.fp, g, "left"), np.searchsorted(index.fp, g, "right")
    n = hi - lo
    hit = multi_range(lo, n)
    doc, p = np.repeat(doc, n), np.repeat(at, n)
    left, right = extend(x.hash, p, x.offsets[:-1][doc], x.offsets[1:][doc], index.hash, index.at[hit], index.first[hit], index.last[hit])
    ok = left + right >= least
    hit, doc = hit[ok], doc[ok]
    rows = np.stack([doc, index.item[hit], (p[ok] - left[ok]) - x.offsets[:-1][doc], index.at[hit] - left[ok] - index.first[hit], (left + right)[ok]], 1)
    rows = np.unique(rows, axis=0) if len(rows) else rows
    return pa.record_batch(
        [pa.array(chunk_ids[rows[:, 0]], pa.int64()), pa.array(index.item_id[rows[:, 1]], pa.int64()), *(pa.array(rows[:, i].astype(np.int32)) for i in (2, 3, 4))],
        ["doc_id", "item_id", "doc_word", "item_word", "n_words"],
    )


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, w: int = 4, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every longest span of at least ``k + w - 1`` words that a document and a benchmark item share.

    docs: doc_id, text; benchmark: item_id, text; other columns are left out.
    One row (doc_id, item_id, doc_word, item_word, n_words) a span; positions
    count words from 0.  Rows without id or text, and texts of fewer than
    k + w - 1 words, give none; a repeated row of docs gives its spans again, a
    repeated benchmark row too.  An empty table on either side gives an empty
    result.  A text of any length is scanned to its end.
    """
    least = k + w - 1
    docs, benchmark = documents(docs), documents(benchmark, ("item_id", "text"))
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= broadcast_bytes:
        rows = benchmark.collect()
        index = build(np.array([r[0] for r in rows], np.int64), pa.array([r[1] for r in rows], pa.string()), k, w)
        shared = docs.sparkSession.sparkContext.broadcast(index)
        return map_chunks(docs, lambda c: matches(ints(c, "doc_id"), col(c, "text"), shared.value, k, w, least), SCHEMA)
    return _joined(docs, benchmark, k, w, least)


def _joined(docs: DataFrame, benchmark: DataFrame, k: int, w: int, least: int) -> DataFrame:
    """The same for a benchmark of any size: fingerprints meet in a shuffle, then each candidate pair of texts is compared."""

    def prints(name: str):
        def fn(c: pa.RecordBatch) -> pa.RecordBatch:
            g, doc, _ = _fingerprints(K.words(col(c, "text")), k, w)
            return pa.record_batch([pa.array(g.view(np.int64)), pa.array(ints(c, name)[doc], pa.int64()), pa.array(ints(c, "h")[doc], pa.int64())], ["fp", name, "h"])

        return fn

    d, b = docs.withColumn("h", F.xxhash64("text")), benchmark.withColumn("h", F.xxhash64("text"))
    fd = map_chunks(d, prints("doc_id"), "fp long, doc_id long, h long")
    fb = map_chunks(b, prints("item_id"), "fp long, item_id long, h long").withColumnRenamed("h", "bh")
    pairs = fd.join(fb, "fp").select("doc_id", "h", "item_id", "bh").distinct()
    full = pairs.join(d, ["doc_id", "h"]).join(b.select("item_id", F.col("h").alias("bh"), F.col("text").alias("item_text")), ["item_id", "bh"]).select("doc_id", "text", "item_id", "item_text")

    def compare(c: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i in range(c.num_rows):
            one = c.slice(i, 1)
            out.append(matches(ints(one, "doc_id"), col(one, "text"), build(ints(one, "item_id"), col(one, "item_text"), k, w), k, w, least))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if any(x.num_rows for x in out) else out[0]

    return map_chunks(full, compare, SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, w: int = 4) -> DataFrame:
    """``docs`` without the documents in which ``find_leaks`` finds something, with all their columns, whatever their names.

    A row without id is known by its text; rows without text stay; all rows of
    an id go if one of its texts does; an empty table stays empty.
    """
    key = row_key(docs)
    bad = find_leaks(docs.select(key.alias("doc_id"), "text"), benchmark, k, w).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(bad, key == bad["_leak"], "left_anti")
