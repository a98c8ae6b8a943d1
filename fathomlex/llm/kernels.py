"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on whole Arrow string arrays at once: one lower-casing
pass, one byte-class pass and a handful of numpy passes, so a Python worker
spends tens of nanoseconds on a byte and never loops over characters.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII
characters of the lower-cased text.  In SQL that is
``regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+')``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; keeps a worker's arrays near 30 MB, whatever an Arrow batch holds.
CHUNK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F | 1)
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: dict[str, np.ndarray] = {}


def _power_table(kind: str, n: int) -> np.ndarray:
    """Powers of the hash base (or of its inverse) modulo 2**64, grown on demand."""
    have = _tables.get(kind)
    if have is None or len(have) < n:
        base = {"up": int(_BASE), "down": _inverse(int(_BASE)), "up2": int(_BASE2), "down2": _inverse(int(_BASE2))}[kind]
        have = _tables[kind] = _powers(base, max(n, 1 << 16))
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that close inputs get unrelated hashes."""
    h = np.array(h, dtype=np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    bytes_ = np.frombuffer(data, dtype=np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return bytes_, (offsets - first if len(offsets) else np.zeros(1, np.int64))


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into slices of about ``most`` bytes of text; a longer text is a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    cells = batch.column(batch.schema.get_field_index(column))
    _, offsets = raw_binary(cells) if pa.types.is_binary(cells.type) else raw(cells)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    """The words of a chunk: ``hash[i]`` in text ``doc[i]``, bytes ``start[i]:end[i]`` of ``data``; text d has words ``offsets[d]:offsets[d+1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    offsets: np.ndarray
    text_offsets: np.ndarray


def lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """A position-free 64-bit hash of each span of bytes, from one prefix sum of the whole buffer."""
    if not len(start):
        return np.zeros(0, np.uint64)
    tail = "2" if second else ""
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table("up" + tail, n), out=prefix[1:])
    h = (prefix[end] - prefix[start]) * _power_table("down" + tail, n + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0x94D049BB133111EB))


def words(texts: pa.Array, second: bool = False) -> Words:
    data, offsets = raw(lower(texts))
    is_word = _WORD[data]
    n = len(data)
    edge = np.empty(n + 1, bool)
    if n:
        edge[0], edge[n] = is_word[0], False
        edge[1:n] = is_word[1:] & ~is_word[:-1]
    else:
        edge[:] = False
    cut = offsets[:-1][offsets[:-1] < offsets[1:]]  # texts lie end to end: a word also begins where its text does
    edge[cut] = is_word[cut] if n else False
    start = np.flatnonzero(edge[:n])
    stop = np.empty(n + 1, bool)
    if n:
        stop[0] = False
        stop[1:n] = is_word[:-1] & ~is_word[1:]
        stop[n] = is_word[-1]
        inner = cut[cut > 0]
        stop[inner] = is_word[inner - 1]
    else:
        stop[:] = False
    end = np.flatnonzero(stop)
    word_offsets = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(word_offsets))
    return Words(data, start, end, span_hash(data, start, end, second), doc, word_offsets, offsets)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive items that begin at each place; ``len(h) - k + 1`` of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 8:
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out *= _BASE
            out += h[i : i + n]
        return mix(out)
    prefix = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power_up(len(h)), out=prefix[1:])
    return mix((prefix[k:] - prefix[:-k]) * _power_table("down", n))


def _power_up(n: int) -> np.ndarray:
    return _power_table("up", n)


def inside(doc: np.ndarray, k: int) -> np.ndarray:
    """True where the k items from a place on belong to one text."""
    n = len(doc) - k + 1
    return doc[:n] == doc[k - 1 :] if n > 0 else np.zeros(0, bool)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, by doubling: log2(w) passes."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, h.dtype)
    m, width = h, 1
    while width * 2 <= w:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[:n], m[w - width : w - width + n])


def winnow(h: np.ndarray, doc: np.ndarray, w: int) -> np.ndarray:
    """Places of the k-gram hashes that winnowing keeps.

    ``h`` are the k-gram hashes of one chunk in order, ``doc`` their texts. In
    each window of w hashes of one text the least is kept (the last of equal
    ones, on the upper 36 bits).  A text with fewer than w k-grams keeps its
    least one.
    """
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 28) - 1)
    key = (h & ~low) | (low - np.arange(n, dtype=np.uint64))
    keep = np.zeros(n, bool)
    if n >= w:
        least = sliding_min(key, w)[doc[: n - w + 1] == doc[w - 1 :]]
        keep[(low - (least & low)).astype(np.int64)] = True
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    short = np.diff(np.r_[first, n]) < w
    if short.any():
        least = np.minimum.reduceat(key, first)[short]
        keep[(low - (least & low)).astype(np.int64)] = True
    return np.flatnonzero(keep)


def distinct_by_doc(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text in ascending order, and the offsets of the texts among them. ``h`` is sorted in place."""
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    new = np.ones(len(h), bool)
    if len(h):
        new[1:] = h[1:] != h[:-1]
        new[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    total = np.zeros(len(h) + 1, np.int64)
    np.cumsum(new, out=total[1:])
    return h[new], total[offsets]


def doc_grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All word n-gram hashes of a chunk and the offsets of its texts among them; texts of fewer than n words have none."""
    g = grams(w.hash, n)
    ok = inside(w.doc, n)
    count = np.maximum(np.diff(w.offsets) - n + 1, 0)
    return g[ok], np.r_[0, np.cumsum(count)]


def raw_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a binary array without nulls; the bytes are a fresh, aligned copy."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].copy(), offsets - offsets[0]
