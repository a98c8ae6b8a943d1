"""Candidate pairs of an exact set-similarity join, by prefix, length, positional and bitmap filters.

Sets are arrays of tokens in a global order, rare tokens first.  Two sets of
Jaccard similarity t or more have their first common token in the first
|x| - ceil(t|x|) + 1 tokens of both, and their first two in one more.  A rare
token alone is a key; a frequent one only with each that may follow it, so keys
stay selective however large the corpus grows.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa

from . import kernels as K
from . import rarity
from .common import multi_range

#: One row a key of a set: 32 bits of the key (its part has the rest), the set, its size, the most it can share with another from here on, and a parity bitmap of its tokens.
ROW = np.dtype([("k", "<u4"), ("s", "<u8"), ("n", "<u4"), ("most", "<u4"), ("b", "<u8")])
#: Pairs that are looked at together.
SLICE = 1 << 21


def needed(n: np.ndarray, t: Fraction) -> np.ndarray:
    """ceil(t * n), in integers."""
    return -((-n.astype(np.int64) * t.numerator) // t.denominator)


def overlap_needed(n: np.ndarray, m: np.ndarray, t: Fraction) -> np.ndarray:
    """Common tokens that sets of n and m tokens need for similarity t: ceil(t / (1 + t) * (n + m))."""
    return -((-(n.astype(np.int64) + m.astype(np.int64)) * t.numerator) // (t.numerator + t.denominator))


def set_hash(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, whatever the order of its tokens."""
    total = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(K.mix(tokens ^ np.uint64(0xA0761D6478BD642F)), out=total[1:])
    return K.mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64))


def parity(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 bits of each set, each token flipping one: two sets differ in at least as many tokens as bits."""
    total = np.zeros(len(tokens) + 1, np.uint64)
    np.bitwise_xor.accumulate(np.uint64(1) << (tokens & np.uint64(63)), out=total[1:])
    return total[offsets[1:]] ^ total[offsets[:-1]]


def keys(tokens: np.ndarray, offsets: np.ndarray, t: Fraction, rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the sets ``tokens[offsets[i]:offsets[i+1]]`` (ascending): 64-bit key, set, most overlap from the key on, and whether it is a lone token's.

    Sets of one token have that token as their key; they have no equals but themselves.
    """
    n = np.diff(offsets)
    prefix = np.where(n > 0, n - needed(n, t) + 1, 0)
    owner = np.repeat(np.arange(len(n)), prefix)
    at = multi_range(offsets[:-1], prefix)
    place = at - offsets[:-1][owner]
    alone = (rarity.class_of(tokens[at]) <= rare) | (needed(n, t)[owner] < 2)
    one, many = np.flatnonzero(alone), np.flatnonzero(~alone)
    longer = np.minimum(prefix + 1, n)[owner[many]]
    follow = longer - 1 - place[many]
    first = np.repeat(at[many], follow)
    second = multi_range(at[many] + 1, follow)
    own2 = np.repeat(owner[many], follow)
    key = np.concatenate([K.mix(tokens[at[one]]), K.mix(tokens[first] * np.uint64(0x9E3779B97F4A7C15) + K.mix(tokens[second]))])
    own = np.concatenate([owner[one], own2])
    most = np.concatenate([n[owner[one]] - place[one], n[own2] - (second - offsets[:-1][own2]) + 1])
    return key, own, most, np.r_[np.ones(len(one), bool), np.zeros(len(first), bool)]


def rows(tokens: np.ndarray, offsets: np.ndarray, sets: np.ndarray, t: Fraction, rare: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, ROW) arrays for an exchange by key."""
    key, own, most, _ = keys(tokens, offsets, t, rare)
    out = np.empty(len(key), ROW)
    out["k"], out["s"], out["most"] = key & np.uint64(0xFFFFFFFF), sets[own], most
    out["n"] = np.diff(offsets)[own]
    out["b"] = parity(tokens, offsets)[own]
    return key, out


def candidates(r: np.ndarray, t: Fraction) -> np.ndarray:
    """Pairs of sets, as an (n, 2) array with the lesser first, that share a key and pass all filters."""
    found = []
    r = r[np.lexsort((r["s"], r["k"]))]
    if len(r):
        r = r[np.r_[True, (r["k"][1:] != r["k"][:-1]) | (r["s"][1:] != r["s"][:-1])]]
    k = r["k"].astype(np.uint64) << np.uint64(32)
    c = k | r["n"].astype(np.uint64)
    order = np.argsort(c, kind="stable")
    r, c, k = r[order], c[order], k[order]
    longest = np.minimum(r["n"].astype(np.uint64) * np.uint64(t.denominator) // np.uint64(t.numerator), np.uint64(0xFFFFFFFF))
    i = np.arange(len(r))
    count = np.searchsorted(c, k | longest, "right") - i - 1
    done = np.r_[0, np.cumsum(count)]
    a = 0
    while a < len(r):
        z = max(a + 1, int(np.searchsorted(done, done[a] + SLICE, "right")) - 1)
        x, y = np.repeat(i[a:z], count[a:z]), multi_range(i[a:z] + 1, count[a:z])
        need = overlap_needed(r["n"][x], r["n"][y], t)
        ok = np.minimum(r["most"][x], r["most"][y]) >= need
        x, y, need = x[ok], y[ok], need[ok]
        differ = r["n"][x].astype(np.int64) + r["n"][y] - 2 * need
        ok = np.bitwise_count(r["b"][x] ^ r["b"][y]) <= differ
        p, q = r["s"][x[ok]], r["s"][y[ok]]
        found.append(np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], 1), axis=0) if len(p) else np.zeros((0, 2), np.uint64))
        a = z
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.uint64)
    return np.unique(pairs, axis=0) if len(pairs) else pairs


def pair_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], ["a", "b"])


def binaries(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of an array of 64-bit numbers as a column of binaries."""
    size = values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * size).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit numbers of a column of binaries, end to end, and the offsets of its rows."""
    data, offsets = K.raw_binary(column)
    return data.view(np.uint64) if len(data) else np.zeros(0, np.uint64), offsets // 8


def common(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Tokens that the sets in each row of two columns share."""
    x, xo = lists(a)
    y, yo = lists(b)
    row = np.r_[np.repeat(np.arange(len(xo) - 1), np.diff(xo)), np.repeat(np.arange(len(yo) - 1), np.diff(yo))]
    both = np.r_[x, y]
    order = np.lexsort((both, row))
    both, row = both[order], row[order]
    same = (both[1:] == both[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][same], minlength=len(xo) - 1)
