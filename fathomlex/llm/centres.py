"""Balls of near copies: sets that lie close to one of a few centres are similar to each other without a look at the pairs.

Jaccard distance is a metric.  With r = (1 - t) / 2, any two sets within r of a
centre are within 1 - t of each other, so a ball of m sets takes m comparisons
for its m (m - 1) / 2 links.  Any set can be a centre: which ones are taken
changes the work, never the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np

from . import kernels as K
from .common import multi_range
from .setjoin import needed


#: Matches of tokens with centres that are looked at together.
SLICE = 1 << 18


def _slices(count: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have ``SLICE`` together or less, or are one row."""
    done = np.r_[0, np.cumsum(count)]
    a = 0
    while a < len(count):
        z = max(a + 1, int(np.searchsorted(done, done[a] + SLICE, "right")) - 1)
        yield a, z
        a = z


def inner(t: Fraction) -> Fraction:
    """Similarity to a centre that makes a set a member of its ball."""
    return (1 + t) / 2


def outer(t: Fraction) -> Fraction:
    """Similarity to a centre without which a set is similar to no member of its ball."""
    return (3 * t - 1) / 2


def _mixed(tokens: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return K.mix(tokens ^ K.mix(centre.astype(np.uint64) + np.uint64(1)))


def reach(both: np.ndarray, n: np.ndarray, m: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether sets of n and m tokens, ``both`` of them common, have similarity t."""
    return both * t.denominator >= (n.astype(np.int64) + m - both) * t.numerator


@dataclass
class Centres:
    """The centres' sizes; some tokens of each in ascending order, with the centre and how many of them a near set has; and all (token, centre) pairs, mixed."""

    t: Fraction
    size: np.ndarray
    token: np.ndarray
    of: np.ndarray
    votes: np.ndarray
    pairs: np.ndarray

    def near(self, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set, centre, common tokens) of all sets that reach ``outer`` similarity to a centre, in order."""
        n = np.diff(offsets)
        own = np.repeat(np.arange(len(n)), n)
        lo, hi = np.searchsorted(self.token, tokens, "left"), np.searchsorted(self.token, tokens, "right")
        some = np.flatnonzero(hi > lo)
        count = (hi - lo)[some]
        found = []
        for a, z in _slices(count):
            found.append(np.unique(np.repeat(own[some[a:z]], count[a:z]) * len(self.size) + self.of[multi_range(lo[some[a:z]], count[a:z])], return_counts=True))
        key, got = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(found) > 1:
            key, which = np.unique(key, return_inverse=True)
            got = np.bincount(which, got).astype(np.int64)
        s, c = key // max(1, len(self.size)), key % max(1, len(self.size))
        ok = got >= self.votes[c]
        s, c = s[ok], c[ok]
        both = np.zeros(len(s), np.int64)
        for a, z in _slices(n[s]):
            row = np.repeat(np.arange(a, z), n[s[a:z]])
            m = _mixed(tokens[multi_range(offsets[:-1][s[a:z]], n[s[a:z]])], c[row])
            at = np.minimum(np.searchsorted(self.pairs, m), max(0, len(self.pairs) - 1))
            both[a:z] = np.bincount(row[self.pairs[at] == m] - a, minlength=z - a)
        ok = reach(both, n[s], self.size[c], outer(self.t))
        return s[ok], c[ok], both[ok]

    def balls(self, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The ball of each set, -1 for none, and (set, centre) of the balls of which it may be similar to a member.

        The ball is that of the most similar centre.  Of two balls, only the
        members of the later one look at the earlier one.
        """
        n = np.diff(offsets)
        s, c, both = self.near(tokens, offsets)
        ball = np.full(len(n), -1, np.int64)
        member = reach(both, n[s], self.size[c], inner(self.t))
        j = both / (n[s] + self.size[c] - both)
        order = np.lexsort((c, -j, s))
        order = order[member[order]]
        first = order[np.r_[True, s[order][1:] != s[order][:-1]]] if len(order) else order
        ball[s[first]] = c[first]
        look = (c != ball[s]) & ((ball[s] < 0) | (c < ball[s]))
        return ball, (s[look], c[look])


def build(sets: list[np.ndarray], t: Fraction) -> Centres:
    """Of the given sets, the later ones that lie close to an earlier one are left out."""
    index: dict[int, list[int]] = {}
    kept: list[np.ndarray] = []
    for x in sets:
        shared: dict[int, int] = {}
        for tok in x.tolist():
            for c in index.get(tok, ()):
                shared[c] = shared.get(c, 0) + 1
        if any(2 * both >= len(x) + len(kept[c]) - both for c, both in shared.items()):
            continue
        for tok in x.tolist():
            index.setdefault(tok, []).append(len(kept))
        kept.append(x)
    size = np.array([len(x) for x in kept], np.int64)
    least = needed(size, outer(t))
    votes = np.maximum(1, np.minimum(least, size // 8))
    some = []
    for i, x in enumerate(kept):  # tokens of few centres first: a near set has votes[i] of these
        order = np.lexsort((x, np.array([len(index[v]) for v in x.tolist()])))
        some.append(x[order[: int(size[i] - least[i] + votes[i])]])
    token = np.concatenate([*some, np.zeros(0, np.uint64)])
    of = np.repeat(np.arange(len(kept)), [len(x) for x in some]).astype(np.int32)
    order = np.argsort(token, kind="stable")
    pairs = np.concatenate([*(_mixed(x, np.full(len(x), i)) for i, x in enumerate(kept)), np.zeros(0, np.uint64)])
    return Centres(t, size, token[order], of[order], votes, np.sort(pairs))


def consensus(sets: list[np.ndarray], t: Fraction) -> np.ndarray:
    """The tokens of more than half of the sets, if half of the sets are then close to them; else nothing."""
    tokens, count = np.unique(np.concatenate(sets), return_counts=True)
    c = tokens[2 * count > len(sets)]
    close = sum(bool(reach(np.int64(len(np.intersect1d(x, c))), np.int64(len(x)), len(c), inner(t))) for x in sets)
    return c if 2 * close >= len(sets) and len(c) else c[:0]
