"""A trie over ordered token sets, and the similarity joins that walk it.

Sets are stored token by token in one global order, so sets that begin alike
share a path.  A probe goes down the trie with the number of tokens it shares
with the path so far - counted once for all sets below - and leaves a subtree
as soon as what remains of either side cannot reach the overlap needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np


class _Node:
    __slots__ = ("deep", "high", "kids", "least", "low", "tokens")

    def __init__(self, low: int, high: int, tokens: np.ndarray, deep: int, least: int) -> None:
        #: The sets below are low .. high - 1 in lexicographic order; tokens are those of the edge to here.
        self.low, self.high, self.tokens, self.deep, self.least = low, high, tokens, deep, least
        self.kids: list[_Node] = []


def _need(n: int, m: int, t: Fraction) -> int:
    return -((-(n + m) * t.numerator) // (t.numerator + t.denominator))


class Trie:
    """``sets``: ascending arrays; ``sizes``: of the whole sets, of which ``sets`` may be the tokens from some place of the order on."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int], t: Fraction) -> None:
        self.t = t
        n = len(sets)
        self.ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
        cut = np.r_[0, np.cumsum([len(x) for x in sets])]
        dense = [flat[a:b] for a, b in zip(cut[:-1], cut[1:])]
        #: Sets in lexicographic order: which of ``sets`` each is, its tokens, and its size.
        self.order = sorted(range(n), key=lambda i: dense[i].astype(">u4").tobytes())
        self.seq = [dense[i] for i in self.order]
        self.size = [int(sizes[i]) for i in self.order]
        self.mask = np.zeros(len(self.ids), bool)
        self.root = self._built()

    def _built(self) -> _Node:
        seq, n = self.seq, len(self.seq)

        def shared(x: np.ndarray, y: np.ndarray) -> int:
            k = min(len(x), len(y))
            differ = np.flatnonzero(x[:k] != y[:k])
            return int(differ[0]) if len(differ) else k

        lcp = [shared(seq[i], seq[i + 1]) for i in range(n - 1)]
        # built left to right: the stack holds the path to the last set
        root = _Node(0, n, np.zeros(0, np.int64), 0, 0)
        stack = [root]
        for i in range(n):
            depth = lcp[i - 1] if i else 0
            last = None
            while stack[-1].deep > depth:
                last = stack.pop()
            if stack[-1].deep < depth and last is not None:  # the edge to ``last`` forks
                at = depth - stack[-1].deep
                mid = _Node(last.low, n, last.tokens[:at], depth, 0)
                last.tokens = last.tokens[at:]
                stack[-1].kids[-1] = mid
                mid.kids.append(last)
                stack.append(mid)
            if len(seq[i]) > stack[-1].deep:
                leaf = _Node(i, n, seq[i][stack[-1].deep :], len(seq[i]), 0)
                stack[-1].kids.append(leaf)
                stack.append(leaf)
        todo = [(root, n)]
        while todo:
            node, high = todo.pop()
            node.high = high
            node.least = min(self.size[node.low : node.high])
            todo += [(kid, node.kids[k + 1].low if k + 1 < len(node.kids) else node.high) for k, kid in enumerate(node.kids)]
        return root

    def walk(self, x: np.ndarray, size: int, after: int = -1) -> Iterator[tuple[int, int]]:
        """(place, common tokens) of the sets after place ``after`` that are similar to a probe of dense tokens ``x``."""
        mask, t = self.mask, self.t
        mask[x] = True
        todo = [(self.root, 0)]
        while todo:
            node, have = todo.pop()
            if node.high <= after + 1:
                continue
            if len(node.tokens):
                have += int(mask[node.tokens].sum())
                rest = len(x) - int(np.searchsorted(x, node.tokens[-1], "right"))
                if have + rest < _need(size, node.least, t):
                    continue
            first_kid = node.kids[0].low if node.kids else node.high
            for y in range(max(node.low, after + 1), first_kid):  # the sets that end here
                if have >= _need(size, self.size[y], t):
                    yield y, have
            todo += [(kid, have) for kid in node.kids]
        mask[x] = False

    def probe(self, tokens: np.ndarray, size: int) -> list[tuple[int, int]]:
        """(which of ``sets``, common tokens) of those that are similar to a set that isn't in the trie."""
        at = np.minimum(np.searchsorted(self.ids, tokens), max(0, len(self.ids) - 1))
        known = at[self.ids[at] == tokens] if len(self.ids) else at[:0]
        return [(self.order[y], have) for y, have in self.walk(known, size)]


def join(sets: list[np.ndarray], sizes: list[int], t: Fraction) -> Iterator[tuple[int, int, int]]:
    """(i, j, common tokens) of all pairs of ``sets`` that reach similarity t."""
    trie = Trie(sets, sizes, t)
    for x in range(len(sets) - 1):
        for y, have in trie.walk(trie.seq[x], trie.size[x], x):
            a, b = trie.order[x], trie.order[y]
            yield min(a, b), max(a, b), have
