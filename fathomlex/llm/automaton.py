"""Regular expressions as one deterministic automaton.

Rules are parsed into syntax trees, joined into one nondeterministic automaton,
made deterministic by subset construction over byte classes and minimised by
partition refinement.  The result is one array of transitions for all rules.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: No rule matches this byte: it separates texts (it never occurs in UTF-8).
BREAK = 0xFF
_ALL = frozenset(range(BREAK))
_DIGIT = frozenset(range(48, 58))
_LETTER = frozenset([*range(65, 91), *range(97, 123)])
_NAMED = {"d": _DIGIT, "w": _DIGIT | _LETTER | {95}, "s": frozenset(b" \t\n\r\f\v")}
_CONTROL = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11}
MOST_STATES = 200_000


@dataclass
class Tree:
    """kind: 'bytes' (one byte of a set), 'cat', 'alt', or 'rep' of its only kid, least to most times (None: without end)."""

    kind: str
    bytes: frozenset = frozenset()
    kids: list = field(default_factory=list)
    least: int = 0
    most: int | None = 0


class _Parser:
    """The usual notation: literals, escapes, classes, groups, alternatives, counts; ``(?i)`` in front folds ASCII case."""

    def __init__(self, text: str) -> None:
        self.fold = text.startswith("(?i)")
        self.s, self.i = text[4:] if self.fold else text, 0

    def parse(self) -> Tree:
        t = self.alt()
        if self.i < len(self.s):
            raise ValueError(f"unbalanced ) in {self.s!r}")
        return t

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def take(self) -> str:
        if self.i >= len(self.s):
            raise ValueError(f"{self.s!r} ends too early")
        self.i += 1
        return self.s[self.i - 1]

    def alt(self) -> Tree:
        kids = [self.cat()]
        while self.peek() == "|":
            self.take()
            kids.append(self.cat())
        return kids[0] if len(kids) == 1 else Tree("alt", kids=kids)

    def cat(self) -> Tree:
        kids = []
        while self.peek() not in ("", "|", ")"):
            kids.append(self.counted())
        return Tree("cat", kids=kids)

    def counted(self) -> Tree:
        t = self.atom()
        while (c := self.peek()) and c in "*+?{":
            self.take()
            least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(c, (0, 0))
            if c == "{":
                body = self.s[self.i : self.s.index("}", self.i)]
                self.i += len(body) + 1
                lo, comma, hi = body.partition(",")
                least = int(lo)
                most = (int(hi) if hi else None) if comma else least
            t = Tree("rep", kids=[t], least=least, most=most)
        return t

    def one(self, b: frozenset) -> Tree:
        if self.fold:
            b = b | {x ^ 32 for x in b & _LETTER}
        return Tree("bytes", bytes=b - {BREAK})

    def atom(self) -> Tree:
        c = self.take()
        if c == "(":
            if self.s.startswith("?:", self.i):
                self.i += 2
            t = self.alt()
            if self.peek() != ")":
                raise ValueError(f"missing ) in {self.s!r}")
            self.take()
            return t
        if c == "[":
            return self.one(self.group())
        if c == ".":
            return self.one(_ALL - {10})
        if c == "\\":
            return self.one(self.escape())
        raw = c.encode()
        return self.one(frozenset(raw)) if len(raw) == 1 else Tree("cat", kids=[self.one(frozenset([x])) for x in raw])

    def escape(self) -> frozenset:
        c = self.take()
        if c.lower() in _NAMED:
            return _NAMED[c] if c.islower() else _ALL - _NAMED[c.lower()]
        if c in _CONTROL:
            return frozenset([_CONTROL[c]])
        if c.isalnum():
            raise ValueError(f"\\{c} has no meaning here")
        return frozenset(c.encode())

    def group(self) -> frozenset:
        negated = self.peek() == "^"
        if negated:
            self.take()
        out: set[int] = set()
        start = True
        while start or self.peek() != "]":
            start = False
            c = self.take()
            b = self.escape() if c == "\\" else frozenset(c.encode())
            if self.peek() == "-" and self.s[self.i + 1 : self.i + 2] not in ("]", "") and len(b) == 1:
                self.take()
                c = self.take()
                (hi,) = self.escape() if c == "\\" else frozenset(c.encode())
                b = frozenset(range(min(b), hi + 1))
            out |= b
        self.take()
        return frozenset(_ALL - out if negated else out)


def parse(rule: str) -> Tree:
    return _Parser(rule).parse()


def shortest(t: Tree) -> Tree:
    """The rule without what may be left out at its end: it matches where matches of the rule can first end."""
    if t.kind == "rep":
        if not t.least:
            return Tree("cat")
        kid = shortest(t.kids[0])
        return kid if t.least == 1 else Tree("cat", kids=[Tree("rep", kids=t.kids, least=t.least - 1, most=t.least - 1), kid])
    if t.kind == "cat":
        kids = list(t.kids)
        while kids:
            end = shortest(kids.pop())
            if end.kind != "cat" or end.kids:
                return Tree("cat", kids=[*kids, end])
        return Tree("cat")
    if t.kind == "alt":
        return Tree("alt", kids=[shortest(k) for k in t.kids])
    return t


def longest(t: Tree) -> int:
    """Bytes of the longest match; an endless part within a rule is an error."""
    if t.kind == "bytes":
        return 1
    if t.kind == "cat":
        return sum(map(longest, t.kids))
    if t.kind == "alt":
        return max(map(longest, t.kids))
    if t.most is None:
        raise ValueError("only the end of a rule may repeat without bound")
    return t.most * longest(t.kids[0])


class TooMany(ValueError):
    """More states than asked for."""


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.step) - 1

    def add(self, t: Tree, at: int) -> int:
        """Build ``t`` from state ``at``; its end."""
        if t.kind == "bytes":
            to = self.state()
            src = at
            if self.step[src] is not None:
                src = self.state()
                self.empty[at].append(src)
            self.step[src] = (t.bytes, to)
            return to
        if t.kind == "cat":
            for k in t.kids:
                at = self.add(k, at)
            return at
        if t.kind == "alt":
            to = self.state()
            for k in t.kids:
                start = self.state()
                self.empty[at].append(start)
                self.empty[self.add(k, start)].append(to)
            return to
        for _ in range(t.least):
            at = self.add(t.kids[0], at)
        if t.most is None:
            loop, to = self.state(), self.state()
            self.empty[at].append(loop)
            start = self.state()
            self.empty[loop] += [start, to]
            self.empty[self.add(t.kids[0], start)].append(loop)
            return to
        ends = [at]
        for _ in range(t.most - t.least):
            start = self.state()
            self.empty[at].append(start)
            at = self.add(t.kids[0], start)
            ends.append(at)
        to = self.state()
        for e in ends:
            self.empty[e].append(to)
        return to

    def closure(self, states: set[int]) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for n in self.empty[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)


@dataclass
class Dfa:
    """``next[state * classes + byte_class[b]]`` is the next state times ``classes``; states from ``accept`` on accept ``rules[state - accept]``.

    State 0 is the start; ``dead``, if any, is where no match can follow.
    """

    next: np.ndarray
    byte_class: np.ndarray
    classes: int
    accept: int
    rules: list[tuple[int, ...]]
    start: int
    dead: int


def byte_classes(trees: list[Tree]) -> np.ndarray:
    """Class of each byte: bytes of one class are alike to all rules."""
    sets: dict[frozenset, None] = {}
    todo = list(trees)
    while todo:
        t = todo.pop()
        if t.kind == "bytes":
            sets[t.bytes] = None
        todo += t.kids
    table = np.zeros((256, len(sets)), bool)
    for j, s in enumerate(sets):
        table[list(s), j] = True
    return np.unique(table, axis=0, return_inverse=True)[1].reshape(-1).astype(np.uint8)


def _better(nfa: _Nfa, states: list[int], core: dict[int, frozenset], final: int) -> set[tuple[int, int]]:
    """Pairs (p, q) of a rule's states: whatever leads from q to the end of the rule has a beginning that leads there from p."""
    out = {(p, q) for p in states for q in states if p == final or (q != final and nfa.step[q][0] <= nfa.step[p][0])}
    while True:
        bad = {(p, q) for p, q in out if p != final and not all(any((x, y) in out for x in core[nfa.step[p][1]]) for y in core[nfa.step[q][1]])}
        if not bad:
            return out
        out -= bad


def compile_rules(trees: list[Tree], search: bool, byte_class: np.ndarray | None = None, most: int = MOST_STATES) -> Dfa:
    """One automaton for all rules.

    With ``search`` a match may begin anywhere, and states of a rule that another
    state of it makes needless are left out: it accepts where matches first end.
    """
    nfa = _Nfa()
    starts, finals, spans = [], {}, []
    for i, t in enumerate(trees):
        s = nfa.state()
        starts.append(s)
        last = nfa.add(t, s)
        end = nfa.state()
        nfa.empty[last].append(end)
        finals[end] = i
        spans.append((s, end))
    byte_class = byte_classes(trees) if byte_class is None else byte_class
    n = int(byte_class.max()) + 1
    of_set = {x[0]: np.unique(byte_class[sorted(x[0])]).tolist() for x in nfa.step if x}
    real = lambda states: frozenset(y for y in states if nfa.step[y] or y in finals)
    core = {x: real(nfa.closure({x})) for x in {*starts, *(x[1] for x in nfa.step if x)}}
    better: set[tuple[int, int]] = set()
    if search:
        for s, end in spans:
            better |= _better(nfa, [x for x in range(s, end + 1) if nfa.step[x] or x == end], core, end)
    needless: dict[int, set[int]] = {}
    for p, q in better:
        if p != q and not ((q, p) in better and q < p):
            needless.setdefault(p, set()).add(q)
    begin = frozenset().union(*(core[s] for s in starts))

    def pruned(states: frozenset) -> frozenset:
        gone = set().union(*(needless[x] for x in states if x in needless)) if search else set()
        return states - gone

    first = pruned(begin)
    known, order, rows = {first: 0}, [first], []
    memo: dict[frozenset, int] = {}
    for here in order:
        if search:  # what a rule has accepted is over
            here = frozenset(x for x in here if x not in finals) | begin if any(x in finals for x in here) else here | begin
            here = pruned(here)
        to: list[set[int]] = [set() for _ in range(n)]
        for x in here:
            if nfa.step[x]:
                for c in of_set[nfa.step[x][0]]:
                    to[c].add(nfa.step[x][1])
        row = []
        for x in to:
            f = frozenset(x)
            if f not in memo:
                full = frozenset().union(*(core[y] for y in f))
                full = pruned(full | begin if search else full)
                if full not in known:
                    known[full] = len(order)
                    order.append(full)
                    if len(order) > most:
                        raise TooMany(f"the rules need more than {most} states")
                memo[f] = known[full]
            row.append(memo[f])
        rows.append(row)
    nxt = np.array(rows)
    label = [tuple(sorted(finals[x] for x in s if x in finals)) for s in order]
    names = sorted(set(label))
    block = np.array([names.index(x) for x in label])
    while True:  # states are split until all of a block go to the same blocks
        _, finer = np.unique(np.c_[block, block[nxt]], axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    rep = np.unique(block, return_index=True)[1]
    accepts = np.array([bool(label[r]) for r in rep])
    rank = np.empty(len(rep), int)
    sorted_blocks = np.argsort(accepts, kind="stable")
    rank[sorted_blocks] = np.arange(len(rep))
    nxt = rank[block[nxt[rep[sorted_blocks]]]]
    accept = int((~accepts).sum())
    loops = [i for i in range(accept) if (nxt[i] == i).all()]
    return Dfa(np.ascontiguousarray(nxt * n, dtype=np.int32).reshape(-1), byte_class, n, accept, [label[rep[b]] for b in sorted_blocks[accept:]], int(rank[block[0]]), loops[0] if loops else -1)
