"""Secret scan: all rules in one pass over the bytes.

The rules, whole, make few deterministic automata, minimised: one if its states
aren't too many, else as many as keep them few, since counts of several rules
that run at once multiply.  A batch of texts is cut into lanes of equal length
that overlap by the longest shortest match, and all lanes take their next step
in all automata together, one array operation for each.  An automaton accepts
where matches of a rule can first end; from the places before, that rule's own
automaton steps along, all places together, to the end of the longest match.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import automaton
from . import kernels as K
from .common import col, documents, ints, map_chunks, multi_range

#: Name and expression; only the end of an expression may repeat without bound.
RULES: tuple[tuple[str, str], ...] = (
    ("aws_access_key", r"(AKIA|ASIA)[0-9A-Z]{16}"),
    ("github_token", r"gh[pousr]_[0-9A-Za-z]{36,}"),
    ("google_api_key", r"AIza[0-9A-Za-z_-]{35}"),
    ("slack_token", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    ("stripe_key", r"(sk|rk)_(live|test)_[0-9A-Za-z]{16,}"),
    ("private_key", r"-----BEGIN ([A-Z]{2,10} )?PRIVATE KEY-----"),
    ("json_web_token", r"eyJhbGciOi[0-9A-Za-z_.-]{10,}"),
    ("password", r"(?i)(password|passwd|pwd)[\t ]{0,3}[=:][\t ]{0,3}[\x22']?[0-9a-z!@#$%^&*_+./~-]{8,}".replace(r"\x22", '"')),
    ("token", r"(?i)(token|secret|api[_-]?key)[\t ]{0,3}[=:][\t ]{0,3}[\x22']?[0-9a-z_+/=.-]{16,}".replace(r"\x22", '"')),
    ("url_login", r"://[0-9A-Za-z_.-]{1,32}:[^ \t\n\r@/:]{3,32}@[0-9A-Za-z.-]{3,}"),
)
SCHEMA = "doc_id long, rule string, n_matches int, secrets string"
LANE = 1024


#: States of one automaton, at most, if it is of several rules.
STATES = 700


@dataclass
class Scanner:
    names: list[str]
    #: Rules of each automaton, and the automaton; one partition of bytes into classes for all.
    joint: list[tuple[list[int], automaton.Dfa]]
    each: list[automaton.Dfa]
    #: Bytes of the longest shortest match of each rule.
    reach: list[int]


@lru_cache(8)
def scanner(rules: tuple[tuple[str, str], ...] = RULES) -> Scanner:
    trees = [automaton.parse(r) for _, r in rules]
    short = [automaton.shortest(t) for t in trees]
    kinds = automaton.byte_classes(trees)
    joint: list[tuple[list[int], automaton.Dfa]] = []
    for i, t in enumerate(short):
        alone = automaton.compile_rules([t], True, kinds)
        for j, (own, d) in enumerate(joint):
            if len(d.next) * (len(alone.next) // alone.classes) > 25 * STATES * d.classes:
                continue  # not worth a try
            try:
                joint[j] = [*own, i], automaton.compile_rules([short[k] for k in [*own, i]], True, kinds, STATES)
                break
            except automaton.TooMany:
                continue
        else:
            joint.append(([i], alone))
    return Scanner([n for n, _ in rules], joint, [automaton.compile_rules([t], False, kinds) for t in trees], [automaton.longest(t) for t in short])


def accepts(kinds: np.ndarray, s: Scanner) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each automaton the places after which it accepts, and its states there; ``kinds``: the classes of all bytes."""
    n, lap = len(kinds), max(s.reach) - 1
    lanes = -(-n // LANE)
    padded = np.full(lap + lanes * LANE, s.each[0].byte_class[automaton.BREAK], np.uint8)
    padded[lap : lap + n] = kinds
    steps = np.lib.stride_tricks.as_strided(padded, (lanes, lap + LANE), (LANE, 1)).T.astype(np.int32, order="C")
    states = [np.full(lanes, d.start * d.classes, np.int32) for _, d in s.joint]
    floors = [d.accept * d.classes for _, d in s.joint]
    found: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in s.joint]
    for i, c in enumerate(steps):
        for g, (_, d) in enumerate(s.joint):
            state = states[g] = d.next.take(states[g] + c)
            if i >= lap and int(state.max()) >= floors[g]:
                lane = np.flatnonzero(state >= floors[g])
                found[g].append((i, lane, state[lane] // d.classes))
    out = []
    for f in found:
        place = np.concatenate([lane * LANE + (i - lap) for i, lane, _ in f] + [np.zeros(0, np.int64)])
        state = np.concatenate([st for _, _, st in f] + [np.zeros(0, np.int32)])
        order = np.argsort(place, kind="stable")
        order = order[place[order] < n]
        out.append((place[order], state[order]))
    return out


def ends(kinds: np.ndarray, start: np.ndarray, dfa: automaton.Dfa) -> np.ndarray:
    """For each place, the end of the longest match of a rule that begins there, or -1; ``kinds`` ends with a class that no rule matches."""
    n, dead, floor = dfa.classes, dfa.dead * dfa.classes, dfa.accept * dfa.classes
    out = np.full(len(start), -1, np.int64)
    lane, at = np.arange(len(start)), start.astype(np.int64)
    state = np.full(len(start), dfa.start * n, np.int32)
    stays = dfa.next.reshape(-1, n) == np.arange(len(dfa.next) // n, dtype=np.int32)[:, None] * n
    for step in count():
        if not len(lane):
            return out
        if step > 64 and step % 16 == 0:  # the few that go on mostly stay in one state: to the end of that
            for i in range(len(lane)):
                row, width = stays[state[i] // n], 256
                while row[kinds[at[i]]]:
                    here = row[kinds[at[i] : at[i] + width]]
                    at[i] += len(here) if here.all() else int(np.argmin(here))
                    width *= 4
                if state[i] >= floor:
                    out[lane[i]] = at[i]
        state = dfa.next[state + kinds[at]]
        at += 1
        ok = state >= floor
        out[lane[ok]] = at[ok]
        ok = state != dead
        lane, at, state = lane[ok], at[ok], state[ok]


def matches(data: np.ndarray, offsets: np.ndarray, s: Scanner) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each rule (text, start, end) of the leftmost-longest matches, as places in ``data``."""
    none = (np.zeros(0, np.int64),) * 3
    if not len(data):
        return [none] * len(s.names)
    breaks = offsets[1:] + np.arange(len(offsets) - 1)
    kinds = s.each[0].byte_class[np.insert(data, offsets[1:], automaton.BREAK)]
    out = [none] * len(s.names)
    for (own, dfa), (place, state) in zip(s.joint, accepts(kinds, s)):
        for i, r in enumerate(own):
            e = place[np.array([i in x for x in dfa.rules] or [False])[state - dfa.accept]] if len(place) else place
            if not len(e):
                continue
            # all places from which a match may have come to one of these ends
            lo = e + 1 - s.reach[r]
            lo = np.maximum(lo, np.r_[0, e[:-1] + 1])
            start = multi_range(np.maximum(lo, 0), e + 1 - np.maximum(lo, 0))
            end = ends(kinds, start, s.each[r])
            start, end = start[end >= 0], end[end >= 0]
            take, free = [], 0
            for k, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
                if a >= free:
                    take.append(k)
                    free = b
            start, end = start[take], end[take]
            text = np.searchsorted(breaks, start, "left")
            out[r] = text, start - text, end - text
    return out


def scan_chunk(c: pa.RecordBatch, s: Scanner) -> pa.RecordBatch:
    data, offsets = K.raw(col(c, "text"))
    ids = ints(c, "doc_id")
    hits: dict[tuple[int, int], list[bytes]] = {}
    for r, (text, start, end) in enumerate(matches(data, offsets, s)):
        for t, x, y in zip(text.tolist(), start.tolist(), end.tolist()):
            hits.setdefault((t, r), []).append(data[x:y].tobytes())
    rows = [(int(ids[t]), s.names[r], len(found), " ".join(x.decode("utf-8", "replace") for x in found)) for (t, r), found in sorted(hits.items())]
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], ["doc_id", "rule", "n_matches", "secrets"])


def scan(docs: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(doc_id, rule, n_matches, secrets) for each document and rule that matches it: the leftmost-longest matches, in order, joined by spaces.

    Rows without id or text and empty texts give none; a repeated row gives its
    rows again; texts of any length are scanned to their end.  No rule matches
    across two texts.  An empty table has an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner(rules))
    return map_chunks(documents(docs), lambda c: scan_chunk(c, shared.value), SCHEMA, most=4 << 20)
