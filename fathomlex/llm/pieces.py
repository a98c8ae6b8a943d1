"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The pieces, their scores and the kind of model come from a model file.  One pass
over a text follows the automaton's output links: they are the pieces that end
at a place, and each relaxes the place by way of the one where it begins.

Of a unigram model the sequence of pieces with the greatest total score is kept;
of equal ones the longest last piece wins.  A character that no piece spells
costs the least score less 10.  Of a model whose pieces are made by merges, best
first, a piece is taken only after one that it goes with: if the two, alone,
would stay as they are.  Sequences all of whose neighbours go together are
exactly those that replaying the merges gives, and one piece at a place has
such a sequence before it; so the ids are the model's own.  That holds if no
merge is better than those that make its parts, as in every trained model; if
one is, segments' merges are replayed as they are.  A character that no piece
spells becomes its bytes in both kinds.

Where no piece has two neighbouring characters side by side, nothing reaches
across: texts are cut there, each distinct segment is encoded once and
remembered, and all segments take their steps together: one automaton step,
then one relaxation for each output link, as array operations.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import kernels as K
from .common import col, map_chunks, multi_range

#: The folder of vocabulary files; ``FATHOMLEX_TOKENIZERS`` or an argument can name another.
FOLDER = os.environ.get("FATHOMLEX_TOKENIZERS", "/opt/tokenizers")
MODEL = "piece_bpe_32k.model"
SCHEMA = "doc_id long, ids array<int>, n_ids int, exact boolean"
#: Segments that are remembered, at most; then all are forgotten.
REMEMBERED = 1 << 17
CHUNK = 1 << 21
_SPACE = 32
_UNKNOWN, _START, _NONE = -2, -3, -4


@dataclass
class Automaton:
    """Nodes are places in the trie of all pieces, 0 its root.

    Child of node s by byte c: ``to[base[s] + c]`` if ``owner[base[s] + c] == s``,
    else the search goes on at ``fail[s]``.  ``first``: the node itself if a
    piece ends there, else its nearest suffix that is one; ``link``: the next
    such suffix after it; 0 ends both chains.
    """

    base: np.ndarray
    owner: np.ndarray
    to: np.ndarray
    fail: np.ndarray
    first: np.ndarray
    link: np.ndarray
    length: np.ndarray
    score: np.ndarray
    piece: np.ndarray
    #: The pieces by number, for ``Merges``.
    number: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        at = self.base[state] + c
        ok = self.owner[at] == state
        out = np.where(ok, self.to[at], 0)
        todo = np.flatnonzero(~ok & (state > 0))
        s = self.fail[state[todo]]
        while len(todo):
            at = self.base[s] + c[todo]
            ok = self.owner[at] == s
            out[todo[ok]] = self.to[at[ok]]
            more = ~ok & (s > 0)
            todo, s = todo[more], self.fail[s[more]]
        return out


def build(words: list[bytes], scores: list[float], ids: list[int]) -> Automaton:
    kids: list[dict[int, int]] = [{}]
    end: dict[int, int] = {}
    for i, w in enumerate(words):
        s = 0
        for c in w:
            t = kids[s].get(c)
            if t is None:
                t = kids[s][c] = len(kids)
                kids.append({})
            s = t
        end[s] = i
    n = len(kids)
    fail, first, link = (np.zeros(n, np.int32) for _ in range(3))
    length, score, piece = np.zeros(n, np.int32), np.zeros(n), np.full(n, -1, np.int32)
    for s, i in end.items():
        length[s], score[s], piece[s] = len(words[i]), scores[i], ids[i]
        first[s] = s
    queue = list(kids[0].values())
    for s in queue:  # by depth
        for c, t in kids[s].items():
            f = int(fail[s])
            while f and c not in kids[f]:
                f = int(fail[f])
            fail[t] = kids[f].get(c, 0)
            queue.append(t)
        link[s] = first[fail[s]]
        if not first[s]:
            first[s] = link[s]
    # rows of the trie are laid over each other in one array, those with most children first
    size = n + 1024
    used = bytearray(size + 512)
    base = np.zeros(n, np.int32)
    free, at = 256, 256
    for s in sorted((i for i in range(n) if kids[i]), key=lambda i: -len(kids[i])):
        cs = sorted(kids[s])
        if len(cs) == 1:  # fills what holes there are
            while used[free]:
                free += 1
            b = free - cs[0]
        else:
            b = at
            while any(used[b + c] for c in cs):
                b += 1
            at = b if len(cs) < 32 else b + 1
        base[s] = b
        for c in cs:
            used[b + c] = 1
        if len(used) - max(at, free) < 1024:
            used += bytes(len(used))
    room = len(used) + 256
    owner, to = np.full(room, -1, np.int32), np.zeros(room, np.int32)
    for s, k in enumerate(kids):
        for c, t in k.items():
            owner[base[s] + c], to[base[s] + c] = s, t
    return Automaton(base, owner, to, fail, first, link, length, score, piece)


@dataclass
class Merges:
    """What tells whether one piece may follow another: pieces by number, those that are no character with the two that make them, and which two make one.

    ``rank``: a better merge has a lesser one; characters have -1, and so in
    ``undone`` have pieces that replaying the merges never leaves.  Numbers
    beyond the pieces' are characters that are no piece.
    """

    rank: np.ndarray
    undone: np.ndarray
    left: np.ndarray
    right: np.ndarray
    key: np.ndarray
    made: np.ndarray
    #: Rank and id by piece, where merges must be replayed; else None.
    replay: tuple[dict, dict] | None = None

    def together(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether p and q stay as they are when q follows p: the last merges of both are undone, latest first, to see if one across was better."""
        out = np.ones(len(p), bool)
        at, a, b = np.arange(len(p)), p.astype(np.int64), q.astype(np.int64)
        limit = np.full(len(p), 1 << 40)
        n = len(self.rank)
        while len(at):
            k = a * n + b
            i = np.minimum(np.searchsorted(self.key, k), max(0, len(self.key) - 1))
            across = (self.key[i] == k) & (2 * self.rank[self.made[i]] < limit) if len(self.key) else np.zeros(len(at), bool)
            out[at[across]] = False
            ra, rb = self.undone[a], self.undone[b]
            more = ~across & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[more], a[more], b[more], ra[more], rb[more]
            # of equal merges the one further left comes first
            undo = ra > rb
            limit = np.where(undo, 2 * ra, 2 * rb + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return out


def replayed(word: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """What merging the best pair of a word, the leftmost of equal ones, over and over leaves of it, and the last pair."""
    x, last = list(word), None
    while len(x) > 1:
        best = min(range(len(x) - 1), key=lambda i: rank.get(x[i] + x[i + 1], 1 << 40))
        if x[best] + x[best + 1] not in rank:
            break
        last = (x[best], x[best + 1])
        x[best : best + 2] = ["".join(last)]
    return x, last


def merges(words: list[str], scores: list[float]) -> tuple[Merges, np.ndarray]:
    """The merges of some pieces, and which pieces they ever make."""
    order = {s: i for i, s in enumerate(sorted(set(scores), reverse=True))}
    rank = {w: order[s] for w, s in zip(words, scores)}
    number = {w: i for i, w in enumerate(words)}
    for w in words:
        for c in w:
            number.setdefault(c, len(number))
    n = len(number)
    r, left, right = (np.full(n, -1, np.int64) for _ in range(3))
    ok = np.zeros(len(words), bool)
    key, made = [], []
    for i, w in enumerate(words):
        if len(w) == 1:
            ok[i] = True
            continue
        x, last = replayed(w, rank)
        r[i] = rank[w]
        if x == [w]:
            ok[i] = True
            left[i], right[i] = number[last[0]], number[last[1]]
        for k in range(1, len(w)):
            if w[:k] in number and w[k:] in number:
                key.append(number[w[:k]] * n + number[w[k:]])
                made.append(i)
    order_ = np.argsort(key)
    m = Merges(r, np.where(left >= 0, r, -1), left, right, np.array(key, np.int64)[order_], np.array(made, np.int64)[order_])
    i = np.flatnonzero(left >= 0)
    if not ok.all() or (r[i] < np.maximum(r[left[i]], r[right[i]])).any():
        m.replay = {w: r for w, r in rank.items() if len(w) > 1}, {}
    return m, ok


@dataclass
class Vocabulary:
    """What encoding and decoding need of a model; the mark of a space is byte 32 here, so a text may hold that character itself."""

    auto: Automaton
    unknown: float
    #: id of the piece of each byte
    byte_id: np.ndarray
    #: bytes of all pieces end to end, and where each begins
    spelled: np.ndarray
    offsets: np.ndarray
    #: number of each character of the pieces by code point, and whether some piece has two of them side by side, a bit for each pair
    char: np.ndarray
    chars: int
    beside: np.ndarray
    #: None of a unigram model
    merges: Merges | None
    #: segments' hashes in order, and the ids of each
    known: tuple = field(default=(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)))
    pairs: dict = field(default_factory=dict)


def _fields(data: bytes):
    """(number, value) of the fields of an encoded message."""
    i = 0

    def number() -> int:
        nonlocal i
        x = shift = 0
        while True:
            c = data[i]
            i += 1
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                return x

    while i < len(data):
        k = number()
        if k & 7 == 0:
            yield k >> 3, number()
        else:
            n = number() if k & 7 == 2 else 4 if k & 7 == 5 else 8
            yield k >> 3, data[i : i + n]
            i += n


def by_merges(model: bytes) -> bool:
    """Whether a model file is one of merges: field 3 of its field 2 is 2."""
    return any(k == 3 and v == 2 for f, x in _fields(model) if f == 2 for k, v in _fields(x))


def vocabulary(pieces: list[tuple[str, float, int]], byte_id: np.ndarray, spelled: list[bytes], of_merges: bool) -> Vocabulary:
    """``pieces``: text, with spaces as they are, score and id of each; ``spelled``: bytes of each id."""
    words, scores, ids = ([p[i] for p in pieces] for i in range(3))
    m, ok = merges(words, scores) if of_merges else (None, np.ones(len(words), bool))
    use = [i for i in range(len(words)) if ok[i]]
    chars = sorted({c for i in use for c in words[i]})
    char = np.zeros(0x110000, np.uint16 if len(chars) < 65535 else np.uint32)
    for i, c in enumerate(chars, 1):
        char[ord(c)] = i
    n = len(chars) + 1
    beside = np.zeros(n * n, bool)
    for i in use:
        c = char[[ord(x) for x in words[i]]].astype(np.int64)
        beside[c[:-1] * n + c[1:]] = True
    auto = build([words[i].encode() for i in use], [scores[i] for i in use], [ids[i] for i in use])
    number = np.full(len(auto.piece), _NONE, np.int32)
    where = {ids[i]: i for i in use}
    for s in np.flatnonzero(auto.length).tolist():
        number[s] = where[int(auto.piece[s])]
    auto.number = number
    if m is not None and m.replay:
        m.replay[1].update((w, i) for w, i in zip(words, ids))
    return Vocabulary(auto, min(scores) - 10, byte_id, np.frombuffer(b"".join(spelled), np.uint8), np.r_[0, np.cumsum([len(x) for x in spelled])], char, n, np.packbits(beside, bitorder="little"), m)


def load(path: str | None = None) -> Vocabulary:
    """The vocabulary of a model file with byte pieces; ``path`` defaults to ``MODEL`` in ``FOLDER``."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path or os.path.join(FOLDER, MODEL))
    spelled: list[bytes] = []
    byte_id = np.full(256, -1, np.int32)
    pieces = []
    for i in range(m.get_piece_size()):
        p = m.id_to_piece(i)
        if m.is_byte(i):
            b = int(p[3:-1], 16)
            byte_id[b] = i
            spelled.append(bytes([b]))
            continue
        w = "" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else p.replace("▁", " ")
        spelled.append(w.encode())
        if w:
            pieces.append((w, m.get_score(i), i))
    if (byte_id < 0).any():
        raise ValueError("the model has no piece for every byte")
    return vocabulary(pieces, byte_id, spelled, by_merges(m.serialized_model_proto()))


def encode_one(word: bytes, v: Vocabulary) -> list[int]:
    """The ids of one segment of any length."""
    a, m = v.auto, v.merges
    if m is not None and m.replay:
        return [i for w in replayed(word.decode(), m.replay[0])[0] for i in ([m.replay[1][w]] if w in m.replay[1] else v.byte_id[list(w.encode())].tolist())]
    n = len(word)
    best, back, size = [0.0] + [-np.inf] * n, [0] * (n + 1), [0] * (n + 1)
    last = [_START] + [_NONE] * n
    s = char = 0
    for i in range(n):
        c = word[i]
        if c & 0xC0 != 0x80:
            char = i
        while a.owner[a.base[s] + c] != s and s:
            s = int(a.fail[s])
        s = int(a.to[a.base[s] + c]) if a.owner[a.base[s] + c] == s else 0
        o, alone = int(a.first[s]), False
        while o:
            k = int(a.length[o])
            alone |= k == i + 1 - char
            if m is None:
                if (x := best[i + 1 - k] + a.score[o]) > best[i + 1]:
                    best[i + 1], back[i + 1], size[i + 1] = x, int(a.piece[o]), k
            elif last[i + 1] == _NONE and (p := last[i + 1 - k]) != _NONE:
                q = int(a.number[o])
                if p >= 0 and (p, q) not in v.pairs:
                    if len(v.pairs) >= REMEMBERED:
                        v.pairs.clear()
                    v.pairs[p, q] = bool(m.together(np.array([p]), np.array([q]))[0])
                if p < 0 or v.pairs[p, q]:
                    last[i + 1], back[i + 1], size[i + 1] = q, int(a.piece[o]), k
            o = int(a.link[o])
        if (i + 1 == n or word[i + 1] & 0xC0 != 0x80) and not alone:
            if m is None:
                if (x := best[char] + v.unknown) > best[i + 1]:
                    best[i + 1], back[i + 1], size[i + 1] = x, _UNKNOWN, i + 1 - char
            elif last[i + 1] == _NONE:
                last[i + 1], back[i + 1], size[i + 1] = _UNKNOWN, _UNKNOWN, i + 1 - char
    out, i = [], n
    while i:
        if not size[i]:
            raise RuntimeError("a segment has no sequence of pieces")
        out += [back[i]] if back[i] != _UNKNOWN else [int(v.byte_id[b]) for b in reversed(word[i - size[i] : i])]
        i -= size[i]
    return out[::-1]


def _encode_lanes(data: np.ndarray, start: np.ndarray, size: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """ids of the segments at ``start``, longest first, end to end, and how many each has."""
    a, m, n, top = v.auto, v.merges, len(start), int(size[0])
    if m is None:
        best = np.full((top + 1) * n, -np.inf)
        best[:n] = 0
    else:
        last = np.full((top + 1) * n, _NONE, np.int32)
        last[:n] = _START
    back, width = np.zeros((top + 1) * n, np.int32), np.zeros((top + 1) * n, np.int32)
    state, char = np.zeros(n, np.int32), np.zeros(n, np.int64)
    active = np.searchsorted(-size, -np.arange(1, top + 1), "right")
    for i in range(top):
        k = int(active[i])
        c = data[start[:k] + i]
        char[:k] = np.where((c & 0xC0) != 0x80, i, char[:k])
        state[:k] = a.step(state[:k], c)
        cid, cw = np.zeros(k, np.int32), np.zeros(k, np.int32)
        cur = np.full(k, -np.inf) if m is None else np.full(k, _NONE, np.int32)
        need = i + 1 - char[:k]
        alone = np.zeros(k, bool)
        o = a.first[state[:k]]
        lane = np.flatnonzero(o)
        o = o[lane]
        while len(lane):
            w = a.length[o]
            alone[lane[w == need[lane]]] = True
            if m is None:
                x = best[(i + 1 - w) * n + lane] + a.score[o]
                ok = x > cur[lane]
                cur[lane[ok]] = x[ok]
            else:
                p, q = last[(i + 1 - w) * n + lane], a.number[o]
                ok = (p != _NONE) & (cur[lane] == _NONE)
                ask = np.flatnonzero(ok & (p >= 0))
                ok[ask] = m.together(p[ask], q[ask])
                cur[lane[ok]] = q[ok]
            at = lane[ok]
            cid[at], cw[at] = a.piece[o[ok]], w[ok]
            o = a.link[o]
            more = o > 0
            lane, o = lane[more], o[more]
        ends = size[:k] == i + 1
        ends[~ends] = (data[start[:k][~ends] + i + 1] & 0xC0) != 0x80
        lane = np.flatnonzero(ends & ~alone)
        if len(lane):
            if m is None:
                x = best[char[lane] * n + lane] + v.unknown
                ok = x > cur[lane]
                cur[lane[ok]] = x[ok]
            else:
                ok = cur[lane] == _NONE
                cur[lane[ok]] = _UNKNOWN
            at = lane[ok]
            cid[at], cw[at] = _UNKNOWN, need[at]
        row = slice((i + 1) * n, (i + 1) * n + k)
        back[row], width[row] = cid, cw
        if m is None:
            best[row] = cur
        else:
            last[row] = cur
    # from the ends backwards: one more piece of every segment a round
    lane, pos = np.arange(n), size.astype(np.int64).copy()
    lanes, found, places = [], [], []
    while len(lane):
        at = pos * n + lane
        w, b = width[at].astype(np.int64), back[at]
        if not w.all():
            raise RuntimeError("a segment has no sequence of pieces")
        unk = b == _UNKNOWN
        if unk.any():
            every = multi_range(pos[unk] - w[unk], w[unk])
            own = np.repeat(lane[unk], w[unk])
            lanes.append(own)
            found.append(v.byte_id[data[start[own] + every]])
            places.append(every)
        lanes.append(lane[~unk])
        found.append(b[~unk])
        places.append(pos[~unk] - w[~unk])
        pos = pos - w
        lane, pos = lane[pos > 0], pos[pos > 0]
    lanes, found, places = np.concatenate(lanes), np.concatenate(found), np.concatenate(places)
    return found[np.lexsort((places, lanes))], np.bincount(lanes, minlength=n)


#: Lanes from which steps taken together are faster than one by one.
FEW = 12


def encode_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """ids of all segments in order, and how many each has."""
    n = len(start)
    size = end - start
    count = np.zeros(n, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.argsort(-size, kind="stable")
    at = 0
    while at < n:  # segments of like lengths together, about a million cells at once
        most = int(size[order[at]])
        to = int(np.searchsorted(-size[order], -(most // 2), "right"))
        part = order[at : min(to, at + max(FEW, (1 << 20) // (most + 1)))]
        at += len(part)
        if len(part) >= FEW and not (v.merges is not None and v.merges.replay):
            ids, c = _encode_lanes(data, start[part], size[part], v)
        else:
            each = [encode_one(data[start[w] : end[w]].tobytes(), v) for w in part]
            ids, c = np.array([x for e in each for x in e], np.int32), np.array([len(e) for e in each])
        count[part] = c
        out.append((part, ids, c))
    first = np.r_[0, np.cumsum(count)]
    flat = np.zeros(int(first[-1]), np.int32)
    for part, ids, c in out:
        flat[multi_range(first[:-1][part], c)] = ids
    return flat, count


def code_points(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Code points of the characters that begin at ``lead``."""
    x = np.r_[data, np.zeros(3, np.uint8)].astype(np.uint32)
    b = x[lead]
    out = b.copy()
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        at = np.flatnonzero((b >= low) & (b < high))
        if len(at):
            c = b[at] & mask
            for i in range(1, more + 1):
                c = c << 6 | (x[lead[at] + i] & 0x3F)
            out[at] = c
    return np.minimum(out, 0x10FFFF)


def segments(data: np.ndarray, begin: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Places at which a segment begins: those of ``begin`` (places at which texts do), and where no piece has the characters on both sides."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    c = v.char[code_points(data, lead)].astype(np.int64)
    n = int(v.chars)
    pair = c[:-1] * n + c[1:]
    cut = np.ones(len(lead), bool)
    if len(pair):
        cut[1:] = (v.beside[pair >> 3] >> (pair & 7).astype(np.uint8)) & 1 == 0
    mark = np.zeros(len(data), bool)
    mark[lead[cut]] = True
    mark[begin] = True
    return np.flatnonzero(mark)


def _remembered(h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """ids of distinct segments, of ascending hashes ``h``, and how many each has; those that were met before are looked up."""
    known, first, count, flat = v.known
    at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    old = known[at] == h if len(known) else np.zeros(len(h), bool)
    new = np.flatnonzero(~old)
    ids, c = encode_words(data, start[new], end[new], v)
    if len(known) + len(new) > REMEMBERED:  # only those of this chunk are kept
        at = at[old]
        flat, count, known = flat[multi_range(first[at], count[at])], count[at], h[old]
        first = np.cumsum(count) - count
    where = np.searchsorted(known, h[new])
    firsts = len(flat) + np.r_[0, np.cumsum(c)][:-1]
    known, first, count, flat = np.insert(known, where, h[new]), np.insert(first, where, firsts), np.insert(count, where, c), np.r_[flat, ids]
    v.known = (known, first, count, flat)
    at = np.searchsorted(known, h)
    return flat[multi_range(first[at], count[at])], count[at]


def encode_texts(texts: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """ids of all texts end to end, and the offsets of the texts among them. A text that isn't empty is read with a space before it."""
    data, offsets = K.raw(texts)
    full = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][full], _SPACE)
    offsets = offsets + np.r_[0, np.cumsum(full)]
    start = segments(data, offsets[:-1][full], v)
    end = np.r_[start[1:], len(data)] if len(start) else start
    h, one, which = np.unique(K.span_hash(data, start, end), return_index=True, return_inverse=True)
    ids, count = _remembered(h, data, start[one], end[one], v)
    first = np.r_[0, np.cumsum(count)]
    flat = ids[multi_range(first[:-1][which], count[which])]
    cut = np.r_[0, np.cumsum(count[which])][np.searchsorted(start, offsets)]
    # segments that only seem equal by their hash would not spell the text
    said, at = spell(flat, cut, v)
    size = np.diff(offsets)
    wrong = np.flatnonzero(np.diff(at) != size)
    if not len(wrong) and not np.array_equal(said, data):
        differ = np.flatnonzero(said != data)
        wrong = np.unique(np.searchsorted(offsets, differ, "right") - 1)
    if len(wrong):
        parts = [flat[a:b] for a, b in zip(cut[:-1], cut[1:])]
        for d in wrong:
            parts[d] = np.array(encode_one(data[offsets[d] : offsets[d + 1]].tobytes(), v), np.int32)
        flat, cut = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
    return flat, cut


def spell(ids: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that the ids of each text spell, and the offsets of the texts among them."""
    size = np.diff(v.offsets)[ids]
    total = np.r_[0, np.cumsum(size)]
    return v.spelled[multi_range(v.offsets[:-1][ids], size)], total[offsets]


def decode_ids(ids: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> pa.Array:
    """The texts: what the ids spell, without the space before each; bytes that are no UTF-8 become U+FFFD."""
    data, at = spell(ids, offsets, v)
    lead = at[:-1][(np.diff(at) > 0)]
    lead = lead[data[lead] == _SPACE]
    before = np.zeros(len(data) + 1, np.int64)
    before[lead + 1] = 1
    at = at - np.cumsum(before)[at]
    data = np.delete(data, lead)
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data.tobytes())])
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())


def _ids_column(flat: np.ndarray, cut: np.ndarray, none: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(flat.astype(np.int32)), mask=pa.array(none)) if len(none) else pa.array([], pa.list_(pa.int32()))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, n_ids, exact) for every row of ``docs`` (doc_id, text); exact: decoding the ids gives the text again.

    A row without text has null ids; an empty text has none, n_ids 0; rows
    without id and repeated rows are encoded like all others; texts of any
    length are encoded whole; other columns are left out; an empty table stays
    empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def fn(c: pa.RecordBatch) -> pa.RecordBatch:
        texts = col(c, "text")
        v = shared.value
        flat, cut = encode_texts(texts, v)
        none = ~texts.is_valid().to_numpy(zero_copy_only=False)
        said, at = K.raw(decode_ids(flat, cut, v))
        data, offsets = K.raw(texts)
        if np.array_equal(at, offsets) and np.array_equal(said, data):
            exact = np.ones(len(texts), bool)
        else:
            exact = np.array([np.array_equal(said[a:b], data[i:j]) for a, b, i, j in zip(at[:-1], at[1:], offsets[:-1], offsets[1:])], bool)
        return pa.record_batch([col(c, "doc_id").cast(pa.int64()), _ids_column(flat, cut, none), pa.array(np.diff(cut).astype(np.int32), mask=none), pa.array(exact, mask=none)], ["doc_id", "ids", "n_ids", "exact"])

    return map_chunks(docs.select("doc_id", "text"), fn, SCHEMA, most=CHUNK)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) for every row of (doc_id, ids); null ids give a null text, no ids an empty one; null or foreign ids within spell nothing; repeated rows are decoded again; an empty table stays empty."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                lists = col(c, "ids").cast(pa.large_list(pa.int64()))
                v = shared.value
                none = ~lists.is_valid().to_numpy(zero_copy_only=False)
                size = np.where(none, 0, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                flat = lists.flatten()
                ids = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False)
                ok = (ids >= 0) & (ids < len(v.offsets) - 1)
                cut = np.r_[0, np.cumsum(ok)][np.r_[0, np.cumsum(size)]]
                texts = decode_ids(ids[ok], cut, v)
                yield pa.record_batch([col(c, "doc_id").cast(pa.int64()), pc.if_else(pa.array(none), pa.scalar(None, pa.string()), texts.cast(pa.string()))], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
