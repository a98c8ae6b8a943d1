"""N-gram Jaccard self-join of documents by prefix trees, and the classes it makes.

A document is the set of its word n-grams.  Documents of one set are collapsed
first.  Large families of near copies are balls around a few centres: their
members are similar to each other by the triangle inequality (``centres``), and
whatever else lies near a ball walks tries of its members.  All other sets meet
at the n-grams that come first in a global order, those of few documents before
those of many, n-grams of one document left out.  A pair of similar sets shares
several of the first n-grams of both (l of them, if each gives l - 1 more than a
prefix filter needs).  The sets of pairs that do meet are stored, in a block of
the first n-gram they share, in a trie from that n-gram on (whole, if it is a
common one), and each walks the trie.  No block counts more than a pair's
overlap and that of its first shared n-gram counts it all, so the largest count
is the overlap.  n-grams and sets are known by 64-bit hashes, leads by 48 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bitmap, centres, setjoin, trie
from . import kernels as K
from .common import col, documents, drop, give_back, in_batches, ints, map_chunks, map_gather, multi_range, n_parts, pa_schema, row_key, unblobbed, written

#: n-grams of so many documents and more make a level of the global order each; level 0 is n-grams of one document.
COMMON = (2, 4, 32, 256, 2048, 16384, 131072)
#: Level of n-grams that can be the lead of a large family.
FAMILY = 3
#: Different sets that make a family large, and how many of them are looked at to find its centre, about.
LARGE, SAMPLE = 32, 24
#: Bounds of what is broadcast: centres, their n-grams, and bits that tell the levels. The largest families come first; smaller ones just meet at keys.
MOST_CENTRES, MOST_TOKENS, MOST_BITS = 2048, 1 << 20, 1 << 28
#: Members and visitors of a ball in one trie.
MEMBERS, VISITORS = 512, 2048
#: Pairs of one block that are looked at together.
SLICE = 1 << 18
#: Distinct pairs of a part, and similar ones, that a task holds before it sends them on.
HELD_PAIRS, HELD_LINKS = 1 << 18, 1 << 14
#: What the broadcast levels begin with.
_MARK = b"fathomlex levels of n-grams\n"
_KEY = np.dtype("<u4")
#: A key of a set: its place in the part, its level plus 8 if it is the set's lead, the set, its size, its n-grams from the key on, and 48 bits that stand for the lead and the n-gram after it.
_ROW = np.dtype([("k", "<u4"), ("kind", "u1"), ("s", "<u8"), ("n", "<u4"), ("most", "<u4"), ("head", "<u4"), ("head2", "<u2")])
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)
_THREE = np.uint64(3)
_TOP = np.uint64(61)


def _several(size: np.ndarray) -> np.ndarray:
    """n-grams that similar sets must share among their first ones, by the lesser size."""
    return 1 + size.astype(np.int64) // 16


def _place(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of a hash and 32 bits of its place in the part; both ascend with the hash."""
    x = (h >> _32) * np.uint64(parts) + ((h & _LOW) * np.uint64(parts) >> _32)
    return (x >> _32).astype(np.int64), (x & _LOW).astype(np.uint32)


def _sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text; a text of fewer than n words has one, all of its words."""
    x = K.words(texts)
    g, offsets = K.doc_grams(x, n)
    count = np.diff(x.offsets)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.array([K.mix(np.array([int(K.grams(x.hash[x.offsets[d] : x.offsets[d + 1]], int(count[d]))[0]) ^ int(count[d])], np.uint64))[0] for d in short], np.uint64)
        g = np.insert(g, offsets[short], whole)
        add = np.zeros(len(offsets), np.int64)
        add[short + 1] = 1
        offsets = offsets + np.cumsum(add)
    return K.distinct_by_doc(g, offsets)


class _Levels:
    """Bits that tell how common n-grams are: for each level and part, 2**power of them from ``first`` on.

    They are one broadcast value, whose file workers map: those of an executor
    share its pages, and none has a copy of its own.
    """

    def __init__(self, parts: int, data: Broadcast) -> None:
        self.parts, self.data = parts, data

    def __getstate__(self) -> dict:
        return {"parts": self.parts, "data": self.data}

    @cached_property
    def _all(self) -> np.ndarray:
        path = getattr(self.data, "_path", None)  # none where broadcasts are encrypted
        if path:
            with open(path, "rb") as f:
                at = f.read(256).find(_MARK)
            if at >= 0:
                return np.memmap(path, np.uint8, "r", at + len(_MARK))
        return np.frombuffer(self.data.value, np.uint8)[len(_MARK) :]

    @cached_property
    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(COMMON) * self.parts
        first = np.frombuffer(self._all[: 8 * n].tobytes(), np.int64)
        return first.reshape(-1, self.parts), self._all[8 * n : 9 * n].astype(np.int64).reshape(-1, self.parts)

    @property
    def bits(self) -> np.ndarray:
        return self._all[9 * len(COMMON) * self.parts :]

    def of(self, part: np.ndarray, k: np.ndarray) -> np.ndarray:
        bits = self.bits
        level = np.zeros(len(k), np.int64)
        alive = np.arange(len(k))
        for first, power in zip(*self._tables):
            p = part[alive]
            slot = first[p] + (k[alive].astype(np.int64) >> (32 - power[p]))
            ok = (np.asarray(bits[slot >> 3]) >> (slot & 7).astype(np.uint8)) & 1 > 0
            alive = alive[ok]
            level[alive] += 1
        return level


def _levels(docs: DataFrame, n: int, parts: int) -> _Levels:
    """How common each n-gram is, counted over all documents and told in ``MOST_BITS`` bits a level at most: n-grams that share a bit count as the more common one."""

    def all_grams(c: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        part, k = _place(_sets(col(c, "text"), n)[0], parts)
        return part.astype(np.int32), k

    def bits(t_: pa.Table) -> pa.Table:
        k = unblobbed(t_, _KEY)
        k.sort()
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        df = np.diff(np.r_[at, len(k)])
        k = k[at]
        powers, out = [], []
        for least in COMMON:
            some = k[df >= least]
            power = min(max(3, int(16 * len(some)).bit_length()), max(3, (MOST_BITS // parts).bit_length() - 1))
            m = np.zeros(1 << power, np.uint8)
            m[some >> np.uint32(32 - power)] = 1
            powers.append(power)
            out.append(np.packbits(m, bitorder="little").tobytes())
        del k
        give_back()
        return pa.table({"part": t_.column("part")[:1], "power": pa.array([powers], pa.list_(pa.int32())), "bits": pa.array([b"".join(out)], pa.binary())})

    rows = written(map_gather(docs, all_grams, parts).groupBy("part").applyInArrow(bits, "part int, power array<int>, bits binary"), "levels")
    first, power = np.zeros((len(COMMON), parts), np.int64), np.full((len(COMMON), parts), 3, np.uint8)
    flat = bytearray(len(_MARK) + 9 * first.size)
    head = len(flat)
    flat += b"\0"  # for parts without n-grams
    for r in rows.toLocalIterator():  # the driver holds the bits once
        at = 8 * (len(flat) - head)
        flat += r["bits"]
        for i, p in enumerate(r["power"]):
            first[i, r["part"]], power[i, r["part"]] = at, p
            at += 1 << p
    drop(rows)
    flat[:head] = _MARK + first.tobytes() + power.tobytes()
    return _Levels(parts, docs.sparkSession.sparkContext.broadcast(flat))


def _in_order(tokens: np.ndarray, offsets: np.ndarray, levels: _Levels) -> np.ndarray:
    """The sets' n-grams as ascending numbers of the global order: how common they are in the upper three bits."""
    level = levels.of(*_place(tokens, levels.parts)).astype(np.uint64)
    return K.distinct_by_doc((tokens >> _THREE) | (level << _TOP), offsets)[0]


def _where(o: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part, place in the part and level of n-grams in the global order."""
    return *_place(o << _THREE, parts), (o >> _TOP).astype(np.int64)


def _at_level(o: np.ndarray, offsets: np.ndarray, level: int) -> np.ndarray:
    """How many n-grams of each set are below a level: the place of its first one from there on."""
    below = np.r_[0, np.cumsum(o < np.uint64(level) << _TOP)]
    return below[offsets[1:]] - below[offsets[:-1]]


def _head(o: np.ndarray, offsets: np.ndarray, lead: np.ndarray, some: np.ndarray) -> np.ndarray:
    """A hash of the lead and the n-gram after it, of ``some`` of the sets: unlike texts that share one rarely share both."""
    at = lead[some]
    after = np.minimum(at + 1, offsets[1:][some] - 1)
    return K.mix(o[at] * np.uint64(0x9E3779B97F4A7C15) + K.mix(o[after]))


def _summed(rows: np.ndarray) -> np.ndarray:
    """Rows (a, b, w, several, have) with one row a pair: the least w and all of have."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.flatnonzero(np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])])
    out = rows[first]
    out[:, 4] = np.add.reduceat(rows[:, 4], first)
    return out


def _keys(o: np.ndarray, offsets: np.ndarray, sets: np.ndarray, parts: int, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(part, row) of the keys of sets."""
    size = np.diff(offsets)
    prefix = np.where(size > 0, np.minimum(size, size - setjoin.needed(size, t) + _several(size)), 0)
    own = np.repeat(np.arange(len(size)), prefix)
    at = multi_range(offsets[:-1], prefix)
    # near copies differ in rare n-grams, so the lead is the first common one that is a key
    lead = offsets[:-1].copy()
    for least in (2, FAMILY):
        below = _at_level(o, offsets, least)
        lead = np.where(below < prefix, offsets[:-1] + below, lead)
    several = (o[at] >> _TOP) > 0  # an n-gram of one document meets nothing
    own, at = own[several], at[several]
    out = np.empty(len(at), _ROW)
    part, out["k"], level = _where(o[at], parts)
    out["s"], out["n"], out["most"] = sets[own], size[own], offsets[1:][own] - at
    out["kind"] = level + 8 * (at == lead[own])
    head = _head(o, offsets, lead, size > 0)
    head = np.repeat(head, np.bincount(own, minlength=len(size))[size > 0])
    out["head"], out["head2"] = head >> _32, (head >> np.uint64(16)) & np.uint64(0xFFFF)
    return part, out


def _meet(r: np.ndarray, part: int, t: Fraction) -> Iterator[np.ndarray]:
    """Pairs of sets that share a key, piece by piece (a pair may be in several, to be summed), each with the key as (level, part, place): a number that ascends with the global order.

    Sets of the same lead and n-gram after it - near copies mostly - are a pair
    there and nowhere else; others must meet at several keys.
    """
    found, held = [], 0
    r = r[np.lexsort((255 - r["kind"], r["s"], r["k"]))]
    r = r[np.r_[True, (r["k"][1:] != r["k"][:-1]) | (r["s"][1:] != r["s"][:-1])]]
    c = r["k"].astype(np.uint64) << _32 | r["n"].astype(np.uint64)
    order = np.argsort(c, kind="stable")
    r, c = r[order], c[order]
    longest = np.minimum(r["n"].astype(np.uint64) * np.uint64(t.denominator) // np.uint64(t.numerator), _LOW)
    count = np.searchsorted(c, r["k"].astype(np.uint64) << _32 | longest, "right") - np.arange(len(r)) - 1
    done = np.r_[0, np.cumsum(count)]
    for lo in range(0, int(done[-1]), SLICE):
        at = np.arange(lo, min(lo + SLICE, int(done[-1])))
        x = np.searchsorted(done, at, "right") - 1
        y = x + 1 + at - done[x]
        several = _several(np.minimum(r["n"][x], r["n"][y]))
        ok = np.minimum(r["most"][x], r["most"][y]) > setjoin.overlap_needed(r["n"][x], r["n"][y], t) - several
        same = (r["head"][x] == r["head"][y]) & (r["head2"][x] == r["head2"][y])
        ok = np.where(same, (r["kind"][x] >= 8) & (r["kind"][y] >= 8), ok)
        x, y, several, same = x[ok], y[ok], several[ok], same[ok]
        w = ((r["kind"][x] & 7).astype(np.int64) << 60) | part << 32 | r["k"][x].astype(np.int64)
        p, q = r["s"][x], r["s"][y]
        rows = np.stack([np.minimum(p, q).view(np.int64), np.maximum(p, q).view(np.int64), w, several, np.where(same, several, 1)], 1)
        found.append(_summed(rows))
        held += len(found[-1])
        if held > HELD_PAIRS:
            yield _summed(np.concatenate(found))
            found, held = [], 0
    if held:
        yield _summed(np.concatenate(found))


def _table(columns: list, schema: str) -> pa.Table:
    """Numbers as a table of a Spark schema."""
    names = pa_schema(schema)
    return pa.table([pa.array(np.asarray(c), f.type) for c, f in zip(columns, names)], schema=names)


def _centres(docs: DataFrame, sets: DataFrame, n: int, t: Fraction) -> centres.Centres | None:
    """Centres of the largest families: what most of some sets of one lead have in common."""
    spark = docs.sparkSession
    families = sets.where("lead <> 0").select("lead", "s").distinct().groupBy("lead").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= LARGE)
    top = families.orderBy(F.desc("m"), "lead").limit(MOST_CENTRES).collect() if centres.outer(t) > 0 else []
    if not top:
        return None
    hot = F.broadcast(spark.createDataFrame([(r["lead"], r["m"]) for r in top], "lead long, m long"))
    some = sets.join(hot, "lead").where(F.expr(f"pmod(xxhash64(lead, s), greatest(1, m div {SAMPLE})) = 0")).groupBy("lead", "s").agg(F.min("doc_id").alias("doc_id"))
    some = written(some.select("doc_id", F.col("lead").alias("family")), "family-sample")  # about SAMPLE rows a family

    def tokens(c: pa.RecordBatch) -> pa.RecordBatch:
        g, offsets = _sets(col(c, "text"), n)
        return pa.record_batch([pa.array(ints(c, "family"), pa.int64()), setjoin.binaries(g, offsets)], ["family", "tokens"])

    def middle(table: pa.Table) -> pa.Table:
        flat, cut = setjoin.lists(col(table, "tokens"))
        c = centres.consensus([flat[a:b] for a, b in zip(cut[:-1], cut[1:])], t)
        return pa.table({"family": table.column("family")[:1], "n": pa.array([len(c)], pa.int64()), "tokens": pa.array([c.tobytes()], pa.binary())})

    read = docs.join(F.broadcast(some), "doc_id").select("family", "text")
    middles = written(map_chunks(read, tokens, "family long, tokens binary").groupBy("family").applyInArrow(middle, "family long, n long, tokens binary"), "centres")
    size = dict(middles.where("n > 0").select("family", "n").collect())
    use, total = [], 0
    for r in top:
        if r["lead"] in size and total + size[r["lead"]] <= MOST_TOKENS:
            total += size[r["lead"]]
            use.append(r["lead"])
    found = {r["family"]: np.frombuffer(bytes(r["tokens"]), np.uint64) for r in middles.where(F.col("family").isin(use)).collect()} if use else {}
    drop(some)
    drop(middles)
    return centres.build([found[f] for f in use], t) if use else None


@dataclass
class Similar:
    """sets (s, doc_id), all documents that have words; pairs (a, b, common, na, nb), similar sets that aren't of one ball; members (s, ball); visits (s, ball, d): s, of no or another ball, is similar to d documents of the ball, or, ball -1, s is a member and similar to d documents that visit it."""

    sets: DataFrame
    pairs: DataFrame
    members: DataFrame
    visits: DataFrame


def similar_sets(docs: DataFrame, n: int, t: Fraction) -> Similar:
    spark = docs.sparkSession
    docs = documents(docs)
    parts = n_parts(docs)
    levels = _levels(docs, n, parts)

    def ids(c: pa.RecordBatch) -> pa.RecordBatch:
        tokens, offsets = _sets(col(c, "text"), n)
        some = np.diff(offsets) > 0
        o = _in_order(tokens, offsets, levels)
        below = _at_level(o, offsets, FAMILY)
        lead = np.zeros(len(below), np.uint64)
        has = below < np.diff(offsets)
        lead[has] = _head(o, offsets, offsets[:-1] + below, has)
        return pa.record_batch([pa.array(setjoin.set_hash(tokens, offsets)[some].view(np.int64)), pa.array(ints(c, "doc_id")[some], pa.int64()), pa.array(lead[some].view(np.int64))], ["s", "doc_id", "lead"])

    sets = written(map_chunks(docs, ids, "s long, doc_id long, lead long").distinct(), "sets")
    middle = spark.sparkContext.broadcast(_centres(docs, sets, n, t))
    members, visits = _in_balls(docs, sets, n, t, levels, middle) if middle.value else (spark.createDataFrame([], "s long, ball int"), spark.createDataFrame([], "s long, ball int, d long"))

    def free(c: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sets of a chunk that are in no ball: n-grams, offsets, hash of each; equal ones once."""
        tokens, offsets = _sets(col(c, "text"), n)
        s = setjoin.set_hash(tokens, offsets)
        ok = np.zeros(len(s), bool)
        ok[np.unique(s, return_index=True)[1]] = True
        ok &= np.diff(offsets) > 0
        if middle.value:
            ok &= middle.value.balls(tokens, offsets)[0] < 0
        return tokens[np.repeat(ok, np.diff(offsets))], np.r_[0, np.cumsum(np.diff(offsets)[ok])], s[ok]

    def keys(c: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        tokens, offsets, s = free(c)
        return _keys(_in_order(tokens, offsets, levels), offsets, s, parts, t)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        part, r = table.column("part")[0].as_py(), unblobbed(table, _ROW)
        del table
        for rows in _meet(r, part, t):
            yield from in_batches(pa.table([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(5)], ["a", "b", "w", "several", "have"])).to_batches()
        del r
        give_back()

    pairs = map_gather(docs, keys, parts).groupBy("part").applyInArrow(meet, "a long, b long, w long, several long, have long")
    pairs = pairs.groupBy("a", "b", "several").agg(F.min("w").alias("w"), F.sum("have").alias("have")).where("have >= several")
    blocks = written(pairs.select("w", F.explode(F.array("a", "b")).alias("s")).distinct(), "blocks")
    wanted = spark.sparkContext.broadcast(bitmap.of(blocks, "s"))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch):
                tokens, offsets, s = free(c)
                ok = bitmap.has(wanted.value, s)
                tokens, offsets = tokens[np.repeat(ok, np.diff(offsets))], np.r_[0, np.cumsum(np.diff(offsets)[ok])]
                yield pa.record_batch([pa.array(s[ok].view(np.int64)), setjoin.binaries(_in_order(tokens, offsets, levels), offsets)], ["s", "tokens"])
        give_back()

    body = docs.mapInArrow(bodies, "s long, tokens binary").groupBy("s").agg(F.min("tokens").alias("tokens"))
    at_block = blocks.join(body, "s").withColumn("part", F.pmod(F.xxhash64("w"), F.lit(parts)).cast("int"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        w, s = ints(table, "w"), ints(table, "s")
        flat, cut = setjoin.lists(col(table, "tokens"))
        order = np.argsort(w, kind="stable")
        edges = np.flatnonzero(np.r_[True, w[order][1:] != w[order][:-1]])
        out = []
        for lo, hi in zip(edges.tolist(), np.r_[edges[1:], len(w)].tolist()):
            rows = order[lo:hi]
            level, part, k = int(w[rows[0]]) >> 60, int(w[rows[0]]) >> 32 & 0xFFFFFFF, int(w[rows[0]]) & 0xFFFFFFFF
            start = np.uint64(0) if level > 1 else np.uint64((level << 61) | (_least_at(part, k, parts) >> 3))
            whole = [flat[cut[r] : cut[r + 1]] for r in rows]
            for i, j, both in trie.join([x[np.searchsorted(x, start) :] for x in whole], [len(x) for x in whole], t):
                a, b = (i, j) if s[rows[i]].astype(np.uint64) < s[rows[j]].astype(np.uint64) else (j, i)
                out.append((s[rows[a]], s[rows[b]], both, len(whole[a]), len(whole[b])))
                if len(out) >= HELD_LINKS:
                    yield from _table(list(zip(*out)), links).to_batches()
                    out = []
        if out:
            yield from _table(list(zip(*out)), links).to_batches()

    links = "a long,b long,common long,na long,nb long"
    near = at_block.select("part", "w", "s", "tokens").groupBy("part").applyInArrow(walk, "a long, b long, common long, na long, nb long")
    near = written(near.groupBy("a", "b", "na", "nb").agg(F.max("common").alias("common")), "near")
    drop(blocks)
    return Similar(sets.select("s", "doc_id"), near, members, visits)


def _in_balls(docs: DataFrame, sets: DataFrame, n: int, t: Fraction, levels, middle) -> tuple[DataFrame, DataFrame]:
    """Members and visits of all balls."""
    spark = docs.sparkSession

    def bodies(c: pa.RecordBatch) -> pa.RecordBatch:
        tokens, offsets = _sets(col(c, "text"), n)
        s = setjoin.set_hash(tokens, offsets)
        one = np.unique(s, return_index=True)[1]
        ball, (who, where) = middle.value.balls(tokens, offsets)
        one = one[ball[one] >= 0]
        first = np.zeros(len(s), bool)
        first[np.unique(s, return_index=True)[1]] = True
        who, where = who[first[who]], where[first[who]]
        row = np.r_[one, who]
        size = np.diff(offsets)[row]
        cut = np.r_[0, np.cumsum(size)]
        o = _in_order(tokens, offsets, levels) if len(row) else tokens
        body = setjoin.binaries(o[multi_range(offsets[:-1][row], size)], cut)
        return pa.record_batch([pa.array(s[row].view(np.int64)), pa.array(np.r_[ball[one], where].astype(np.int32)), pa.array(np.arange(len(row)) < len(one)), body], ["s", "ball", "member", "tokens"])

    around = written(map_chunks(docs, bodies, "s long, ball int, member boolean, tokens binary"), "balls")
    members = written(around.where("member").select("s", "ball").distinct(), "members")
    # blocks of a ball: so many of its members, and so many of those that visit it
    size = around.groupBy("ball").agg(F.sum(F.col("member").cast("long")).alias("m"), F.sum((~F.col("member")).cast("long")).alias("v")).where("m > 0 AND v > 0")
    size = F.broadcast(size.select("ball", F.expr(f"cast((m + {MEMBERS - 1}) div {MEMBERS} AS int)").alias("bm"), F.expr(f"cast((v + {VISITORS - 1}) div {VISITORS} AS int)").alias("bv")))
    docs_of = sets.groupBy("s").agg(F.count(F.lit(1)).alias("docs"))
    rows = around.join(size, "ball").join(docs_of, "s")
    own = F.pmod(F.xxhash64("s"), F.when(F.col("member"), F.col("bm")).otherwise(F.col("bv"))).cast("int")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("member"), F.col("bv")).otherwise(F.col("bm")) - 1)))
    rows = rows.select("ball", F.when(F.col("member"), own).otherwise(F.col("other")).alias("block"), F.when(F.col("member"), F.col("other")).otherwise(own).alias("visit"), "s", "member", "docs", "tokens")

    def walk(table: pa.Table) -> pa.Table:
        s, member, docs_ = ints(table, "s"), col(table, "member").to_numpy(zero_copy_only=False), ints(table, "docs")
        ball = table.column("ball")[0].as_py()
        # the most common first: near copies then share long paths
        flat, cut = setjoin.lists(col(table, "tokens"))
        whole = [~flat[a:b][::-1] for a, b in zip(cut[:-1], cut[1:])]
        inside = np.flatnonzero(member)[np.unique(s[member], return_index=True)[1]]
        visit = np.flatnonzero(~member)[np.unique(s[~member], return_index=True)[1]]
        got = np.zeros(len(s), np.int64)
        if len(inside) and len(visit):
            tree = trie.Trie([whole[i] for i in inside], [len(whole[i]) for i in inside], t)
            for v in visit:
                for j, _ in tree.probe(whole[v], len(whole[v])):
                    got[v] += docs_[inside[j]]
                    got[inside[j]] += docs_[v]
        some = np.flatnonzero(got)
        return _table([s[some], np.where(member[some], -1, ball), got[some]], "s long,ball int,d long")

    visits = written(rows.groupBy("ball", "block", "visit").applyInArrow(walk, "s long, ball int, d long").groupBy("s", "ball").agg(F.sum("d").alias("d")), "visits")
    drop(around)
    return members, visits


def _least_at(part: int, k: int, parts: int) -> int:
    """The least 64-bit hash at a place of a part, and a little below it for rounding."""
    return max(0, ((part << 64 | k << 32) // parts) - (1 << 33))


def find_classes(docs: DataFrame, n: int = 2, t: Fraction = Fraction(3, 5)) -> DataFrame:
    """(doc_id, class_id, n_links) for each document that is similar to another: their sets of word n-grams have a Jaccard similarity of ``t`` or more.

    n_links is the number of documents that it is similar to.  A class is all
    documents that such links connect, class_id the least doc_id among them.  A
    document without a link is alone in its class and has no row.  Rows without
    id, text or a word are linked to nothing; a text of fewer than n words has
    one n-gram, all of its words; texts of any length are taken whole; repeated
    rows of an id and set are one, and an id with texts of different sets is
    several documents, a row each.  An empty table has an empty result.
    """
    x = similar_sets(docs, n, t)
    one = written(x.sets.groupBy("s").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("docs")).join(x.members, "s", "left"), "one-of-each-set")
    # links that are known pair by pair, from visits, and within the balls
    docs_of = one.select("s", "docs")
    both = x.pairs.select(F.col("a").alias("s"), F.col("b").alias("o")).unionByName(x.pairs.select(F.col("b").alias("s"), F.col("a").alias("o")))
    known = both.join(docs_of.withColumnRenamed("s", "o"), "o").select("s", F.col("docs").alias("d")).unionByName(x.visits.select("s", "d")).groupBy("s").agg(F.sum("d").alias("d"))
    # a ball is one vertex, of a number below 0 that no other has: classes never go through all of its members
    vertex = F.when(F.col("ball") >= 0, -1 - F.col("ball").cast("long")).otherwise(F.col("s"))
    visiting = x.visits.where("ball >= 0").join(x.members.withColumnRenamed("ball", "own"), "s", "left")
    edges = x.pairs.select(F.col("a").alias("doc_id"), F.col("b").alias("other_id")).unionByName(
        visiting.select(F.when(F.col("own").isNotNull(), -1 - F.col("own").cast("long")).otherwise(F.col("s")).alias("doc_id"), (-1 - F.col("ball").cast("long")).alias("other_id"))
    )
    label = groups(edges)
    of_vertex = one.groupBy(vertex.alias("v")).agg(F.min("first").alias("first"), F.sum("docs").alias("docs"))
    of_class = written(of_vertex.join(label.select(F.col("doc_id").alias("v"), F.col("first").alias("l")), "v", "left").withColumn("l", F.coalesce("l", "v")), "vertices")
    least = of_class.groupBy("l").agg(F.min("first").alias("class_id"))
    named = of_class.join(least, "l").select("v", "class_id", F.col("docs").alias("ball_docs"))
    balls = F.broadcast(named.where(F.col("v").between(-MOST_CENTRES, -1)).select((-1 - F.col("v")).cast("int").alias("ball"), "class_id", "ball_docs"))
    within = one.where("ball IS NOT NULL").join(balls, "ball").select("s", "class_id", (F.col("ball_docs") - 1).alias("own"))
    alone = one.where("ball IS NULL").join(named.withColumnRenamed("v", "s"), "s").select("s", "class_id", (F.col("docs") - 1).alias("own"))
    of_set = within.unionByName(alone).join(known, "s", "left").select("s", "class_id", (F.col("own") + F.coalesce("d", F.lit(0))).alias("n_links")).where("n_links > 0")
    return x.sets.join(of_set, "s").select("doc_id", "class_id", "n_links")


def groups(pairs: DataFrame) -> DataFrame:
    """Connected groups of (doc_id, other_id) pairs: (doc_id, first), first the least id of the group.

    Each round takes the least label among neighbours and then that label's own
    label, so a chain of length m takes about log m rounds; each round is a
    written table.
    """
    edges = written(pairs.select(F.col("doc_id").alias("u"), F.col("other_id").alias("v")).unionByName(pairs.select(F.col("other_id").alias("u"), F.col("doc_id").alias("v"))).distinct(), "edges")
    label = written(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")).withColumn("changed", F.lit(True)), "labels")
    while True:
        around = edges.join(label.select(F.col("u").alias("v"), F.col("l").alias("m")), "v").groupBy("u").agg(F.min("m").alias("m"))
        low = label.join(around, "u").select("u", "l", F.least("l", "m").alias("m"))
        jump = low.join(label.select(F.col("u").alias("m"), F.col("l").alias("ll")), "m", "left")
        new = written(jump.select("u", F.least("m", F.coalesce("ll", "m")).alias("l"), (F.least("m", F.coalesce("ll", "m")) != F.col("l")).alias("changed")), "labels")
        drop(label)
        label = new
        if not new.where("changed").limit(1).count():
            drop(edges)
            return label.select(F.col("u").alias("doc_id"), F.col("l").alias("first"))


def one_of_each(docs: DataFrame, n: int = 2, t: Fraction = Fraction(3, 5)) -> DataFrame:
    """``docs`` with one document of each class of similar ones, that of least id; rows that repeat an id and its text are one, the first by all columns.

    A row without id is known by its text and comes after all that have one.
    Rows without text stay, each of them.  Of an id whose texts are of different
    classes all rows go if one of them isn't the first of its class.  Texts of
    any length are taken whole; an empty table stays empty; all columns come
    back, whatever their names.
    """
    key = row_key(docs)
    gone = find_classes(docs.select(key.alias("doc_id"), "text"), n, t).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, key == gone["_gone"], "left_anti")
    # only rows whose id comes again are shuffled with their texts
    again = docs.groupBy(key.alias("_again")).count().where("_again IS NOT NULL AND count > 1").select("_again")
    once = left.join(again, key == again["_again"], "left_anti")
    more = left.join(again, key == again["_again"], "left_semi")
    first = F.row_number().over(Window.partitionBy(key, more["text"]).orderBy(*(more[c] for c in docs.columns)))
    return once.unionByName(more.select(*(more[c] for c in docs.columns), first.alias("_row")).where("_row = 1").drop("_row"))
