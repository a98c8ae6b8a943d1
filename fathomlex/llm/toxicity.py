"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Labelled documents are dealt into three parts by a hash of the id: one finds
words and word beginnings that toxic documents use far more often (the learned
lexicon, beside a written one), one trains the trees, one calibrates them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, stats
from . import kernels as K
from .common import col, ints, map_chunks

#: Labelled documents used, at most: the only bound here.
SAMPLE = 30_000
STEMS = (0, 4, 6)  # bytes of a word that make an entry; 0: the whole word
WRITTEN = (
    "idiot idiots moron morons stupid dumb loser losers scum trash clown pathetic worthless disgusting hate kill shut ugly fool imbecile jerk vermin filth"
    " idiote imbécile connard salope ordure crétin nul pourriture dégoûtant débile merde"
    " idiot dumm blöd arschloch abschaum müll hässlich ekelhaft wertlos trottel schwachkopf"
    " idiota imbécil estúpido tonto basura escoria inútil asqueroso patético payaso mierda"
).split()
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer ti tú usted ustedes vosotros".split()
NEAR = 3
_written, _second = stats.hashes(WRITTEN), stats.hashes(SECOND_PERSON)
_PLAIN = np.array([c for c in range(256)], np.uint8)
for _a, _b in zip(b"013457@$", b"oleastas"):
    _PLAIN[_a] = _b

NAMES = ("written", "learned", "learned_most", "learned_words", "near_second", "second_person", "upper", "bangs", "questions", "symbols", "obfuscated", "obfuscated_written", "long_runs", "n_words")
SCHEMA = "doc_id long, score double, toxic boolean"


def _entries(x: K.Words) -> list[np.ndarray]:
    """For each length of ``STEMS``, the hash of each word's beginning; shorter words are entries whole."""
    return [x.hash if not n else K.mix(K.span_hash(x.data, x.start, np.minimum(x.end, x.start + n)) + np.uint64(n)) for n in STEMS]


@dataclass
class Lexicon:
    hash: np.ndarray
    weight: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.weight[at], 0.0)


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of ``NAMES`` for each text."""
    x = K.words(texts)
    n = np.diff(x.offsets).astype(np.float64)
    per = np.maximum(n, 1)
    bad = stats.is_in(x.hash, _written) if len(x.hash) else np.zeros(0, bool)
    weight = np.zeros(len(x.hash))
    for h in _entries(x):
        weight = np.maximum(weight, lexicon.of(h))
    nasty = bad | (weight > 0)
    you = stats.is_in(x.hash, _second) if len(x.hash) else bad
    near = np.zeros(len(nasty), bool)
    for d in range(1, NEAR + 1):
        if len(nasty) > d:
            same = x.doc[d:] == x.doc[:-d]
            near[d:] |= nasty[d:] & you[:-d] & same
            near[:-d] |= nasty[:-d] & you[d:] & same
    most = np.zeros(len(n))
    np.maximum.at(most, x.doc, weight) if len(weight) else None
    # words with digits or signs between letters, and what they spell when those are read as letters
    data, offsets = K.raw(K.lower(texts))
    letter = (data >= 97) & (data < 123)
    odd = ((data >= 48) & (data < 58)) | (data == 64) | (data == 36) | (data == 42)
    body = letter | odd | (data >= 128)
    start = body.copy()
    start[1:] &= ~body[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = body[first]
    stop = np.zeros(len(data) + 1, bool)
    stop[1:-1] = body[:-1] & ~body[1:]
    if len(data):
        stop[-1] = body[-1]
        inner = first[first > 0]
        stop[inner] = body[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop)
    odds, letters = np.r_[0, np.cumsum(odd)], np.r_[0, np.cumsum(letter)]
    mixed = (odds[e] > odds[s]) & (letters[e] > letters[s])
    doc = np.searchsorted(offsets, s[mixed], "right") - 1
    spelled = stats.is_in(K.span_hash(_PLAIN[data], s[mixed], e[mixed]), _written)
    same3 = np.zeros(len(data), bool)
    if len(data) > 2:
        same3[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    b = dict(zip(stats._KINDS, stats.byte_counts(texts).T))
    chars = np.maximum(np.diff(offsets), 1)
    docs = len(n)
    return np.stack(
        [
            stats.by_doc(bad, x.offsets) / per, stats.by_doc(weight, x.offsets) / per, most, stats.by_doc(weight > 0, x.offsets), stats.by_doc(near, x.offsets) / per, stats.by_doc(you, x.offsets) / per,
            b["upper"] / np.maximum(b["upper"] + b["lower"], 1), b["bang"] / per, b["question"] / per, b["symbol"] / chars, np.bincount(doc, minlength=docs) / per, np.bincount(doc, weights=spelled, minlength=docs) / per,
            stats.by_doc(same3, offsets) / per, np.log1p(n),
        ],
        1,
    )


@dataclass
class Model:
    lexicon: Lexicon
    trees: boosting.Trees
    calibrated: boosting.Isotonic

    def score(self, texts: pa.Array) -> np.ndarray:
        return self.calibrated(self.trees.margin(features(texts, self.lexicon)))


def _learn_lexicon(rows: DataFrame) -> Lexicon:
    """Entries that at least 8 toxic documents use, at odds of 8 or more against the others; the weight is the log of the odds."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch):
                x = K.words(col(c, "text"))
                toxic = ints(c, "toxic") == 1
                for h in _entries(x):
                    u, o = K.distinct_by_doc(h.copy(), x.offsets)
                    bad = np.repeat(toxic, np.diff(o))
                    k, inverse = np.unique(u, return_inverse=True)
                    yield pa.record_batch([pa.array(k.view(np.int64)), pa.array(np.bincount(inverse, bad, len(k)).astype(np.int64)), pa.array(np.bincount(inverse, ~bad, len(k)).astype(np.int64))], ["h", "bad", "good"])

    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    found = rows.mapInArrow(counts, "h long, bad long, good long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("bad >= 8")
    odds = F.log((F.col("bad") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("good") + 0.5) / (n.get(0, 0) + 1))
    top = found.withColumn("w", odds).where(F.col("w") > float(np.log(8))).collect()  # no more than the words of the labelled rows
    h = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(h)
    return Lexicon(h[order], np.array([r["w"] for r in top], np.float64)[order])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from labels (doc_id, toxic 0/1), ``sample`` of them at most, those of least hash of the id; ids labelled both ways are left out, and of an id with several texts the least one is used."""
    lab = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
    lab = lab.where("toxic = other").select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(lab), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("part", part)
    lexicon = _learn_lexicon(rows.where("part = 0"))

    def measured(c: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([col(c, "doc_id").cast(pa.int64()), col(c, "part").cast(pa.int32()), col(c, "toxic").cast(pa.int32()), pa.array([v.tobytes() for v in features(col(c, "text"), lexicon)], pa.binary())], ["doc_id", "part", "toxic", "x"])

    got = map_chunks(rows.where("part > 0"), measured, "doc_id long, part int, toxic int, x binary").toPandas().sort_values(["doc_id", "x"])
    x = np.frombuffer(b"".join(got["x"]), np.float64).reshape(-1, len(NAMES))
    y, p = got["toxic"].to_numpy(np.float64), got["part"].to_numpy()
    trees = boosting.fit_trees(x[p == 1], y[p == 1])
    return Model(lexicon, trees, boosting.fit_isotonic(trees.margin(x[p == 2]), y[p == 2]))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, toxic) for every row of ``docs``: the calibrated probability, and whether it is one half or more.

    A row without text has a null score and is not toxic; an empty text is
    scored by features of 0; texts of any length are scored whole; rows without
    id and repeated rows are scored like all others.  Without labels the score
    is the same for all; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def judge(c: pa.RecordBatch) -> pa.RecordBatch:
        texts = col(c, "text")
        none = ~texts.is_valid().to_numpy(zero_copy_only=False)
        score = model.value.score(texts)
        return pa.record_batch([col(c, "doc_id").cast(pa.int64()), pa.array(score, mask=none), pa.array((score >= 0.5) & ~none)], ["doc_id", "score", "toxic"])

    return map_chunks(docs.select("doc_id", "text"), judge, SCHEMA)
