"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document.  Expectation
maximisation over the counts of all vote patterns estimates how often each
labeller is right, without any true label.  The posterior labels of a bounded
sample train a linear scorer over hashed words and word shapes, and the scorer
judges all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import stats
from .common import col, give_back, map_chunks, small_batches

#: Documents whose posterior labels train the scorer, at most: the only bound here.
SAMPLE = 8192
BUCKETS = 1 << 16
SCHEMA = "doc_id long, p_junk double, score double, keep boolean"

#: Labeller of junk: statistic, the number beyond which it votes, whether that is above it, and the words it needs to vote.
JUNK: tuple[tuple[str, float, bool, int], ...] = (
    ("distinct_trigrams", 0.5, False, 20),
    ("repeats", 0.2, True, 8),
    ("upper", 0.5, True, 4),
    ("symbols", 0.06, True, 4),
    ("bangs", 0.2, True, 4),
    ("bars", 0.15, True, 4),
    ("function_words", 0.05, False, 20),
    ("word_length", 14, True, 4),
    ("distinct_words", 0.1, False, 20),
)
#: The labeller of good documents votes for text that is within all of these: statistic, bound, whether it must be below, and the words from which it counts.
ORDINARY: tuple[tuple[str, float, bool, int], ...] = (
    ("distinct_trigrams", 0.7, False, 40),
    ("repeats", 0.1, True, 8),
    ("upper", 0.3, True, 4),
    ("symbols", 0.03, True, 1),
    ("bangs", 0.1, True, 1),
    ("bars", 0.05, True, 1),
    ("function_words", 0.08, False, 40),
    ("word_length", 12, True, 4),
)
LABELLERS = (*(name for name, *_ in JUNK), "ordinary")


def votes(x: np.ndarray) -> np.ndarray:
    """0: no vote, 1: good, 2: junk; a row for each document, a column for each labeller."""
    out = np.zeros((len(x), len(LABELLERS)), np.int64)
    n = x[:, stats.NAMES.index("n_words")]
    for j, (name, bound, above, least) in enumerate(JUNK):
        v = x[:, stats.NAMES.index(name)]
        out[((v > bound) if above else (v < bound)) & (n >= least), j] = 2
    ordinary = n > 0
    for name, bound, below, least in ORDINARY:
        v = x[:, stats.NAMES.index(name)]
        ordinary &= ((v < bound) if below else (v > bound)) | (n < least)
    out[ordinary, -1] = 1
    return out


def packed(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


@dataclass
class WeakModel:
    """Share of junk, and P(vote | class) as [labeller, class, vote]; class 1 is junk."""

    junk: float
    p: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        logs = np.log(self.p)
        s = np.zeros((len(v), 2)) + np.log([1 - self.junk, self.junk])
        for j in range(v.shape[1]):
            s += logs[j][:, v[:, j]].T
        return 1 / (1 + np.exp(np.clip(s[:, 0] - s[:, 1], -500, 500)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> WeakModel:
    """Expectation maximisation on distinct vote patterns and how many documents have each.

    It starts from labellers that err rarely, so class 1 is what junk votes point at.
    """
    m = patterns.shape[1]
    p = np.empty((m, 2, 3))
    p[:, 0], p[:, 1] = [0.985, 0.005, 0.01], [0.69, 0.01, 0.3]
    p[-1, 0], p[-1, 1] = [0.1, 0.89, 0.01], [0.89, 0.1, 0.01]
    model = WeakModel(0.1, p)
    total = counts.sum()
    for _ in range(rounds if total else 0):
        q = model.posterior(patterns)
        w = np.stack([counts * (1 - q), counts * q])
        p = np.empty((m, 2, 3))
        for v in range(3):
            p[:, :, v] = ((patterns == v).T.astype(np.float64) @ w.T) + 0.5
        p /= p.sum(2, keepdims=True)
        new = WeakModel(float((w[1].sum() + 1) / (total + 2)), p)
        done = abs(new.junk - model.junk) < 1e-10
        model = new
        if done:
            break
    return model


def accuracies(model: WeakModel) -> list[tuple[str, float]]:
    """Of each labeller's votes, the share that agree with the class."""
    w = np.array([1 - model.junk, model.junk])
    right = w[0] * model.p[:, 0, 1] + w[1] * model.p[:, 1, 2]
    wrong = w[0] * model.p[:, 0, 2] + w[1] * model.p[:, 1, 1]
    return [(name, float(r / (r + e))) for name, r, e in zip(LABELLERS, right, wrong)]


def features(texts: pa.Array, x: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of hashed words, hashed shapes of what lies between spaces, and repeats; each kind's values of a text add up to 1 at most."""
    n_docs = len(x.offsets) - 1
    words = np.diff(x.offsets)
    half = np.uint64(BUCKETS // 2)
    parts = [(x.doc, (x.hash % half).astype(np.int64), 1 / np.maximum(words, 1)[x.doc])]
    same = np.flatnonzero((x.hash[1:] == x.hash[:-1]) & (x.doc[1:] == x.doc[:-1])) + 1
    parts.append((x.doc[same], np.full(len(same), BUCKETS), 1 / np.maximum(words, 1)[x.doc[same]]))
    data, offsets = K.raw(texts)
    solid = data > 32
    kind = np.where(data >= 128, 97, np.where((data >= 97) & (data < 123), 97, np.where((data >= 65) & (data < 91), 65, np.where((data >= 48) & (data < 58), 48, data)))).astype(np.uint8)
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[firsts] = solid[firsts]
    run = solid.copy()
    run[1:] &= start[1:] | (kind[1:] != kind[:-1])
    at = np.flatnonzero(run)
    token = np.flatnonzero(start[at])
    ends = np.r_[token[1:], len(at)] if len(token) else token
    doc = np.searchsorted(offsets, at[token], "right") - 1
    shape = K.span_hash(kind[at], token, ends)
    parts.append((doc, (shape % half).astype(np.int64) + BUCKETS // 2, 1 / np.maximum(np.bincount(doc, minlength=n_docs), 1)[doc]))
    return tuple(np.concatenate(c) for c in zip(*parts))


def scores(texts: pa.Array, x: K.Words, weights: np.ndarray) -> np.ndarray:
    doc, bucket, value = features(texts, x)
    z = np.bincount(doc, weights=value * weights[bucket], minlength=len(x.offsets) - 1) + weights[-1]
    return 1 / (1 + np.exp(np.clip(z, -500, 500)))  # of being good


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 150) -> np.ndarray:
    """Logistic regression on (buckets, values, P(junk)) by Adam steps over all rows; the last weight is the intercept."""
    w = np.zeros(BUCKETS + 2)
    if not rows:
        return w
    doc = np.repeat(np.arange(len(rows)), [len(b) for b, _, _ in rows])
    bucket, value = np.concatenate([b for b, _, _ in rows]).astype(np.int64), np.concatenate([v for _, v, _ in rows]).astype(np.float64)
    y = np.array([p for _, _, p in rows])
    m, s = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        z = np.bincount(doc, weights=value * w[bucket], minlength=len(rows)) + w[-1]
        e = (1 / (1 + np.exp(-z)) - y) / len(rows)
        g = np.bincount(bucket, weights=value * e[doc], minlength=len(w)) + 1e-7 * w
        g[-1] = e.sum()
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    return w


@dataclass
class Model:
    weak: WeakModel
    weights: np.ndarray


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Both models: votes are counted over all documents, the scorer learns from ``sample`` rows at most, those of least hash of id and text."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text").where(F.col("text").isNotNull())

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch):
                p, n = np.unique(packed(votes(stats.measure(col(c, "text")))), return_counts=True)
                yield pa.record_batch([pa.array(p), pa.array(n)], ["pattern", "n"])

    rows = docs.mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    code, n = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
    weak = estimate(code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3, n)
    share = min(1.0, sample / max(n.sum(), 1))

    def labelled(c: pa.RecordBatch) -> pa.RecordBatch:
        texts = col(c, "text")
        x = K.words(texts)
        doc, bucket, value = features(texts, x)
        key, inverse = np.unique(doc.astype(np.int64) * (BUCKETS + 1) + bucket, return_inverse=True)
        value = np.bincount(inverse, weights=value)
        cut = np.searchsorted(key // (BUCKETS + 1), np.arange(c.num_rows + 1))
        b = (key % (BUCKETS + 1)).astype(np.int32)
        return pa.record_batch(
            [col(c, "key").cast(pa.int64()), pa.array([b[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary()), pa.array([value[i:j].astype(np.float32).tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary()), pa.array(weak.posterior(votes(stats.measure(texts, x))))],
            ["key", "b", "v", "p"],
        )

    # about sample + 4 of its square roots are looked at, so that hardly ever fewer than sample are there to take
    room = min(1.0, share * (1 + 4 / max(sample, 1) ** 0.5))
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    some = docs.select(key.alias("key"), "text").where(F.col("key") < F.lit(int(room * (1 << 30))))
    taken = map_chunks(some, labelled, "key long, b binary, v binary, p double").orderBy("key", "b", "v").limit(sample).collect()
    return Model(weak, train([(np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.float32), r[3]) for r in taken]))


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, p_junk, score, keep) for every row of ``docs``.

    p_junk: what the labellers' votes say; score: the scorer's probability of a
    good document; keep: score of one half or more.  A row without text has
    nulls and is not kept, nor is a text without a word; rows without id are
    judged like all others; repeated rows are judged alike, each of them; texts
    of any length are judged whole; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))

    def judge(c: pa.RecordBatch) -> pa.RecordBatch:
        texts, m = col(c, "text"), model.value
        x = K.words(texts)
        score = scores(texts, x, m.weights)
        p = m.weak.posterior(votes(stats.measure(texts, x)))
        none = ~texts.is_valid().to_numpy(zero_copy_only=False)
        keep = (score >= 0.5) & (np.diff(x.offsets) > 0) & ~none
        return pa.record_batch([col(c, "doc_id").cast(pa.int64()), pa.array(p, mask=none), pa.array(score, mask=none), pa.array(keep)], ["doc_id", "p_junk", "score", "keep"])

    return map_chunks(docs.select("doc_id", "text"), judge, SCHEMA)


def keep_good(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that ``classify`` rejects, with all their columns, whatever their names.

    Rows without text and texts without a word go; rows without id are judged
    like all others; repeated rows stay or go together; an empty table stays
    empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch):
                texts = col(c, "text")
                x = K.words(texts)
                yield c.filter(pa.array((scores(texts, x, model.value.weights) >= 0.5) & (np.diff(x.offsets) > 0)))
        give_back()

    return docs.mapInArrow(good, docs.schema)
