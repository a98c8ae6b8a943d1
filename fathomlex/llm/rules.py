"""Quality rules: a decision list learned from labelled statistics by sequential covering.

Rules that name bad documents are grown one at a time on part of the labelled
rows, condition by condition, pruned on the rest, and kept while they are right
more often than not.  The list becomes one ordered Spark expression over the
columns of statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats
from .common import col, map_chunks

#: Labelled documents that the rules learn from, at most: the only bound here.
SAMPLE = 20_000
CUTS = 48


@dataclass(frozen=True)
class Rule:
    """All conditions (statistic, '<=' or '>', threshold) together; right: of the labelled rows that it took, the share that were bad, by Laplace's estimate."""

    conditions: tuple[tuple[str, str, float], ...]
    right: float

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, cut in self.conditions:
            out = out & ((F.col(name) <= cut) if op == "<=" else (F.col(name) > cut))
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{n} {op} {cut:.6g}" for n, op, cut in self.conditions) or "true"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of ``stats.NAMES``; nulls in the statistics of a row without text."""

    def fn(c: pa.RecordBatch) -> pa.RecordBatch:
        texts = col(c, "text")
        none = ~texts.is_valid().to_numpy(zero_copy_only=False)
        x = stats.measure(texts)
        return pa.record_batch([col(c, "doc_id").cast(pa.int64()), *(pa.array(v, mask=none) for v in x.T)], ["doc_id", *stats.NAMES])

    return map_chunks(docs.select("doc_id", "text"), fn, ", ".join(["doc_id long", *(f"{n} double" for n in stats.NAMES)]))


def _covers(x: np.ndarray, conditions: list[tuple[int, str, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, op, cut in conditions:
        out &= (x[:, j] <= cut) if op == "<=" else (x[:, j] > cut)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> list[tuple[int, str, float]]:
    """Add the condition with the greatest information gain, until none gains or only bad rows are left."""
    conditions: list[tuple[int, str, float]] = []
    here = np.ones(len(x), bool)
    while True:
        p, n = bad[here].sum(), (~bad[here]).sum()
        if not p or not n:
            break
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for j in range(x.shape[1]):
            v, b = x[here, j], bad[here]
            for cut in np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 1)[1:-1], method="lower")):
                low = v <= cut
                for op, m in (("<=", low), (">", ~low)):
                    q, k = b[m].sum(), m.sum()
                    if q and (gain := q * (np.log2(q / k) - base)) > best[0]:
                        best = (gain, (j, op, float(cut)))
        if best[1] is None:
            break
        conditions.append(best[1])
        here &= _covers(x, [best[1]])
    return conditions


def _worth(x: np.ndarray, bad: np.ndarray, conditions: list[tuple[int, str, float]]) -> float:
    m = _covers(x, conditions)
    return (bad[m].sum() - (~bad[m]).sum()) / max(m.sum(), 1) if m.any() else -1.0


def learn(x: np.ndarray, bad: np.ndarray, least_right: float = 0.9, least_cover: int = 5) -> list[Rule]:
    """Ordered rules over the columns of ``x`` (``stats.NAMES``); empty if there is nothing to learn."""
    grow = np.arange(len(x)) % 3 < 2
    left = np.ones(len(x), bool)
    out: list[Rule] = []
    while bad[left].any():  # each rule takes least_cover rows or ends the list
        conditions = _grow(x[left & grow], bad[left & grow])
        px, pb = x[left & ~grow], bad[left & ~grow]
        while len(conditions) > 1 and _worth(px, pb, conditions[:-1]) >= _worth(px, pb, conditions):
            conditions = conditions[:-1]
        m = _covers(x, conditions) & left
        right = (bad[m].sum() + 1) / (m.sum() + 2)
        if not conditions or right < least_right or m.sum() < least_cover:
            break
        out.append(Rule(tuple((stats.NAMES[j], op, cut) for j, op, cut in conditions), float(right)))
        left &= ~m
    return out


def expression(rules: list[Rule]) -> tuple[Column, Column]:
    """Two ordered conditional expressions: the decision ('reject' or 'keep') and the number of the rule that made it, 0 if none did."""
    decision, number = F, F
    for i, r in enumerate(rules, 1):
        decision, number = decision.when(r.column(), "reject"), number.when(r.column(), i)
    if not rules:
        return F.lit("keep"), F.lit(0)
    return decision.otherwise("keep"), number.otherwise(0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from the labelled documents (labels: doc_id, quality, 0 for bad), ``sample`` of them at most, those of least hash of the id.

    Labels without id or quality, and ids that are labelled twice in two ways,
    are left out.  Of an id with several texts, the one of the least statistics
    is learned from, so ``sample`` also bounds the rows.
    """
    lab = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    lab = lab.where("quality = other").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = measured(docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(lab.select("doc_id")), "doc_id", "left_semi"))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(*stats.NAMES)).alias("x")).select("doc_id", "x.*").join(lab, "doc_id").toPandas().sort_values("doc_id")
    return learn(rows[list(stats.NAMES)].to_numpy(), rows["quality"].to_numpy() == 0)


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, decision, rule) for every row of ``docs``: 'reject' and the number of the first rule that holds, else 'keep' and 0.

    A row without text is 'reject' with rule -1; an empty text has statistics
    of 0 and is judged by them; texts of any length are measured whole; rows
    without id and repeated rows are judged like all others; without labels all
    that has a text is kept; an empty table gives no rows.
    """
    decision, number = expression(fit(docs, labels, sample))
    none = F.col("n_words").isNull()
    return measured(docs).select("doc_id", F.when(none, "reject").otherwise(decision).alias("decision"), F.when(none, -1).otherwise(number).alias("rule"))
