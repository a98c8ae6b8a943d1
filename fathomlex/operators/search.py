"""Plans to DataFrames: one scan of the postings, one aggregation by document, then columns only."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import AllOf, AnyOf, Leaf, Near, Nothing, Plan, RangeLeaf, TermLeaf

KEY = ("index", "doc_id")


def _ends(c: Column, b: bytes, low: bool, strict: bool) -> Column:
    """Comparison with a bound, as strings where the bound is text, so that it reaches the scan; else bytewise."""
    try:
        x, bound = c, F.lit(b.decode())
    except UnicodeDecodeError:
        x, bound = c.cast("binary"), F.lit(bytearray(b))
    if low:
        return x > bound if strict else x >= bound
    return x < bound if strict else x <= bound


def has(leaf: TermLeaf | RangeLeaf, term: Column) -> Column:
    """Whether a term of the leaf's field is one of the leaf's."""
    if isinstance(leaf, TermLeaf):
        return term == leaf.term
    parts = []
    if leaf.prefix is not None:
        parts.append(term.startswith(leaf.prefix))
    if leaf.low is not None:
        parts.append(_ends(term, leaf.low, True, leaf.above))
    if leaf.high is not None:
        parts.append(_ends(term, leaf.high, False, leaf.below))
    if leaf.size is not None:
        parts.append(F.octet_length(term) == leaf.size)
    return reduce(Column.__and__, parts, term.isNotNull())


def condition(leaf: TermLeaf | RangeLeaf) -> Column:
    """The postings of a leaf."""
    return (F.col("index") == leaf.index) & (F.col("field") == leaf.field) & has(leaf, F.col("term"))


def wanted(leaves: Sequence[TermLeaf | RangeLeaf]) -> dict[str, Callable[[Column], Column]]:
    """By field the condition on its terms that any of the leaves puts: ``only`` of ``index.postings``."""
    by: dict[str, list] = {}
    for x in leaves:
        by.setdefault(x.field, []).append(x)
    return {name: _any(own) for name, own in by.items()}


def _any(leaves: list) -> Callable[[Column], Column]:
    terms = sorted({x.term for x in leaves if isinstance(x, TermLeaf)})
    ranges = [x for x in leaves if isinstance(x, RangeLeaf)]
    return lambda term: reduce(Column.__or__, [*([term.isin(terms)] if terms else []), *(has(x, term) for x in ranges)])


@dataclass
class Weights:
    """What scores need of the whole index: of each leaf its factor, then the norm and the number of terms. Factors and norm are numbers, or columns beside the documents."""

    factor: list[float] | list[Column]
    norm: float | Column
    n_terms: int


def frequencies(postings: DataFrame, plan: Plan, stats: DataFrame | None = None) -> list[int]:
    """Postings of each term leaf, counted before any filter; 0 for ranges. One aggregation of a few values for all leaves, or a look at ``stats`` (``index.term_stats``)."""
    terms = [x for x in plan.leaves if isinstance(x, TermLeaf)]
    if not terms:
        return [0] * len(plan.leaves)
    distinct = sorted({(x.index, x.field, x.term) for x in terms})
    if stats is not None:
        found = {(r["index"], r["field"], r["term"]): r["df"] for r in stats.where(reduce(Column.__or__, (condition(TermLeaf(*d)) for d in distinct))).collect()}
        return [found.get((x.index, x.field, x.term), 0) if isinstance(x, TermLeaf) else 0 for x in plan.leaves]
    row = postings.where(reduce(Column.__or__, (condition(x) for x in terms))).agg(*(F.count(F.when(condition(TermLeaf(*d)), 1)).alias(f"n{i}") for i, d in enumerate(distinct))).first()
    df = dict(zip(distinct, row))
    return [df[(x.index, x.field, x.term)] if isinstance(x, TermLeaf) else 0 for x in plan.leaves]


def weights(plan: Plan, df: list[int]) -> Weights:
    n_docs = sum(df)
    idf = [1 + math.log((n_docs + 1) / (n + 1)) for n in df]
    boost = [x.boost if isinstance(x, TermLeaf) else 1.0 for x in plan.leaves]
    norm = 1 / math.sqrt(1 + sum((i * b) ** 2 for i, b in zip(idf, boost)))
    return Weights([i * i * b for i, b in zip(idf, boost)], norm, len(plan.leaves))


def _counted(scan: DataFrame, plan: Plan, filter_: Column | None, in_phrase: set[int]) -> tuple[DataFrame, Weights]:
    """Documents with what each leaf has in them, and their weights beside them, of one pass over the postings.

    Both the documents and the counts of terms are made from one list a
    document, whole, so that Spark moves these lists once and uses the exchange
    twice.  Counts are of all postings, lists of those that pass the filter.
    """
    cells = [F.lit(True).alias("ok") if filter_ is None else F.coalesce(filter_, F.lit(False)).alias("ok")]
    for i, leaf in enumerate(plan.leaves):
        cells.append(F.when(condition(leaf), F.size("positions")).alias(f"n{i}"))
        if i in in_phrase:
            cells.append(F.when(condition(leaf), F.col("positions")).alias(f"p{i}"))
    lists = scan.groupBy(*KEY).agg(F.collect_list(F.struct(*cells)).alias("hits"))

    def of(name: str) -> Callable[[Column], Column]:
        return lambda h: F.when(h["ok"], h[name])

    def there(name: str) -> Callable[[Column], Column]:
        return lambda h: h[name].isNotNull()

    counts = [F.sum(F.size(F.filter("hits", there(f"n{i}")))) if isinstance(x, TermLeaf) else F.sum(F.lit(0)) for i, x in enumerate(plan.leaves)]
    df = lists.agg(*(F.coalesce(c, F.lit(0)).cast("double").alias(f"_df{i}") for i, c in enumerate(counts)))
    n_docs = reduce(Column.__add__, (F.col(f"_df{i}") for i in range(len(counts))))
    idf = [1 + F.log((n_docs + 1) / (F.col(f"_df{i}") + 1)) for i in range(len(counts))]
    boost = [x.boost if isinstance(x, TermLeaf) else 1.0 for x in plan.leaves]
    norm = 1 / F.sqrt(1 + reduce(Column.__add__, ((k * b) * (k * b) for k, b in zip(idf, boost))))
    beside = df.select(norm.alias("_norm"), *((k * k * b).alias(f"_w{i}") for i, (k, b) in enumerate(zip(idf, boost))))
    each = [F.array_max(F.transform("hits", of(f"n{i}"))).alias(f"_n{i}") for i in range(len(counts))]
    each += [F.array_max(F.transform("hits", of(f"p{i}"))).alias(f"_p{i}") for i in sorted(in_phrase)]
    docs = lists.select(*KEY, *each).crossJoin(F.broadcast(beside))
    return docs, Weights([F.col(f"_w{i}") for i in range(len(counts))], F.col("_norm"), len(counts))


def _phrase(lists: list[Column]) -> Column:
    return F.exists(lists[0], lambda m: reduce(Column.__and__, (F.array_contains(p, m + k) for k, p in enumerate(lists[1:], 1)), F.lit(True)))


def _window(lists: list[Column], n: int) -> Column:
    inside = lambda x: reduce(Column.__and__, (F.exists(p, lambda y: (y >= x) & (y < x + n)) for p in lists))
    return F.exists(F.concat(*lists), inside)


def matches(postings: DataFrame, plan: Plan, filter_: Column | None = None, w: Weights | None = None, props: bool = False, counted: bool = False) -> DataFrame:
    """(index, doc_id, score) of the documents that the plan finds; without weights the score is null. No order.

    Postings hold (index, field, term, doc_id, positions, inline).  All leaves
    read one scan; phrases alone carry positions through the shuffle.  With
    ``props`` the result also has ``positions``, a map from 'field:term' to the
    places of each of the query's terms that the document has, and ``inline``.
    With ``counted`` the weights come of the same scan: for postings that are
    built as they are read. It leaves no room for ``props``.
    """
    more = ("positions", "inline") if props else ()
    if not plan.leaves or isinstance(plan.tree, Nothing):
        out = postings.select(*KEY, F.lit(None).cast("double").alias("score"), F.lit(None).cast("map<string,array<int>>").alias("positions"), F.lit(None).cast("map<string,array<string>>").alias("inline"))
        return out.select(*KEY, "score", *more).where(F.lit(False))
    in_phrase = set()

    def visit(node: object) -> None:
        if isinstance(node, Near):
            in_phrase.update(node.leaves)
        for o in (*getattr(node, "ops", ()), *getattr(node, "need", ()), *getattr(node, "ban", ())):
            visit(o)

    visit(plan.tree)
    scan = postings.where(reduce(Column.__or__, (condition(x) for x in plan.leaves)))
    if counted:
        docs, w = _counted(scan, plan, filter_, in_phrase)
    else:
        if filter_ is not None:
            scan = scan.where(filter_)
        aggs = []
        for i, leaf in enumerate(plan.leaves):
            here = condition(leaf)
            aggs.append(F.max(F.when(here, F.size("positions"))).alias(f"_n{i}"))
            if i in in_phrase:
                aggs.append(F.max(F.when(here, F.col("positions"))).alias(f"_p{i}"))
        if props:
            aggs += [F.map_from_entries(F.collect_set(F.struct(F.concat("field", F.lit(":"), "term"), "positions"))).alias("positions"), F.first("inline").alias("inline")]
        docs = scan.groupBy(*KEY).agg(*aggs)
    zero = F.lit(0.0)

    def value(i: int) -> tuple[Column, Column, Column]:
        there = F.col(f"_n{i}").isNotNull()
        if isinstance(plan.leaves[i], RangeLeaf):
            return there, F.lit(0), zero
        return there, F.lit(1), F.sqrt(F.coalesce(F.col(f"_n{i}"), F.lit(0)).cast("double")) * F.lit(w.factor[i] if w else 0.0)

    def build(node: object) -> tuple[Column, Column, Column]:
        """Whether a document matches, how many scores it has, and their sum."""
        if isinstance(node, Leaf):
            return value(node.i)
        if isinstance(node, Nothing):
            return F.lit(False), F.lit(0), zero
        if isinstance(node, Near):
            parts = [value(i) for i in node.leaves]
            lists = [F.col(f"_p{i}") for i in node.leaves]
            near = _phrase(lists) if node.window is None else _window(lists, node.window)
            together = reduce(Column.__and__, (p[0] for p in parts))
            return together & F.coalesce(near, F.lit(False)), F.lit(len(parts)), reduce(Column.__add__, (p[2] for p in parts))
        if isinstance(node, AllOf):
            parts = [build(o) for o in node.need]
            ok = reduce(Column.__and__, [*(p[0] for p in parts), *(~build(o)[0] for o in node.ban)])
            return ok, reduce(Column.__add__, (p[1] for p in parts)), reduce(Column.__add__, (p[2] for p in parts))
        parts = [build(o) for o in node.ops]
        return (
            reduce(Column.__or__, (p[0] for p in parts)),
            reduce(Column.__add__, (F.when(p[0], p[1]).otherwise(0) for p in parts)),
            reduce(Column.__add__, (F.when(p[0], p[2]).otherwise(zero) for p in parts)),
        )

    ok, n, total = build(plan.tree)
    score = n / F.lit(w.n_terms + 1.0) * F.lit(w.norm) * total if w else F.lit(None).cast("double")
    return docs.where(ok).select(*KEY, score.alias("score"), *more)


def page(found: DataFrame, presort: str = "score", start: int = 0, rows: int | None = 10) -> DataFrame:
    """A page in order of falling score, or of doc_id for presort 'key'; equal scores by index and doc_id."""
    order = [F.col("doc_id")] if presort == "key" else [F.desc("score"), F.col("index"), F.col("doc_id")]
    out = found.orderBy(*order)
    if start:
        out = out.offset(start)
    return out if rows is None else out.limit(rows)
