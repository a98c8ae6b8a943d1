"""Inline filters: a query over the inline fields of a posting, as one Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SearchError
from ..functions import analyzers
from ..plans.nodes import And, Group, Not, Or, Range, Scope, Text
from ..plans.schema import Schema


def compile_filter(tree: Scope, schema: Schema, compat: bool = False) -> Column:
    """True for postings whose inline fields satisfy the tree. ``compat``: groups of several parts are joined by AND whatever the default operator is."""

    def join(ops: tuple, name: str, both: bool) -> Column:
        return reduce(Column.__and__ if both else Column.__or__, (node(o, name) for o in ops))

    def terms(name: str) -> Column:
        return F.coalesce(F.col("inline")[schema.canonical(name)], F.array().cast("array<string>"))

    def node(op: object, name: str) -> Column:
        if isinstance(op, Scope):
            return join(op.ops, op.field or name, schema.default_op == "and")
        if isinstance(op, Group):
            return join(op.ops, name, compat or schema.default_op == "and")
        if isinstance(op, (And, Or)):
            return join(op.ops, name, isinstance(op, And))
        if isinstance(op, Not):
            return ~node(op.op, name)
        if isinstance(op, Range):
            return between(op, name)
        if not isinstance(op, Text):
            raise SearchError("unexpected_operation", op)
        if op.flag("proximity") is not None:
            raise SearchError("proximity_not_allowed_in_filter", op.s)
        analyzer, args = schema.analysis(name)
        found = analyzers.get(analyzer).python(op.s, args)
        if not found:
            return F.lit(False)
        if len(found) > 1:
            raise SearchError("phrase_not_allowed_in_filter", op.s)
        t = found[0]
        if t is None:
            raise SearchError("stopword_not_allowed_in_filter", op.s)
        wild = op.flag("wildcard")
        if wild == "glob":
            return F.exists(terms(name), lambda x: x.startswith(t))
        if wild == "char":
            return F.exists(terms(name), lambda x: x.startswith(t) & (F.octet_length(x) == len(t.encode()) + 1))
        return F.array_contains(terms(name), t)

    def between(op: Range, name: str) -> Column:
        analyzer, args = schema.analysis(name)
        ends = []
        for s in (op.low, op.high):
            found = analyzers.get(analyzer).python(s, args)
            if len(found) != 1 or found[0] is None:
                raise SearchError("too_many_terms", s)
            ends.append(found[0])
        (low, low_in), (high, high_in) = (ends[0], op.low_in), (ends[1], op.high_in)
        minus = [e.startswith("-") for e in ends]
        if schema.find(name).type == "integer" and any(minus):
            if minus[0] != minus[1]:
                (a, a_in), (b, b_in) = ((low, low_in), (high, high_in)) if minus[0] else ((high, high_in), (low, low_in))
                # negative numbers ascend as their digits descend
                return F.exists(terms(name), lambda x: F.when(x.startswith("-"), (x <= a) if a_in else (x < a)).otherwise((x <= b) if b_in else (x < b)))
        if low.encode() > high.encode():
            low, low_in, high, high_in = high, high_in, low, low_in
        return F.exists(terms(name), lambda x: ((x >= low) if low_in else (x > low)) & ((x <= high) if high_in else (x < high)))

    return node(tree, schema.default_field)
