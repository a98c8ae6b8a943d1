"""Syntax trees of queries. Immutable, compared by value."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Text:
    """A word or quoted text, analyzed later. ``flags``: required, wildcard ('glob' or 'char'), fuzzy, proximity, boost."""

    s: str
    flags: tuple[tuple[str, object], ...] = ()

    def flag(self, name: str, default: object = None) -> object:
        return dict(self.flags).get(name, default)


@dataclass(frozen=True)
class Range:
    low: str
    high: str
    low_in: bool = True
    high_in: bool = True


@dataclass(frozen=True)
class And:
    ops: tuple


@dataclass(frozen=True)
class Or:
    ops: tuple


@dataclass(frozen=True)
class Not:
    op: object


@dataclass(frozen=True)
class Group:
    """Parts side by side, joined by the schema's default operator."""

    ops: tuple


@dataclass(frozen=True)
class Scope:
    index: str | None
    field: str
    ops: tuple = field(default=())
