"""Analyzers: text to tokens.

Each is a builder of a Column (for documents, inside the JVM) with a twin in
plain Python (for the few words of a query, on the driver).  A token is null
where a stopword stood, so that it still takes a position.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SearchError

STOPWORDS = "an as at be by if in is it no not of on or to and are but for the was into such that then they this will their there these".split()


@dataclass(frozen=True)
class Analyzer:
    """``column(text, args)`` and ``python(text, args)`` give the same tokens. ``placed(text, args, keep)``, if there: see ``placed``, in fewer steps over all tokens."""

    column: Callable[[Column, tuple[str, ...]], Column]
    python: Callable[[str, tuple[str, ...]], list[str | None]]
    placed: Callable[[Column, tuple[str, ...], Callable[[Column], Column]], Column] | None = None


#: Runs of letters and digits with single dots before or between. No group holds a repeated choice and nothing is given back, so no text is too long for the JVM's stack.
RUNS = r"\.?[A-Za-z0-9]++(?:\.[A-Za-z0-9]++)*+"


def _least(args: tuple[str, ...]) -> int:
    return int(args[0]) if args else 3


def _runs(text: Column, args: tuple[str, ...]) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(RUNS), F.lit(0)), lambda t: F.length(t) >= _least(args))


def _standard(text: Column, args: tuple[str, ...]) -> Column:
    return F.transform(_runs(text, args), lambda t: F.when(~F.lower(t).isin(STOPWORDS), F.lower(t)))


def _standard_placed(text: Column, args: tuple[str, ...], keep: Callable[[Column], Column]) -> Column:
    return _places(_runs(text, args), F.lower, lambda t: keep(t) & ~t.isin(STOPWORDS))


def _standard_py(text: str, args: tuple[str, ...]) -> list[str | None]:
    runs = (m.lower() for m in re.findall(RUNS, text) if len(m) >= _least(args))
    return [None if t in STOPWORDS else t for t in runs]


def _whitespace(text: Column, args: tuple[str, ...]) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([^ \n\t\f\r\x0B]+)"))


def _integer(text: Column, args: tuple[str, ...]) -> Column:
    width = int(args[0]) if args else 0
    found = F.filter(F.regexp_extract_all(text, F.lit("([0-9-]+)")), lambda t: t.rlike("^-?[0-9]+$"))
    whole = F.transform(found, lambda t: F.concat(F.when(t.startswith("-"), "-").otherwise(""), F.regexp_replace(F.ltrim(t, F.lit("-")), "^0+(?=[0-9])", "")))
    return F.transform(whole, lambda t: F.when(t == "-0", "0").otherwise(t)) if not width else F.transform(whole, lambda t: _padded(F.when(t == "-0", "0").otherwise(t), width))


def _padded(t: Column, width: int) -> Column:
    minus = F.when(t.startswith("-"), "-").otherwise("")
    return F.when(F.length(t) >= width, t).otherwise(F.concat(minus, F.lpad(F.ltrim(t, F.lit("-")), F.lit(width) - F.length(minus), F.lit("0"))))


def _integer_py(text: str, args: tuple[str, ...]) -> list[str | None]:
    width = int(args[0]) if args else 0
    out = []
    for t in re.findall("[0-9-]+", text):
        if re.fullmatch("-?[0-9]+", t):
            n = int(t)
            out.append("-" + str(-n).rjust(width - 1, "0") if n < 0 else str(n).rjust(width, "0"))
    return out


#: By name; ``register`` adds to it.
ANALYZERS: dict[str, Analyzer] = {
    "standard": Analyzer(_standard, _standard_py, _standard_placed),
    "whitespace": Analyzer(_whitespace, lambda text, args: re.findall(r"[^ \n\t\f\r\x0b]+", text)),
    "noop": Analyzer(lambda text, args: F.array(text), lambda text, args: [text]),
    "integer": Analyzer(_integer, _integer_py),
}


def register(name: str, column: Callable, python: Callable) -> None:
    """An analyzer of one's own: Column builder and Python twin."""
    ANALYZERS[name] = Analyzer(column, python)


def get(name: str) -> Analyzer:
    if name not in ANALYZERS:
        raise SearchError("schema_setting_required", f"analyzer {name}")
    return ANALYZERS[name]


def _places(of: Column, term: Callable[[Column], Column], keep: Callable[[Column], Column]) -> Column:
    return F.array_compact(F.transform(of, lambda t, i: F.when(keep(term(t)), F.struct(term(t).alias("term"), i.alias("pos")))))


def placed(text: Column, name: str, args: tuple[str, ...] = (), keep: Callable[[Column], Column] = Column.isNotNull) -> Column:
    """Array of (term, pos) of the tokens that are terms and for which ``keep`` holds, in order; positions count all tokens."""
    own = get(name).placed
    found = own(text, args, keep) if own else _places(tokens(text, name, args), lambda t: t, keep)
    return F.coalesce(found, F.array().cast("array<struct<term:string,pos:int>>"))


def tokens(text: Column, name: str, args: tuple[str, ...] = ()) -> Column:
    """Array of tokens; a null text has none."""
    return F.coalesce(get(name).column(text, args), F.array().cast("array<string>"))
