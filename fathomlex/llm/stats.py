"""Dense statistics of texts, for the quality and toxicity operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import kernels as K

_KINDS = ("lead", "cont", "lower", "upper", "digit", "space", "line", "stop", "comma", "bang", "question", "mark", "bar", "symbol")
_KIND = np.full(256, _KINDS.index("symbol"), np.uint8)
for _chars, _name in (
    (range(0xC0, 0x100), "lead"), (range(0x80, 0xC0), "cont"), (range(97, 123), "lower"), (range(65, 91), "upper"), (range(48, 58), "digit"), (b" \t\r\f\v", "space"),
    (b"\n", "line"), (b".", "stop"), (b",", "comma"), (b"!", "bang"), (b"?", "question"), (b"'\"-:;()", "mark"), (b"|", "bar"),
):
    _KIND[list(_chars)] = _KINDS.index(_name)

#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = (
    "the of and a to in is it that for on with as was at by be this are from or an not but he she they we his her which have had you"
    " le la les de des du un une et est en que qui dans pour par sur au ce il elle ne pas se plus avec sont"
    " der die das und ist den von zu mit sich auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach"
    " el los las y del se lo su al como más o pero sus le ya si con sin una por para no"
).split()

#: What ``measure`` gives, in this order.
NAMES = (
    "n_words", "word_length", "distinct_words", "distinct_trigrams", "repeats", "upper", "digits", "symbols", "bangs", "bars", "commas", "stops", "function_words", "words_a_line", "non_ascii",
)


def hashes(words: list[str]) -> np.ndarray:
    """Sorted hashes of some words."""
    return np.unique(K.words(pa.array(sorted(set(words)))).hash)


def is_in(h: np.ndarray, sorted_hashes: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return sorted_hashes[at] == h


_function = hashes(FUNCTION_WORDS)


def by_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each text."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def byte_counts(texts: pa.Array) -> np.ndarray:
    """Bytes of each kind in each text: one column a kind."""
    data, offsets = K.raw(texts)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n, dtype=np.int64) * len(_KINDS), np.diff(offsets))
    return np.bincount(doc + _KIND[data], minlength=n * len(_KINDS)).reshape(n, -1).astype(np.float64)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def measure(texts: pa.Array, x: K.Words | None = None) -> np.ndarray:
    """One row of ``NAMES`` for each text; an empty or null text has zeros."""
    x = x or K.words(texts)
    b = dict(zip(_KINDS, byte_counts(texts).T))
    n = np.diff(x.offsets).astype(np.float64)
    distinct = np.diff(K.distinct_by_doc(x.hash.copy(), x.offsets)[1])
    g, o = K.doc_grams(x, 3)
    trigrams = np.diff(o)
    distinct3 = np.diff(K.distinct_by_doc(g, o)[1])
    same = np.zeros(len(x.hash), bool)
    if len(same):
        same[1:] = (x.hash[1:] == x.hash[:-1]) & (x.doc[1:] == x.doc[:-1])
    letters = b["lower"] + b["upper"]
    chars = np.diff(K.raw(texts)[1]) - b["cont"]
    lines = b["line"] + 1
    return np.stack(
        [
            n, _share(by_doc((x.end - x.start).astype(np.float64), x.offsets), n), _share(distinct, n), _share(distinct3, trigrams), _share(by_doc(same, x.offsets), n), _share(b["upper"], letters), _share(b["digit"], chars),
            _share(b["symbol"], chars), _share(b["bang"], n), _share(b["bar"], n), _share(b["comma"], n), _share(b["stop"], n), _share(by_doc(is_in(x.hash, _function), x.offsets), n), n / lines, _share(b["lead"], chars),
        ],
        1,
    )
