"""Line dedup by an exact set-similarity join of all lines of all documents.

A line is the set of its words.  A line goes if an earlier one has a Jaccard
similarity of ``t`` or more with it, earlier by (doc_id, text hash, line
number) and whether or not that one stays itself.  Words are ordered by rarity;
prefix, positional, length and bitmap filters leave few candidate pairs, which
are verified on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitmap, rarity, setjoin
from . import kernels as K
from .common import col, documents, give_back, ints, map_gather, n_parts, reduce_parts, row_key, spread, written

#: A word counted at most this often in the corpus is rare enough to be a key of its own.
RARE = 128


def _lines(texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the lines with at least ``least`` of them: tokens, offsets, text and line number of each."""
    x = K.words(texts)
    breaks = np.flatnonzero(x.data == 10)
    # a line of all texts: its text's number plus the line breaks before it
    before = np.searchsorted(breaks, x.text_offsets[:-1])
    of_word = np.searchsorted(breaks, x.start) + x.doc
    total = len(breaks) + len(texts)
    offsets = np.searchsorted(of_word, np.arange(total + 1))
    tokens, offsets = K.distinct_by_doc(x.hash.copy(), offsets)
    first = before + np.arange(len(texts))  # the first line of each text
    line_doc = np.repeat(np.arange(len(texts)), np.diff(np.r_[first, total]))
    line_no = np.arange(total) - first[line_doc]
    keep = np.diff(offsets) >= least
    word_kept = np.repeat(keep, np.diff(offsets))
    return tokens[word_kept], np.r_[0, np.cumsum(np.diff(offsets)[keep])], line_doc[keep], line_no[keep]


def _ordered(tokens: np.ndarray, offsets: np.ndarray, cls: np.ndarray) -> np.ndarray:
    out, _ = K.distinct_by_doc(rarity.ordered(tokens, cls), offsets)
    return out


def _scan(docs: DataFrame, least: int) -> DataFrame:
    """Rows of one table of two kinds: counters of words (part, blob), and lines (s, doc_id, h, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = rarity.Counter()
        for batch in batches:
            for c in K.chunks(batch):
                tokens, offsets, doc, line = _lines(col(c, "text"), least)
                counter.add(tokens)
                n = len(doc)
                yield pa.record_batch(
                    [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(setjoin.set_hash(tokens, offsets).view(np.int64)), pa.array(ints(c, "doc_id")[doc], pa.int64()), pa.array(ints(c, "h")[doc], pa.int64()), pa.array(line.astype(np.int32))],
                    ["part", "blob", "s", "doc_id", "h", "line"],
                )
        r = counter.rows()
        give_back()
        yield pa.record_batch([r.column(0), r.column(1), *(pa.nulls(r.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["part", "blob", "s", "doc_id", "h", "line"])

    return docs.mapInArrow(run, "part int, blob binary, s long, doc_id long, h long, line int")


def find_repeats(docs: DataFrame, t: Fraction = Fraction(9, 10), least: int = 1) -> DataFrame:
    """The lines that go, as (doc_id, h, line): h is xxhash64 of the text, line counts from 0.

    Rows without id or text have no lines.  Every line that has a word is
    compared, of any length; with a greater ``least``, lines of fewer distinct
    words stay.  Rows that agree in id and text are one document; an empty table
    has no lines.
    """
    spark = docs.sparkSession
    docs = documents(docs).withColumn("h", F.xxhash64("text"))
    scan = written(_scan(docs, least), "lines")
    lines = scan.where("part IS NULL").select("s", "doc_id", "h", "line")
    cls = spark.sparkContext.broadcast(rarity.classes(rarity.added_up(scan.where("part IS NOT NULL").select("part", "blob"))))
    parts, rare = n_parts(docs), rarity.class_at(RARE)

    def keys(c: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        tokens, offsets, _, _ = _lines(col(c, "text"), least)
        sets = setjoin.set_hash(tokens, offsets)
        _, one = np.unique(sets, return_index=True)
        take = np.zeros(len(sets), bool)
        take[one] = True
        n = np.diff(offsets)
        take &= n * t.denominator >= (n + 1) * t.numerator  # smaller sets are like their equals only, which have one hash
        tokens, offsets = tokens[np.repeat(take, np.diff(offsets))], np.r_[0, np.cumsum(np.diff(offsets)[take])]
        key, rows = setjoin.rows(_ordered(tokens, offsets, cls.value), offsets, sets[take], t, rare)
        return spread(key, parts), rows

    firsts = lines.groupBy("s").agg(F.min(F.struct("doc_id", "h", "line")).alias("first"))
    pairs = written(reduce_parts(map_gather(docs, keys, parts), setjoin.ROW, lambda r: setjoin.pair_batch(setjoin.candidates(r, t)), "a long, b long").distinct(), "line-pairs")

    # the sets of the candidates, each read from its first line
    sides = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    wanted = written(firsts.join(sides, "s").select("s", "first"), "line-sets")
    in_docs = spark.sparkContext.broadcast(bitmap.of(wanted.select(F.col("first.h").alias("h")), "h"))
    in_sets = spark.sparkContext.broadcast(bitmap.of(wanted, "s"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bitmap.has(in_docs.value, ints(batch, "h"))))
            for c in K.chunks(batch):
                tokens, offsets, _, _ = _lines(col(c, "text"), least)
                s = setjoin.set_hash(tokens, offsets)
                ok = bitmap.has(in_sets.value, s)
                tokens, offsets = tokens[np.repeat(ok, np.diff(offsets))], np.r_[0, np.cumsum(np.diff(offsets)[ok])]
                yield pa.record_batch([pa.array(s[ok].view(np.int64)), setjoin.binaries(tokens, offsets)], ["s", "tokens"])

    known = docs.mapInArrow(sets, "s long, tokens binary").groupBy("s").agg(F.min("tokens").alias("tokens"))
    info = known.join(wanted, "s")
    left = info.select(F.col("s").alias("a"), F.col("tokens").alias("x"), F.col("first").alias("fa"))
    right = info.select(F.col("s").alias("b"), F.col("tokens").alias("y"), F.col("first").alias("fb"))

    # of each pair, only the set that begins later can lose its first line
    later = F.when(F.col("fa") > F.col("fb"), F.col("a")).otherwise(F.col("b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch, "x", 1 << 21):
                x, y = col(c, "x"), col(c, "y")
                both = setjoin.common(x, y)
                either = np.diff(setjoin.lists(x)[1]) + np.diff(setjoin.lists(y)[1]) - both
                ok = both * t.denominator >= either * t.numerator
                yield pa.record_batch([pa.array(np.unique(ints(c, "late")[ok]), pa.int64())], ["late"])

    near = pairs.join(left, "a").join(right, "b").select(later.alias("late"), "x", "y").mapInArrow(verify, "late long").distinct()
    gone = lines.join(firsts.withColumnRenamed("s", "s1"), F.col("s") == F.col("s1")).join(near, F.col("s") == F.col("late"), "left")
    is_first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("h") == F.col("first.h")) & (F.col("line") == F.col("first.line"))
    return gone.where(~is_first | F.col("late").isNotNull()).select("doc_id", "h", "line").distinct()


def dedup_lines(docs: DataFrame, t: Fraction = Fraction(9, 10), least: int = 1) -> DataFrame:
    """``docs`` with the repeated lines of ``find_repeats`` taken out of text; (doc_id, text, n_removed).

    Every row of docs comes back, also those without id or text, which are left
    as they are; a document all of whose lines go keeps an empty text.  The
    other lines stay as they are, joined by line breaks; an empty table stays
    empty.
    """
    gone = _gone(docs, t, least)
    d = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    j = d.join(gone, (F.col("doc_id") == F.col("_d")) & (F.col("h") == F.col("_h")), "left")
    left = _left(F.col("text"), F.col("_gone"))
    return j.select("doc_id", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left).alias("text"), F.coalesce(F.size("_gone"), F.lit(0)).alias("n_removed"))


def _left(text: Column, gone: Column) -> Column:
    """The text without the lines of some ascending numbers: of its lines, what lies between one number and the next."""
    parts = F.split(text, "\n", -1)
    after = F.concat(F.array(F.lit(-1)), gone)
    until = F.concat(gone, F.array(F.size(parts)))
    return F.array_join(F.flatten(F.zip_with(after, until, lambda a, b: F.slice(parts, a + 2, b - a - 1))), "\n")


def _gone(docs: DataFrame, t: Fraction, least: int) -> DataFrame:
    """(_d, _h, _gone): the numbers of the lines that go of each document, in order."""
    lines = F.array_sort(F.collect_list("line"))
    return find_repeats(docs, t, least).groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).agg(lines.alias("_gone"))


def without_repeats(docs: DataFrame, t: Fraction = Fraction(9, 10), least: int = 1) -> DataFrame:
    """``docs`` with all their columns and the texts of ``dedup_lines``; n_chars, if there is one, is counted again.

    Rows whose text had words and has none left are dropped; all others come
    back, also those without text.  A row without id is known by its text and
    comes after all that have one; repeated rows are one document and stay or
    go together; texts of any length are taken whole; an empty table stays
    empty.
    """
    key = row_key(docs)
    gone = _gone(docs.select(key.alias("doc_id"), "text"), t, least)
    j = docs.join(gone, (key == gone["_d"]) & (F.xxhash64(docs["text"]) == gone["_h"]), "left")
    text = F.when(gone["_gone"].isNull(), docs["text"]).otherwise(_left(docs["text"], gone["_gone"]))
    j = j.where(gone["_gone"].isNull() | text.rlike(r"[A-Za-z0-9\x{80}-\x{10FFFF}]"))
    chars = F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return j.select(*(text.alias("text") if c == "text" else chars.alias(c) if c == "n_chars" else docs[c] for c in docs.columns))
