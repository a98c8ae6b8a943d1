"""The corpus pipeline: documents that are worth training on, without repeats and benchmark text, as token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomlex.llm import common, decontaminate, linededup, ngramjoin, pieces, quality


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; rows without text and texts without a word go, rows without id are judged like all others, repeated rows stay or go together, an empty table stays empty."""
    return quality.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that earlier documents or lines have; a document that has nothing but such lines goes.

    Rows without text and texts without a word stay; a row without id comes
    after all others and is known by its text; repeated rows are one document;
    an empty table stays empty.
    """
    return linededup.without_repeats(docs)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least id; repeated rows are one.

    Rows without text and texts without a word stay; a row without id comes
    after all others and is known by its text; an empty table stays empty.
    """
    return ngramjoin.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage of 8 words with the benchmark; rows without text stay, rows without id are judged by their text, repeated rows stay or go together, an empty table stays empty."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text: (doc_id, ids, n_ids, exact), a row for each row; null ids for a null text, none for an empty one."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("lines", drop_repeated_lines),
    ("near_duplicates", one_of_similar),
    ("decontamination", drop_leaks),
    ("sentencepiece", encoded),
]

#: The first stage learns a model, which SQL can't; tests/llm/test_pipeline.py holds the stages after it against comparing everything, one after another.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
