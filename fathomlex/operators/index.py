"""The inverted index as DataFrames: fields normalized and analyzed, postings built, replaced and deleted.

docs:      index, doc_id, fields map<string,string>
postings:  index, field, term, doc_id, positions array<int>, inline map<string,array<string>>, key_clock bigint
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analyzers import placed, tokens
from ..plans.schema import Schema

POSTINGS = ("index", "field", "term", "doc_id", "positions", "inline", "key_clock")
POSTINGS_KIND = "index string, field string, term string, doc_id string, positions array<int>, inline map<string,array<string>>, key_clock bigint"


def from_columns(df: DataFrame, index: str, key: str, fields: Mapping[str, str]) -> DataFrame:
    """docs with the field of each entry (name: column of df) as text; null values are no fields; rows without key are left out."""
    pairs = F.map_from_entries(F.filter(F.array(*(F.named_struct(F.lit("key"), F.lit(n), F.lit("value"), F.col(c).cast("string")) for n, c in fields.items())), lambda e: e["value"].isNotNull()))
    doc_id = F.col(key).cast("string")
    # the condition is on what joins are by, so that a join puts no other one into a part of a plan that reads docs twice
    return df.where(doc_id.isNotNull()).select(F.lit(index).alias("index"), doc_id.alias("doc_id"), pairs.alias("fields"))


def from_fields(rows: DataFrame, index: str) -> DataFrame:
    """docs from rows (doc_id, ord, name, value), one a field: values of one name are joined in order by a space, and names stand in the order of their first values."""
    joined = rows.where("value IS NOT NULL").groupBy("doc_id", "name").agg(F.sort_array(F.collect_list(F.struct("ord", "value"))).alias("v"))
    joined = joined.select("doc_id", F.struct(F.col("v")[0]["ord"].alias("ord"), F.col("name").alias("key"), F.array_join(F.col("v.value"), " ").alias("value")).alias("e"))
    in_order = F.transform(F.sort_array(F.collect_list("e")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return joined.groupBy("doc_id").agg(F.map_from_entries(in_order).alias("fields")).select(F.lit(index).alias("index"), "doc_id", "fields")


def _names(schema: Schema, names: list[str]) -> list[tuple[str, str]]:
    """(name, name that it is indexed under) of the fields that count."""
    return [(n, schema.canonical(n)) for n in names if not schema.find(n).skip]


def field_names(docs: DataFrame) -> list[str]:
    """All field names in use: one small aggregation."""
    return sorted(r[0] for r in docs.select(F.explode(F.map_keys("fields")).alias("n")).distinct().collect())


def _text(names: list[str]) -> Column:
    """The text of a field: that of its names, in the document's order."""
    if len(names) == 1:
        return F.col("fields")[names[0]]
    return F.array_join(F.transform(F.filter(F.map_entries("fields"), lambda e: e["key"].isin(names)), lambda e: e["value"]), " ")


def inline_terms(docs: DataFrame, schema: Schema, names: list[str]) -> Column:
    """inline field -> its distinct terms in order, as one map built in the row."""
    by: dict[str, list[str]] = {}
    for n, c in _names(schema, names):
        if schema.find(n).inline != "no":
            by.setdefault(c, []).append(n)
    entries = []
    for c, ns in by.items():
        analyzer, args = schema.analysis(c)
        found = F.array_sort(F.array_distinct(F.array_compact(tokens(_text(ns), analyzer, args))))
        entries.append(F.named_struct(F.lit("key"), F.lit(c), F.lit("value"), found))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0)) if entries else empty


def postings(docs: DataFrame, schema: Schema, names: list[str] | None = None, clock: Column | None = None, only: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """All postings of ``docs``, one row a document. ``names``: the field names, if they are known, which saves a pass.

    Texts move once, by document.  A field's tokens are put in order and cut
    into terms within the row, so no token is shuffled or sorted with others; a
    document without fields, and an empty table, have no postings.

    ``only`` has for each field that is asked for a condition on its terms: all
    texts are analyzed, but other terms go before anything is put in order, and
    texts stay where they are.
    """
    names = field_names(docs) if names is None else names
    by: dict[str, list[str]] = {}
    for n, c in _names(schema, names):
        if schema.find(n).inline != "only" and (only is None or c in only):
            by.setdefault(c, []).append(n)
    if not by:
        return docs.sparkSession.createDataFrame([], POSTINGS_KIND)
    cells = []
    for c, ns in by.items():
        found = placed(_text(ns), *schema.analysis(c), only[c] if only else Column.isNotNull)
        cells.append(F.struct(F.lit(c).alias("field"), F.sort_array(found).alias("at")))
    if only is None:
        spark = docs.sparkSession
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # a number, or small inputs would become one partition
        docs = docs.repartition(n, "index", "doc_id")
    rows = docs.select("index", "doc_id", inline_terms(docs, schema, names).alias("inline"), (clock if clock is not None else F.lit(0)).cast("long").alias("key_clock"), F.explode(F.array(*cells)).alias("c"))
    rows = rows.select("index", "doc_id", "inline", "key_clock", "c.field", F.col("c.at").alias("at"), F.size("c.at").alias("n")).where("n > 0")
    first = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == 0) | (F.col("at")[i]["term"] != F.col("at")[F.greatest(i - 1, F.lit(0))]["term"]))
    rows = rows.withColumn("first", first)
    ends = F.arrays_zip(F.col("first").alias("lo"), F.concat(F.slice("first", 2, F.col("n")), F.array("n")).alias("hi"))
    terms = F.transform(ends, lambda r: F.struct(F.col("at")[r["lo"]]["term"].alias("term"), F.transform(F.slice("at", r["lo"] + 1, r["hi"] - r["lo"]), lambda e: e["pos"]).alias("positions")))
    rows = rows.select("index", "doc_id", "inline", "key_clock", "field", F.explode(terms).alias("r"))  # the tokens stay behind here
    return rows.select("index", "field", "r.term", "doc_id", "r.positions", "inline", "key_clock")


def sizes(postings_: DataFrame, docs: DataFrame, most: int) -> DataFrame:
    """(index, doc_id, bytes) of documents whose fields and postings together take more than ``most`` bytes, about: a store may refuse them."""
    words = postings_.groupBy("index", "doc_id").agg(F.sum(F.octet_length("term") + 4 * F.size("positions")).alias("p"))
    own = docs.select("index", "doc_id", F.octet_length(F.to_json("fields")).alias("f"))
    return own.join(words, ["index", "doc_id"], "left").select("index", "doc_id", (F.col("f") + F.coalesce("p", F.lit(0))).cast("long").alias("bytes")).where(F.col("bytes") > most)


def term_stats(postings_: DataFrame) -> DataFrame:
    """(index, field, term, df): how many documents have each term; a table to be stored beside the postings, from which scores then take their counts."""
    return postings_.groupBy("index", "field", "term").agg(F.count("*").alias("df"))


def docs_stats(docs: DataFrame, schema: Schema, names: list[str]) -> DataFrame:
    """``term_stats`` of the postings of ``docs``, counted without them: the distinct tokens of each row, where it lies."""
    by: dict[str, list[str]] = {}
    for n, c in _names(schema, names):
        if schema.find(n).inline != "only":
            by.setdefault(c, []).append(n)
    if not by:
        return term_stats(docs.sparkSession.createDataFrame([], POSTINGS_KIND))
    cells = [F.struct(F.lit(c).alias("field"), F.array_distinct(tokens(_text(ns), *schema.analysis(c))).alias("terms")) for c, ns in by.items()]
    rows = docs.select("index", F.explode(F.array(*cells)).alias("c")).select("index", "c.field", F.explode("c.terms").alias("term"))
    return rows.where("term IS NOT NULL").groupBy("index", "field", "term").agg(F.count("*").alias("df"))


def save_stats(stats: DataFrame, path: str) -> None:
    """Write term counts so that a query reads only its terms'."""
    stats.repartitionByRange("index", "field", "term").sortWithinPartitions("index", "field", "term").write.mode("overwrite").partitionBy("index", "field").parquet(path)


def save(postings_: DataFrame, path: str) -> None:
    """Write postings so that a query's field and terms prune files and row groups: by index and field, sorted by term."""
    postings_.repartitionByRange("index", "field", "term").sortWithinPartitions("index", "field", "term", "doc_id").write.mode("overwrite").partitionBy("index", "field").parquet(path)


def newest(postings_: DataFrame) -> DataFrame:
    """Of each posting key (index, field, term, doc_id) the one of the greatest clock; of equal clocks one with the greatest positions."""
    key = ["index", "field", "term", "doc_id"]
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("key_clock"), F.desc("positions")))
    return postings_.withColumn("_n", n).where("_n = 1").drop("_n")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Docs or postings but those of the (index, doc_id) keys in ``gone``."""
    keys = gone.select("index", "doc_id").distinct()
    return rows.join(keys, ["index", "doc_id"], "left_anti")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Docs or postings with those of ``new`` in place of what the same documents had."""
    return without(old, new).unionByName(new)


def last_docs(docs: DataFrame) -> DataFrame:
    """One row a document: that of the greatest key_clock, of equal ones the greatest fields."""
    n = F.row_number().over(Window.partitionBy("index", "doc_id").orderBy(F.desc("key_clock"), F.desc(F.to_json("fields"))))
    return docs.withColumn("_n", n).where("_n = 1").drop("_n")


def add_terms(old: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings with those of ``terms`` (all posting columns) added; of one key the greatest clock wins."""
    return newest(old.unionByName(terms.select(*POSTINGS)))


def without_terms(old: DataFrame, gone: DataFrame) -> DataFrame:
    """Postings but those of the (index, field, term, doc_id, key_clock) in ``gone`` whose clock is no greater; a null clock takes all."""
    keys = gone.groupBy("index", "field", "term", "doc_id").agg(F.max(F.coalesce("key_clock", F.lit((1 << 63) - 1))).alias("_clock"))
    key = ["index", "field", "term", "doc_id"]
    return old.join(keys, key, "left").where(F.col("_clock").isNull() | (F.col("key_clock") > F.col("_clock"))).select(*POSTINGS)
