"""All registered queries of the search engine and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analyzers import STOPWORDS, tokens
from ..operators import index as ix
from ..operators.engine import Engine
from ..sources import extract, solr
from . import schema as sc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DOCS = sc.parse(
    "docs",
    {"default_field": "text", "analyzer": "whitespace"},
    [
        {"name": "text", "analyzer": "standard"},
        {"name": "lang", "inline": True},
        {"name": "source", "inline": True},
        {"name": "n_chars", "type": "integer", "inline": True},
    ],
)
CUSTOMERS = sc.parse("customers", {"default_field": "segment", "analyzer": "whitespace"}, [{"name": "segment"}, {"name": "balance", "type": "integer", "padding_size": 6, "inline": True}])
ORDERS = sc.parse("orders", {"default_field": "date", "analyzer": "whitespace"}, [{"name": "date", "type": "date"}])
PARTS = sc.parse("parts", {"default_field": "name", "analyzer": "standard"}, [{"name": "name"}, {"name": "brand", "analyzer": "noop"}, {"name": "size", "type": "integer"}])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    return ix.from_columns(table(spark, sf_dir, "documents"), "docs", "doc_id", {f: f for f in fields or ("text", "lang", "source", "n_chars")})


def engine(spark: SparkSession, sf_dir: str, *fields: str) -> Engine:
    """An engine over documents; only the named fields are analyzed."""
    return Engine.over(docs(spark, sf_dir, *fields), DOCS, list(fields or ("text", "lang", "source", "n_chars")))


def _other(spark: SparkSession, sf_dir: str, name: str, schema: sc.Schema, key: str, fields: dict[str, Column]) -> Engine:
    df = table(spark, sf_dir, name)
    df = df.select(F.col(key).alias("_key"), *(c.alias(n) for n, c in fields.items()))
    d = ix.from_columns(df, schema.name, "_key", {n: n for n in fields})
    return Engine.over(d, schema, list(fields))


def customers(spark: SparkSession, sf_dir: str) -> Engine:
    return _other(spark, sf_dir, "customer", CUSTOMERS, "c_custkey", {"segment": F.col("c_mktsegment"), "balance": F.floor("c_acctbal").cast("string")})


def orders(spark: SparkSession, sf_dir: str) -> Engine:
    return _other(spark, sf_dir, "orders", ORDERS, "o_orderkey", {"date": F.date_format("o_orderdate", "yyyy-MM-dd")})


def parts(spark: SparkSession, sf_dir: str) -> Engine:
    return _other(spark, sf_dir, "part", PARTS, "p_partkey", {"name": F.col("p_name"), "brand": F.col("p_brand"), "size": F.col("p_size").cast("string")})


# SQL for documents: tokens, positions and postings as the analyzers and the index have them
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_STD = r"list_transform(list_filter(regexp_extract_all({0}, '(?:\.?[A-Za-z0-9])+'), lambda x: len(x) >= 3), lambda x: lower(x))"
_T = f"t AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, n_chars, {_STD.format('text')} AS w FROM documents WHERE doc_id IS NOT NULL)"
_P = f"p AS (SELECT doc_id, w[i] AS term, i - 1 AS pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t) WHERE w[i] NOT IN ({_STOP}))"
_POST = "post AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY doc_id, term)"
_BASE = f"WITH {_T}, {_P}, {_POST}"


def _has(t: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM post WHERE term = '{t}')"


def _ids(where: str) -> str:
    return f"{_BASE} SELECT DISTINCT doc_id FROM t WHERE {where}"


def _score_sql(counted: list[str], boosts: dict[str, float] | None = None, extra: int = 0, banned: tuple[str, ...] = ()) -> str:
    """Scores of documents by the terms that count for each: the closed formula. ``extra``: range leaves."""
    terms = [*counted, *banned]
    b = boosts or {}
    n_docs = " + ".join(f"(SELECT count(*) FROM post WHERE term = '{t}')" for t in terms) or "0"
    idf = {t: f"(1 + ln(((SELECT n FROM n_docs) + 1.0) / ((SELECT count(*) FROM post WHERE term = '{t}') + 1)))" for t in terms}
    squares = " + ".join([*(f"power({idf[t]} * {b.get(t, 1.0)}, 2)" for t in terms), *["power(1 + ln((SELECT n FROM n_docs) + 1.0), 2)"] * extra])
    cases = " ".join(f"WHEN '{t}' THEN power({idf[t]}, 2) * {b.get(t, 1.0)}" for t in counted)
    return (
        f"n_docs AS (SELECT {n_docs} AS n), k AS (SELECT 1 / sqrt(1 + {squares}) AS norm), "
        f"sc AS (SELECT doc_id, count(*) AS n, sum(sqrt(tf) * CASE term {cases} END) AS s FROM post WHERE term IN ({', '.join(repr(t) for t in counted)}) GROUP BY doc_id), "
        f"scored AS (SELECT doc_id, round(n / {len(terms) + extra + 1.0} * (SELECT norm FROM k) * s, 6) AS score FROM sc)"
    )


def _found(name: str, query: str, where: str, fields: tuple[str, ...] = ("text",), **options) -> None:
    """Register a query whose result is the ids it matches."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir, *fields).match("docs", query, **options).select("doc_id")

    QUERIES[name] = run
    ORACLE[name] = _ids(where)


def _scored(name: str, query: str, sql: str, fields: tuple[str, ...] = ("text",), **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir, *fields).match("docs", query, scored=True, **options).select("doc_id", F.round("score", 6).alias("score"))

    QUERIES[name] = run
    ORACLE[name] = sql


# analysis
def _analyze(column: str, analyzer: str, args: tuple[str, ...] = ()) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = table(spark, sf_dir, "documents")
        return d.select("doc_id", F.posexplode(tokens(F.col(column).cast("string"), analyzer, args)).alias("pos", "term")).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))

    return run


QUERIES["analyze_standard"] = _analyze("text", "standard")
ORACLE["analyze_standard"] = f"WITH {_T}, {_P} SELECT term, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM p GROUP BY term"
QUERIES["analyze_whitespace"] = _analyze("text", "whitespace")
ORACLE["analyze_whitespace"] = r"""SELECT w[i] AS term, count(*) AS n, CAST(sum(i - 1) AS BIGINT) AS pos_sum FROM (
    SELECT w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT regexp_extract_all(text, '[^ \n\t\f\r\v]+') AS w FROM documents)) GROUP BY 1"""
QUERIES["analyze_integer"] = _analyze("n_chars", "integer", ("10",))
ORACLE["analyze_integer"] = "SELECT lpad(CAST(n_chars AS VARCHAR), 10, '0') AS term, count(*) AS n, CAST(0 AS BIGINT) AS pos_sum FROM documents WHERE n_chars IS NOT NULL GROUP BY 1"
QUERIES["analyze_noop"] = _analyze("source", "noop")
ORACLE["analyze_noop"] = "SELECT source AS term, count(*) AS n, CAST(0 AS BIGINT) AS pos_sum FROM documents WHERE source IS NOT NULL GROUP BY 1"


def postings_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ix.postings(docs(spark, sf_dir, "text"), DOCS, ["text"])
    return p.select("doc_id", "term", F.size("positions").alias("tf"), F.array_min("positions").alias("first"), F.array_max("positions").alias("last"))


QUERIES["postings_build"] = postings_build
ORACLE["postings_build"] = f"WITH {_T}, {_P} SELECT doc_id, term, CAST(count(*) AS INTEGER) AS tf, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) AS INTEGER) AS last FROM p GROUP BY doc_id, term"


def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "text", "lang").term_stats().select("field", "term", "df")


QUERIES["term_df"] = term_df
ORACLE["term_df"] = f"{_BASE} SELECT 'text' AS field, term, count(*) AS df FROM post GROUP BY term UNION ALL SELECT 'lang', lang, count(*) FROM documents WHERE lang IS NOT NULL GROUP BY lang"

# boolean queries
_found("term", "from", _has("from"))
_found("and", "from AND tion", f"{_has('from')} AND {_has('tion')}")
_found("or", "que OR thre", f"{_has('que')} OR {_has('thre')}")
_found("not", "from AND NOT tion", f"{_has('from')} AND NOT {_has('tion')}")
_found("minus", "+from -tion -ther", f"{_has('from')} AND NOT {_has('tion')} AND NOT {_has('ther')}")
_found("or_not_ignored", "que OR NOT from", _has("que"))
_found("equal_precedence", "que OR thre AND from", f"({_has('que')} OR {_has('thre')}) AND {_has('from')}")
_found("group_default_or", "(que thre NOT from)", f"({_has('que')} OR {_has('thre')}) AND NOT {_has('from')}")
_found("group_default_and", "from tion", f"{_has('from')} AND {_has('tion')}", op="and")
_found("nested_bool", "(que AND des) OR (from AND (tion OR NOT ther))", f"({_has('que')} AND {_has('des')}) OR ({_has('from')} AND {_has('tion')})")
_found("field_scope", "lang:fr AND (text:que OR source:src3)", f"lang = 'fr' AND ({_has('que')} OR source = 'src3')", ("text", "lang", "source"))
_found("fuzzy_is_exact", "from~0.8", _has("from"))
_found("no_tokens", "ab", "false")

# wildcards and ranges
_found("prefix_glob", "thr*", "doc_id IN (SELECT doc_id FROM post WHERE starts_with(term, 'thr'))")
_found("char_wildcard", "thr?", "doc_id IN (SELECT doc_id FROM post WHERE starts_with(term, 'thr') AND octet_length(encode(term)) = 4)")
_found("range_inclusive", "[thra TO thrz]", "doc_id IN (SELECT doc_id FROM post WHERE term BETWEEN 'thra' AND 'thrz')")
_found("range_exclusive", "{thre TO thst}", "doc_id IN (SELECT doc_id FROM post WHERE term BETWEEN 'thrf' AND 'thss')")
_found("range_reversed", "[thrz TO thra]", "doc_id IN (SELECT doc_id FROM post WHERE term BETWEEN 'thra' AND 'thrz')")
_found("range_mixed_ends", "[thre TO thst}", "doc_id IN (SELECT doc_id FROM post WHERE term BETWEEN 'thre' AND 'thss')")
_found("int_range", "n_chars:[500 TO 1500]", "n_chars BETWEEN 500 AND 1500", ("text", "n_chars"))


def int_range_mixed_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).match("customers", "balance:[\\-500 TO 700]").select("doc_id")


QUERIES["int_range_mixed_sign"] = int_range_mixed_sign
ORACLE["int_range_mixed_sign"] = "SELECT CAST(c_custkey AS VARCHAR) AS doc_id FROM customer WHERE floor(c_acctbal) BETWEEN -500 AND 700"


def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).match("orders", "[1996-03-01 TO 1996-05-31]").select("doc_id")


QUERIES["date_range"] = date_range
ORACLE["date_range"] = "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-05-31'"


def noop_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).match("parts", "brand:Brand#12 OR (name:widget AND size:[5 TO 9])").select("doc_id")


QUERIES["noop_field"] = noop_field
ORACLE["noop_field"] = "SELECT CAST(p_partkey AS VARCHAR) AS doc_id FROM part WHERE p_brand = 'Brand#12' OR (list_contains(string_split(p_name, ' '), 'widget') AND p_size BETWEEN 5 AND 9)"

# phrases
_found("phrase", '"thatin thatin inoran"', "doc_id IN (SELECT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN p c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 WHERE a.term = 'thatin' AND b.term = 'thatin' AND c.term = 'inoran')")
_found("phrase_two", '"from tion"', "doc_id IN (SELECT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'from' AND b.term = 'tion')")
_found("proximity", '"from tion ther"~12', "doc_id IN (SELECT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id JOIN p c ON a.doc_id = c.doc_id WHERE a.term = 'from' AND b.term = 'tion' AND c.term = 'ther' AND greatest(a.pos, b.pos, c.pos) - least(a.pos, b.pos, c.pos) < 12)")

# scores
_scored("score_term", "from", f"{_BASE}, {_score_sql(['from'])} SELECT doc_id, score FROM scored")
_scored("score_bool", "from OR tion OR que", f"{_BASE}, {_score_sql(['from', 'tion', 'que'])} SELECT doc_id, score FROM scored")
_scored("score_boost", "from^2.5 OR tion", f"{_BASE}, {_score_sql(['from', 'tion'], {'from': 2.5})} SELECT doc_id, score FROM scored")
_scored("score_and_not", "from AND tion AND NOT ther", f"{_BASE}, {_score_sql(['from', 'tion'], banned=('ther',))} SELECT doc_id, score FROM scored WHERE {_has('from')} AND {_has('tion')} AND NOT {_has('ther')}")
_scored(
    "coord_range", "from OR [thra TO thrz]",
    f"{_BASE}, {_score_sql(['from'], extra=1)}, r AS (SELECT DISTINCT doc_id FROM post WHERE term BETWEEN 'thra' AND 'thrz') SELECT doc_id, score FROM scored UNION ALL SELECT doc_id, 0.0 FROM r WHERE doc_id NOT IN (SELECT doc_id FROM scored)",
)


def _page(start: int, rows: int, presort: str, query: str = "from OR tion OR que") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir, "text").search("docs", query, start=start, rows=rows, presort=presort).select("doc_id", F.round("score", 6).alias("score"))

    return run


_EXACT = _score_sql(["from", "tion", "que"]).replace("round(", "(").replace(" * s, 6)", " * s)")
QUERIES["topk_page"] = _page(10, 10, "score")
ORACLE["topk_page"] = f"{_BASE}, {_EXACT} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 10 OFFSET 10"
QUERIES["presort_key"] = _page(5, 20, "key")
ORACLE["presort_key"] = f"{_BASE}, {_EXACT} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY doc_id LIMIT 20 OFFSET 5"


def num_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "text").match("docs", "from OR tion OR que", scored=True).agg(F.count("*").alias("num_found"), F.round(F.max("score"), 6).alias("max_score"))


QUERIES["num_found"] = num_found
ORACLE["num_found"] = f"{_BASE}, {_EXACT} SELECT count(*) AS num_found, round(max(score), 6) AS max_score FROM scored"


def page_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page by score, ordered by a field: rank is the place within the page."""
    e = engine(spark, sf_dir)
    page = e.search("docs", "from OR tion OR que", rows=25)
    full = e.fetched(page).select("doc_id", F.col("fields")["n_chars"].cast("long").alias("n_chars"))
    return full.orderBy("n_chars", "doc_id")


QUERIES["page_sort"] = page_sort
ORACLE["page_sort"] = f"{_BASE}, {_EXACT} SELECT s.doc_id, n_chars FROM (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 25) s JOIN t ON s.doc_id = t.doc_id ORDER BY n_chars, s.doc_id"

# inline filters
_ALL = ("text", "lang", "source", "n_chars")
_found("inline_filter_term", "from", f"{_has('from')} AND lang = 'en' AND source IN ('src1', 'src2')", _ALL, filter="lang:en AND (source:src1 OR source:src2)")
_found("inline_filter_range", "from OR que", f"({_has('from')} OR {_has('que')}) AND n_chars BETWEEN 200 AND 2000", _ALL, filter="n_chars:[200 TO 2000]")
_found("inline_filter_exclusive", "from", f"{_has('from')} AND n_chars > 200 AND n_chars < 2000", _ALL, filter="n_chars:{200 TO 2000}")
_found("inline_filter_not", "from OR que", f"({_has('from')} OR {_has('que')}) AND lang <> 'en'", _ALL, filter="NOT lang:en")
_found("inline_filter_glob", "from", f"{_has('from')} AND (starts_with(source, 'src1') OR (starts_with(source, 'src') AND length(source) = 4))", _ALL, filter="source:src1* OR source:src?")


# changes
def upsert_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as documents that every event replaces: the last by clock stays."""
    e = table(spark, sf_dir, "events")
    d = ix.from_columns(e.withColumn("_c", F.struct("event_id")), "users", "user_id", {"type": "event_type", "_clock": "event_id"})
    d = d.withColumn("key_clock", F.col("fields")["_clock"].cast("long"))
    return ix.last_docs(d).select("doc_id", F.col("fields")["type"].alias("event_type"), "key_clock")


QUERIES["upsert_lww"] = upsert_lww
ORACLE["upsert_lww"] = "SELECT CAST(user_id AS VARCHAR) AS doc_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS key_clock FROM events GROUP BY user_id"


def upsert_replaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source written again with another text: old terms are gone, new ones there."""
    e = engine(spark, sf_dir, "text", "source")
    fresh = e.docs.where(F.col("fields")["source"] == "src1").withColumn("fields", F.map_from_arrays(F.array(F.lit("text"), F.lit("source")), F.array(F.lit("quite another text"), F.lit("src1"))))
    return e.upsert(fresh, DOCS, ["text", "source"]).match("docs", "from OR another").select("doc_id")


QUERIES["upsert_replaces"] = upsert_replaces
ORACLE["upsert_replaces"] = f"{_BASE} SELECT doc_id FROM t WHERE source = 'src1' OR {_has('from')} OR {_has('another')}"


def delete_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "text")
    gone = spark.createDataFrame([("docs", str(i)) for i in range(0, 50)], "index string, doc_id string")
    return e.without(gone).match("docs", "from").select("doc_id")


QUERIES["delete_by_id"] = delete_by_id
ORACLE["delete_by_id"] = f"{_BASE} SELECT doc_id FROM t WHERE {_has('from')} AND CAST(doc_id AS BIGINT) >= 50"


def delete_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "text")
    return e.without(e.delete_by_query("docs", "tion OR ther")).match("docs", "from").select("doc_id")


QUERIES["delete_by_query"] = delete_by_query
ORACLE["delete_by_query"] = _ids(f"{_has('from')} AND NOT ({_has('tion')} OR {_has('ther')})")


# extraction
def json_extract_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("key"), F.lit("application/json").alias("content_type"), F.col("props").alias("value"))
    return extract.extracted(objects).select("doc_id", "name", "value")


QUERIES["json_extract_flatten"] = json_extract_flatten
ORACLE["json_extract_flatten"] = "SELECT CAST(event_id AS VARCHAR) AS doc_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL"


def xml_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as XML and read again as fields."""
    o = table(spark, sf_dir, "orders")
    xml = F.format_string('<order id="%d"><status>%s</status><when.day>%s</when.day></order>', "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd"))
    objects = o.select(F.col("o_orderkey").cast("string").alias("key"), F.lit("application/xml").alias("content_type"), xml.alias("value"))
    return extract.extracted(objects).select("doc_id", "name", "value")


QUERIES["xml_extract"] = xml_extract
ORACLE["xml_extract"] = """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'order@id' AS name, CAST(o_orderkey AS VARCHAR) AS value FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'order_status', o_orderstatus FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'order_when_day', strftime(o_orderdate, '%Y-%m-%d') FROM orders"""


def merged_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: the turns of a role are one field, in order."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("ord"), F.col("role").alias("name"), F.col("text").alias("value"))
    d = ix.from_fields(rows, "talks")
    return d.select("doc_id", F.explode("fields").alias("name", "value"))


QUERIES["merged_fields"] = merged_fields
ORACLE["merged_fields"] = "SELECT CAST(conv_id AS VARCHAR) AS doc_id, role AS name, string_agg(text, ' ' ORDER BY turn, text) AS value FROM conversations WHERE text IS NOT NULL GROUP BY conv_id, role"


# results as input of further queries
def mapreduce_count_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = engine(spark, sf_dir, *_ALL).match("docs", "from OR que", filter="n_chars:[0 TO 5000]")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "n_chars")
    return hits.join(d, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


QUERIES["mapreduce_count_by"] = mapreduce_count_by
ORACLE["mapreduce_count_by"] = f"{_BASE} SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM t WHERE ({_has('from')} OR {_has('que')}) AND n_chars BETWEEN 0 AND 5000 GROUP BY lang"


def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "text", "lang", "source").facets("docs", "from OR que", "source")


QUERIES["facet_counts"] = facet_counts
ORACLE["facet_counts"] = f"{_BASE} SELECT source AS value, count(*) AS n FROM t WHERE {_has('from')} OR {_has('que')} GROUP BY source"


def solr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A select request, its documents as rows."""
    r = solr.select(replace(engine(spark, sf_dir), most=None), {"q": "from AND lang:en", "rows": "15", "fl": "id,lang,n_chars", "sort": "n_chars desc"}, "docs")
    return spark.createDataFrame([(d["id"], d["fields"]["lang"], d["fields"]["n_chars"], r["num_found"]) for d in r["docs"]], "doc_id string, lang string, n_chars string, num_found long")


QUERIES["solr_select"] = solr_select
ORACLE["solr_select"] = f"""{_BASE}, l AS (SELECT doc_id, 'x' AS term, 1 AS tf FROM t WHERE lang = 'en'), n_docs AS (SELECT (SELECT count(*) FROM post WHERE term = 'from') + (SELECT count(*) FROM l) AS n),
k AS (SELECT power(1 + ln((n + 1.0) / ((SELECT count(*) FROM post WHERE term = 'from') + 1)), 2) AS f FROM n_docs),
hit AS (SELECT post.doc_id, sqrt(post.tf) * f AS s FROM post JOIN l USING (doc_id), k WHERE post.term = 'from')
SELECT h.doc_id, lang, CAST(n_chars AS VARCHAR) AS n_chars, (SELECT count(*) FROM hit) AS num_found FROM (SELECT * FROM hit ORDER BY s DESC, doc_id LIMIT 15) h JOIN t ON h.doc_id = t.doc_id"""


from . import registry_more  # noqa: E402, F401  (adds its queries to these)
