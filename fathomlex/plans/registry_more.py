"""Registered queries of changes, requests, extraction and the rarer forms of queries, with their SQL."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analyzers
from ..operators import index as ix
from ..operators.engine import Engine
from ..sources import extract, shared, solr
from ..streaming import ingest
from . import registry as r
from . import schema as sc

QUERIES, ORACLE = r.QUERIES, r.ORACLE
_found, _scored, _has, _ids, _BASE, _EXACT = r._found, r._scored, r._has, r._ids, r._BASE, r._EXACT


# a store that is kept up to date
EVENTS = sc.parse("events", {"default_field": "type", "analyzer": "whitespace"}, [{"name": "type"}])


def _event_store(spark: SparkSession, sf_dir: str) -> ingest.Store:
    """Users as documents that events write and errors delete, in two batches that are out of order, both applied again."""
    e = r.table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("doc_id"), F.create_map(F.lit("type"), F.col("event_type")).alias("fields"), F.col("event_id").alias("key_clock"), (F.col("event_type") == "error").alias("deleted"))
    early = F.col("fields")["type"].isin("error", "view")
    store = ingest.Store(spark, shared.new_path(spark, "store"), EVENTS, fanout=2)
    for batch_id, part in enumerate((early, ~early)):
        store.apply(rows.where(part), batch_id, "first")
    store.apply(rows.where(early), 0, "first")  # a batch that comes again
    store.apply(rows, 0, "second")  # another stream with the same events
    return store


def stream_lww_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_store(spark, sf_dir).docs().select("doc_id", F.col("fields")["type"].alias("event_type"), "key_clock")


_LAST = "last AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS key_clock FROM events GROUP BY user_id)"
QUERIES["stream_lww_delete"] = stream_lww_delete
ORACLE["stream_lww_delete"] = f"WITH {_LAST} SELECT * FROM last WHERE event_type <> 'error'"


def stream_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query over the postings of the store."""
    store = _event_store(spark, sf_dir)
    return Engine(store.postings(), {"events": EVENTS}, store.docs()).match("events", "purchase OR click").select("doc_id")


QUERIES["stream_search"] = stream_search
ORACLE["stream_search"] = f"WITH {_LAST} SELECT doc_id FROM last WHERE event_type IN ('purchase', 'click')"


def postings_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw postings of all events, of which the newest of each user and type stays."""
    e = r.table(spark, sf_dir, "events")
    p = e.select(F.lit("events").alias("index"), F.lit("type").alias("field"), F.col("event_type").alias("term"), F.col("user_id").cast("string").alias("doc_id"), F.array(F.lit(0)).alias("positions"), F.lit(None).cast("map<string,array<string>>").alias("inline"), F.col("event_id").alias("key_clock"))
    return ix.newest(p).select("doc_id", "term", "key_clock")


QUERIES["postings_newest"] = postings_newest
ORACLE["postings_newest"] = "SELECT CAST(user_id AS VARCHAR) AS doc_id, event_type AS term, max(event_id) AS key_clock FROM events GROUP BY 1, 2"


# terms by themselves
def terms_added_and_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source get a term; documents of a language lose one."""
    e = r.engine(spark, sf_dir, "text", "lang", "source")
    own = e.docs.select("index", "doc_id", F.col("fields")["lang"].alias("lang"), F.col("fields")["source"].alias("source"))
    none = F.lit(None).cast("map<string,array<string>>")
    more = own.where("source = 'src1'").select("index", F.lit("text").alias("field"), F.lit("added").alias("term"), "doc_id", F.array(F.lit(0)).alias("positions"), none.alias("inline"), F.lit(1).cast("long").alias("key_clock"))
    gone = own.where("lang = 'en'").select("index", F.lit("text").alias("field"), F.lit("from").alias("term"), "doc_id", F.lit(5).cast("long").alias("key_clock"))
    return e.changed(lambda p: ix.without_terms(ix.add_terms(p, more), gone)).match("docs", "added OR from").select("doc_id")


QUERIES["terms_added_and_deleted"] = terms_added_and_deleted
ORACLE["terms_added_and_deleted"] = _ids(f"source = 'src1' OR ({_has('from')} AND lang <> 'en')")


# requests
def solr_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents replaced and added by an update in XML; of one id the last stays, and one without fields is found no more."""
    field = '<field name="{}">{}</field>'.format
    docs = [(0, "first xanadu"), (0, "tion xanadu"), (999999999, "xanadu from"), (999999998, "of xanadu")]
    text = "<add>" + "".join(f"<doc>{field('id', i)}{field('text', t)}</doc>" for i, t in docs) + f"<doc>{field('id', 1)}</doc></add>"
    e = solr.update(replace(r.engine(spark, sf_dir, "text"), most=None), text, "docs")
    return e.match("docs", "from OR xanadu").select("doc_id")


QUERIES["solr_update"] = solr_update
ORACLE["solr_update"] = _ids(f"{_has('from')} AND doc_id NOT IN ('0', '1')") + " UNION ALL SELECT unnest(['0', '999999999', '999999998']) AS doc_id"


def solr_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents deleted by id, by index and id, and by query, all in one request; commit changes nothing."""
    e = solr.update(r.engine(spark, sf_dir, "text"), "<delete><id>3</id><id>docs:5</id><query>tion AND ther</query></delete>", "docs")
    return solr.update(e, "<commit/>", "docs").match("docs", "from").select("doc_id")


QUERIES["solr_delete"] = solr_delete
ORACLE["solr_delete"] = _ids(f"{_has('from')} AND doc_id NOT IN ('3', '5') AND NOT ({_has('tion')} AND {_has('ther')})")


def _request(wt: str) -> str:
    return {"q": "from AND lang:en", "rows": "15", "start": "3", "fl": "id,lang,n_chars", "sort": "n_chars desc", "wt": wt}


def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a response in JSON; integer fields are numbers there."""
    x = json.loads(solr.respond(replace(r.engine(spark, sf_dir), most=None), _request("json"), "docs"))["response"]
    return spark.createDataFrame([(d["id"], d["fields"]["lang"], d["fields"]["n_chars"], x["numFound"]) for d in x["docs"]], "doc_id string, lang string, n_chars long, num_found long")


def response_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a response in XML."""
    x = ET.fromstring(solr.respond(replace(r.engine(spark, sf_dir), most=None), _request("xml"), "docs")).find("result")
    rows = [{c.get("name"): c.text for c in d} for d in x]
    return spark.createDataFrame([(d["id"], d["lang"], int(d["n_chars"]), int(x.get("numFound"))) for d in rows], "doc_id string, lang string, n_chars long, num_found long")


QUERIES |= {"response_json": response_json, "response_xml": response_xml}
_SELECT = ORACLE["solr_select"].replace("LIMIT 15", "LIMIT 15 OFFSET 3").replace("CAST(n_chars AS VARCHAR)", "CAST(n_chars AS BIGINT)")
ORACLE |= {"response_json": _SELECT, "response_xml": _SELECT}


def sorted_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All results in the order of an integer field before a page is taken."""
    e = replace(r.engine(spark, sf_dir), most=None)
    x = solr.select(e, {"q": "from", "rows": "20", "start": "5", "sort": "n_chars desc, source asc", "fl": "id,n_chars"}, "docs", "global")
    return spark.createDataFrame([(int(d["fields"]["n_chars"]), x["num_found"]) for d in x["docs"]], "n_chars long, num_found long")


QUERIES["sorted_whole"] = sorted_whole
ORACLE["sorted_whole"] = f"{_BASE} SELECT CAST(n_chars AS BIGINT) AS n_chars, (SELECT count(*) FROM post WHERE term = 'from') AS num_found FROM t WHERE {_has('from')} ORDER BY n_chars DESC NULLS LAST LIMIT 20 OFFSET 5"


def max_score_of_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many match, and the score of the first row of a page."""
    f = replace(r.engine(spark, sf_dir, "text"), most=None).found("docs", "from OR tion OR que", start=7, rows=5)
    return spark.createDataFrame([(f.num_found, round(f.max_score, 6))], "num_found long, max_score double")


QUERIES["max_score_of_page"] = max_score_of_page
ORACLE["max_score_of_page"] = f"{_BASE}, {_EXACT} SELECT (SELECT count(*) FROM scored) AS num_found, round(score, 6) AS max_score FROM (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 1 OFFSET 7)"


def score_stored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from a stored table of term counts."""
    e = r.engine(spark, sf_dir, "text")
    path = shared.new_path(spark, "stats")
    ix.save_stats(e.term_stats(), path)
    return replace(e, stats=spark.read.parquet(path)).match("docs", "from OR tion OR que", scored=True).select("doc_id", F.round("score", 6).alias("score"))


QUERIES["score_stored_counts"] = score_stored_counts
ORACLE["score_stored_counts"] = ORACLE["score_bool"]


def match_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with the places of the query's terms and an inline field."""
    m = r.engine(spark, sf_dir, "text", "lang").match("docs", "from AND (tion OR ther)", props=True)
    each = m.select("doc_id", F.col("inline")["lang"][0].alias("lang"), F.explode("positions").alias("term", "at"))
    return each.select("doc_id", "lang", "term", F.size("at").alias("n"), F.array_min("at").alias("first"), F.array_max("at").alias("last"))


QUERIES["match_properties"] = match_properties
ORACLE["match_properties"] = f"""{_BASE} SELECT p.doc_id, t.lang, 'text:' || term AS term, CAST(count(*) AS INTEGER) AS n, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) AS INTEGER) AS last
FROM p JOIN t ON t.doc_id = p.doc_id WHERE term IN ('from', 'tion', 'ther') AND p.{_has('from')} AND (p.{_has('tion')} OR p.{_has('ther')}) GROUP BY p.doc_id, t.lang, term"""


# rarer forms of queries
_found("stem_is_analyzed", "THR*", "doc_id IN (SELECT doc_id FROM post WHERE starts_with(term, 'thr'))")
_found("stem_char_is_analyzed", "Thr?", "doc_id IN (SELECT doc_id FROM post WHERE starts_with(term, 'thr') AND octet_length(encode(term)) = 4)")
_found("phrase_of_one_term", '"ab from"', _has("from"))
_found("window_of_one_term", '"ab from"~4', _has("from"))
_found("required_and_optional", "+from tion", f"{_has('from')} OR {_has('tion')}")
_found("quoted_range", 'n_chars:["500" TO "1500"]', "n_chars BETWEEN 500 AND 1500", ("text", "n_chars"))
_found("range_all", "n_chars:[0 TO 9999999999]", "n_chars IS NOT NULL", ("text", "n_chars"))
_found("other_default_field", "fr OR de", "lang IN ('fr', 'de')", ("text", "lang"), df="lang")
_TWO = "doc_id IN (SELECT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'from' AND b.term = 'tion')"
_scored("score_phrase", '"from tion"', f"{_BASE}, {r._score_sql(['from', 'tion'])} SELECT doc_id, score FROM scored WHERE {_TWO}")
_scored("score_group", "(from tion) AND que", f"{_BASE}, {r._score_sql(['from', 'tion', 'que'])} SELECT doc_id, score FROM scored WHERE ({_has('from')} OR {_has('tion')}) AND {_has('que')}")

# inline filters
_found("inline_filter_list", "from OR que", f"({_has('from')} OR {_has('que')}) AND (lang = 'fr' OR source = 'src2')", r._ALL, filter="lang:fr source:src2")
_found("inline_filter_list_and", "from OR que", f"({_has('from')} OR {_has('que')}) AND lang = 'en' AND source = 'src2'", r._ALL, filter="lang:en source:src2", op="and")
_found("inline_filter_group", "from", f"{_has('from')} AND source IN ('src1', 'src3') AND lang <> 'de'", r._ALL, filter="source:(src1 src3) AND NOT lang:de")
_found("inline_filter_minus", "from", f"{_has('from')} AND lang = 'en' AND source <> 'src1'", r._ALL, filter="lang:en AND -source:src1")


def inline_filter_mixed_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.customers(spark, sf_dir).match("customers", "BUILDING OR FURNITURE", 'balance:["-500" TO 700]').select("doc_id")


QUERIES["inline_filter_mixed_sign"] = inline_filter_mixed_sign
ORACLE["inline_filter_mixed_sign"] = "SELECT CAST(c_custkey AS VARCHAR) AS doc_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') AND floor(c_acctbal) BETWEEN -500 AND 700"


# analyzers of one's own
analyzers.register("letters", lambda text, args: F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)")), lambda text, args: re.findall("[a-z]+", text.lower()))
_LETTERS = sc.parse("pages", {"default_field": "url", "analyzer": "letters"}, [{"name": "url"}])


def custom_analyzer(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ix.from_columns(r.table(spark, sf_dir, "pages"), "pages", "page_id", {"url": "url"})
    return Engine.over(d, _LETTERS, ["url"]).match("pages", "ORG AND NOT https").select("doc_id")


QUERIES["custom_analyzer"] = custom_analyzer
ORACLE["custom_analyzer"] = "SELECT CAST(page_id AS VARCHAR) AS doc_id FROM (SELECT page_id, regexp_extract_all(lower(url), '[a-z]+') AS w FROM pages) WHERE list_contains(w, 'org') AND NOT list_contains(w, 'https')"


def aliased_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations under the aliases of one field, in the order of the turns: a phrase can run across."""
    s = sc.parse("talks", {"default_field": "talk", "analyzer": "whitespace"}, [{"name": "talk", "aliases": ["user", "assistant", "system"]}])
    c = r.table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    first = F.split(F.trim(F.regexp_replace("text", r"[ \n\t\f\r\x0B]+", " ")), " ")[0]
    rows = c.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("ord"), F.col("role").alias("name"), first.alias("value"))
    p = ix.postings(ix.from_fields(rows, "talks"), s)
    return p.select("doc_id", "term", F.size("positions").alias("n"))


QUERIES["aliased_fields"] = aliased_fields
ORACLE["aliased_fields"] = r"""SELECT CAST(conv_id AS VARCHAR) AS doc_id, w AS term, CAST(count(*) AS INTEGER) AS n
FROM (SELECT conv_id, regexp_extract(text, '[^ \n\t\f\r\v]+') AS w FROM conversations WHERE text IS NOT NULL) WHERE w <> '' GROUP BY 1, 2"""


# extraction
def _objects(spark: SparkSession, sf_dir: str, kind: str, value) -> DataFrame:
    return r.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.lit(kind).alias("content_type"), F.col("o_orderstatus").alias("bucket"), value.alias("value"))


def json_extract_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested objects, arrays, booleans and names that are cleaned."""
    inner = F.struct(F.array("o_orderstatus", "o_orderpriority").alias("a.b"), F.struct((F.col("o_orderstatus") == "F").alias("done")).alias("c:d"))
    value = F.to_json(F.struct(F.col("o_orderkey").alias("id"), inner.alias("x"), F.array(F.struct(F.col("o_custkey").alias("cust"))).alias("list")))
    return extract.extracted(_objects(spark, sf_dir, "application/json; charset=utf-8", value)).select("doc_id", "name", "value")


QUERIES["json_extract_nested"] = json_extract_nested
ORACLE["json_extract_nested"] = """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, * FROM orders)
SELECT doc_id, 'id' AS name, doc_id AS value FROM o UNION ALL SELECT doc_id, 'x_a_b', o_orderstatus FROM o UNION ALL SELECT doc_id, 'x_a_b', o_orderpriority FROM o
UNION ALL SELECT doc_id, 'x_c_d_done', CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END FROM o UNION ALL SELECT doc_id, 'list_cust', CAST(o_custkey AS VARCHAR) FROM o"""


def pairs_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit('[["status", "'), "o_orderstatus", F.lit('"], ["who", [["id", '), F.col("o_custkey").cast("string"), F.lit("]]]]"))
    return extract.extracted(_objects(spark, sf_dir, "application/x-pairs", value)).select("doc_id", "name", "value")


QUERIES["pairs_extract"] = pairs_extract
ORACLE["pairs_extract"] = "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'status' AS name, o_orderstatus AS value FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'who_id', CAST(o_custkey AS VARCHAR) FROM orders"


def raw_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extracted(_objects(spark, sf_dir, "text/plain", F.col("o_orderpriority")), "body").select("doc_id", "name", "value")


QUERIES["raw_extract"] = raw_extract
ORACLE["raw_extract"] = "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'body' AS name, o_orderpriority AS value FROM orders"


def bucket_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of one bucket have an extractor of their own."""
    split = lambda text, default: list(zip(("level", "label"), text.split("-", 1)))
    return extract.extracted(_objects(spark, sf_dir, "text/plain", F.col("o_orderpriority")), own={"F": split}).select("doc_id", "name", "value")


QUERIES["bucket_extract"] = bucket_extract
ORACLE["bucket_extract"] = """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'value' AS name, o_orderpriority AS value FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'level', split_part(o_orderpriority, '-', 1) FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'label', substr(o_orderpriority, strpos(o_orderpriority, '-') + 1) FROM orders WHERE o_orderstatus = 'F'"""


def object_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of an event log, each the new state of its user: read, replaced, deleted and searched."""
    e = r.table(spark, sf_dir, "events")
    objects = e.select(F.lit("users").alias("bucket"), F.col("user_id").alias("key"), F.lit("application/json").alias("content_type"), F.to_json(F.struct(F.struct("event_type").alias("last"))).alias("value"), F.col("event_id").alias("key_clock"), (F.col("event_type") == "error").alias("deleted"))
    s = sc.default("users")
    store = ingest.Store(spark, shared.new_path(spark, "objects"), s)
    store.apply(ingest.changes(objects, s), 0)
    return Engine(store.postings(), {"users": s}, store.docs()).match("users", "last_event_type:signup OR last_event_type:view").select("doc_id")


QUERIES["object_hook"] = object_hook
ORACLE["object_hook"] = f"WITH {_LAST} SELECT doc_id FROM last WHERE event_type IN ('signup', 'view')"
