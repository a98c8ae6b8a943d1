"""Select and update requests of the XML search protocol, as functions of plain parameters."""

from __future__ import annotations

import glob
import json
import os
import re
import time
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SearchError
from ..operators.engine import MOST_RESULTS, Engine
from ..plans.schema import Schema
from . import extract


def projection(fl: str | None) -> list[str] | None:
    """Field names split at commas and spaces; None for all."""
    return None if not fl or fl.strip() == "*" else [x for x in re.split("[, ]+", fl) if x]


def sort_keys(sort: str) -> list[tuple[str, bool]]:
    """(field, whether it falls) of 'f asc, g desc'."""
    out = []
    for part in filter(None, (p.strip() for p in sort.split(","))):
        name, _, way = part.partition(" ")
        out.append((name, way.strip().lower() == "desc"))
    return out


def sorted_page(rows: DataFrame, schema: Schema, sort: str) -> DataFrame:
    """Rows with a fields map in the order of ``sort``: integer fields by value, others bytewise, missing values first when rising."""
    order = []
    for name, falls in sort_keys(sort):
        c = F.col("fields")[name]
        c = c.cast("decimal(38,0)") if schema.find(name).type == "integer" else c
        order.append(c.desc_nulls_last() if falls else c.asc_nulls_first())
    return rows.orderBy(*order, "rank") if order else rows.orderBy("rank")


def select(engine: Engine, params: dict[str, str], index: str = "search", sort_scope: str = "page") -> dict:
    """A select request as a dict: q, filter, df, q.op, start, rows, sort, presort, fl, wt, index; see ``as_json`` and ``as_xml``.

    The sort orders the page, or with sort_scope 'global' all results before
    they are paged.
    """
    index = params.get("index", index)
    q = params.get("q")
    if not q:
        raise SearchError("missing_query")
    fields = projection(params.get("fl"))
    sort = params.get("sort", "none")
    schema = engine.schema(index)
    if fields == [schema.unique_key] and sort != "none":
        raise SearchError("fl_id_with_sort")
    start, rows = int(params.get("start", 0)), params.get("rows", "10")
    options = {"df": params.get("df"), "op": params.get("q.op")}
    limit = None if rows == "infinity" else int(rows)
    by_page = sort == "none" or sort_scope == "page"
    if not by_page:
        return _sorted_whole(engine, params, index, sort, start, limit, fields, options)
    found = engine.found(index, q, params.get("filter"), start, limit, params.get("presort", "score"), **options)
    spark = engine.postings.sparkSession
    page = spark.createDataFrame([(i, *r) for i, r in enumerate(found.rows)], "rank int, index string, doc_id string, score double")
    if fields == [schema.unique_key]:
        docs = [{"id": r["doc_id"], "fields": {}} for r in found.rows]
        return _response(params, found.num_found, start, 0.0, docs, schema)
    full = engine.fetched(_small(page, found.rows))
    full = sorted_page(full, schema, sort) if sort != "none" else full.orderBy("rank")
    docs = [{"id": r["doc_id"], "fields": {k: v for k, v in sorted(r["fields"].items()) if fields is None or k in fields}} for r in full.collect()]
    return _response(params, found.num_found, start, found.max_score, docs, schema)


def _sorted_whole(engine: Engine, params: dict, index: str, sort: str, start: int, limit: int | None, fields: list[str] | None, options: dict) -> dict:
    """The same with all results in the order of the sort, equal ones by score, before a page is taken. All matches move with their sort keys, and the page's documents alone with their fields."""
    schema = engine.schema(index)
    keys, cells = sort_keys(sort), []
    for i, (name, _) in enumerate(keys):
        c = F.col("fields")[name]
        cells.append((c.cast("decimal(38,0)") if schema.find(name).type == "integer" else c).alias(f"_s{i}"))
    all_ = engine.match(index, params["q"], params.get("filter"), True, **options).join(engine.docs.select("index", "doc_id", *cells), ["index", "doc_id"])

    def page(m: DataFrame) -> DataFrame:
        order = [F.desc_nulls_last(f"_s{i}") if falls else F.asc_nulls_first(f"_s{i}") for i, (_, falls) in enumerate(keys)]
        m = m.orderBy(*order, F.desc("score"), "doc_id").offset(start)
        return (m if limit is None else m.limit(limit)).select("index", "doc_id", "score")

    got, n = engine.counted(all_, page)
    ranked = engine.postings.sparkSession.createDataFrame([(i, r["index"], r["doc_id"]) for i, r in enumerate(got)], "rank int, index string, doc_id string")
    full = engine.fetched(_small(ranked, got)).orderBy("rank").collect() if got else []
    docs = [{"id": r["doc_id"], "fields": {k: v for k, v in sorted(r["fields"].items()) if fields is None or k in fields}} for r in full]
    return _response(params, n, start, max((r["score"] for r in got), default=0.0), docs, schema)


def _small(page: DataFrame, rows: list) -> DataFrame:
    """A page that was made of rows here: unless it is very long, documents are joined where they lie."""
    return F.broadcast(page) if len(rows) <= MOST_RESULTS else page


def respond(engine: Engine, params: dict[str, str], index: str = "search", sort_scope: str = "page") -> str:
    """The response to a select request as text, in XML or, with wt=json, JSON; QTime counts milliseconds."""
    began = time.monotonic()
    r = select(engine, params, index, sort_scope)
    r["qtime"] = round(1000 * (time.monotonic() - began))
    return as_json(r) if params.get("wt") == "json" else as_xml(r)


def _response(params: dict, n: int, start: int, top: float, docs: list[dict], schema: Schema) -> dict:
    return {"params": params, "num_found": n, "start": start, "max_score": f"{top:.6f}" if top else "0.0", "docs": docs, "types": {k: schema.find(k).type for d in docs for k in d["fields"]}, "key": schema.unique_key}


def as_json(r: dict) -> str:
    docs = [{"id": d["id"], "fields": {k: int(v) if r["types"][k] == "integer" and re.fullmatch(r"[+-]?\d+", v.strip()) else v for k, v in d["fields"].items()}} for d in r["docs"]]
    return json.dumps({"responseHeader": {"status": 0, "QTime": r.get("qtime", 0), "params": r["params"]}, "response": {"numFound": r["num_found"], "start": r["start"], "maxScore": r["max_score"], "docs": docs}})


def as_xml(r: dict) -> str:
    tag = {"integer": "int", "date": "date"}
    asked = "".join(f"<str name={quoteattr(k)}>{escape(v)}</str>" for k, v in sorted(r["params"].items()))
    header = f'<lst name="responseHeader"><int name="status">0</int><int name="QTime">{r.get("qtime", 0)}</int><lst name="params">{asked}</lst></lst>'
    out = ['<?xml version="1.0" encoding="UTF-8"?>', f'<response>{header}<result name="response" numFound="{r["num_found"]}" start="{r["start"]}" maxScore="{r["max_score"]}">']
    for d in r["docs"]:
        cells = "".join("<{0} name={1}>{2}</{0}>".format(tag.get(r["types"][k], "str"), quoteattr(k), escape(v)) for k, v in d["fields"].items())
        out.append(f'<doc><str name={quoteattr(r["key"])}>{escape(d["id"])}</str>{cells}</doc>')
    return "\n".join([*out, "</result></response>"])


def update(engine: Engine, text: str, index: str = "search") -> Engine:
    """The engine after an update in XML: add replaces documents of the same key, delete takes ids, 'index:id' or queries, commit and optimize change nothing.

    Each document of an add stands for itself: of one id the last is stored, and
    one that has nothing but its id is stored without postings.  Plans grow with
    each update: ``streaming.ingest.Store`` is for many of them.
    """
    kind, body = extract.update_command(text)
    schema = engine.schema(index)
    spark = engine.postings.sparkSession
    if kind in ("commit", "optimize"):
        return engine
    if kind == "add":
        last: dict[str, dict[str, str]] = {}
        for doc in body:
            ids = [v for n, v in doc if n == schema.unique_key]
            if not ids:
                raise SearchError("required_field_not_found", schema.unique_key)
            fields: dict[str, str] = {}
            for n, v in doc:
                if n != schema.unique_key:
                    fields[n] = f"{fields[n]} {v}" if n in fields else v
            last[ids[0]] = fields  # of one id the last document stays
        docs = spark.createDataFrame([(index, i, f) for i, f in last.items()], "index string, doc_id string, fields map<string,string>")
        return engine.upsert(docs, schema, sorted({n for f in last.values() for n in f}))
    if kind != "delete":
        raise SearchError("unknown_command", kind)
    keys = None
    for what, value in body:
        if what == "id" and not value:
            raise SearchError("empty_id_on_solr_delete")
        if what == "id":
            own, colon, rest = value.partition(":")
            k = spark.createDataFrame([(own, rest) if colon else (index, value)], "index string, doc_id string")
        else:
            k = engine.delete_by_query(index, value)
        keys = k if keys is None else keys.unionByName(k)
    if keys is None:
        return engine
    return engine.without(keys)


def index_files(engine: Engine, paths: list[str], index: str = "search") -> Engine:
    """The engine after the updates that some XML files hold, in order; a directory stands for its files by name."""
    for p in paths:
        for f in sorted(x for x in glob.glob(f"{p}/*") if os.path.isfile(x)) if os.path.isdir(p) else [p]:
            with open(f, encoding="utf-8") as text:
                engine = update(engine, text.read(), index)
    return engine
