"""python -m fathomlex COMMAND ...: index, solr, delete, search, search-doc, explain, facets, set-schema and show-schema over an index folder.

An index folder holds ``schema.json`` ({"name", "settings", "fields"}), ``docs``
and ``postings``.
"""

from __future__ import annotations

import argparse
import json
import os
import shutil

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import index as ix
from .operators.engine import Engine
from .plans import schema as sc
from .sources import extract, solr


def _engine(spark: SparkSession, path: str, s: sc.Schema) -> Engine:
    return Engine(spark.read.parquet(f"{path}/postings"), {s.name: s}, spark.read.parquet(f"{path}/docs"))


def _replace(e: Engine, path: str) -> None:
    """Write what an engine holds beside the old tables, then put it in their place."""
    if e.docs is None:
        return
    e.docs.write.mode("overwrite").parquet(f"{path}/docs.new")
    ix.save(e.postings, f"{path}/postings.new")
    for name in ("docs", "postings"):
        shutil.rmtree(f"{path}/{name}", ignore_errors=True)
        os.rename(f"{path}/{name}.new", f"{path}/{name}")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="fathomlex", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "solr", "delete", "search", "search-doc", "explain", "facets", "set-schema", "show-schema"):
        c = sub.add_parser(name)
        c.add_argument("path", help="the index folder")
        if name == "index":
            c.add_argument("files", help="a directory or glob of text files; names are document ids")
        elif name == "solr":
            c.add_argument("files", nargs="+", help="files of updates in XML, or directories of them")
        elif name == "delete":
            c.add_argument("files", help="a directory or glob: documents of its files' names go")
        elif name == "set-schema":
            c.add_argument("file", help='{"name", "settings", "fields"} in JSON')
        elif name != "show-schema":
            c.add_argument("query")
            c.add_argument("--filter")
        if name in ("search", "search-doc"):
            c.add_argument("--start", type=int, default=0)
            c.add_argument("--rows", type=int, default=10)
            c.add_argument("--presort", choices=("score", "key"), default="score")
        if name == "facets":
            c.add_argument("--field", required=True)
    a = p.parse_args(argv)
    described = f"{a.path}/schema.json"
    if a.command == "set-schema":
        with open(a.file) as f:
            d = json.load(f)
        sc.parse(d["name"], d["settings"], d["fields"])
        os.makedirs(a.path, exist_ok=True)
        with open(described, "w") as f:
            json.dump(d, f)
        return
    if os.path.exists(described):
        with open(described) as f:
            d = json.load(f)
        s = sc.parse(d["name"], d["settings"], d["fields"])
    else:
        s = sc.default(os.path.basename(a.path.rstrip("/")) or "search")
    if a.command == "show-schema":
        print(s)
        return
    spark = SparkSession.builder.appName("fathomlex").getOrCreate()
    if a.command == "index":
        docs = ix.from_fields(extract.directory(spark, a.files, s.default_field), s.name)
        docs.write.mode("overwrite").parquet(f"{a.path}/docs")
        ix.save(ix.postings(spark.read.parquet(f"{a.path}/docs"), s), f"{a.path}/postings")
        return
    if a.command == "solr" and not os.path.exists(f"{a.path}/docs"):
        e = Engine(spark.createDataFrame([], ix.POSTINGS_KIND), {s.name: s})
    else:
        e = _engine(spark, a.path, s)
    if a.command == "solr":
        _replace(solr.index_files(e, a.files, s.name), a.path)
    elif a.command == "delete":
        gone = extract.directory(spark, a.files, s.default_field).select(F.lit(s.name).alias("index"), "doc_id")
        _replace(Engine(ix.without(e.postings, gone), e.schemas, ix.without(e.docs, gone)), a.path)
    elif a.command == "explain":
        for k, v in e.explain(s.name, a.query, a.filter).items():
            print(f"{k}: {v}")
    elif a.command == "facets":
        e.facets(s.name, a.query, a.field, a.filter).orderBy(F.desc("n"), "value").show(truncate=False)
    else:
        page = e.search(s.name, a.query, a.filter, a.start, a.rows, a.presort)
        (e.fetched(page) if a.command == "search-doc" else page).show(a.rows, truncate=False)


if __name__ == "__main__":
    main()
