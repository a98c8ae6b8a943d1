"""Extractors: objects and files to field rows (doc_id, ord, name, value), by content type."""

from __future__ import annotations

import json
import xml.sax
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "doc_id string, ord int, name string, value string"
Pairs = list[tuple[str, str]]


def clean(name: str) -> str:
    return name.replace(".", "_").replace(":", "_")


def raw_fields(text: str, default: str) -> Pairs:
    return [(default, text)]


def json_fields(text: str, default: str) -> Pairs:
    """Nested names joined by '_', a field for each array element, nulls dropped; values without a name go to the default field."""

    def said(v: object) -> str:
        return v if isinstance(v, str) else json.dumps(v)

    def walk(v: object, name: str) -> Iterator[tuple[str, str]]:
        if isinstance(v, dict):
            for k, x in v.items():
                yield from walk(x, f"{name}_{clean(k)}" if name else clean(k))
        elif isinstance(v, list):
            for x in v:
                yield from walk(x, name)
        elif v is not None:
            yield name or default, said(v)

    return list(walk(json.loads(text), ""))


class _Xml(xml.sax.ContentHandler):
    def __init__(self, default: str):
        super().__init__()
        self.default, self.path, self.text, self.out = default, [], [], []

    def _end_text(self) -> None:
        text = "".join(self.text)
        self.text = []
        if text.strip():
            self.out.append(("_".join(self.path) or self.default, text))

    def startElement(self, name, attrs):
        self._end_text()
        self.path.append(clean(name))
        for k in attrs.getNames():
            self.out.append((f"{'_'.join(self.path)}@{clean(k)}", attrs.getValue(k)))

    def endElement(self, name):
        self._end_text()
        self.path.pop()

    def characters(self, content):
        self.text.append(content)


def xml_fields(text: str, default: str) -> Pairs:
    """Tag paths joined by '_', attributes as path@name; text between tags is a value of the path."""
    h = _Xml(default)
    xml.sax.parseString(text.encode(), h)
    return h.out


def term_fields(text: str, default: str) -> Pairs:
    """Property lists of nested (name, value) pairs, written as JSON arrays of pairs."""

    def walk(v: object, name: str) -> Iterator[tuple[str, str]]:
        if isinstance(v, list) and v and all(isinstance(x, list) and len(x) == 2 and isinstance(x[0], str) for x in v):
            for k, x in v:
                yield from walk(x, f"{name}_{clean(k)}" if name else clean(k))
        elif isinstance(v, list):
            for x in v:
                yield from walk(x, name)
        elif v is not None:
            yield name or default, v if isinstance(v, str) else json.dumps(v)

    return list(walk(json.loads(text), ""))


#: By content type; all others are raw. A bucket can have one of its own.
EXTRACTORS: dict[str, Callable[[str, str], Pairs]] = {
    **dict.fromkeys(("application/json", "application/x-javascript", "text/javascript", "text/x-javascript", "text/x-json"), json_fields),
    **dict.fromkeys(("application/xml", "text/xml"), xml_fields),
    "application/x-pairs": term_fields,
}


Own = Callable[[str, str], Pairs]


def extracted(objects: DataFrame, default: str = "value", own: Own | Mapping[str, Own] | None = None, errors: bool = False) -> DataFrame:
    """Field rows of objects (key, content_type, value, and bucket if extractors go by it).

    ``own`` takes the place of the content type's extractor: for all objects, or
    for those of the buckets that it names.  A value that can't be read fails
    the job with the key in its message, or with ``errors`` becomes a row of
    null name whose value is the message; rows without key or value have no
    fields.  Raw objects never leave the JVM.
    """
    by_bucket = dict(own) if isinstance(own, Mapping) else {}
    every = None if isinstance(own, Mapping) else own
    kind = F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1))
    bucket = F.coalesce(F.col("bucket").cast("string"), F.lit("")) if by_bucket else F.lit("")
    d = objects.where("key IS NOT NULL AND value IS NOT NULL").select(F.col("key").cast("string").alias("key"), kind.alias("kind"), bucket.alias("bucket"), F.col("value").cast("binary").alias("value"))
    plain = F.lit(False) if every else ~F.col("kind").isin(list(EXTRACTORS)) & ~F.col("bucket").isin(list(by_bucket) or [" "])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for key, type_, of, value in zip(p["key"], p["kind"], p["bucket"], p["value"]):
                f = every or by_bucket.get(of) or EXTRACTORS.get(type_, raw_fields)
                try:
                    pairs = f(bytes(value).decode("utf-8", "replace"), default)
                except Exception as e:
                    if not errors:
                        raise ValueError(f"object {key!r} of type {type_!r} can't be read: {e}") from e
                    pairs = [(None, f"{type(e).__name__}: {e}")]
                out += [(key, i, n, v) for i, (n, v) in enumerate(pairs)]
            yield pd.DataFrame(out, columns=["doc_id", "ord", "name", "value"])

    raw = d.where(plain).select(F.col("key").alias("doc_id"), F.lit(0).alias("ord"), F.lit(default).alias("name"), F.make_valid_utf8(F.col("value").cast("string")).alias("value"))
    return raw.unionByName(d.where(~plain).mapInPandas(run, FIELDS))


def directory(spark: SparkSession, path: str, default: str = "value") -> DataFrame:
    """Field rows of all files below a path (or of a glob): doc_id is the file's name, its whole text the default field."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("doc_id"), F.lit(0).alias("ord"), F.lit(default).alias("name"), "value")


class _Add(xml.sax.ContentHandler):
    def __init__(self):
        super().__init__()
        self.kind, self.docs, self.doc, self.name, self.text, self.deletes = "", [], None, None, [], []

    def startElement(self, name, attrs):
        self.text = []
        self.kind = self.kind or name
        if name == "doc":
            self.doc = []
        elif name == "field":
            self.name = attrs.get("name")

    def characters(self, content):
        self.text.append(content)

    def endElement(self, name):
        text = "".join(self.text)
        if name == "field":
            self.doc.append((self.name, text))
        elif name == "doc":
            self.docs.append(self.doc)
        elif name in ("id", "query") and self.kind == "delete":
            self.deletes.append((name, text))


def update_command(text: str) -> tuple[str, list]:
    """An update in XML: ('add', documents as lists of (name, value)), ('delete', (kind, text) pairs), ('commit', []) or ('optimize', [])."""
    h = _Add()
    xml.sax.parseString(text.encode(), h)
    return h.kind, h.deletes if h.kind == "delete" else h.docs
