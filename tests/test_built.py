"""Engines over docs whose postings aren't stored: the same results as over stored ones, of one reading of the texts."""

import pytest
from pyspark.sql import functions as F

from fathomlex.functions import analyzers
from fathomlex.operators import index as ix
from fathomlex.operators.engine import Engine
from fathomlex.plans import registry
from fathomlex.plans import schema as sc

SF = "/root/testdata/sf0.001"
SCHEMA = sc.parse(
    "b", {"default_field": "text", "analyzer": "whitespace"},
    [{"name": "text", "analyzer": "standard", "aliases": ["title"]}, {"name": "lang", "inline": True}, {"name": "only", "inline": "only"}, {"name": "n", "type": "integer", "inline": True}, {"name": "none", "skip": True}],
)
ROWS = [
    ("1", {"text": "from tion from que", "lang": "en", "n": "5"}),
    ("2", {"text": "FROM, the tion. this que", "lang": "fr", "n": "-7", "only": "x"}),
    ("3", {"text": "a.b .from from.tion thread thrust three three", "lang": "en", "n": "70", "title": "que que"}),
    ("4", {"text": "", "lang": "en"}),
    ("5", {}),
    ("6", {"lang": "de", "only": "x", "none": "from"}),
    ("7", {"text": "tion ther from tion ther ther", "n": "5 70"}),
    ("8", {"text": "Straße İfrom K\u212aelvin fromé from", "lang": "fr en"}),
    ("9", {"text": "of to tion " * 50, "lang": "en", "n": "5"}),
]
QUERIES = [
    ("from", None), ("from OR tion OR que", None), ("(from tion) AND que", None), ("from AND tion AND NOT ther", "lang:en"), ("from^2.5 OR from OR nowhere", None),
    ("from OR [thra TO thrz]", None), ("thr* OR que", 'n:["-10" TO 10]'), ('"tion ther"', None), ('"from tion"~5 OR que', "NOT lang:fr"), ('"ther ther" AND from', None),
    ("lang:en AND n:5", "only:x OR lang:en"), ("n:[\\-9 TO 6] OR tion", None), ("title:que", None), ("nowhere", None), ("que OR NOT from", "lang:(en fr)"),
]


@pytest.fixture(scope="module")
def both(spark):
    docs = spark.createDataFrame([("b", k, f) for k, f in ROWS], "index string, doc_id string, fields map<string,string>")
    p = ix.postings(docs, SCHEMA)
    return Engine.over(docs, SCHEMA), Engine(spark.createDataFrame(p.collect(), p.schema), {"b": SCHEMA}, docs)


def found(e, query, filter_, scored):
    return {r["doc_id"]: r["score"] for r in e.match("b", query, filter_, scored=scored).collect()}


@pytest.mark.parametrize("query,filter_", QUERIES)
def test_built_as_stored(both, query, filter_):
    for scored in (False, True):
        got, want = (found(e, query, filter_, scored) for e in both)
        assert got == (pytest.approx(want, rel=1e-12) if scored else want)


def test_weights_of_postings_that_stand_twice(spark, both):
    """Counts are of postings, whatever documents they are of."""
    twice = both[1].postings.unionByName(both[1].postings.where("doc_id < '4'"))
    e = Engine(twice, {"b": SCHEMA}, some=lambda leaves: twice)
    assert found(e, "from OR tion", "lang:en", True) == pytest.approx(found(Engine(twice, {"b": SCHEMA}), "from OR tion", "lang:en", True), rel=1e-12)


def plans_of(monkeypatch, spark, name):
    """The plans that a query runs until its rows are there, as they ran, and how many analyze texts."""
    seen, collect = [], type(spark.range(1)).collect

    def noted(df):
        rows = collect(df)
        seen.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return rows

    monkeypatch.setattr(type(spark.range(1)), "collect", noted)
    registry.QUERIES[name](spark, SF).collect()
    return seen, sum("regexp_extract_all" in line and "Generate explode(array(struct(field" in line for plan in seen for line in plan.splitlines())


#: How often a query analyzes the texts.
PASSES = {
    "score_group": 1,
    "score_bool": 1,
    "num_found": 1,
    "solr_delete": 2,
    "inline_filter_minus": 1,
    "inline_filter_glob": 1,
    "solr_select": 1,
    "sorted_whole": 1,
    "presort_key": 1,
    "score_phrase": 1,
    "response_xml": 1,
    "delete_by_query": 2,
    "score_and_not": 1,
    "topk_page": 1,
    "page_sort": 1,
    "score_term": 1,
    "response_json": 1,
    "group_default_or": 1,
    "coord_range": 1,
}


@pytest.mark.parametrize("name", PASSES)
def test_passes(monkeypatch, spark, name):
    """Each pass reads all texts where they are; none of them moves with its terms."""
    plans, passes = plans_of(monkeypatch, spark, name)
    assert passes == PASSES[name] and not any("REPARTITION" in p for p in plans)


def test_long_runs(spark):
    """A run of letters as long as a file is one token."""
    texts = ["a" * 200_000, "a.b" * 60_000, "..ab a. .a 1.2.3 x..y.z", "é.a-bcd...efg"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(analyzers.tokens(F.col("t"), "standard").alias("w"))
    assert [r["w"] for r in df.collect()] == [analyzers.get("standard").python(t, ()) for t in texts] == [[texts[0]], [texts[1]], [".ab", "1.2.3", ".y.z"], ["bcd", ".efg"]]


def test_counts_without_postings(both):
    """the same counts as of postings, without building them."""
    got, want = ({(r["index"], r["field"], r["term"], r["df"]) for r in x.collect()} for x in (both[0].term_stats(), ix.term_stats(both[1].postings)))
    plan = both[0].term_stats()._jdf.queryExecution().optimizedPlan().toString()
    assert got == want and got and "sort_array" not in plan and "RepartitionByExpression" not in plan
