import json
import random

import pytest
from pyspark.sql import functions as F

from fathomlex.errors import SearchError
from fathomlex.functions.analyzers import ANALYZERS, tokens
from fathomlex.operators import index as ix
from fathomlex.operators.engine import MOST_RESULTS, Engine
from fathomlex.plans import registry
from fathomlex.plans import schema as sc
from fathomlex.sources import extract, solr
from fathomlex.streaming import ingest
from fathomlex.streaming.ingest import Store

COLORS = "red orange yellow green blue indigo violet".split()


def sample100():
    code = lambda i: "A" + chr(65 + i // 10) + chr(65 + i % 10)
    for i in range(100):
        yield ("id" + code(i), {"key": "key" + code(i), "acc": " ".join(code(j) for j in range(i + 1)), "color": COLORS[i % 7], "parity": "odd" if i % 2 == 0 else "even"})


def build(spark, schema, rows, names=None):
    docs = spark.createDataFrame([(schema.name, k, f) for k, f in rows], "index string, doc_id string, fields map<string,string>")
    p = ix.postings(docs, schema, names)
    return Engine(spark.createDataFrame(p.collect(), p.schema), {schema.name: schema}, docs)


@pytest.fixture(scope="module")
def hundred(spark):
    return build(spark, sc.parse("test", {"default_field": "acc", "analyzer": "standard"}, [{"name": n} for n in ("key", "acc", "color", "parity")]), sample100())


@pytest.mark.parametrize(
    "query,n",
    [
        ("acc:ABC", 88), ("acc:abc", 88), ("color:red", 15), ("parity:even", 50), ("color:(red blue)", 29), ("acc:AFA AND color:red", 7), ("acc:AFA AND color:red AND parity:even", 3), ("color:red OR parity:odd", 57),
        ("color:red OR parity:odd OR key:keyAAB", 58), ("+acc:AAB AND -acc:AAC", 1), ("+acc:AAB AND -acc:AEB", 40), ("(color:red OR color:blue) AND (acc:AJA)", 3), ("(color:red AND parity:even) OR (color:blue AND parity:odd)", 14),
        ("(color:red AND (parity:even OR key:keyABE)) OR ((color:blue OR key:keyABC) AND parity:odd)", 16), ("acc:AEB NOT parity:even NOT color:red", 24), ("acc:(AAB AND (NOT ABA))", 9), ("color:[aaa TO ccc]", 14), ("color:{blue TO yellow}", 72),
        ("key:[keyAAA TO keyAAJ]", 10), ("key:{keyAAA TO keyAAJ}", 8), ("key:[keyAAA TO keyAAJ}", 9), ("key:{keyAAA TO keyAAJ]", 9), ("key:keyAA*", 10), ("key:keyAAA*", 1), ("key:keyAA?", 10), ('acc:"ABA ABB ABC"', 88), ('acc:"ABA ABC"', 0),
        ('acc:"ABA ABC"~3', 88), ('acc:"ABA ACA ADA"~20', 0), ('acc:"ABA ACA ADA"~21', 70), ("AAC AND AAJ", 91), ("AAC AAJ", 98),
    ],
)
def test_counts(hundred, query, n):
    assert hundred.count("test", query) == n


def test_default_op_and_errors(hundred):
    assert hundred.count("test", "color:red parity:even", op="and") == 7
    assert hundred.count("test", "red", df="color") == 15
    for query, code in (("-color:red", None), ("color:(-red)", "single_negated_term"), ("the", "stopword_not_allowed_in_query"), ('"red the blue"', "stopword_not_allowed_in_proximity"), ("[the TO zzz]", "stopword_not_allowed_in_range"), ("[ab TO zzz]", "too_many_terms"), ("nofield:x", "missing_field"), ("-red -blue", "single_negated_term")):
        with pytest.raises(SearchError) as e:
            hundred.plan("test", query)
        assert code is None or e.value.code == code


def test_page_and_found(hundred):
    f = hundred.found("test", "acc:AAA OR acc:AJJ", rows=3)
    assert f.num_found == 100 and f.rows[0]["doc_id"] == "idAJJ" and f.max_score == f.rows[0]["score"] > f.rows[1]["score"]
    assert [r["doc_id"] for r in hundred.search("test", "parity:even", presort="key", start=2, rows=2).collect()] == ["idAAF", "idAAH"]
    for q, n, options in (("nothere", 0, {}), ("ab", 0, {}), ("AAA", 100, {"start": 500}), ("AAA", 100, {"rows": 0})):
        f = hundred.found("test", q, **options)
        assert (f.rows, f.num_found, f.max_score) == ([], n, 0.0)
    with pytest.raises(SearchError):
        Engine(hundred.postings, hundred.schemas, most=10).found("test", "acc:AAA")
    assert {r["value"]: r["n"] for r in build(hundred.postings.sparkSession, sc.parse("f", {"default_field": "c", "analyzer": "whitespace"}, [{"name": "c", "inline": True}]), [("1", {"c": "x y"}), ("2", {"c": "x"})]).facets("f", "x", "c").collect()} == {"x": 2, "y": 1}


def test_random_trees_against_sets(hundred):
    """Random boolean queries against the same on Python sets."""
    docs = dict(sample100())
    rnd = random.Random(7)
    atoms = [f"color:{c}" for c in COLORS] + ["parity:even", "parity:odd"]
    holds = {a: {k for k, f in docs.items() if f[a.split(":")[0]] == a.split(":")[1]} for a in atoms}

    def tree(depth):
        if depth == 0 or rnd.random() < 0.2:
            a = rnd.choice(atoms)
            return a, holds[a]
        op = rnd.choice(["AND", "OR"])
        (q1, s1), (q2, s2) = tree(depth - 1), tree(depth - 1)
        if op == "AND" and rnd.random() < 0.3:
            return f"({q1} AND NOT {q2})", s1 - s2
        return f"({q1} {op} {q2})", (s1 & s2 if op == "AND" else s1 | s2)

    for _ in range(12):
        q, want = tree(3)
        assert {r["doc_id"] for r in hundred.match("test", q).collect()} == want, q


TEXTS = ["", "The quick brown fox", "a.b .hidden x1.2 über naïve", "-1 0 +10 -0 00 1-2 12345678901 --5", "  \t two\nlines\x0bhere\r", "it's Not THE there", "7 -007", "漢字 abc"]


@pytest.mark.parametrize("name,args", [("standard", ()), ("standard", ("1",)), ("whitespace", ()), ("noop", ()), ("integer", ("4",)), ("integer", ("10",)), ("integer", ())])
def test_analyzer_twins_agree(spark, name, args):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", tokens(F.col("t"), name, args).alias("x"))
    got = {r["i"]: r["x"] for r in df.collect()}
    assert got == {i: ANALYZERS[name].python(t, args) for i, t in enumerate(TEXTS)}


def test_positions(spark):
    e = build(spark, sc.parse("p", {"default_field": "v", "analyzer": "standard"}, [{"name": "v"}]), [("1", {"v": "ab the fox and fox"}), ("2", {})])
    got = {(r["term"], tuple(r["positions"])) for r in e.postings.collect()}
    assert got == {("fox", (1, 3))}  # 'ab' takes no place, stopwords do


def test_schema_rules():
    s = sc.default("x")
    assert s.find("size_num").type == "integer" and s.find("when_dt").type == "date" and s.analysis("body_txt") == ("standard", ()) and s.analysis("other") == ("whitespace", ())
    s = sc.parse("x", {"default_field": "a", "analyzer": "whitespace"}, [{"name": "a", "aliases": ["b", "c*"]}, {"name": "o_1", "type": "integer"}, {"name": "o_*"}])
    assert s.canonical("cxy") == "a" and s.find("o_1").type == "integer" and s.find("o_2").type == "string"
    for settings, fields, code in (
        ({}, [], "malformed_schema"), ({"default_field": "a", "default_op": "xor"}, [], "malformed_schema"), ({"default_field": "a"}, [{"name": "a", "type": "float"}], "malformed_schema"),
        ({"default_field": "a"}, [{"name": "a*", "aliases": ["b"]}], "bad_alias_wildcard"), ({"default_field": "a"}, [{"name": "a", "padding_char": "ab"}], "bad_padding_char"),
        ({"default_field": "a"}, [{"name": "a", "type": "integer", "padding_char": "x"}], "integer_fields_only_pads_with_zeros"), ({"default_field": "a"}, [{"name": "a", "analyzer_args": [1]}], "analyzer_args_must_be_strings"),
    ):
        with pytest.raises(SearchError) as e:
            sc.parse("x", settings, fields)
        assert e.value.code == code
    with pytest.raises(SearchError) as e:
        sc.parse("x", {"default_field": "a"}, [{"name": "a"}]).analysis("a")
    assert e.value.code == "schema_setting_required"


def test_skip_alias_inline_and_filters(spark):
    s = sc.parse("t", {"default_field": "a", "analyzer": "whitespace"}, [{"name": "a", "aliases": ["b"]}, {"name": "gone", "skip": True}, {"name": "only", "inline": "only"}, {"name": "n", "type": "integer", "padding_size": 4, "inline": True}])
    e = build(spark, s, [("1", {"a": "x", "b": "y", "gone": "x", "only": "pa qa", "n": "-50"}), ("2", {"a": "x", "n": "7"}), ("3", {"a": "x"})])
    ids = lambda q, f=None, **o: sorted(r["doc_id"] for r in e.match("t", q, f, **o).collect())
    assert ids("y") == ids("b:y") == ["1"] and ids("only:pa") == []
    assert ids("x", "only:pa") == ["1"] and ids("x", "NOT only:pa") == ["2", "3"] and ids("x", 'n:["-60" TO 5]') == ["1"] and ids("x", 'n:["-60" TO 7}') == ["1"] and ids("x", "n:[0 TO 7]") == ["2"] and ids("x", "only:qa*") == ["1"] and ids("x", "only:qa n:7") == ["1", "2"]
    assert ids("x", "only:pa n:7", op="and") == []
    assert sorted(r["doc_id"] for r in Engine(e.postings, e.schemas, compat=True).match("t", "x", "(only:pa n:7)").collect()) == []
    assert ids('n:["-60" TO 10]') == ["1", "2"]
    for f, code in (('"x y"', "phrase_not_allowed_in_filter"), ('"x y"~3', "proximity_not_allowed_in_filter")):
        with pytest.raises(SearchError) as err:
            e.match("t", "x", f)
        assert err.value.code == code


def test_exclusive_ranges(spark):
    e = build(spark, sc.parse("t", {"default_field": "a", "analyzer": "whitespace"}, [{"name": "a"}]), [("1", {"a": "aa"}), ("2", {"a": "b"}), ("3", {"a": "c"}), ("4", {"a": "a"})])
    ids = lambda e: sorted(r["doc_id"] for r in e.match("t", "{a TO c}").collect())
    assert ids(e) == ["2"] and ids(Engine(e.postings, e.schemas, strict=True)) == ["1", "2"]


def test_extractors(spark):
    assert extract.json_fields('{"a": {"b.c": [1, "x", null]}, "d": true}', "value") == [("a_b_c", "1"), ("a_b_c", "x"), ("d", "true")]
    assert extract.json_fields('["x", 2]', "value") == [("value", "x"), ("value", "2")]
    assert extract.xml_fields('<a k="1">t<b:c>u</b:c>v</a>', "value") == [("a@k", "1"), ("a", "t"), ("a_b_c", "u"), ("a", "v")]
    assert extract.term_fields('[["a", [["b", 1]]], ["c", "x"]]', "value") == [("a_b", "1"), ("c", "x")]
    rows = [("1", "application/json", b'{"x": 1}'), ("2", "text/plain", b"raw"), ("3", None, b"raw"), (None, "text/plain", b"x"), ("4", "text/xml", b"<q>z</q>")]
    got = extract.extracted(spark.createDataFrame(rows, "key string, content_type string, value binary")).collect()
    assert sorted((r["doc_id"], r["name"], r["value"]) for r in got) == [("1", "x", "1"), ("2", "value", "raw"), ("3", "value", "raw"), ("4", "q", "z")]


def test_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "sub" / "b.txt").write_text("three")
    assert sorted((r["doc_id"], r["value"]) for r in extract.directory(spark, str(tmp_path)).collect()) == [("a.txt", "one\ntwo"), ("b.txt", "three")]


def test_solr_round(spark):
    s = sc.parse("b", {"default_field": "t", "analyzer": "standard"}, [{"name": "id"}, {"name": "t"}, {"name": "n", "type": "integer"}])
    e = Engine(spark.createDataFrame([], "index string, field string, term string, doc_id string, positions array<int>, inline map<string,array<string>>, key_clock bigint"), {"b": s})
    e = solr.update(e, '<add><doc><field name="id">1</field><field name="t">quick fox</field><field name="n">+10</field></doc><doc><field name="id">2</field><field name="t">lazy</field><field name="t">fox</field><field name="n">9</field></doc></add>', "b")
    r = solr.select(e, {"q": "fox", "sort": "n asc"}, "b")
    assert [d["id"] for d in r["docs"]] == ["2", "1"] and r["num_found"] == 2 and r["docs"][0]["fields"]["t"] == "lazy fox"
    assert '"n": 9' in solr.as_json(r) and '<int name="n">9</int>' in solr.as_xml(r)
    assert [d["id"] for d in solr.select(e, {"q": "fox", "sort": "n desc", "rows": "1"}, "b", "global")["docs"]] == ["1"]
    assert solr.select(e, {"q": "fox", "fl": "id"}, "b")["max_score"] == "0.0"
    for params, code in (({}, "missing_query"), ({"q": "fox", "fl": "id", "sort": "n asc"}, "fl_id_with_sort")):
        with pytest.raises(SearchError) as err:
            solr.select(e, params, "b")
        assert err.value.code == code
    e2 = solr.update(e, '<add><doc><field name="id">1</field><field name="t">other</field></doc></add>', "b")
    assert e2.count("b", "quick") == 0 and e2.count("b", "other") == 1
    assert solr.update(e, "<delete><id>b:1</id></delete>", "b").count("b", "fox") == 1
    assert solr.update(e, "<delete><query>lazy</query><id>1</id></delete>", "b").count("b", "fox") == 0
    assert solr.update(e, "<commit/>", "b") is e
    with pytest.raises(SearchError):
        solr.update(e, "<add><doc><field name='t'>x</field></doc></add>", "b")


def test_registered_select_has_no_cap(spark, monkeypatch):
    monkeypatch.setattr(Engine.__init__, "__defaults__", tuple(1 if x == MOST_RESULTS else x for x in Engine.__init__.__defaults__))
    sf = "/root/testdata/sf0.001"
    with pytest.raises(SearchError, match="too_many_results"):
        registry.engine(spark, sf).found("docs", "from AND lang:en")
    rows = registry.QUERIES["solr_select"](spark, sf).collect()
    assert len(rows) == 15 and rows[0]["num_found"] > 15


def test_last_write_wins(spark):
    rows = [("i", "f", "t", "d", [1], None, 1), ("i", "f", "t", "d", [2], None, 2)]
    p = spark.createDataFrame(rows, "index string, field string, term string, doc_id string, positions array<int>, inline map<string,array<string>>, key_clock bigint")
    assert [r["positions"] for r in ix.newest(p).collect()] == [[2]]


def test_streaming_upserts(spark, tmp_path):
    s = sc.parse("s", {"default_field": "v", "analyzer": "whitespace"}, [{"name": "v"}])
    kind = "doc_id string, fields map<string,string>, key_clock bigint, deleted boolean"
    src = tmp_path / "in"
    store = Store(spark, str(tmp_path / "store"), s)
    for rows in ([("1", {"v": "a"}, 1, False), ("2", {"v": "a b"}, 1, False)], [("1", {"v": "c"}, 2, False), ("2", None, 3, True)]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(src))
        store.follow(spark.readStream.schema(kind).parquet(str(src)), str(tmp_path / "ckpt")).awaitTermination()
    e = Engine(store.postings(), {"s": s})
    assert [r["doc_id"] for r in e.match("s", "c").collect()] == ["1"] and e.count("s", "a") == 0 and store.version() == 1
    (stream,) = store.state()["applied"]
    store.apply(spark.createDataFrame([("9", {"v": "c"}, 9, False)], kind), 1, stream)  # a batch that is repeated
    assert store.docs().count() == 1
    # another checkpoint reads all again: batches of a stream of its own, and nothing changes
    store.follow(spark.readStream.schema(kind).parquet(str(src)), str(tmp_path / "other")).awaitTermination()
    assert len(store.state()["applied"]) == 2 and [(r["doc_id"], r["key_clock"]) for r in store.docs().collect()] == [("1", 2)]
    # a late write doesn't undo a delete, a later one does
    store.apply(spark.createDataFrame([("2", {"v": "late"}, 2, False), ("7", {"v": "new"}, 1, False)], kind), 0, "third")
    assert sorted(r["doc_id"] for r in store.docs().collect()) == ["1", "7"]
    store.apply(spark.createDataFrame([("2", {"v": "later"}, 4, False)], kind), 1, "third")
    assert sorted(r["doc_id"] for r in store.docs().collect()) == ["1", "2", "7"]


def test_store_merges_its_tables(spark, tmp_path):
    s = sc.parse("s", {"default_field": "v", "analyzer": "whitespace"}, [{"name": "v"}])
    kind = "doc_id string, fields map<string,string>, key_clock bigint, deleted boolean"
    store = Store(spark, str(tmp_path / "store"), s, fanout=3)
    assert store.docs().count() == 0 == store.postings().count()
    for i in range(9):
        store.apply(spark.createDataFrame([(str(i % 4), {"v": f"x{i}"}, i, i % 3 == 2)], kind), i, "a")
        assert len(store.state()["tables"]) <= 3
    assert sorted((r["doc_id"], r["key_clock"]) for r in store.docs().collect()) == [("2", 6), ("3", 7)]


def test_object_hook(spark, tmp_path):
    """Objects of two buckets, one with an extractor of its own, replaced and deleted."""
    s = sc.parse("s", {"default_field": "value", "analyzer": "whitespace"}, [{"name": "*"}])
    kind = "bucket string, key string, content_type string, value binary, key_clock long, deleted boolean"
    rows = [("b", "1", "application/json", b'{"a": "x y", "n": {"m": ["p", "q"]}}', 1, False), ("up", "2", "text/plain", b"shout", 1, None), ("b", "3", "text/plain", b"gone", 1, False), ("b", "3", "text/plain", b"gone", 2, True), ("b", "4", "application/json", b"{}", 1, False), ("b", None, "text/plain", b"x", 1, False)]
    store = Store(spark, str(tmp_path / "store"), s)
    store.apply(ingest.changes(spark.createDataFrame(rows, kind), s, {"up": lambda text, default: [(default, text.upper())]}), 0)
    e = Engine(store.postings(), {"s": s}, store.docs())
    ids = lambda q: sorted(r["doc_id"] for r in e.match("s", q).collect())
    assert ids("a:y") == ids("n_m:q") == ["1"] and ids("SHOUT") == ["2"] and ids("gone") == [] and store.docs().count() == 3


def test_bad_objects_are_named(spark):
    rows = [("1", "application/json", b"{"), ("2", "application/json", b'{"a": 1}')]
    d = spark.createDataFrame(rows, "key string, content_type string, value binary")
    got = {r["doc_id"]: (r["name"], r["value"]) for r in extract.extracted(d, errors=True).collect()}
    assert got["2"] == ("a", "1") and got["1"][0] is None and "JSONDecodeError" in got["1"][1]
    with pytest.raises(Exception, match="can't be read"):
        extract.extracted(d).collect()


def test_updates_of_one_id_and_of_no_fields(spark):
    s = sc.parse("b", {"default_field": "t", "analyzer": "standard"}, [{"name": "id"}, {"name": "t"}])
    e = Engine(spark.createDataFrame([], ix.POSTINGS_KIND), {"b": s})
    field = '<field name="{}">{}</field>'.format
    e = solr.update(e, f"<add><doc>{field('id', 1)}{field('t', 'uno')}</doc><doc>{field('id', 1)}{field('t', 'dos')}</doc><doc>{field('id', 2)}{field('t', 'tres')}</doc></add>", "b")
    assert e.count("b", "uno") == 0 and e.count("b", "dos") == 1 and e.docs.count() == 2
    e = solr.update(e, f"<add><doc>{field('id', 2)}</doc></add>", "b")
    assert e.count("b", "tres") == 0 and e.docs.count() == 2 and e.count("b", "dos") == 1


def test_empty_tables_have_no_postings(spark):
    s = sc.default("x")
    empty = spark.createDataFrame([], "index string, doc_id string, fields map<string,string>")
    assert ix.postings(empty, s).count() == 0 == ix.postings(empty, s, ["a"]).count()
    bare = spark.createDataFrame([("x", "1", {})], empty.schema)
    assert ix.postings(bare, s).count() == 0 and Engine(ix.postings(bare, s), {"x": s}).count("x", "q") == 0


def test_properties_of_results(spark):
    s = sc.parse("p", {"default_field": "v", "analyzer": "whitespace"}, [{"name": "v"}, {"name": "c", "inline": True}])
    e = build(spark, s, [("1", {"v": "a b a", "c": "red"}), ("2", {"v": "b", "c": "blue"})])
    got = {r["doc_id"]: (r["positions"], r["inline"]) for r in e.match("p", "a OR b", props=True).collect()}
    assert got == {"1": ({"v:a": [0, 2], "v:b": [1]}, {"c": ["red"]}), "2": ({"v:b": [0]}, {"c": ["blue"]})}
    assert e.match("p", "(a)", props=True).columns == ["index", "doc_id", "score", "positions", "inline"]


def test_aliases_merge_in_the_documents_order(spark):
    s = sc.parse("p", {"default_field": "v", "analyzer": "whitespace"}, [{"name": "v", "aliases": ["b", "a"]}])
    rows = spark.createDataFrame([("1", 0, "b", "one"), ("1", 1, "a", "two"), ("1", 2, "v", "three"), ("2", 0, "a", "two"), ("2", 1, "b", "one")], extract.FIELDS)
    e = Engine(ix.postings(ix.from_fields(rows, "p"), s), {"p": s})
    assert [r["doc_id"] for r in e.match("p", '"one two three"').collect()] == ["1"] and [r["doc_id"] for r in e.match("p", '"two one"').collect()] == ["2"]


def test_stored_term_counts_give_the_same_scores(spark, tmp_path, hundred):
    ix.save_stats(ix.term_stats(hundred.postings), str(tmp_path / "stats"))
    e = Engine(hundred.postings, hundred.schemas, stats=spark.read.parquet(str(tmp_path / "stats")))
    for q in ("color:red OR acc:AFA OR acc:NONE", "parity:even AND color:[blue TO red]"):
        score = lambda x: {r["doc_id"]: round(r["score"], 12) for r in x.match("test", q, scored=True).collect()}
        assert score(e) == score(hundred)


def test_large_documents_are_named(spark):
    s = sc.parse("p", {"default_field": "v", "analyzer": "whitespace"}, [{"name": "v"}])
    docs = spark.createDataFrame([("p", "1", {"v": "x " * 500}), ("p", "2", {"v": "x"})], "index string, doc_id string, fields map<string,string>")
    assert [r["doc_id"] for r in ix.sizes(ix.postings(docs, s), docs, 1000).collect()] == ["1"]


def test_responses_and_files(spark, tmp_path):
    s = sc.parse("b", {"default_field": "t", "analyzer": "standard"}, [{"name": "id"}, {"name": "t"}])
    e = Engine(spark.createDataFrame([], ix.POSTINGS_KIND), {"b": s})
    (tmp_path / "1.xml").write_text('<add><doc><field name="id">1</field><field name="t">quick fox</field></doc><doc><field name="id">2</field><field name="t">fox</field></doc></add>')
    (tmp_path / "2.xml").write_text("<delete><id>2</id></delete>")
    e = solr.index_files(e, [str(tmp_path)], "b")
    r = json.loads(solr.respond(e, {"q": "fox", "wt": "json"}, "b"))
    assert r["response"]["numFound"] == 1 and r["responseHeader"]["params"]["q"] == "fox" and r["responseHeader"]["QTime"] >= 0
    assert '<str name="q">fox</str>' in solr.respond(e, {"q": "fox"}, "b") and '<int name="QTime">' in solr.respond(e, {"q": "fox"}, "b")
    with pytest.raises(SearchError, match="too_many_results"):
        solr.select(Engine(e.postings, e.schemas, e.docs, most=0), {"q": "fox", "sort": "t asc"}, "b", "global")


def test_saved_postings(spark, tmp_path, hundred):
    ix.save(hundred.postings, str(tmp_path / "p"))
    e = Engine(spark.read.parquet(str(tmp_path / "p")), hundred.schemas)
    assert e.count("test", "color:red AND acc:AFA") == 7
    assert "PartitionFilters: [" in e.match("test", "color:red")._jdf.queryExecution().toString()


def test_terms_are_added_and_taken(spark):
    kind = "index string, field string, term string, doc_id string, positions array<int>, inline map<string,array<string>>, key_clock bigint"
    p = spark.createDataFrame([("i", "f", "t", "1", [0], None, 5), ("i", "f", "t", "2", [0], None, 5)], kind)
    more = spark.createDataFrame([("i", "f", "t", "1", [7], None, 6), ("i", "f", "u", "1", [1], None, 6), ("i", "f", "t", "2", [9], None, 4)], kind)
    p = ix.add_terms(p, more)
    assert sorted((r["term"], r["doc_id"], r["positions"]) for r in p.collect()) == [("t", "1", [7]), ("t", "2", [0]), ("u", "1", [1])]
    gone = spark.createDataFrame([("i", "f", "t", "1", 5), ("i", "f", "u", "1", None), ("i", "f", "t", "2", 5)], "index string, field string, term string, doc_id string, key_clock long")
    assert [(r["term"], r["doc_id"]) for r in ix.without_terms(p, gone).collect()] == [("t", "1")]


def test_command_line(spark, tmp_path, capsys):
    from fathomlex.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("quick fox")
    (tmp_path / "in" / "b.txt").write_text("lazy dog")
    main(["index", str(tmp_path / "ix"), str(tmp_path / "in")])
    main(["search", str(tmp_path / "ix"), "fox"])
    main(["explain", str(tmp_path / "ix"), "fox"])
    out = capsys.readouterr().out
    assert "a.txt" in out and "b.txt" not in out and "TermLeaf" in out
    (tmp_path / "in" / "b.txt").unlink()
    main(["delete", str(tmp_path / "ix"), str(tmp_path / "in")])
    main(["search", str(tmp_path / "ix"), "dog"])
    main(["search", str(tmp_path / "ix"), "fox"])
    out = capsys.readouterr().out
    assert "b.txt" in out and "a.txt" not in out


def test_command_line_of_updates(spark, tmp_path, capsys):
    from fathomlex.__main__ import main

    (tmp_path / "s.json").write_text(json.dumps({"name": "n", "settings": {"default_field": "t", "analyzer": "standard"}, "fields": [{"name": "id"}, {"name": "t"}]}))
    (tmp_path / "u.xml").write_text('<add><doc><field name="id">one</field><field name="t">quick fox</field></doc></add>')
    main(["set-schema", str(tmp_path / "ix"), str(tmp_path / "s.json")])
    main(["solr", str(tmp_path / "ix"), str(tmp_path / "u.xml")])
    main(["solr", str(tmp_path / "ix"), str(tmp_path / "u.xml")])
    main(["search", str(tmp_path / "ix"), "fox"])
    assert capsys.readouterr().out.count("one") == 1
