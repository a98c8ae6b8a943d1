"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, linededup, ngramjoin, pieces, quality, rules, secrets, substring, tokencounts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+')"

QUERIES["op2_decontamination"] = op2_decontamination
ORACLE["op2_decontamination"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
dg AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
bg AS (SELECT item_id, i - 1 AS q, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM b)),
hit AS (SELECT DISTINCT doc_id, item_id, p, q FROM dg JOIN bg USING (g)),
run AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS r FROM hit)
SELECT doc_id, item_id, CAST(min(p) AS INTEGER) AS doc_word, CAST(min(q) AS INTEGER) AS item_word, CAST(count(*) + 7 AS INTEGER) AS n_words
FROM run GROUP BY doc_id, item_id, p - q, r
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


QUERIES["op10_line_dedup"] = op10_line_dedup
ORACLE["op10_line_dedup"] = rf"""
WITH line AS (SELECT doc_id, text, i - 1 AS line, parts[i] AS s FROM (
    SELECT doc_id, text, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL))),
tok AS (SELECT doc_id, line, list_sort(list_distinct({_WORDS.replace("text", "s")})) AS w FROM line),
occ AS (SELECT doc_id, line, w, (doc_id, line) AS pos FROM tok WHERE len(w) >= 1),
sets AS (SELECT w, min(pos) AS lead, len(w) AS n, row_number() OVER () AS s FROM occ GROUP BY w),
df AS (SELECT t, count(*) AS c FROM (SELECT unnest(w) AS t FROM sets) GROUP BY t),
ranked AS (SELECT s, n, t, row_number() OVER (PARTITION BY s ORDER BY c, t) AS r FROM (SELECT s, n, unnest(w) AS t FROM sets) JOIN df USING (t)),
prefix AS (SELECT s, n, t FROM ranked WHERE r <= n - (9 * n + 9) // 10 + 1),
cand AS (SELECT DISTINCT a.s AS a, b.s AS b FROM prefix a JOIN prefix b ON a.t = b.t AND a.s <> b.s AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n),
near AS (SELECT DISTINCT cand.a AS s FROM cand JOIN sets x ON x.s = cand.a JOIN sets y ON y.s = cand.b
    WHERE y.lead < x.lead AND 10 * len(list_intersect(x.w, y.w)) >= 9 * (x.n + y.n - len(list_intersect(x.w, y.w)))),
gone AS (SELECT doc_id, line FROM occ JOIN sets USING (w) WHERE pos <> lead OR s IN (SELECT s FROM near)),
kept AS (SELECT l.doc_id, string_agg(l.s, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL) AS text, CAST(count(g.line) AS INTEGER) AS n_removed
    FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
SELECT doc_id, coalesce(text, '') AS text, n_removed FROM kept
"""


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.find_classes(table(spark, sf_dir, "documents"))


QUERIES["op1_ngram_jaccard_join"] = op1_ngram_jaccard_join
ORACLE["op1_ngram_jaccard_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM w WHERE len(w) > 0),
sets AS (SELECT g, min(doc_id) AS lead, count(*) AS docs, len(g) AS n, row_number() OVER () AS s FROM g GROUP BY g),
df AS (SELECT t, count(*) AS c FROM (SELECT unnest(g) AS t FROM sets) GROUP BY t),
ranked AS (SELECT s, n, t, row_number() OVER (PARTITION BY s ORDER BY c, t) AS r FROM (SELECT s, n, unnest(g) AS t FROM sets) JOIN df USING (t)),
prefix AS (SELECT s, n, t FROM ranked WHERE r <= n - (3 * n + 4) // 5 + 1),
cand AS (SELECT DISTINCT a.s AS a, b.s AS b FROM prefix a JOIN prefix b ON a.t = b.t AND a.s < b.s AND 5 * a.n >= 3 * b.n AND 5 * b.n >= 3 * a.n),
j AS (SELECT a, b FROM (SELECT a, b, len(list_intersect(x.g, y.g)) AS i, x.n + y.n AS m FROM cand JOIN sets x ON x.s = a JOIN sets y ON y.s = b) WHERE 5 * i >= 3 * (m - i)),
edge AS (SELECT a, b FROM j UNION ALL SELECT b, a FROM j),
reach AS (SELECT s AS a, s AS b FROM sets UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
class AS (SELECT reach.a AS s, min(lead) AS class_id FROM reach JOIN sets ON sets.s = reach.b GROUP BY reach.a),
links AS (SELECT x.s, x.docs - 1 + coalesce(sum(y.docs), 0) AS n_links FROM sets x LEFT JOIN edge ON edge.a = x.s LEFT JOIN sets y ON y.s = edge.b GROUP BY x.s, x.docs)
SELECT doc_id, class_id, CAST(n_links AS BIGINT) AS n_links FROM g JOIN sets USING (g) JOIN class USING (s) JOIN links USING (s) WHERE n_links > 0
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.find_repeated_spans(table(spark, sf_dir, "documents"))


QUERIES["op7_substring_dedup"] = op7_substring_dedup
ORACLE["op7_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i+49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS src FROM win GROUP BY g),
hit AS (SELECT doc_id, p, min(src) AS src FROM win JOIN f USING (g) WHERE src < doc_id GROUP BY doc_id, p),
run AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM hit)
SELECT doc_id, CAST(min(p) AS INTEGER) AS start_word, CAST(count(*) + 49 AS INTEGER) AS n_words, min(src) AS first_doc FROM run GROUP BY doc_id, r
"""


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


QUERIES["op3_secret_scan"] = op3_secret_scan
ORACLE["op3_secret_scan"] = (
    "SELECT doc_id, rule, CAST(len(m) AS INTEGER) AS n_matches, array_to_string(m, ' ') AS secrets FROM ("
    + " UNION ALL ".join("SELECT doc_id, '{}' AS rule, regexp_extract_all(text, '{}') AS m FROM documents WHERE doc_id IS NOT NULL".format(n, r.replace("'", "''")) for n, r in secrets.RULES)
    + ") WHERE len(m) > 0"
)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


QUERIES["op4_quality_classifier"] = op4_quality_classifier


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES |= {"op5_quality_rules": op5_quality_rules, "op8_toxicity": op8_toxicity}


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


QUERIES["op9_sentencepiece"] = op9_sentencepiece


def sentencepiece_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ids of all documents spell."""
    return pieces.decode(pieces.encode(table(spark, sf_dir, "documents")))


QUERIES["sentencepiece_decode"] = sentencepiece_decode
ORACLE["sentencepiece_decode"] = "SELECT doc_id, text FROM documents"


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.totals(table(spark, sf_dir, "documents"))


QUERIES["op6_token_counts"] = op6_token_counts


def token_counts_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the tokenizer that SQL knows too."""
    return tokencounts.totals(table(spark, sf_dir, "documents"), ("words-1",))


QUERIES["token_counts_of_words"] = token_counts_of_words
ORACLE["token_counts_of_words"] = f"""SELECT source, lang, 'words-1' AS tokenizer, count(*) AS docs, CAST(sum(coalesce(len({_WORDS}), 0)) AS BIGINT) AS tokens, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars
FROM documents GROUP BY source, lang"""
