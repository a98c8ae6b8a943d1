"""Tables with nulls in any column, empty and long texts, ties, repeated rows and extra columns of clashing names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000


def rows():
    return [
        (1, "one two three four five six seven eight nine ten", "en", "a", 48), (2, "one two three four five six seven eight nine ten", "en", "a", 48), (2, "one two three four five six seven eight nine ten", "en", "a", 48), (3, None, "en", "b", None),
        (4, "", None, None, 0), (None, "no id here at all", "de", "b", 17), (5, LONG, "fr", "c", len(LONG)), (6, "\n\n \t", "fr", "c", 4), (7, "漢字 ünï\n漢字 ünï cödé", "fr", None, None), (8, "one two three four five six seven eight nine eleven", "en", "a", None),
    ]


def docs(spark, more=True):
    df = spark.createDataFrame(rows(), DOCS)
    if more:
        for n in ("h", "s", "part", "blob", "line", "first", "a", "b", "tokens", "key_clock", "_gone", "_leak", "toxic", "quality", "digest", "label"):
            from pyspark.sql import functions as F

            df = df.withColumn(n, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
