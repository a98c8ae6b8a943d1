from edge import docs, empty

import corpus_pipeline as cp
from fathomlex.llm import decontaminate, quality

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    columns = d.columns
    now = d
    for name, stage in cp.STAGES[:-1]:
        before = now.count()
        now = stage(spark, now, SF)
        assert now.columns == columns, name
        now = spark.createDataFrame(now.collect(), d.schema)
        assert 0 < now.count() <= before
    assert decontaminate.find_leaks(now, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    good = {r["doc_id"] for r in quality.classify(d).where("keep").collect()}
    assert {r["doc_id"] for r in now.collect()} <= good
    last = cp.STAGES[-1][1](spark, now, SF)
    assert last.where("exact").count() == now.count()
    assert sorted(r["doc_id"] for r in cp.run(spark, SF).collect()) == sorted(r["doc_id"] for r in now.collect())


def test_stages_take_odd_and_empty_tables(spark):
    for name, stage in cp.STAGES:
        stage(spark, docs(spark), SF).collect()
        assert stage(spark, empty(spark), SF).count() == 0, name


def test_stages_against_brute_force(spark):
    """Every stage on what the one before kept, against comparing everything with everything."""
    import random

    from test_llm import classes, repeated_lines, spans, words

    rnd = random.Random(43)
    vocab = [f"w{i}" for i in range(900)]
    passage = [rnd.choice(vocab) for _ in range(30)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    lines = [prose(rnd.randrange(1, 12)) for _ in range(15)]
    texts = []
    for i in range(90):
        t = "\n".join([prose(rnd.randrange(8, 40)) for _ in range(rnd.randrange(1, 4))] + rnd.sample(lines, rnd.randrange(3)))
        if i % 5 == 0 and texts:  # near copies
            w = rnd.choice(texts).split(" ")
            for k in range(0, len(w), 13):
                w[min(len(w) - 1, k + rnd.randrange(13))] = f"changed{rnd.randrange(999)}"
            t = " ".join(w)
        if i % 9 == 0:
            t += " " + " ".join(passage[rnd.randrange(10) :])
        texts.append(t)
    texts += texts[:6] + [lines[0], "", None]
    d = spark.createDataFrame([(3 * i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, texts[1], "en", "s", 1), (None, None, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    bench = [(1, " ".join(passage)), (2, prose(20))]

    from fathomlex.llm import common, linededup, ngramjoin, pieces

    keyed = lambda df: sorted((r["k"], r["text"]) for r in df.select(common.row_key(df).alias("k"), "text").collect() if r["k"] is not None)
    now = keyed(d)
    kept = spark.createDataFrame(linededup.without_repeats(d).collect(), d.schema)
    gone = repeated_lines(now)
    now = [(i, "\n".join(s for k, s in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in now]
    now = [(i, t) for (i, t), (_, old) in zip(now, keyed(d)) if words(t) or not words(old)]
    assert sorted(t for _, t in keyed(kept)) == sorted(t for _, t in now)
    now = keyed(kept)  # rows without id have another key when their text is another
    kept = spark.createDataFrame(ngramjoin.one_of_each(kept).collect(), d.schema)
    other = {i for i, c, _ in classes(now) if i != c}
    now = sorted({x for x in now if x[0] not in other})
    assert keyed(kept) == now and len(other) > 5
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    kept = spark.createDataFrame(decontaminate.decontaminate(kept, benchmark).collect(), d.schema)
    bad = {s[0] for s in spans(now, bench)}
    now = [x for x in now if x[0] not in bad]
    assert keyed(kept) == now and len(bad) > 3
    import os

    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=os.path.join(pieces.FOLDER, pieces.MODEL))
    got = sorted((r["ids"] for r in cp.encoded(spark, kept, SF).collect() if r["ids"] is not None))
    assert got == sorted(m.encode([t for _, t in now]))


def test_odd_rows_have_defined_results(spark):
    """Nulls, empty and long texts, copies: what each stage leaves of them."""
    left = {name: sorted(str(r["doc_id"]) for r in stage(spark, docs(spark), SF).collect()) for name, stage in cp.STAGES}
    assert left["lines"] == ["1", "3", "4", "5", "6", "7", "8", "None"]
    assert left["near_duplicates"] == ["1", "3", "4", "5", "6", "7", "None"]
    assert len(left["decontamination"]) == len(left["sentencepiece"]) == 10
    assert not {"3", "4", "6"} & set(left["quality"])
