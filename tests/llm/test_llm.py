import dataclasses
import os
import random
import re
import tracemalloc
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same
from edge import DOCS, LONG, docs, empty, rows
from pyspark.sql import functions as F

from fathomlex.llm import boosting, decontaminate, linededup, ngramjoin, pieces, quality, queries, rules, secrets, substring, tokencounts, toxicity
from fathomlex.llm import automaton as au

SF = "/root/testdata/sf0.001"
WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")


def words(t):
    return WORD.findall(t.lower())


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_agrees_with_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLE[name], SF)


def test_all_ten_are_registered():
    assert sorted(int(m[1]) for n in queries.QUERIES if (m := re.match(r"op(\d+)_", n))) == list(range(1, 11))


# 1
def grams(t, n=2):
    w = words(t)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def random_docs(seed, n=120):
    """Documents with copies, near copies and shared passages from a small vocabulary."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        if out and rnd.random() < 0.5:
            w = rnd.choice(out)[1].split()
            for _ in range(rnd.randrange(4)):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(vocab)
        else:
            w = [rnd.choice(vocab) for _ in range(rnd.randrange(1, 40))]
        out.append((i, " ".join(w)))
    return out


def classes(d, n=2):
    """(doc_id, class_id, n_links) by comparing all pairs."""
    sets = [(i, s) for i, s in sorted({(i, grams(t, n)) for i, t in d}, key=lambda x: x[0]) if s]
    links = [[j for j, (_, b) in enumerate(sets) if j != k and 5 * len(a & b) >= 3 * len(a | b)] for k, (_, a) in enumerate(sets)]
    label = list(range(len(sets)))
    for k in range(len(sets)):  # sets are in the order of their ids: a class is reached from its least one first
        todo = [k]
        while todo:
            x = todo.pop()
            for j in links[x]:
                if label[j] > label[k]:
                    label[j] = label[k]
                    todo.append(j)
    return sorted((i, sets[label[k]][0], len(links[k])) for k, (i, _) in enumerate(sets) if links[k])


def family(rnd, first, m, size, edits):
    """Near copies of one text, some far from it, and some of those alone like others."""
    base = [f"f{rnd.randrange(3000)}" for _ in range(size)]
    out = []
    for i in range(m):
        w = list(base)
        for _ in range(rnd.randrange(edits)):
            w[rnd.randrange(size)] = f"e{rnd.randrange(99999)}"
        out.append((first + i, " ".join(w)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("large", [32, 3])
def test_1_classes_against_brute_force(spark, seed, large, monkeypatch):
    monkeypatch.setattr(ngramjoin, "LARGE", large)
    d = random_docs(seed)
    assert got(ngramjoin.find_classes(spark.createDataFrame(d, "doc_id long, text string"))) == classes(d)


@pytest.mark.parametrize("large", [999, 10])
def test_1_families_against_brute_force(spark, large, monkeypatch):
    monkeypatch.setattr(ngramjoin, "LARGE", large)
    monkeypatch.setattr(ngramjoin, "MEMBERS", 40)
    monkeypatch.setattr(ngramjoin, "VISITORS", 7)
    monkeypatch.setattr(ngramjoin, "FAMILY", 1)
    rnd = random.Random(23)
    d = [*family(rnd, 0, 150, 60, 16), *family(rnd, 200, 90, 40, 3), *family(rnd, 300, 12, 30, 6)]
    # a second family that lies a little way from the first, and copies
    mid = d[0][1].split()
    for i in range(60):
        w = [*mid[:48], *(f"g{k}" for k in range(12))]
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(60)] = f"e{rnd.randrange(99999)}"
        d.append((400 + i, " ".join(w)))
    d += [(500 + i, d[i][1]) for i in range(30)]
    df = spark.createDataFrame(d, "doc_id long, text string")
    assert got(ngramjoin.find_classes(df)) == classes(d)
    if large == 10:
        x = ngramjoin.similar_sets(df, 2, Fraction(3, 5))
        assert x.members.count() > 100 and x.visits.count() > 0


def test_1_balls_are_exact():
    rnd = random.Random(29)
    t = Fraction(3, 5)
    d = [np.array(sorted(rnd.sample(range(80), rnd.randrange(1, 60))), np.uint64) for _ in range(300)]
    near = [np.array(sorted({*d[i % 20].tolist()} ^ {*rnd.sample(range(80), rnd.randrange(12))}), np.uint64) for i in range(200)]
    c = ngramjoin.centres.build(d[:20], t)
    every = [x for x in d + near if len(x)]
    flat, cut = np.concatenate(every), np.r_[0, np.cumsum([len(x) for x in every])]
    s, k, both = c.near(flat, cut)
    kept = []
    for x in d[:20]:
        if not any(2 * len(np.intersect1d(x, y)) >= len(np.union1d(x, y)) for y in kept):
            kept.append(x)
    want = [(i, j, len(np.intersect1d(x, y))) for i, x in enumerate(every) for j, y in enumerate(kept) if 5 * len(np.intersect1d(x, y)) >= 2 * len(np.union1d(x, y))]
    assert list(zip(s.tolist(), k.tolist(), both.tolist())) == want
    ball, _ = c.balls(flat, cut)
    for i, b in enumerate(ball):
        close = [len(np.intersect1d(every[i], y)) / len(np.union1d(every[i], y)) for y in kept]
        assert (b >= 0) == (max(close) >= 0.8) and (b < 0 or close[b] == max(close))


def peak(f):
    """MB that are held at once while ``f`` runs."""
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_1_levels_are_mapped(spark):
    d = random_docs(3)
    levels = ngramjoin._levels(spark.createDataFrame(d, "doc_id long, text string"), 2, 50)
    assert isinstance(levels.bits, np.memmap)
    df = Counter(np.concatenate([np.unique(ngramjoin._sets(pa.array([t]), 2)[0]) for _, t in d]).tolist())
    g = np.array([*df, *range(1, 9)], np.uint64)
    want = [sum(c >= least for least in ngramjoin.COMMON) for c in [*df.values(), *[0] * 8]]
    level = levels.of(*ngramjoin._place(g, 50))
    assert (level >= want).all() and (level == want).mean() > 0.9


def test_1_many_sets_of_one_key_are_met_in_pieces():
    m = 1700
    r = np.zeros(m, ngramjoin._ROW)
    r["k"], r["kind"], r["s"], r["n"], r["most"], r["head"] = 7, 2, np.arange(m) + 10, 12, 12, np.arange(m)
    found, mb = peak(lambda: sum(len(np.atleast_2d(x)) for x in ngramjoin._meet(r, 3, Fraction(3, 5))))
    assert found == m * (m - 1) // 2
    assert mb < 120


def test_1_pieces_have_all_pairs(monkeypatch):
    rnd = np.random.default_rng(5)
    r = np.zeros(600, ngramjoin._ROW)
    r["k"], r["s"], r["kind"], r["n"], r["most"], r["head"] = rnd.integers(0, 9, 600), rnd.integers(0, 90, 600), 2, 12, 12, rnd.integers(0, 1 << 30, 600)
    monkeypatch.setattr(ngramjoin, "SLICE", 50)
    monkeypatch.setattr(ngramjoin, "HELD_PAIRS", 70)
    pieces_ = list(ngramjoin._meet(r, 3, Fraction(3, 5)))
    have = Counter()
    for a, b, _, _, h in np.concatenate(pieces_).tolist():
        have[a, b] += h
    of = defaultdict(set)
    for k, s in zip(r["k"].tolist(), r["s"].tolist()):
        of[k].add(s)
    assert len(pieces_) > 5 and have == Counter((a, b) for x in of.values() for a in x for b in x if a < b)


def test_1_many_centres_are_looked_at_in_slices():
    rnd = np.random.default_rng(9)
    sets = [np.unique(np.r_[np.arange(60), rnd.integers(1000, 1 << 40, 60)]).astype(np.uint64) for _ in range(400)]
    c = ngramjoin.centres.build(sets, Fraction(3, 5))
    assert len(c.size) == 400
    texts = [sets[i % 400] for i in range(300)]
    (s, k, both), mb = peak(lambda: c.near(np.concatenate(texts), np.r_[0, np.cumsum([len(x) for x in texts])]))
    assert set(zip(range(300), range(300))) <= set(zip(s.tolist(), k.tolist()))
    assert mb < 90


def test_1_edges(spark):
    assert got(ngramjoin.find_classes(empty(spark))) == []
    assert got(ngramjoin.find_classes(docs(spark))) == [(1, 1, 2), (2, 1, 2), (8, 1, 2)]
    twice = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (1, "x y z w"), (9, "x y z w"), (9, "x y z w")], "doc_id long, text string")
    assert got(ngramjoin.find_classes(twice)) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (9, 1, 1)]
    left = ngramjoin.one_of_each(docs(spark))
    assert left.columns == docs(spark).columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "3", "4", "5", "6", "7", "None"]
    odd = spark.createDataFrame([(None, "x y"), (None, "x y"), (4, None), (4, None), (5, "q r"), (5, "q r")], "doc_id long, text string")
    assert sorted(map(str, ([r["doc_id"] for r in ngramjoin.one_of_each(odd).collect()]))) == ["4", "4", "5", "None"]


def test_1_groups(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "doc_id long, other_id long")
    assert dict(got(ngramjoin.groups(pairs))) == {**{i: 0 for i in range(21)}, 50: 50, 51: 50}


# 2
def spans(d, b, least=8):
    out = set()
    for i, t in d:
        for j, u in b:
            x, y = words(t), words(u)
            for p in range(len(x)):
                for q in range(len(y)):
                    if x[p] == y[q] and (p == 0 or q == 0 or x[p - 1] != y[q - 1]):
                        n = 0
                        while p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
                            n += 1
                        if n >= least:
                            out.add((i, j, p, q, n))
    return sorted(out)


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_2_spans_against_brute_force(spark, broadcast):
    rnd = random.Random(3)
    vocab = ["a", "b", "c", "d", "é"]
    b = [(j, " ".join(rnd.choice(vocab) for _ in range(20))) for j in range(5)]
    d = [(i, " ".join(rnd.choice(vocab) for _ in range(30)) + " " + " ".join(rnd.choice(b)[1].split()[2 : 2 + rnd.randrange(4, 16)]).upper() + ", x") for i in range(20)]
    found = decontaminate.find_leaks(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(b, "item_id long, text string"), broadcast_bytes=broadcast)
    assert got(found) == spans(d, b)


def test_2_edges(spark):
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine"), (2, None), (None, "x"), (3, "")], "item_id long, text string")
    assert [r[:2] for r in got(decontaminate.find_leaks(docs(spark), bench))] == [(1, 1), (2, 1), (2, 1), (8, 1)]
    assert got(decontaminate.find_leaks(docs(spark), bench.limit(0))) == [] == got(decontaminate.find_leaks(empty(spark), bench))
    kept = decontaminate.decontaminate(docs(spark), bench)
    assert kept.columns == docs(spark).columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "5", "6", "7", "None"]


# 3
TOKENS = ["AKIA" + "A1B2C3D4E5F6G7H8", "ghp_" + "a" * 40, "xoxb-1234567890-abc", "sk_live_" + "x" * 20, "-----BEGIN RSA PRIVATE KEY-----", "password: hunter2hunter2", "PASSWORD=Abc!12345", "api_key = 0123456789abcdef", "https://me:secret@host.example", "AIza" + "b" * 35, "eyJhbGciOi" + "c" * 30]


def test_3_scan_against_re(spark):
    rnd = random.Random(5)
    d = []
    for i in range(60):
        parts = [rnd.choice(["plain", "pass word", "AKIA", "://", "token", "é", "\n"]) for _ in range(rnd.randrange(30))]
        for _ in range(rnd.randrange(3)):
            parts.insert(rnd.randrange(len(parts) + 1), rnd.choice(TOKENS))
        d.append((i, " ".join(parts)))
    d.append((99, "x" * 5000 + " " + TOKENS[0] + " " + "y" * 5000))
    want = sorted((i, n, len(m), " ".join(m)) for i, t in d for n, r in secrets.RULES if (m := [x.group() for x in re.finditer(r, t)]))
    assert got(secrets.scan(spark.createDataFrame(d, "doc_id long, text string"))) == want and len(want) > 20


def test_3_edges(spark):
    assert got(secrets.scan(empty(spark))) == [] == got(secrets.scan(docs(spark)))
    assert len(got(secrets.scan(spark.createDataFrame([(1, TOKENS[0]), (1, TOKENS[0]), (None, TOKENS[0])], "doc_id long, text string")))) == 2


# 4, 5, 8: held-out accuracy
def labelled(spark, column):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return d, lab, {r["doc_id"]: r[column] for r in lab.collect()}


def test_4_accuracy_without_labels(spark):
    d, _, truth = labelled(spark, "quality")
    keep = {r["doc_id"]: r["keep"] for r in quality.classify(d).collect()}
    right = sum(keep[i] == bool(q) for i, q in truth.items()) / len(truth)
    kept = sum(keep[i] for i, q in truth.items() if q) / sum(truth.values())
    assert right >= 0.93 and kept >= 0.95


def test_4_em_finds_accuracies():
    rnd = np.random.default_rng(1)
    truth = rnd.random(20000) < 0.2
    v = np.zeros((len(truth), len(quality.LABELLERS)), np.int64)
    for j in range(v.shape[1] - 1):
        v[:, j] = np.where(rnd.random(len(truth)) < np.where(truth, 0.4, 0.02), 2, 0)
    v[:, -1] = np.where(rnd.random(len(truth)) < np.where(truth, 0.05, 0.9), 1, 0)
    p, n = np.unique(v, axis=0, return_counts=True)
    m = quality.estimate(p, n.astype(float))
    assert abs(m.junk - truth.mean()) < 0.02 and ((m.posterior(v) > 0.5) == truth).mean() > 0.97
    assert abs(m.p[0, 1, 2] - 0.4) < 0.05 and all(0.5 < a <= 1 for _, a in quality.accuracies(m))


def test_4_edges(spark):
    assert quality.classify(empty(spark)).count() == 0
    out = {(r["doc_id"], r["keep"]) for r in quality.classify(docs(spark)).collect()}
    assert quality.classify(docs(spark)).count() == len(rows()) and (3, False) in out and (4, False) in out and (6, False) in out
    assert quality.keep_good(docs(spark)).columns == docs(spark).columns


def test_5_learns_a_planted_rule():
    rnd = np.random.default_rng(2)
    x = rnd.random((4000, len(rules.stats.NAMES)))
    bad = ((x[:, 3] > 0.8) & (x[:, 5] <= 0.5)) | (x[:, 7] > 0.95)
    found = rules.learn(x, bad)
    said = np.zeros(len(x), bool)
    for r in found:
        m = np.ones(len(x), bool)
        for n, op, c in r.conditions:
            v = x[:, rules.stats.NAMES.index(n)]
            m &= (v <= c) if op == "<=" else (v > c)
        said |= m
    assert found and (said == bad).mean() > 0.97


def test_5_held_out_accuracy(spark):
    d, lab, truth = labelled(spark, "quality")
    half = lab.where("doc_id % 2 = 0")
    said = {r["doc_id"]: r["decision"] == "keep" for r in rules.judge(d, half).collect()}
    other = {i: q for i, q in truth.items() if i % 2}
    assert sum(said[i] == bool(q) for i, q in other.items()) / len(other) >= 0.9


def test_5_edges(spark):
    lab = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None), (5, 0)], "doc_id long, quality int")
    out = [(r["doc_id"], r["decision"], r["rule"]) for r in rules.judge(docs(spark), lab).collect()]
    assert len(out) == len(rows()) and (3, "reject", -1) in out and (4, "keep", 0) in out
    assert rules.judge(empty(spark), lab).count() == 0 and rules.judge(docs(spark), lab.limit(0)).where("decision = 'reject'").count() == 1


def test_8_held_out_accuracy(spark):
    d, lab, truth = labelled(spark, "toxic")
    said = {r["doc_id"]: r["toxic"] for r in toxicity.classify(d, lab.where("doc_id % 3 > 0")).collect()}
    other = {i: t for i, t in truth.items() if i % 3 == 0}
    assert sum(said[i] == bool(t) for i, t in other.items()) / len(other) >= 0.95


def test_8_trees_and_isotonic():
    rnd = np.random.default_rng(3)
    x = rnd.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    t = boosting.fit_trees(x[:1500], y[:1500])
    assert ((t.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95
    iso = boosting.fit_isotonic(np.array([1.0, 2, 3, 4]), np.array([0, 1, 0, 1]))
    at = iso(np.linspace(0, 5, 50))
    assert (np.diff(at) >= 0).all() and 0 < at[0] < at[-1] < 1


def test_8_edges(spark):
    lab = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None), (5, 0)], "doc_id long, toxic int")
    out = toxicity.classify(docs(spark), lab).collect()
    assert len(out) == len(rows()) and [r["score"] for r in out if r["doc_id"] == 3] == [None] and toxicity.classify(empty(spark), lab).count() == 0
    assert len({round(r["score"], 9) for r in toxicity.classify(docs(spark), lab.limit(0)).collect() if r["score"] is not None}) == 1


def test_4_em_against_loops():
    rnd = np.random.default_rng(4)
    m = len(quality.LABELLERS)
    patterns = np.unique(np.where(rnd.random((40, m)) < 0.7, 0, rnd.integers(1, 3, (40, m))), axis=0)
    counts = rnd.integers(1, 200, len(patterns)).astype(float)
    got_ = quality.estimate(patterns, counts, rounds=25)
    p = [[[0.985, 0.005, 0.01], [0.69, 0.01, 0.3]] for _ in range(m)]
    p[-1] = [[0.1, 0.89, 0.01], [0.89, 0.1, 0.01]]
    junk = 0.1
    for _ in range(25):
        post = []
        for v in patterns:
            good, bad = 1 - junk, junk
            for j in range(m):
                good, bad = good * p[j][0][v[j]], bad * p[j][1][v[j]]
            post.append(bad / (good + bad))
        new = [[[0.5] * 3, [0.5] * 3] for _ in range(m)]
        for v, n, q in zip(patterns, counts, post):
            for j in range(m):
                new[j][0][v[j]] += n * (1 - q)
                new[j][1][v[j]] += n * q
        p = [[[x / sum(row) for x in row] for row in two] for two in new]
        before, junk = junk, (sum(n * q for n, q in zip(counts, post)) + 1) / (counts.sum() + 2)
        if abs(junk - before) < 1e-10:
            break
    assert abs(got_.junk - junk) < 1e-9 and np.allclose(got_.p, np.array(p), atol=1e-9)


def test_4_scores_against_loops():
    texts = ["Buy NOW!!! a1 a1 a1", "", "The cat sat on the mat.\nThe end", "x" * 50 + " y"]
    w = np.random.default_rng(5).normal(size=quality.BUCKETS + 2)
    x = quality.K.words(pa.array(texts))
    got_ = quality.scores(pa.array(texts), x, w)
    half = quality.BUCKETS // 2
    for i, t in enumerate(texts):
        said = WORD.findall(t.lower())
        h = {u: int(quality.K.words(pa.array([u])).hash[0]) for u in said}
        z = w[-1] + sum(w[h[u] % half] / len(said) for u in said) + sum(w[quality.BUCKETS] / len(said) for a, b in zip(said, said[1:]) if a == b)
        shapes = []
        for s in t.split():
            kinds = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in s]
            shapes.append("".join(c for k, c in enumerate(kinds) if k == 0 or kinds[k - 1] != c))
        for s in shapes:
            b = s.encode()
            hs = int(quality.K.span_hash(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])
            z += w[hs % half + half] / len(shapes)
        assert abs(got_[i] - 1 / (1 + np.exp(z))) < 1e-9


def test_5_list_against_loops():
    rnd = np.random.default_rng(6)
    x = np.round(rnd.random((300, len(rules.stats.NAMES))), 1)
    bad = ((x[:, 2] > 0.7) & (x[:, 4] <= 0.6)) | (x[:, 6] > 0.9)
    bad ^= rnd.random(300) < 0.02

    def covers(row, conditions):
        return all(row[j] <= c if op == "<=" else row[j] > c for j, op, c in conditions)

    def grown(rows):
        conditions, here = [], rows
        while True:
            p, n = sum(b for _, b in here), sum(not b for _, b in here)
            if not p or not n:
                return conditions
            best, pick = 1e-9, None
            for j in range(x.shape[1]):
                v = sorted(r[j] for r, _ in here)
                for c in sorted({v[int(np.floor(q * (len(v) - 1)))] for q in np.linspace(0, 1, rules.CUTS + 1)[1:-1]}):
                    for op in ("<=", ">"):
                        inside = [b for r, b in here if covers(r, [(j, op, c)])]
                        if sum(inside) and (gain := sum(inside) * (np.log2(sum(inside) / len(inside)) - np.log2(p / (p + n)))) > best:
                            best, pick = gain, (j, op, float(c))
            if pick is None:
                return conditions
            conditions.append(pick)
            here = [(r, b) for r, b in here if covers(r, [pick])]

    def worth(rows, conditions):
        inside = [b for r, b in rows if covers(r, conditions)]
        return (2 * sum(inside) - len(inside)) / len(inside) if inside else -1.0

    left = [(i, r, b) for i, (r, b) in enumerate(zip(x, bad.tolist()))]
    want = []
    while any(b for _, _, b in left):
        conditions = grown([(r, b) for i, r, b in left if i % 3 < 2])
        rest = [(r, b) for i, r, b in left if i % 3 == 2]
        while len(conditions) > 1 and worth(rest, conditions[:-1]) >= worth(rest, conditions):
            conditions = conditions[:-1]
        taken = [b for _, r, b in left if covers(r, conditions)]
        right = (sum(taken) + 1) / (len(taken) + 2)
        if not conditions or right < 0.9 or len(taken) < 5:
            break
        want.append((tuple((rules.stats.NAMES[j], op, c) for j, op, c in conditions), right))
        left = [(i, r, b) for i, r, b in left if not covers(r, conditions)]
    found = rules.learn(x, bad)
    assert [(r.conditions, pytest.approx(r.right)) for r in found] == want and want


def test_5_many_rules_are_learned():
    """More rules and more conditions than any fixed small number."""
    x = np.zeros((30 * 60, len(rules.stats.NAMES)))
    x[:, 0] = np.repeat(np.arange(60), 30)
    bad = np.repeat(np.arange(60) % 2 == 1, 30)
    found = rules.learn(x, bad)
    said = np.zeros(len(x), bool)
    for r in found:
        said |= np.logical_and.reduce([(x[:, 0] <= c) if op == "<=" else (x[:, 0] > c) for _, op, c in r.conditions])
    assert len(found) > 24 and (said == bad).mean() > 0.95


def test_8_calibration_against_min_max():
    rnd = np.random.default_rng(7)
    s, y = np.sort(rnd.normal(size=60)), (rnd.random(60) < 0.5).astype(float)
    iso = boosting.fit_isotonic(s, y)
    v = np.r_[0.5, y, 0.5]
    n = len(v)
    mean = lambda a, b: v[a : b + 1].mean()
    want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    assert np.allclose(iso(s), want[1:-1], atol=1e-12)


def test_8_splits_against_loops():
    rnd = np.random.default_rng(8)
    x = np.round(rnd.random((120, 3)), 1)
    y = ((x[:, 1] > 0.4) ^ (rnd.random(120) < 0.1)).astype(float)
    t = boosting.fit_trees(x, y, rounds=2, depth=1, rate=0.5, l2=1.0)
    p0 = (y.sum() + 1) / (len(y) + 2)
    margin = np.full(len(y), np.log(p0 / (1 - p0)))
    for k in range(2):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        best = (1e-6, None)
        for j in range(3):
            for c in sorted(set(x[:, j]))[:-1]:
                low = x[:, j] <= c
                part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
                gain = part(low) + part(~low) - g.sum() ** 2 / (h.sum() + 1)
                if gain > best[0] + 1e-12:
                    best = (gain, (j, c))
        j, c = best[1]
        low = x[:, j] <= c
        value = [-0.5 * g[m].sum() / (h[m].sum() + 1) for m in (low, ~low)]
        assert t.feature[k, 0] == j and abs(t.cut[k, 0] - c) < 1e-12 and np.allclose(t.value[k], value)
        margin = margin + np.where(low, value[0], value[1])
    assert np.allclose(t.margin(x), margin)


def test_8_lexicon_has_no_cap(spark):
    """More entries than the words of any fixed small list."""
    words_ = [f"bad{i}word" for i in range(1800)]
    rows_ = [(i, " ".join(words_)) for i in range(60)] + [(100 + i, "plain words here") for i in range(60)]
    lab = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows_], "doc_id long, toxic int")
    m = toxicity.fit(spark.createDataFrame(rows_, "doc_id long, text string"), lab)
    assert len(m.lexicon.hash) > 1800


# 6
def test_6_counts_against_brute_force(spark):
    count = tokencounts.TOKENIZERS["byte_bpe_50k-1"]()
    want, seen = defaultdict(lambda: [0, 0, 0]), set()
    for i, t, lang, source, _ in sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0)):
        if t is not None and t in seen:
            continue
        seen.add(t)
        w = want[(source, lang)]
        for k, v in enumerate((1, int(count(pa.array([t]))[0]), len(t or ""))):
            w[k] += v
    found = {(r["source"], r["lang"]): [r["docs"], r["tokens"], r["chars"]] for r in tokencounts.maintain(docs(spark)).collect()}
    assert found == dict(want) and tokencounts.maintain(empty(spark)).count() == 0


def test_6_totals_of_all_documents_and_tokenizers(spark, tmp_path):
    docs(spark, more=False).write.parquet(str(tmp_path / "documents.parquet"))
    want = defaultdict(lambda: [0, 0, 0])
    for version, make in tokencounts.TOKENIZERS.items():
        count = make()
        for _, t, lang, source, _ in rows():
            w = want[(source, lang, version)]
            for k, v in enumerate((1, int(count(pa.array([t], pa.string()))[0]), len(t or ""))):
                w[k] += v
    found = {(r["source"], r["lang"], r["tokenizer"]): [r["docs"], r["tokens"], r["chars"]] for r in queries.QUERIES["op6_token_counts"](spark, str(tmp_path)).collect()}
    assert found == dict(want) and tokencounts.totals(empty(spark)).count() == 0


def test_6_batches_are_idempotent_and_merged(spark):
    r = tokencounts.Rollup(spark, fanout=2)
    rows_ = tokencounts.counted(docs(spark), "words-1")
    assert r.commit("a", tokencounts.inserts(rows_)) and not r.commit("a", tokencounts.inserts(rows_))
    first = sorted(map(str, r.totals().collect()))
    for b in "bcd":
        r.commit(b, tokencounts.inserts(rows_))
        r.commit(b + "-", tokencounts.deletes(rows_))
    assert sorted(map(str, r.totals().collect())) == first
    r.commit("z", tokencounts.deletes(rows_))
    assert r.totals().count() == 0 and len(r._state()["deltas"]) <= 3


# 7
@pytest.mark.parametrize("batches", [1, 4])
def test_7_spans_against_brute_force(spark, batches):
    rnd = random.Random(11)
    base = [f"t{rnd.randrange(500)}" for _ in range(400)]
    d = []
    for i in range(30):
        w = [f"u{rnd.randrange(500)}" for _ in range(60)]
        if rnd.random() < 0.7:
            a = rnd.randrange(300)
            w[20:20] = base[a : a + rnd.randrange(40, 100)]
        d.append((i * 3, " ".join(w)))
    first, want = {}, []
    for i, t in d:
        w = words(t)
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    for i, t in d:
        w = words(t)
        hit = [(p, first[tuple(w[p : p + 50])]) for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i]
        run = []
        for p, s in hit:
            if run and run[-1][1] == p - 1:
                run[-1][1], run[-1][2] = p, min(run[-1][2], s)
            else:
                run.append([p, p, s])
        want += [(i, a, b - a + 50, s) for a, b, s in run]
    assert got(substring.find_repeated_spans(spark.createDataFrame(d, "doc_id long, text string"), batches)) == sorted(want) and want


def test_7_edges(spark):
    assert substring.find_repeated_spans(empty(spark)).count() == 0
    assert got(substring.find_repeated_spans(docs(spark))) == []
    copy = spark.createDataFrame([(5, LONG), (9, LONG), (9, LONG)], "doc_id long, text string")
    assert {r[:1] + r[3:] for r in got(substring.find_repeated_spans(copy))} == {(9, 5)}


def test_7_index_refuses_a_batch_twice_and_compacts(spark, tmp_path):
    ix = substring.Index(spark, str(tmp_path / "ix"), fanout=2)
    p = spark.createDataFrame([(1, 1)], "fp long, doc_id long")
    for i in range(6):
        ix.add(str(i), p, 4)
    m = ix.manifest()
    ix.add("0", p, 4)
    assert ix.manifest() == m and len(m["runs"]) < 6 and ix.history(m).count() == 6
    assert sorted(x.name for x in (tmp_path / "ix").iterdir() if x.name.startswith("run")) == sorted(r[1].rsplit("/", 1)[1] for r in m["runs"])
    with pytest.raises(RuntimeError, match="another writer"):
        ix._commit(m)


def test_7_runs_are_joined_where_they_lie(spark, tmp_path):
    """A join with a run exchanges the batch's side alone, and so does none of a merge."""
    ix = substring.Index(spark, str(tmp_path / "ix"))
    ix.add("a", spark.range(1000).selectExpr("id AS fp", "id % 7 AS doc_id"), 8)
    (r,) = ix.manifest()["runs"]
    spark.sql(f"DROP TABLE run_{substring.hashlib.sha1(r[1].encode()).hexdigest()}")  # another session finds it by its path
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.range(500, 2000).selectExpr("id AS fp").join(ix.run(r), "fp", "left_semi")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert j.count() == 500 and plan.count("Exchange") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# 9
@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=os.path.join(pieces.FOLDER, pieces.MODEL))


ODD = ["the quick brown fox", "", " ", "a  b\n\nc\t", "漢字 ﬁ x", "Größe élève mañana", "internationalization " * 3, "thxqzthionshhehe", " " * 50 + "x" + " " * 17, "a" * 300, "http://a.b/c?d=e&f=12345678", "\x00\x01 न म 😀😀"]


def test_9_viterbi_of_a_unigram_model_against_brute_force(vocabulary, library):
    m = library
    score = {m.id_to_piece(i).replace("▁", " "): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
    unknown = min(score.values()) - 10
    v = dataclasses.replace(vocabulary, merges=None, known=pieces.Vocabulary.__dataclass_fields__["known"].default)
    flat, cut = pieces.encode_texts(pa.array(ODD), v)
    for t, a, b in zip(ODD, cut[:-1], cut[1:]):
        s = " " + t if t else ""
        best, back = [0.0] + [-1e300] * len(s), [0] * (len(s) + 1)
        for e in range(1, len(s) + 1):
            for f in range(max(0, e - 40), e):
                x = score.get(s[f:e], unknown if e - f == 1 else None)
                if x is not None and best[f] + x > best[e]:
                    best[e], back[e] = best[f] + x, f
        out, e = [], len(s)
        while e:
            w = s[back[e] : e]
            out = ([m.piece_to_id(w.replace(" ", "▁"))] if w in score else [int(vocabulary.byte_id[c]) for c in w.encode()]) + out
            e = back[e]
        assert flat[a:b].tolist() == out, t
        assert pieces.encode_one(s.encode(), v) == out


def test_9_merges_against_replaying_them(vocabulary):
    rnd = random.Random(31)
    parts = ["a", "b", "ab", "ba", "abb", "aa", "aab", "bab", "c", "abab", "bb", "aaaa", " ", "  ", " a", "cab"]
    walked = 0
    for k in range(200):
        if k % 2:  # made as by training: each of two that are there
            parts = ["a", "b", "c", " "]
            while len(parts) < 16:
                if (w := rnd.choice(parts) + rnd.choice(parts)) not in parts and len(w) < 9:
                    parts.append(w)
        scores = [-float(i) for i in range(len(parts))] if k % 2 else [float(-rnd.randrange(8)) if len(w) > 1 else -99.0 for w in parts]
        v = pieces.vocabulary([(w, s, 256 + i) for i, (w, s) in enumerate(zip(parts, scores))], np.arange(256, dtype=np.int32), [bytes([i]) for i in range(256)] + [w.encode() for w in parts], True)
        rank = {w: -s for w, s in zip(parts, scores)}
        texts = ["".join(rnd.choice("aaabbbc dé") for _ in range(rnd.randrange(14))) for _ in range(60)]
        flat, cut = pieces.encode_texts(pa.array(texts), v)
        walked += v.merges.replay is None
        for t, a, b in zip(texts, cut[:-1], cut[1:]):
            want = [i for w in (pieces.replayed(" " + t, {k: r for k, r in rank.items() if len(k) > 1})[0] if t else []) for i in ([256 + parts.index(w)] if w in parts else w.encode())]
            assert flat[a:b].tolist() == want, (t, scores)
    assert 10 < walked < 200


def test_9_ids_are_those_of_the_library(vocabulary, library):
    import pyarrow.parquet as pq

    rnd = random.Random(37)
    some = ["a", "th", "s", "the", "  ", " ", "    ", "é", "漢", "字", "ing", "X", "9", "00", "\n", "ﬁ", "tion", "\t", "—", "😀", "न"]
    texts = pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist() + ODD + ["".join(rnd.choice(some) for _ in range(rnd.randrange(60))) for _ in range(500)]
    flat, cut = pieces.encode_texts(pa.array(texts), vocabulary)
    assert [flat[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])] == library.encode(texts)
    for t in texts[-500:]:
        assert pieces.encode_one((" " + t).encode() if t else b"", vocabulary) == library.encode(t)


def test_9_remembers_a_bounded_number_of_segments(vocabulary, library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 40)
    v = dataclasses.replace(vocabulary, known=pieces.Vocabulary.__dataclass_fields__["known"].default)
    for i in range(6):
        texts = [f"word{j} some other words and {j * i}" for j in range(0, 30, i + 1)]
        flat, cut = pieces.encode_texts(pa.array(texts), v)
        assert [flat[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])] == library.encode(texts)


def test_9_round_trip(spark, vocabulary):
    d = docs(spark)
    enc = pieces.encode(d)
    assert enc.where("NOT exact").count() == 0 and enc.count() == len(rows())
    back = sorted((str(a), b) for a, b in pieces.decode(enc).collect())
    assert back == sorted((str(r[0]), r[1]) for r in rows())
    assert pieces.encode(empty(spark)).count() == 0
    odd = ["x" * 1000, "é" * 700 + " y", "\x00\x01", "  lead", "trail  ", "▁▁", "▁ 　"]
    f, c = pieces.encode_texts(pa.array(odd), vocabulary)
    assert pieces.decode_ids(f, c, vocabulary).to_pylist() == odd


def test_9_whole_table(spark):
    enc = queries.QUERIES["op9_sentencepiece"](spark, SF)
    assert enc.where("NOT exact OR exact IS NULL").count() == 0 and enc.where("n_ids <> size(ids)").count() == 0


# 10
def repeated_lines(d, t=Fraction(9, 10), least=1):
    lines = [((i, k), frozenset(words(s))) for i, t_ in d for k, s in enumerate(t_.split("\n"))]
    gone = set()
    for pos, s in lines:
        if len(s) >= least and any(q < pos and len(u) >= least and Fraction(len(s & u), len(s | u)) >= t for q, u in lines):
            gone.add(pos)
    return gone


def test_10_lines_against_brute_force(spark):
    rnd = random.Random(13)
    vocab = [f"v{i}" for i in range(30)]
    pool = [[rnd.choice(vocab) for _ in range(rnd.randrange(1, 25))] for _ in range(12)]
    d = []
    for i in range(25):
        lines = []
        for _ in range(rnd.randrange(1, 6)):
            w = list(rnd.choice(pool))
            if rnd.random() < 0.5:
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            lines.append(" ".join(w))
        d.append((i, "\n".join(lines)))
    gone = repeated_lines(d)
    want = sorted((i, "\n".join(s for k, s in enumerate(t.split("\n")) if (i, k) not in gone), sum((i, k) in gone for k in range(t.count("\n") + 1))) for i, t in d)
    assert got(linededup.dedup_lines(spark.createDataFrame(d, "doc_id long, text string"))) == want


def test_10_edges(spark):
    assert linededup.dedup_lines(empty(spark)).count() == 0
    out = linededup.dedup_lines(docs(spark)).collect()
    assert len(out) == len(rows()) and Counter(r["text"] for r in out if r["doc_id"] == 2) == {"": 2} and [r["text"] for r in out if r["doc_id"] is None] == ["no id here at all"]
    left = linededup.without_repeats(docs(spark))
    assert left.columns == docs(spark).columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "3", "4", "5", "6", "7", "8", "None"]


def test_10_copies_with_short_lines_go_whole(spark):
    d = [(1, "Contents\none two three four\nsee also\n--"), (2, "Contents\none two three four\nsee also\n--"), (3, "also see\nContents\nfive six\nfive seven\n\nseven"), (4, "five six\nfive six seven")]
    left = got(linededup.without_repeats(spark.createDataFrame(d, "doc_id long, text string")))
    assert left == [d[0], (3, "five six\nfive seven\n\nseven"), (4, "five six seven")]


def test_10_every_line_against_brute_force(spark):
    rnd = random.Random(17)
    vocab = [f"v{i}" for i in range(14)]
    pool = [" ".join(rnd.choice(vocab) for _ in range(n)) for n in [1, 1, 2, 2, 3, 5, 8, 9, 10, 30, 60] * 3]
    d = [(i, "\n".join(rnd.choice(pool) + rnd.choice(["", "", " v1 v2"]) for _ in range(rnd.randrange(1, 5)))) for i in range(25)]
    gone = repeated_lines(d)
    texts = [(i, "\n".join(s for k, s in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in d]
    assert got(linededup.without_repeats(spark.createDataFrame(d, "doc_id long, text string"))) == [x for x in texts if words(x[1])]


def test_automaton_against_re():
    rnd = random.Random(17)
    for rule in ("ab*c", "(ab|a)c{2,3}", "[a-c]{2}x?", "(?i)abc"):
        dfa = au.compile_rules([au.parse(rule)], False)
        for _ in range(200):
            s = "".join(rnd.choice("abcxA") for _ in range(rnd.randrange(7)))
            ends = [e for e in range(1, len(s) + 1) if re.fullmatch(rule, s[:e])]
            kinds = dfa.byte_class[np.r_[np.frombuffer(s.encode(), np.uint8), np.uint8(au.BREAK)]]
            assert secrets.ends(kinds, np.zeros(1, np.int64), dfa)[0] == (max(ends) if ends else -1), (rule, s)


def test_3_whole_rules_against_re():
    rnd = random.Random(41)
    rules = (("a", r"(AB|CD)[0-9A-D]{5}"), ("b", r"x[ab]{2,4}y"), ("c", r"://[ab]{1,3}:[abc]{2,4}@[a-c]{2,}"), ("d", r"A[AB]{2,}"), ("e", r"(?i)pw[=: ]{0,2}[a-z0-9]{3,}"), ("f", r"aa(bc|b)?"))
    s = secrets.scanner(rules)
    for _ in range(30):
        texts = ["".join(rnd.choice(["AB", "CD", "A", "x", "a", "b", "y", "://", ":", "@", "c", "pw", "=", "9", "é", " "]) for _ in range(rnd.randrange(120))) for _ in range(20)]
        texts[0] = "pw=" + "a" * 700 + "://ab:abc@" + "b" * 3000
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
        for (_, rule), (text, start, end) in zip(rules, secrets.matches(data, offsets, s)):
            found = [(t, data[a:b].tobytes().decode()) for t, a, b in zip(text.tolist(), start.tolist(), end.tolist())]
            assert found == [(i, x.group()) for i, t in enumerate(texts) for x in re.finditer(rule, t)], rule


def test_3_rules_that_need_many_states_are_dealt_to_several_automata():
    s = secrets.scanner()
    assert sorted(r for own, _ in s.joint for r in own) == list(range(len(secrets.RULES))) and 1 < len(s.joint) < 7
    assert all(len(d.next) // d.classes <= secrets.STATES for own, d in s.joint if len(own) > 1)
