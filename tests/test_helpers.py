"""The distributed helpers against brute force, with keys and values that hold a large part of all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from auditframe.functions import text as fx
from auditframe.functions.asof import match_last_event
from auditframe.functions.ranking import kth_free, next_time, ntile, number_rows
from auditframe.functions.similarity import best_cosine, best_jaccard
from auditframe.functions.stats import sign_tail


def hot(rng, n, keys):
    return ["hot" if rng.random() < 0.4 else f"k{rng.randrange(keys)}" for _ in range(n)]


def test_number_rows_over_parts(spark):
    rng = random.Random(1)
    rows = [(k, i) for i, k in enumerate(hot(rng, 600, 9))]
    df = spark.createDataFrame(rows, "k STRING, i BIGINT").repartition(5)
    got = {(r["k"], r["i"]): r["rn"] for r in number_rows(df, ["k"], F.floor(F.col("i") / 7), [F.col("i")]).collect()}
    seen = {}
    for k, i in rows:
        seen[k] = seen.get(k, 0) + 1
        assert got[(k, i)] == seen[k]


@pytest.mark.parametrize("n", [1, 7, 10, 23, 400])
def test_ntile_with_heavy_ties(spark, n):
    rng = random.Random(n)
    rows = [(i, 5.0 if rng.random() < 0.4 else float(rng.randrange(40))) for i in range(n)]
    df = spark.createDataFrame(rows, "id BIGINT, v DOUBLE").repartition(4)
    got = {r["id"]: r["tile"] for r in ntile(df, 10, "v", "id").collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    small, extra = divmod(n, 10)
    sizes = [small + (t < extra) for t in range(10)]
    want, pos = {}, 0
    for t, size in enumerate(sizes):
        for _ in range(size):
            want[order[pos][0]] = t + 1
            pos += 1
    assert got == want


def test_next_time(spark):
    rng = random.Random(3)
    rows = [(i, k, rng.randrange(4000)) for i, k in enumerate(hot(rng, 300, 5))]
    events = [(k, rng.randrange(4000)) for k in hot(rng, 60, 7)]
    stamp = "timestamp_seconds({0} * 3600)"
    left = spark.createDataFrame(rows, "id INT, k STRING, h INT").withColumn("t", F.expr(stamp.format("h")))
    right = spark.createDataFrame(events, "k STRING, h INT").select("k", F.expr(stamp.format("h")).alias("e"))
    got = {r["id"]: r["n"] for r in next_time(left, right, "k", "t", "e", 86400 * 10).select("id", F.unix_timestamp("next_time").alias("n")).collect()}
    for i, k, h in rows:
        later = [e for ek, e in events if ek == k and e >= h]
        assert got[i] == (min(later) * 3600 if later else None)


def test_match_last_event(spark):
    rng = random.Random(4)
    rows = [(i, k, rng.randrange(5000)) for i, k in enumerate(hot(rng, 300, 4))]
    events = [(k, rng.randrange(5000), f"c{rng.randrange(5)}") for k in hot(rng, 150, 4)]
    left = spark.createDataFrame(rows, "id INT, k STRING, s INT").withColumn("t", F.timestamp_seconds("s"))
    right = spark.createDataFrame(events, "k STRING, s INT, c STRING").withColumn("e", F.timestamp_seconds("s")).drop("s")
    got = {r["id"]: r["c"] for r in match_last_event(left, right, "k", "t", "e", ["c"], ["c"], 60).collect()}
    want = {}
    for i, k, s in rows:
        near = [(-e, c) for ek, e, c in events if ek == k and s - 60 <= e <= s]
        if near:
            want[i] = min(near)[1]
    assert got == want


def test_match_on_the_edges(spark):
    left = spark.createDataFrame([(1, "a", 600), (2, "a", 601), (3, "b", 5)], "id INT, k STRING, s INT").withColumn("t", F.timestamp_seconds("s"))
    right = spark.createDataFrame([("a", 0, "x"), ("b", 5, "y")], "k STRING, s INT, c STRING").withColumn("e", F.timestamp_seconds("s")).drop("s")
    got = {r["id"]: r["c"] for r in match_last_event(left, right, "k", "t", "e", ["c"], ["c"], 600).collect()}
    assert got == {1: "x", 3: "y"}


def test_kth_free(spark):
    rng = random.Random(5)
    taken = {("a", n) for n in rng.sample(range(1, 30), 12)} | {("b", 2), ("b", 3)}
    rows = [("a", k) for k in range(1, 40)] + [("b", k) for k in range(1, 5)] + [("c", 3)]
    df = kth_free(
        spark.createDataFrame(rows, "key STRING, k INT"), spark.createDataFrame(sorted(taken), "key STRING, n INT"),
        ["key"], "k", "n", "free", start=2,
    )
    got = {(r["key"], r["k"]): r["free"] for r in df.collect()}
    for key, k in rows:
        free = [n for n in range(2, 200) if (key, n) not in taken]
        assert got[(key, k)] == free[k - 1]


def words(rng, n):
    base = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(n)]
    return " ".join(base)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.85])
def test_best_jaccard_is_exact(spark, threshold):
    rng = random.Random(int(threshold * 100))
    corpus = [(i, words(rng, rng.randrange(0, 25))) for i in range(80)]
    texts = [corpus[rng.randrange(80)][1] if rng.random() < 0.4 else words(rng, rng.randrange(0, 25)) for _ in range(150)]
    texts = [t if rng.random() < 0.5 else t + " extra" for t in texts] + [corpus[0][1]] * 60 + [None]
    arts = list(enumerate(texts))
    split = lambda c: F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda w: w != ""))
    df = best_jaccard(
        spark.createDataFrame(arts, "aid INT, text STRING"), spark.createDataFrame(corpus, "cid INT, text STRING"),
        threshold, "aid", "cid", split,
    )
    got = {r["aid"]: (r["match"], round(r["score"], 9)) for r in df.collect()}
    sets = [(c, set(t.split())) for c, t in corpus]
    want = {}
    for a, t in arts:
        mine = set((t or "").split())
        best = min(((-jaccard(mine, s), c) for c, s in sets if jaccard(mine, s) >= threshold), default=None)
        if best:
            want[a] = (best[1], round(-best[0], 9))
    assert got == want


def test_shingle_matches_are_exact(spark):
    rng = random.Random(8)
    corpus = [(i, words(rng, rng.randrange(1, 12))) for i in range(40)]
    arts = [(i, rng.choice(corpus)[1][2:] + rng.choice(["", " w1", "é w2"])) for i in range(60)] + [(99, "ab")]
    df = best_jaccard(
        spark.createDataFrame(arts, "aid INT, text STRING"), spark.createDataFrame(corpus, "cid INT, text STRING"),
        0.6, "aid", "cid", fx.shingles,
    )
    got = {r["aid"]: (r["match"], round(r["score"], 9)) for r in df.collect()}
    grams = lambda t: {t[k : k + 3] for k in range(len(t) - 2)}
    want = {}
    for a, t in arts:
        mine = grams(" ".join(t.lower().split()))
        best = min(((-jaccard(mine, grams(c)), i) for i, c in corpus if jaccard(mine, grams(c)) >= 0.6), default=None)
        if best:
            want[a] = (best[1], round(-best[0], 9))
    assert got == want


def cosine(a, b):
    dot = sum(x * y for x, y in zip(a, b))
    return dot / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b)) if any(a) and any(b) else 0.0


@pytest.mark.parametrize("pivots,block,threshold", [(4, 8, 0.85), (16, 5, 0.95), (64, 4096, 0.5)])
def test_best_cosine_is_exact(spark, pivots, block, threshold):
    rng = random.Random(pivots)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    near = lambda c: [x + rng.gauss(0, 0.25) for x in c]
    corpus = [(i, near(rng.choice(centres))) for i in range(90)] + [(200 + i, centres[0]) for i in range(40)]
    arts = [(i, near(rng.choice(centres))) for i in range(100)] + [(500, centres[0]), (501, [0.0] * 8)]
    df = best_cosine(
        spark.createDataFrame(arts, "aid INT, embedding ARRAY<DOUBLE>"),
        spark.createDataFrame(corpus, "cid INT, embedding ARRAY<DOUBLE>"),
        threshold, "aid", "cid", pivots=pivots, block=block,
    )
    got = {r["aid"]: (r["match"], round(r["score"], 6)) for r in df.collect()}
    want = {}
    for a, v in arts:
        best = min(((-round(cosine(v, c), 9), i) for i, c in corpus if cosine(v, c) >= threshold), default=None)
        if best:
            want[a] = (best[1], round(-best[0], 6))
    assert got == want


def test_best_cosine_without_corpus(spark):
    empty = spark.createDataFrame([], "cid INT, embedding ARRAY<DOUBLE>")
    arts = spark.createDataFrame([(1, [1.0, 0.0])], "aid INT, embedding ARRAY<DOUBLE>")
    assert best_cosine(arts, empty, 0.5, "aid", "cid").collect() == []


def test_sign_tail_is_the_binomial_tail():
    for d in (1, 2, 7, 40, 301):
        for w in range(d + 1):
            exact = sum(math.comb(d, k) for k in range(w, d + 1)) / 2**d
            assert sign_tail(w, d) == pytest.approx(exact, rel=1e-9)
    assert sign_tail(0, 0) == 1.0
    assert 0 < sign_tail(500_500_000, 1_000_000_000) < 1e-200 or sign_tail(500_500_000, 1_000_000_000) >= 0


def test_template_key(spark):
    pairs = [
        ("Revenue in 2025?", "revenue in 2024"),
        ("Sales on 2024-01-02 above 1,000.50 !", "sales on 2023-12-31 above 7"),
        ("  TOP  5 ", "top 9."),
        ("ﬁve Straße 3", "five strasse 4"),
    ]
    df = spark.createDataFrame(pairs, "a STRING, b STRING").select(fx.template_key(F.col("a")).alias("a"), fx.template_key(F.col("b")).alias("b"))
    for r in df.collect():
        assert r["a"] == r["b"]
    different = spark.createDataFrame([("profit/loss", "profit-loss"), ("t1 rows", "t2 rows")], "a STRING, b STRING").select(
        fx.template_key(F.col("a")).alias("a"), fx.template_key(F.col("b")).alias("b")
    )
    assert all(r["a"] != r["b"] for r in different.collect())


def test_fingerprint_ignores_looks(spark):
    same = ["SELECT a  FROM t -- x", "select a from t ;", "/* hi\n */ Select a\nfrom t"]
    df = spark.createDataFrame([(s,) for s in same + ["select b from t", " ; "]], "s STRING").select(fx.statement_fingerprint(F.col("s")).alias("f"))
    prints = [r["f"] for r in df.collect()]
    assert len(set(prints[:3])) == 1 and prints[3] != prints[0] and prints[4] == ""
