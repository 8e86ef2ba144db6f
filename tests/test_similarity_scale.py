"""Similarity joins: what they move, and blocks of sets against plain loops."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditframe.functions import similarity
from auditframe.functions import text as fx

SPLIT = lambda c: F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda w: w != ""))


def moved(df):
    """Bytes that the exchanges of a collected frame held."""
    def walk(node):
        if "QueryStage" in node.getClass().getSimpleName():
            return walk(node.plan())
        own = node.metrics().get("dataSize") if "ShuffleExchange" in node.getClass().getSimpleName() else None
        inside = node.children()
        return (own.get().value() if own is not None and own.isDefined() else 0) + sum(walk(inside.apply(k)) for k in range(inside.size()))

    return walk(df._jdf.queryExecution().executedPlan().executedPlan())


def test_pairs_that_cannot_reach_the_threshold_do_not_fetch_their_sets(spark):
    rng = random.Random(4)
    pool = [f"w{k}" for k in range(240)]
    texts = [" ".join(rng.sample(pool, 120)) for _ in range(500)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.createDataFrame(list(enumerate(texts[:250])), "aid INT, text STRING")
        right = spark.createDataFrame(list(enumerate(texts[249:])), "cid INT, text STRING")
        df = similarity.best_jaccard(left, right, 0.85, "aid", "cid", SPLIT)
        assert [tuple(r) for r in df.collect()] == [(249, 0, 1.0)]
        # Most of it the pairs that meet by their prefixes; it was 74 MB when each of them fetched both sets.
        assert moved(df) < 40e6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sets_are_written_without_a_row_per_token(spark, monkeypatch):
    plans, real = [], similarity.written
    monkeypatch.setattr(similarity, "written", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, *a))
    frame = spark.createDataFrame([(1, "a b c"), (2, "a b d"), (3, None)], "id INT, text STRING")
    similarity.best_jaccard(frame, frame, 0.5, "id", "id", SPLIT).collect()
    assert plans and not any("explode" in p for p in plans)


@pytest.mark.parametrize("frequent,unpacked,block", [(16, 7, 20), (64, 1024, 8192), (4096, 50, 60)])
def test_blocks_give_the_best_match(spark, monkeypatch, frequent, unpacked, block):
    monkeypatch.setattr(similarity, "FREQUENT", frequent)
    monkeypatch.setattr(similarity, "UNPACKED", unpacked)
    rng = random.Random(block)
    word = lambda: rng.choice("the on er an in re ed nd ha es".split()) + rng.choice(["", "é", "x", "ñ"])
    corpus = [" ".join(word() for _ in range(rng.randrange(0, 40))) for _ in range(120)] + ["same text here", "Same  text here", None, "ab"]
    left = [rng.choice(corpus) for _ in range(60)] + [(rng.choice(corpus) or "")[rng.randrange(9):] + word() for _ in range(120)] + [None, "", "ab", "SAME text here"]
    df = similarity.best_jaccard_blocks(
        spark.createDataFrame(list(enumerate(left)), "aid INT, text STRING"), spark.createDataFrame([(-k, t) for k, t in enumerate(corpus)], "cid INT, text STRING"),
        0.6, "aid", "cid", fx.shingles, block=block,
    )
    got = {r.aid: (r.match, round(r.score, 9)) for r in df.collect()}
    grams = lambda t: {t[k : k + 3] for k in range(len(t) - 2)}
    sets = [(-k, grams(" ".join((t or "").lower().split()))) for k, t in enumerate(corpus)]
    want = {}
    for a, t in enumerate(left):
        own = grams(" ".join((t or "").lower().split()))
        score = lambda s: len(own & s) / len(own | s) if own and s else 0.0  # noqa: E731, B023
        best = min(((-score(s), c) for c, s in sets if score(s) >= 0.6), default=None)
        if best:
            want[a] = (best[1], round(-best[0], 9))
    assert len(want) > 100 and got == want


def test_blocks_without_a_corpus(spark):
    nothing = spark.createDataFrame([], "cid INT, text STRING")
    some = spark.createDataFrame([(1, "some text")], "aid INT, text STRING")
    assert similarity.best_jaccard_blocks(some, nothing, 0.6, "aid", "cid", fx.shingles).collect() == []


def test_vectors_meet_pivots_in_bounded_memory(monkeypatch):
    rng = np.random.default_rng(3)
    pivots = similarity._unit(pd.Series(list(rng.normal(size=(2048, 8)))))
    vectors = pd.Series(list(rng.normal(size=(10000, 8))))
    monkeypatch.setattr(similarity.F, "pandas_udf", lambda f, kind: lambda c: f)
    for step in (similarity._nearest_column(None, pivots), similarity._cells_column(None, pivots, {k: 0.1 for k in range(2048)}, 0.01)):
        tracemalloc.start()
        found = step(vectors)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(found) == 10000 and peak < 60e6
    empty = pd.Series([], dtype=object)
    assert len(similarity._nearest_column(None, pivots)(empty)) == len(similarity._cells_column(None, pivots, {0: 0.1}, 0.1)(empty)) == 0


def test_blocks_are_not_replicated(spark):
    """What a join of blocks shuffles does not grow with the number of blocks of the other side."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("the on er an in re ed nd".split()) for _ in range(40)) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many, few = (similarity.best_jaccard_blocks(frame, frame, 0.6, "id", "id", fx.shingles, block=b) for b in (25, 8192))
        assert {tuple(r)[:2] for r in many.collect()} == {tuple(r)[:2] for r in few.collect()}
        # A match per set and chunk; it was 9.2 MB when each set moved once for each block.
        assert moved(few) < moved(many) < 500_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_are_read_once_for_the_index(spark):
    from auditframe.functions import minhash_index

    _, sets = minhash_index._sets(spark.createDataFrame([(1, "some text"), (2, "")], "id INT, text STRING"), F.col("id"), F.col("text"), fx.shingles)
    assert sets.count() == 1
    assert sets._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_pairs_that_share_a_prefix_do_not_move(spark):
    rng = random.Random(5)
    pool = [f"w{k}" for k in range(240)]
    texts = [" ".join(rng.sample(pool, 120)) for _ in range(500)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = (spark.createDataFrame(list(enumerate(x)), "id INT, text STRING") for x in (texts[:250], texts[249:]))
        df = similarity.best_jaccard(left, right, 0.85, "id", "id", SPLIT)
        assert [tuple(r) for r in df.collect()] == [(249, 0, 1.0)]
        # Nearly all pairs share one of their rarest tokens, and each was a row of a shuffle.
        assert moved(df) < 1e6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_vectors_are_not_repeated_for_open_cells(spark):
    rng = np.random.default_rng(4)
    frame = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=32)]) for k in range(300)], "id INT, embedding ARRAY<DOUBLE>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = similarity.best_cosine(frame, frame, 0.2, "id", "id")
        assert all(r.id == r.match for r in df.collect())
        # No cell closes: each vector moved once for each cell.
        assert moved(df) < 500_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
