"""The stored MinHash index against the exact join."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_similarity_scale import SPLIT, moved

from auditframe.functions import minhash_index as mh
from auditframe.operators import text as t
from auditframe.plans import all_queries
from auditframe.sources import Inputs

SF = "/root/testdata/sf0.01"


def test_recall_on_the_given_texts(spark):
    queries = all_queries()
    exact = {r.artifact_id: (r.item_id, r.field, r.score) for r in queries["tx_ngram_jaccard"](spark, SF).collect()}
    found = {r.artifact_id: (r.item_id, r.field, r.score) for r in queries["tx_ngram_indexed"](spark, SF).collect()}
    assert len(exact) > 50 and sum(found.get(k) == v for k, v in exact.items()) >= 0.9 * len(exact)
    assert all(k in exact and found[k][2] <= exact[k][2] for k in found)


def test_work_is_a_small_share_of_all_pairs(spark, tmp_path):
    i = Inputs(spark, SF)
    t.index_texts(i.corpus, str(tmp_path))
    _, left = mh._sets(i.artifacts, F.col("artifact_id"), F.col("question"), t.tx.shingles)
    right = mh.read_index(spark, str(tmp_path))
    assert mh.candidates(left, right, 0.6).count() < 0.2 * left.count() * right.count()


def test_bins_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(200):
        tokens = rng.integers(-(2**62), 2**62, 150)
        a, b = tokens[:120], tokens[30:]  # 90 of 150 shared
        agree.append((mh._signature(a, 320) == mh._signature(b, 320)).mean())
    assert abs(np.mean(agree) - 0.6) < 0.02
    # A set of one token fills all bins.
    assert len(set(mh._signature(np.array([5]), 64))) == 1


def test_crowded_bands_and_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mh, "CROWDED", 3)
    rng = random.Random(2)
    base = "the quick brown fox jumps over the lazy dog near the river bank today"
    texts = [base[: rng.randint(40, 69)] + rng.choice(["", " again", "!", " soon after"]) for _ in range(60)] + ["something else entirely"]
    frame = lambda rows, name: spark.createDataFrame(list(enumerate(rows)), f"{name} long, question string").withColumn("sql_text", F.lit(None).cast("string"))
    for _ in range(2):
        t.index_texts(frame(texts, "item_id"), str(tmp_path))
    t.index_texts(frame(texts[:1], "item_id").withColumn("item_id", F.lit(900).cast("long")), str(tmp_path), batch="1")
    left = frame([*texts[:20], None, "", "x"], "artifact_id")
    want = {r.artifact_id: r.score for r in t.ngram_matches(left, frame(texts, "item_id")).collect()}
    found = {r.artifact_id: r.score for r in t.ngram_indexed(left, str(tmp_path)).collect()}
    assert len(want) >= 20 and all(found.get(k) == v for k, v in want.items() if v == 1) and set(found) <= set(want)


def test_pairs_do_not_move(spark, tmp_path, monkeypatch):
    # Nearly all pairs share a band and none of them is alone; some bands are crowded.
    monkeypatch.setattr(mh, "CROWDED", 20)
    rng = random.Random(6)
    pool = [f"w{k}" for k in range(150)]
    texts = [" ".join(rng.sample(pool, rng.randint(105, 125))) for _ in range(400)] + [None, "", "w1 w2"]
    left, right = (spark.createDataFrame(list(enumerate(x)), "id INT, text STRING") for x in (texts[:202] + texts[400:], texts[200:]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mh.append_texts(right, str(tmp_path), "0", F.col("id"), F.col("text"), SPLIT)
        df = mh.best_in_index(left, str(tmp_path), 0.6, "id", "text", SPLIT)
        got = {r.id: (r.match, round(r.score, 9)) for r in df.collect()}
        # It was 53 MB when each pair fetched both sets.
        assert moved(df) < 10e6
        rows, sets = mh._sets(left, F.col("id"), F.col("text"), SPLIT)
        index = mh.read_index(spark, str(tmp_path))
        pairs = mh.candidates(sets, index, 0.6).collect()
        own, other = ({r.key: (r.id, set(r.codes)) for r in x.collect()} for x in (sets, index))
        ids = [tuple(r) for r in rows.collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    best = {}
    for p in pairs:
        a, (match, b) = own[p.l][1], other[p.r]
        best[p.l] = min(best.get(p.l, (0, 0)), (-len(a & b) / len(a | b), match))
    want = {i: (best[k][1], round(-best[k][0], 9)) for i, k in ids if k in best and best[k][0] <= -0.6}
    assert len(pairs) > 10000 and len(want) > 190 and got == want
