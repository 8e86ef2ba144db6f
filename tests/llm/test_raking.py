import random
from collections import Counter

import numpy as np
import pytest
from odd import ODD
from pyspark.sql import functions as F

from auditframe.llm import raking


def cells(spark, seed=0):
    r = random.Random(seed)
    rows = [(s, lang, t, r.randint(1, 10**r.randint(1, 5))) for s in "abcde" for lang in ("en", "de", "") for t in ("t1", "t2") if r.random() < 0.9]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long"), rows


POWERS = {"source": 0.5, "lang": 0.3, "topic": 0.0}


def test_marginals_reach_their_targets(spark):
    frame, rows = cells(spark)
    got = raking.rake(frame, raking.tempered(frame, POWERS), rounds=12).collect()
    total = sum(r.tokens for r in got)
    assert len(got) == len(rows)
    for name, power in POWERS.items():
        base, fitted = Counter(), Counter()
        for r in got:
            base[r[name]] += r.tokens
            fitted[r[name]] += r.tokens * r.weight / total
        scale = sum(v**power for v in base.values())
        assert all(abs(fitted[k] - base[k] ** power / scale) < 1e-2 for k in base)


def test_raking_is_that_of_numpy(spark):
    frame, rows = cells(spark, 3)
    got = {(r.source, r.lang, r.topic): r.weight for r in raking.rake(frame, raking.tempered(frame, POWERS), rounds=2).collect()}
    tokens, weight = np.array([r[3] for r in rows], float), np.ones(len(rows))
    for _ in range(2):
        for i, power in enumerate(POWERS.values()):
            key = np.array([r[i] for r in rows])
            scale = sum(tokens[key == k].sum() ** power for k in set(key))
            for k in set(key):
                at = key == k
                weight[at] *= tokens[at].sum() ** power / scale * tokens.sum() / (tokens * weight)[at].sum()
    assert all(abs(got[r[:3]] - w) < 1e-9 * w for r, w in zip(rows, weight, strict=True))


def test_calibration_expects_the_kept_share(spark):
    frame, _ = cells(spark, 5)
    raked = raking.rake(frame, raking.tempered(frame, POWERS), rounds=2).collect()
    again = spark.createDataFrame(raked)
    total = sum(r.tokens for r in raked)
    for keep in (0.1, 0.5, 0.9):
        factor = raking.calibrate(again, keep, steps=40)
        assert abs(sum(r.tokens * min(1, r.weight * factor) for r in raked) / total - keep) < 1e-6


def test_fitting_goes_on_until_the_marginals_are_met(spark):
    """Sources of nearly one language each converge slowly; a hundred rounds and more are made where they are needed."""
    rows = [(f"s{i}", lang, "t", (10**6 if i == 0 else 1000) if (i % 2 == 0) == (lang == "en") else 3) for i in range(12) for lang in ("en", "de")]
    frame = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = raking.tempered(frame, {"source": 0.2, "lang": 0.1, "topic": 1.0})
    with pytest.warns(UserWarning, match="of its target"):
        raking.rake(frame, targets, rounds=1)
    got = raking.rake(frame, targets, tolerance=1e-3).collect()
    total = sum(r.tokens for r in got)
    for name, shares in targets.items():
        for share in shares.collect():
            assert abs(sum(r.tokens * r.weight for r in got if r[name] == share[name]) / total / share.share - 1) < 1e-2


def test_topic_is_that_of_the_most_frequent_long_word():
    assert raking.topic("Banana banana cherry x")[0] == 4
    assert raking.topic("banana cherry cherry") == (3, raking.topic("cherry")[1])
    assert raking.topic("cherry banana")[1] == raking.topic("banana")[1]
    assert [raking.topic(t) for t in (None, "", "ab cd")] == [(0, "none"), (0, "none"), (2, "none")]


def test_draws_follow_probabilities_and_not_order(spark, docs_of):
    docs = docs_of([(i, "alpha beta gammas" if i % 3 else "deltas eps", "en" if i % 2 else "de", f"s{i % 4}", 1) for i in range(4000)])
    got = raking.mix(docs, POWERS, keep=0.4, rounds=3).collect()
    expected = sum(r.probability for r in got)
    assert abs(sum(r.sampled for r in got) - expected) < 4 * np.sqrt(expected)
    again = raking.mix(docs.repartition(5), POWERS, keep=0.4, rounds=3).collect()
    assert {r.doc_id for r in got if r.sampled} == {r.doc_id for r in again if r.sampled}


def test_odd_rows(docs_of):
    docs = docs_of([*ODD, (None, "some words", None, None, None), (None, None, None, "", None), (1, "again", "en", "s", 1), (1, "again", "en", "s", 1)])
    got = raking.mix(docs.withColumns({"topic": F.lit("old"), "weight": F.lit("old"), "Sampled": F.lit(1)}), POWERS, rounds=2)
    rows = got.collect()
    assert len(rows) == len(ODD) + 4 and all(0 <= r.probability <= 1 for r in rows)
    assert len({r.sampled for r in rows if r.text == "again"}) == 1
    assert raking.mix(docs_of([]), POWERS, rounds=1).count() == 0
    assert raking.mix(docs_of([None, ""]), POWERS, rounds=1).count() == 2
