import math
from collections import Counter

import pytest
from odd import ODD
from pyspark.sql import functions as F

from auditframe.llm import backoff


def reference_scores(texts, order):
    """Stupid backoff with each document's own n-grams taken off the counts."""
    docs = [(t or "").encode().lower().split() for t in texts]
    grams = lambda d, n: [tuple(d[i : i + n]) for i in range(len(d) - n + 1)]
    count = Counter(g for d in docs for n in range(1, order + 1) for g in grams(d, n))
    total = sum(map(len, docs))
    out = []
    for d in docs:
        own = Counter(g for n in range(1, order + 1) for g in grams(d, n))
        s = 0.0
        for i in range(len(d)):
            top = min(order, i + 1)
            for n in range(top, 0, -1):
                g = tuple(d[i - n + 1 : i + 1])
                if count[g] > own[g]:
                    below = count[g[:-1]] - own[g[:-1]] if n > 1 else total - len(d)
                    s += math.log((count[g] - own[g]) / below) + (top - n) * math.log(0.4)
                    break
            else:
                s += -math.log(total - len(d) + 1) + (top - 1) * math.log(0.4)
        out.append((len(d), s))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_are_those_of_the_definition(docs_of, table, order, monkeypatch):
    monkeypatch.setattr(backoff, "PART_GRAMS", 5000)
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 40_000)
    texts = [*ODD[:5], *ODD[7:], "a b a b a", "A B c", "b a", *[r.text for r in table("documents").orderBy("doc_id").limit(120).collect()]]
    got = {r.doc_id: r for r in backoff.score(docs_of(texts).repartition(3), order).collect()}
    for i, (n, s) in enumerate(reference_scores(texts, order)):
        assert got[i].n_words == n and got[i].log_score == pytest.approx(s, abs=1e-6)
        assert got[i].mean_log_score == (pytest.approx(s / n) if n else None)


def test_packing():
    import numpy as np

    for values in ([], [0], [1, 2**63, 2**64 - 1], list(range(1000))):
        a = np.array(values, np.uint64)
        assert (backoff.unpack(backoff.pack(a), len(a)) == a).all()


def test_odd_rows(docs_of):
    docs = docs_of([*ODD, (None, "some words", None, None, None), (None, "some words", None, None, None)]).withColumns({"block": F.lit(1), "ids": F.lit("x")})
    got = backoff.score(docs, 3).collect()
    assert len(got) == len(ODD) + 2
    assert {(r.n_words, r.log_score, r.mean_log_score) for r in got if r.doc_id in (0, 1, 2)} == {(0, 0.0, None)}
    same = [r.log_score for r in got if r.doc_id in (7, 8)]
    assert same[0] == same[1] > next(r.log_score for r in got if r.doc_id == 4)
    assert backoff.score(docs_of([])).count() == 0
    assert backoff.score(docs_of([None, ""])).count() == 2


def test_the_query_scores_with_three_words(spark, table):
    from auditframe.llm.queries import QUERIES

    rows = table("documents").orderBy("doc_id").collect()
    got = {r.doc_id: r.mean_log_score for r in QUERIES["op8_stupid_backoff"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r, (n, s) in zip(rows, reference_scores([r.text for r in rows], 3), strict=True):
        assert got[r.doc_id] == (pytest.approx(s / n, abs=1e-6) if n else None)


def test_blocks_move_once(docs_of):
    """Requests and scores read the same exchange of the blocks."""
    scored = backoff.score(docs_of(["a b c", "b c d"]).repartition(2), 3)
    scored.collect()
    plan = scored._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("MapInArrow _blocks") == 1
