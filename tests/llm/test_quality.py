"""Statistics, decision list and additive model."""

import re
from collections import Counter

import numpy as np
import pandas as pd
from odd import ODD
from pyspark.sql import functions as F

from auditframe.llm import gam, rules, statistics
from auditframe.llm.queries import QUERIES


def test_columns_with_dots_in_their_names(docs_of):
    docs = docs_of(["some words here", None]).withColumns({"a.b": F.lit(1), "_key": F.lit(2), "c d": F.lit(3)})
    labels = docs.selectExpr("doc_id", "1 AS quality")
    for got in (rules.judge(docs, []).collect(), gam.score(docs, gam.learn(docs, labels)).collect()):
        assert [(r["a.b"], r["_key"], r["c d"]) for r in got] == [(1, 2, 3)] * 2

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reference_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words from their definitions."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_counts_are_their_definitions(table):
    texts = [*ODD, "a b c a b c", "a a a a", "x\nx\n\ny\nx ", "a b   c\x1c d", "# | <b> &", "a b c d a b c x d a b", *[r.text for r in table("documents").collect()]]
    for t in texts:
        assert statistics.counts(t)[:5] == reference_counts(t), (t or "")[:50]


def test_counts_keep_rows_and_columns(docs_of):
    docs = docs_of([*ODD, (None, None, None, None, None)])
    got = statistics.text_counts(docs, "text", ["doc_id", "source"])
    assert got.count() == len(ODD) + 1 and got.columns == ["doc_id", "source", *statistics.COUNTS]


def frame(n=900, seed=0):
    """Rows whose label follows two rules and is random elsewhere in no way."""
    rng = np.random.default_rng(seed)
    t = pd.DataFrame({name: rng.random(n) for name in rules.STATISTICS})
    bad = ((t.symbols > 0.7) & (t.words <= 0.6)) | (t.upper > 0.9)
    return t, bad.to_numpy()


def test_learnt_rules_find_planted_ones():
    table, bad = frame()
    learnt = rules.learn_rules(table, bad)
    fresh, truth = frame(seed=1)
    found = np.logical_or.reduce([rules.covers(r, fresh) for r in learnt])
    assert (found == truth).mean() > 0.95
    assert {c.statistic for r in learnt for c in r} >= {"symbols", "upper"}


def test_no_rule_without_evidence():
    table, bad = frame()
    assert rules.learn_rules(table, np.zeros(len(table), bool)) == []
    noise = np.random.default_rng(4).random(len(table)) < 0.3
    assert rules.learn_rules(table, noise) == []
    assert rules.learn_rules(table.iloc[:0], bad[:0]) == []


def test_the_spark_expression_is_the_list(spark, table):
    docs = table("documents")
    learnt = [(rules.Condition("upper", True, 0.3),), (rules.Condition("same_word", True, 0.2), rules.Condition("words", True, 60.0)), (rules.Condition("symbols", True, 0.25),)]
    statistic = [F.expr(sql).cast("double").alias(name) for name, sql in rules.STATISTICS.items()]
    counted = statistics.text_counts(docs, "text", ["doc_id"])
    values = counted.select("doc_id", *statistic).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = [next((i for i, r in enumerate(learnt, 1) if rules.covers(r, values.iloc[[k]])[0]), None) for k in range(len(values))]
    got = rules.judge(docs, learnt).orderBy("doc_id").collect()
    assert [r.rule for r in got] == want and len(set(want)) > 2
    assert all(r.kept == (not r.base_failed and r.rule is None) for r in got)


def test_judge_takes_odd_rows(docs_of):
    docs = docs_of(ODD).withColumns({"rule": F.lit("old"), "Kept": F.lit("old"), "n_words": F.lit(-1)})
    got = rules.judge(docs, [])
    assert sum(c.lower() == "kept" for c in got.columns) == 1
    assert {r.base_failed for r in got.filter("doc_id < 5").collect()} == {True}
    assert rules.judge(docs_of([]), []).count() == 0


def test_decision_list_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op5_decision_list"](spark, sf).collect()}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(got) == set(text)
    for i, r in got.items():
        want = reference_counts(text[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)
    held = [x for x in spark.read.parquet(f"{sf}/labels.parquet").collect() if not got[x.doc_id].base_failed and __import__("zlib").crc32(str(x.doc_id).encode()) % 5 == 0]
    assert np.mean([got[x.doc_id].kept == bool(x.quality) for x in held]) > 0.95


def additive_truth(x):
    return ((np.sin(4 * x[:, 0]) + 2 * (x[:, 1] > 0.5) + 3 * ((x[:, 2] > 0.5) ^ (x[:, 3] > 0.5))) > 2.6).astype(float)


def test_the_model_learns_shapes_and_a_pair():
    rng = np.random.default_rng(0)
    x, fresh = rng.random((4000, 5)), rng.random((2000, 5))
    model = gam.fit(x, additive_truth(x))
    assert (2, 3) in model.pairs
    assert ((model.score(fresh) > 0.5) == additive_truth(fresh)).mean() > 0.93
    main = gam.fit(x, additive_truth(x), pairs=0)
    assert ((main.score(fresh) > 0.5) == additive_truth(fresh)).mean() < 0.9


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.random((500, 4))
    model = gam.fit(x, additive_truth(x), rounds=20, pair_rounds=5)
    for row, got in zip(x[:20], model.score(x[:20]), strict=True):
        total = model.intercept + sum(t[np.sum(e <= v)] for e, t, v in zip(model.edges, model.tables, row, strict=True))
        total += sum(t[np.sum(model.coarse[f] <= row[f]), np.sum(model.coarse[g] <= row[g])] for (f, g), t in model.pairs.items())
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-9


def test_model_without_labels_is_constant(docs_of, spark):
    labels = spark.createDataFrame([(0, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = gam.learn(docs_of(ODD), labels)
    got = gam.score(docs_of(ODD).withColumn("score", F.lit("old")), model)
    assert {r.score for r in got.collect()} == {0.5} and got.count() == len(ODD)
    assert gam.score(docs_of([]), model).count() == 0
    again = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0.5 < r.score < 1 for r in gam.score(docs_of(ODD), gam.learn(docs_of(ODD), again)).collect())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op6_additive_model"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [x for x in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[x.doc_id].held_out]
    assert len(held) > 50 and np.mean([got[x.doc_id].predicted == x.quality for x in held]) > 0.95
